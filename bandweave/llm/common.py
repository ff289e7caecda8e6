"""Shared kernels: reading tables, cutting lineage, and hashing the words of Arrow batches in numpy.

Word hashes are 64-bit polynomial hashes finished by a mixer. They are computed for a whole block of texts at once, so the
cost is a few vector passes over the bytes and no Python loop over words.
"""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts into which the rows of any key are dealt where one key may have a large share of all rows.
SALTS = 64
#: Bytes of text that the numpy kernels work on at once; longer single texts are worked on alone.
BLOCK_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SHINGLE = 0xD6E8FEB86659FD93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 10_000) -> None:
    """Arrow batches of bounded size, so that a batch of long texts stays far below a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder that the cluster names (spark.checkpoint.dir).

    A folder of this machine is taken only by a local session that names none; a cluster without one gets an error. The shuffles
    that led to the checkpoint are no longer needed; Spark deletes them when the driver has collected what referred to them.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "bandweave-checkpoints"))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    sc._jvm.System.gc()
    return out


def spread_join(rows: DataFrame, values: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """rows joined with values (at most one row for each of the keys), where a key may have any share of the rows.

    The rows of a key are dealt into SALTS parts by the columns `by`; the parts that occur, at most SALTS rows for a key, meet the
    values first, and the rows then meet their own part."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    parts = rows.select(*keys, "_salt").distinct().join(values, keys, how)
    return rows.join(parts, [*keys, "_salt"], how).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing mixer of the splitmix generator, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(20, (n - 1).bit_length())
            inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
            for name, m in (("up", _MULT), ("down", inverse)):
                steps = np.full(size, m, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))
        return cls.up, cls.down


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one uint8 array and its offsets (nulls are empty texts)."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a piece has about `most` bytes of text or is a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.names.index(text))
        _, offsets = bytes_of(column)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of bytes other than space and \\t..\\r) of a block, and the word offsets of its texts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # no word crosses from one text to the next
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    end = np.flatnonzero(ends) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    up, down = _Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, and their offsets. A text of fewer words has one shingle of all its words;
    a text without words has none."""
    n = np.diff(offsets)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_offsets = np.zeros(len(offsets), np.int64)
    np.cumsum(counts, out=out_offsets[1:])
    rolled = np.zeros(total, np.uint64)
    for j in range(width):
        rolled[: max(0, total - j)] += words[j:] * np.uint64(pow(_SHINGLE, j, 1 << 64))
    owner = np.repeat(np.arange(len(n)), counts)
    at = np.arange(out_offsets[-1]) - out_offsets[owner] + offsets[owner]
    got = rolled[at]
    for d in np.flatnonzero((n > 0) & (n < width)):
        own = enumerate(words[offsets[d] : offsets[d + 1]].tolist())
        got[out_offsets[d]] = (int(n[d]) + sum(w * pow(_SHINGLE, j, 1 << 64) for j, w in own)) % (1 << 64)
    return mix64(got), out_offsets
