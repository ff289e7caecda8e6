"""Pairs of rows, block against block.

Both sides are dealt into blocks of a bounded number of rows by a hash of their id. Each pair of blocks is one row of two
arrays, and a numpy function works on it. A task holds a few blocks however large the tables are, no block is hot, and only
what the function returns (a top-k, or scores) leaves the task. Each side is shuffled once, a partition for each block; a task
reads the blocks of its pairs from there, so disk does not grow with the number of blocks. With keys (`on`), a row is sent once
for each block of the other side. Blocks are as large as a task may hold, and no more are made than keep a cluster busy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 16_384
#: Values in the arrays of a block, 8 bytes each: long rows make shorter blocks.
VALUES = 2_000_000
#: Blocks of SMALL rows and more are made until there are BUSY x BUSY pairs of them, that all cores get some.
SMALL, BUSY = 512, 7
#: Tasks that pairs of blocks are dealt into at most, and right blocks that a task takes one after another where their results are merged.
TASKS, MERGED = 1_000, 2

#: What a function of two blocks gets: for each side the column values (numpy for numbers and arrays of one length, lists otherwise) by name.
Side = dict[str, np.ndarray | list]


def _sizes(df: DataFrame, on: list[str], block: int) -> tuple[int, int]:
    """The number of rows that are dealt into blocks, and the rows that a block may have."""
    if on:  # the rows of a key are dealt among the blocks, so the largest key counts
        n, *sizes = df.groupBy(*on).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()
    else:
        n, *sizes = df.agg(F.count("*"), *[F.coalesce(F.max(F.size(c)), F.lit(0)) for c, kind in df.dtypes if kind.startswith("array")]).first()
    return n, max(1, min(block, VALUES // max(1, sum(sizes))))


def _grid(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """The blocks of both sides that keep a cluster busy and send the fewest rows: a few queries go to many blocks of objects."""
    (n, fits), (m, wide) = left, right
    least = max(1, -(-n // fits)), max(1, -(-m // wide))
    most = max(least[0], min(BUSY * BUSY, -(-n // SMALL))), max(least[1], min(BUSY * BUSY, -(-m // SMALL)))
    pairs = min(BUSY, -(-n // SMALL)) * min(BUSY, -(-m // SMALL))
    choices = [(i, max(least[1], min(most[1], -(-pairs // i)))) for i in range(least[0], most[0] + 1)]
    return min((c for c in choices if c[0] * c[1] >= pairs), key=lambda c: (n * c[1] + m * c[0], c))


def _dealt(df: DataFrame, key: str, on: list[str], blocks: int) -> DataFrame:
    payload = [c for c in df.columns if c not in on]
    dealt = df.withColumn("slot", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    if not on:
        dealt = dealt.repartitionById(blocks, "slot")  # a partition for each block
    return dealt.groupBy(*on, "slot").agg(F.collect_list(F.struct(*payload)).alias("rows"))


def _side(cell: pa.Scalar) -> Side:
    values = cell.values
    out: Side = {}
    for field, column in zip(values.type, values.flatten()):
        kind = field.type.value_type if pa.types.is_list(field.type) else field.type
        plain = pa.types.is_integer(kind) or pa.types.is_floating(kind)
        if not plain:
            out[field.name] = column.to_pylist()
        elif kind is field.type:
            out[field.name] = column.to_numpy(zero_copy_only=False)
        else:
            sizes = np.diff(column.offsets.to_numpy())
            same = len(sizes) > 0 and column.null_count == 0 and bool((sizes == sizes[0]).all())
            out[field.name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), sizes[0]) if same else column.to_pylist()
    return out


def block_pairs(left: DataFrame, right: DataFrame, key: str, fn: Callable[[Side, Side], dict | Iterable[dict]], schema: str, on: list[str] | None = None, block: int = BLOCK, upper: bool = False, *, merge: Callable[[list[dict]], dict] | None = None) -> DataFrame:
    """fn(left block, right block) for every pair of blocks with equal `on` columns, as rows of `schema`.

    fn returns columns (arrays of numpy or Arrow) by name, or yields them piece by piece where a pair of blocks gives many rows; the `on` columns are added
    in front of them. With upper, both sides are the same table, and each pair of blocks is met once, as (a, b) with a <= b by
    slot; fn must then return pairs in both orders or handle it. merge makes one of what fn returned for a left block and several
    right blocks, which then leaves the task in place of them.
    """
    on = on or []
    rows, fits = _sizes(left, on, block)
    n_left, n_right = _grid((rows, fits), (rows, fits) if upper else _sizes(right, on, block))
    if upper:
        n_left = n_right = max(n_left, n_right)
    if on:
        a, b = _dealt(left, key, on, n_left), _dealt(right, key, on, n_right)
        a = a.withColumnRenamed("rows", "x").withColumn("j", F.explode(F.sequence(F.col("slot") if upper else F.lit(0), F.lit(n_right - 1)))).withColumnRenamed("slot", "i")
        lower = F.sequence(F.lit(0), F.col("slot")) if upper else F.sequence(F.lit(0), F.lit(n_left - 1))
        b = b.withColumnRenamed("rows", "y").withColumn("i", F.explode(lower)).withColumnRenamed("slot", "j")
        cells = a.join(b, [*on, "i", "j"])
    else:
        parts = n_right
        if merge is not None:  # right blocks are merged in a task, and left ones are made smaller for it
            parts = -(-n_right // MERGED)
            n_left = max(n_left, min(-(-rows // SMALL), -(-n_left * n_right // parts)))
        parts = min(parts, max(1, TASKS // n_left))
        a = _dealt(left, key, on, n_left)
        b = (a if upper else _dealt(right, key, on, n_right)).select(F.col("slot").alias("j"), F.col("rows").alias("y"))
        a = a.select(F.col("slot").alias("i"), F.col("rows").alias("x"))
        # no side is sent again: each task reads its partitions of both
        b = (b if parts == n_right else b.coalesce(parts)).hint("shuffle_replicate_nl")
        cells = b.join(a, F.col("i") <= F.col("j")) if upper else b.crossJoin(a)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches):
        held: dict[int, dict] = {}  # of each left block, what its right blocks so far have given
        for batch in batches:
            places = {n: batch.schema.names.index(n) for n in ("x", "y", "i", "j")}
            for k in range(batch.num_rows):
                made = fn(_side(batch.column(places["x"])[k]), _side(batch.column(places["y"])[k]))
                if merge is not None:
                    i = batch.column(places["i"])[k].as_py()
                    made = [*([held[i]] if i in held else []), *([made] if isinstance(made, dict) else made)]
                    if made:
                        held[i] = merge(made)
                    continue
                for got in [made] if isinstance(made, dict) else made:
                    size = len(next(iter(got.values())))
                    if size:
                        fixed = [pa.array([batch.column(batch.schema.names.index(c))[k].as_py()] * size) for c in on]
                        yield pa.RecordBatch.from_arrays([*fixed, *(got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n in names)], [*on, *names])
        for got in held.values():
            if len(got[names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(got[n]) for n in names], names)

    prefix = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in left.schema if f.name in on)
    return cells.mapInArrow(run, prefix + schema)
