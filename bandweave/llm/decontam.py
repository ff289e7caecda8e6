"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

Items are grouped by the size of their shingle set into classes [u/2, u). For a class, a document is cut into windows of 2u
shingles that start every u, so any run as long as an item of the class lies wholly inside one window, and the containment
threshold becomes a resemblance that MinHash can see however long the document is: 0.75 * q shared shingles in a window of
2u, with q >= u/2, is a resemblance of at least 0.17. An item whose shingles lie scattered over several windows loses
nothing: the chances of its windows add up. Each of 96 minima is a band of its own, so an item at the threshold is missed
with probability (1 - 0.17)**96 < 2e-8. A hit only makes a candidate: the item counts if at least 75 % of its shingles are in
the document's full shingle set.

The items are the query set. They are taken in blocks of a bounded number and size, and each block is sent to all tasks and meets
every document where it lies: documents are never shuffled, and no document's size or popularity loads a single task. Where
there are several blocks, the result of one is written down before the next is read, so the driver holds one index at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bytes_of, cut, mix64, shingle_hashes, small_batches, word_hashes

WIDTH, PERCENT, MINIMA = 5, 75, 96
#: Items, and bytes of their texts, that are sent to the tasks at once; further items are searched in further blocks.
ITEMS, ITEM_BYTES = 20_000, 32 << 20
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long"


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(101, 101 + 2 * MINIMA, dtype=np.uint64))
    a, b = seeds[::2], seeds[1::2]
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (b >> np.uint64(32)).astype(np.uint32)


def _shingles(texts: list[str]) -> list[np.ndarray]:
    data, offsets = bytes_of(pa.array(texts, pa.large_string()))
    shingles, at = shingle_hashes(*word_hashes(data, offsets), WIDTH)
    return [np.unique(shingles[i:j]) for i, j in zip(at[:-1], at[1:])]


class Index:
    """The minima of a block of items by size class, and their full sets."""

    def __init__(self, items: list[tuple[int, str]]):
        self.sets = [(i, s) for (i, _), s in zip(items, _shingles([t for _, t in items])) if len(s)]
        a, b = _coefficients()
        by_class: dict[int, list[int]] = {}
        for k, (_, s) in enumerate(self.sets):
            by_class.setdefault(1 << len(s).bit_length(), []).append(k)
        self.classes = []
        for upper, members in sorted(by_class.items()):
            starts = np.cumsum([0] + [len(self.sets[k][1]) for k in members])[:-1]
            x = (np.concatenate([self.sets[k][1] for k in members]) >> np.uint64(32)).astype(np.uint32)
            bands = []
            for j in range(MINIMA):
                least = np.minimum.reduceat(x * a[j] + b[j], starts)
                order = np.argsort(least, kind="stable")
                bands.append((least[order], np.array(members)[order]))
            self.classes.append((upper, bands))

    def candidates(self, shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Pairs (text, item) of a block of texts, as an array of two columns."""
        a, b = _coefficients()
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        found = []
        for upper, bands in self.classes:
            half = np.concatenate([np.arange(i, j, upper) for i, j in zip(at[:-1], at[1:])])
            owner = np.searchsorted(at, half, "right") - 1
            # the minimum of a window is that of its two halves; a text's last half is a window of its own
            joined = np.flatnonzero(owner[1:] == owner[:-1])
            for j, (least, members) in enumerate(bands):
                halves = np.minimum.reduceat(x * a[j] + b[j], half)
                window = halves.copy()
                window[joined] = np.minimum(halves[joined], halves[joined + 1])
                lo = np.searchsorted(least, window)
                hit = np.flatnonzero((lo < len(least)) & (least[np.minimum(lo, len(least) - 1)] == window))
                if len(hit):
                    n = np.searchsorted(least, window[hit], "right") - lo[hit]
                    item = members[np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    found.append(np.stack([np.repeat(owner[hit], n), item], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def found(self, piece: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, int, int]]:
        """(row of the piece, item, shared shingles, shingles of the item) of the items in a piece's texts."""
        data, offsets = bytes_of(piece.column(column))
        shingles, at = shingle_hashes(*word_hashes(data, offsets), WIDTH)
        if not len(shingles) or not self.sets:
            return
        last, own = -1, None
        for d, k in self.candidates(shingles, at).tolist():
            if d != last:
                last, own = d, np.unique(shingles[at[d] : at[d + 1]])
            item, s = self.sets[k]
            place = np.minimum(np.searchsorted(own, s), len(own) - 1)
            shared = int((own[place] == s).sum())
            if 100 * shared >= PERCENT * len(s):
                yield d, item, shared, len(s)

    def search(self, batches):
        """Batches of (doc_id, text): a row for each item in a text."""
        for batch in batches:
            for piece in blocks([batch], "text", 1 << 19):
                rows = list(self.found(piece, 1))
                ids = piece.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = list(zip(*rows))[1:] if rows else [()] * 3
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "item_id", "n_shared", "n_item"])

    def without(self, batches):
        """Batches of any columns, text among them: the rows whose texts hold no item."""
        for batch in batches:
            for piece in blocks([batch], "text", 1 << 19):
                keep = np.ones(piece.num_rows, bool)
                for d, *_ in self.found(piece, piece.schema.get_field_index("text")):
                    keep[d] = False
                yield piece.filter(pa.array(keep))


def _indexes(items: DataFrame, block: int) -> Iterator[tuple[Index, bool]]:
    """The blocks of the items as indexes, one at a time, each with whether it is the only one."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    alone = n <= block and size <= ITEM_BYTES
    batch: list[tuple[int, str]] = []
    held = 0
    for row in asked.toLocalIterator():
        batch.append((row.item_id, row.text))
        held += len(row.text.encode())
        if not alone and (len(batch) == block or held >= ITEM_BYTES):
            yield Index(batch), False
            batch, held = [], 0
    if batch or alone:
        yield Index(batch), alone


def contained_items(docs: DataFrame, items: DataFrame, block: int = ITEMS) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: the items of which at least 75 % of the shingles are in a document.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Texts that are null or have no words contain
    nothing and are contained in nothing. An item of fewer than five words is one shingle of all its words and is found
    only in a text that is the same words. Items that repeat are each reported; rows that repeat a document each count, and a
    null doc_id stays null. An empty table on either side gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index, alone in _indexes(items, block):
        one = docs.mapInArrow(index.search, SCHEMA)
        one = one if alone else cut(one)
        out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def clean(docs: DataFrame, items: DataFrame, block: int = ITEMS) -> DataFrame:
    """The rows of docs whose texts hold no item by contained_items(), all columns kept.

    Each row is judged by its own text, whatever its doc_id: rows that repeat a doc_id, or have none, stay or go by themselves.
    Null and empty texts stay. Empty items keep every row; empty docs give an empty result.
    """
    small_batches(docs.sparkSession)
    for index, alone in _indexes(items, block):
        docs = docs.mapInArrow(index.without, docs.schema)
        docs = docs if alone else cut(docs)
    return docs
