"""Exact removal of repeated byte strings by suffix arrays over the passages that can repeat.

1. Anchors. In every window of 100 bytes the 32-byte gram with the smallest hash (the leftmost on ties) is the window's
   anchor. Equal windows have equal anchors at equal places, so a window can repeat only where its anchor does. The windows
   of one anchor are consecutive; their union is the anchor's context.
2. Classes. Anchors meet by their hash. Of equal contexts the earliest stays, all windows of the others are repeats. Anchors
   whose hash occurs once are dropped, so unique text goes no further.
3. Suffix arrays. The different contexts of a hash meet in one shard. A shard is sorted in two stages: only the suffixes
   smaller than their successors are sorted directly, the others are induced by scanning the buckets of first bytes; then
   the common prefixes of neighbours are compared, and of each run that shares 100 bytes all but the earliest are repeats.
4. The repeated windows of a document are merged and removed.

Equal contexts meet by 128 bits (the hash of their anchor and a digest of the whole context with the anchor's place) and are one
string to the suffix arrays, as equal texts would be: their later copies repeat whatever the arrays find. Rows are told apart by
their doc_id and, only where some doc_id repeats, by 128 bits of their text.

Frequent passages: rows are reduced to one for each context (and eight for each hash) in every few megabytes before they are
shuffled; further anchors of a hash that is frequent there are known to repeat and travel by their context instead. A hash
with more different contexts than one task should hold (HOT) leaves the suffix arrays: its windows are dealt one by one by
their own hash, which is exact too and splits any passage.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, SALTS, _Powers, bytes_of, cut, mix64, small_batches

SPAN, GRAM = 100, 32
#: Rows of one hash that a chunk sends by that hash; two show that it repeats.
SENT = 8
#: Different contexts of one hash that are sorted in one task.
HOT = 5_000
#: Bytes of a text that are hashed at once, of text whose anchors are reduced together, and of a suffix array.
SEGMENT, CHUNK, SHARD = 8 << 20, 16 << 20, 1 << 20
#: Rows of a batch that leaves a task, and of one that a table's reader holds.
PIECE, READ = 1 << 16, 256
#: Partitions whose results go to one file. They are worked on one after another, so a task holds no more than one of them.
JOINED = 4
_POSITION = np.uint64((1 << 24) - 1)
_LOWEST = -(1 << 63)


class Rolling:
    """Hashes of any byte ranges of a block."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _Powers.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix64((self.sums[width:] - self.sums[:n]) * self.down[:n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, digest, text, first window, last window) of each anchor of a block of texts; places in the block."""
    none = np.zeros(0, np.int64)
    windows = len(data) - SPAN + 1
    if windows <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    rolling = Rolling(data)
    grams = rolling.grams(GRAM)
    keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN - GRAM + 1:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    rest = SPAN - GRAM + 1 - width
    place = (np.minimum(keys[: len(keys) - rest], keys[rest:])[:windows] & _POSITION).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(windows), "right") - 1
    valid = np.arange(windows) + SPAN <= offsets[text + 1]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (place[starts[1:]] != place[starts[:-1]]) | (starts[1:] != starts[:-1] + 1) | (text[starts[1:]] != text[starts[:-1]])
    lo = starts[new]
    hi = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    at = place[lo]
    digest = mix64(rolling.of(lo, hi + SPAN) + (at - lo).astype(np.uint64))
    return grams[at], digest, text[lo], lo, hi


def merged(keys: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The unions of overlapping or touching ranges of rows with equal keys, sorted: the keys' columns, starts, ends."""
    if not len(start):
        return *keys, start, end
    order = np.lexsort((start, *keys[::-1]))
    keys, start, end = [k[order] for k in keys], start[order], end[order]
    group = np.cumsum(np.append(0, np.any([k[1:] != k[:-1] for k in keys], 0)))
    # ends as running maxima within a document: the group number lifts them above all of earlier documents
    lift = group * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new = np.append(True, (start + lift)[1:] > reach[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)
    return *(k[new] for k in keys), start[new], (reach - lift)[last]


#: A row of documents is named by doc, a, b: its doc_id and, where ids repeat, two hashes of its text.
NAMES = ["kind", "key", "hash", "digest", "doc", "lo", "hi", "a", "b"]
TYPES = [pa.int8(), *[pa.int64()] * 8]
ROWS = "kind tinyint, key long, hash long, digest long, doc long, lo long, hi long, a long, b long"
#: kinds: an anchor that travels by its hash; one that is known to repeat and travels by its context; a repeated range
BY_HASH, BY_CONTEXT, RANGE = 0, 1, 2


def _batch(kind, key, hashes, digest, doc, lo, hi, a, b) -> pa.RecordBatch:
    columns = [np.broadcast_to(np.asarray(kind, np.int8), doc.shape)]
    columns += [np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x for x in (key, hashes, digest, doc, lo, hi, a, b)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def _ranges(doc, a, b, start, end) -> pa.RecordBatch:
    doc, a, b, start, end = merged([doc, a, b], start, end)
    zero = np.zeros(len(doc), np.int64)
    return _batch(RANGE, mix64(doc.astype(np.uint64) + np.uint64(1) ^ a.astype(np.uint64)), zero, zero, doc, start, end, a, b)


class Places:
    """Tells, in rows sorted by their class, doc, lo, a and b that come piece by piece, those that stand at the first place of
    their class (once for each row of documents) from those that stand later."""

    def __init__(self) -> None:
        self.last: list | None = None  # class, a and b of the last row
        self.first: tuple | None = None  # doc and lo of the first row of its class

    def split(self, classes: list[np.ndarray], doc: np.ndarray, lo: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Masks of the rows that begin a class, that stand at its first place in another row of documents, and that stand later."""
        n = len(doc)
        new, same_row = np.ones(n, bool), np.zeros(n, bool)
        if not n:
            return new, same_row, same_row
        new[1:] = np.any([g[1:] != g[:-1] for g in classes], 0)
        same_row[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        if self.last is not None:
            new[0] = any(g[0] != x for g, x in zip(classes, self.last))
            same_row[0] = (a[0], b[0]) == tuple(self.last[-2:])
        of = np.cumsum(new) - 1  # -1: the class goes on from the piece before
        starts = np.flatnonzero(new)
        first_doc, first_lo = (np.append(x[starts], y)[of] for x, y in ((doc, self.first[0] if self.first else 0), (lo, self.first[1] if self.first else 0)))
        later = ~new & ((doc != first_doc) | (lo != first_lo))
        self.last, self.first = [*(g[-1] for g in classes), a[-1], b[-1]], (first_doc[-1], first_lo[-1])
        return new, ~new & ~later & ~same_row, later


def _find(batches):
    """Anchors of all texts, reduced chunk by chunk."""
    held: list[tuple] = []
    size = 0

    def flush():
        columns = [np.concatenate(x) for x in zip(*held)]
        order = np.lexsort(tuple(columns[k] for k in (6, 5, 3, 2, 1, 0)))
        hashes, digest, doc, lo, hi, a, b = (x[order] for x in columns)
        new, other, later = Places().split([hashes, digest], doc, lo, a, b)
        if later.any():
            yield _ranges(doc[later], a[later], b[later], lo[later], hi[later] + SPAN)
        hashes, digest, doc, lo, hi, a, b = (x[new | other] for x in (hashes, digest, doc, lo, hi, a, b))
        head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        rank = np.arange(len(hashes)) - np.repeat(head, np.diff(np.append(head, len(hashes))))
        known = rank >= SENT
        rows = np.where(known, BY_CONTEXT, BY_HASH), np.where(known, mix64(digest), hashes), hashes, digest, doc, lo, hi, a, b
        for at in range(0, len(hashes), PIECE):  # the receiver holds a batch as a whole
            yield _batch(*(x[at : at + PIECE] for x in rows))

    for batch in batches:
        ids, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
        data, offsets = bytes_of(batch.column(1))
        i = 0
        while i < len(ids):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1)
            j = min(j, len(ids))
            base, end = int(offsets[i]), int(offsets[j])
            # a single long text goes segment by segment; each owns the windows that start in it
            for at0 in range(base, max(end, base + 1), SEGMENT):
                to = min(end, at0 + SEGMENT + SPAN - 1)
                own = np.clip(offsets[i : j + 1], at0, to) - at0
                hashes, digest, text, lo, hi = anchors(data[at0:to], own)
                text += i
                shift = at0 - offsets[text]
                held.append((hashes, digest, ids[text], lo + shift, hi + shift, a[text], b[text]))
            size += end - base
            i = j
            if size >= CHUNK:
                yield from flush()
                held.clear()
                size = 0
    if held:
        yield from flush()


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _whole_groups(batches, keys: tuple[int, ...], most: int = 0):
    """Column lists in which the groups of equal sorted key columns are whole; with `most`, joined up to that many rows."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _columns(batch)
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            same &= columns[k] == columns[k][-1]
        head = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if head or (held and any(held[-1][k][-1] != columns[k][0] for k in keys)):
            held.append([c[:head] for c in columns])
            rows += head
            if rows >= most or not head:
                yield [np.concatenate(x) for x in zip(*held)]
                held, rows = [], 0
        held.append([c[head:] for c in columns])
        rows += batch.num_rows - head
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _meet(batches):
    """Rows sorted by key, kind, digest, hash, doc, lo, a, b: the earliest context of each class of repeated anchors, and repeated
    ranges. Rows are taken batch by batch, so a key may have any number of them."""
    places, last, waiting = Places(), None, None  # waiting: the only row so far of a hash that travels by itself
    for batch in batches:
        columns = _columns(batch)
        ranges = columns[0] == RANGE
        if ranges.any():
            yield _batch(RANGE, *(c[ranges] for c in columns[1:]))
            columns = [c[~ranges] for c in columns]
        kind, key, hashes, digest, doc, lo, hi, a, b = columns
        if not len(doc):
            continue
        new, other, later = places.split([kind, key, digest, hashes], doc, lo, a, b)
        if later.any():
            yield _ranges(doc[later], a[later], b[later], lo[later], hi[later] + SPAN)
        begins = np.append(last != (kind[0], key[0]), (kind[1:] != kind[:-1]) | (key[1:] != key[:-1]))
        last = (kind[-1], key[-1])
        group = np.cumsum(begins)  # 0: the one that the last batch ended with
        kept = np.flatnonzero(new | other)
        n = np.bincount(group[kept], minlength=group[-1] + 1)
        n[0] += 1  # its first row is in an earlier batch
        if waiting is not None and n[0] > 1:
            yield waiting
            waiting = None
        again = (n[group[kept]] > 1) | (kind[kept] == BY_CONTEXT)
        out = [c[kept] for c in columns]
        if again.any():
            yield _batch(BY_HASH, *(c[again] for c in out[1:]))
        if group[-1]:
            alone = len(kept) - 1 if not again[-1] else None
            waiting = None if alone is None else _batch(BY_HASH, *(c[alone : alone + 1] for c in out[1:]))


CONTEXTS = "kind tinyint, key long, doc long, lo long, hi long, a long, b long, context binary"
#: kinds: a context; a window that is the first of its hash in a batch; a repeated range
CONTEXT, WINDOW, REPEATED = 0, 1, 2


def _contexts(batches):
    """The contexts' bytes; of hot hashes, a row for each window, reduced batch by batch."""
    kinds = [pa.int8(), *[pa.int64()] * 6, pa.binary()]
    names = [x.split()[0] for x in CONTEXTS.split(", ")]

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        out = [[] for _ in range(7)]  # key, doc, lo, hi, a, b, bytes
        hot = [[] for _ in range(5)]  # hash of the window, doc, start, a, b
        data, offsets = bytes_of(batch.column(1))
        named = zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))
        for d, ((doc, a, b), wanted) in enumerate(zip(named, batch.column(4))):
            text = data[offsets[d] : offsets[d + 1]]
            hashes, los, his, hots = (c.to_numpy(zero_copy_only=False) for c in wanted.values.flatten())
            for h, lo, hi in zip(*(x[~hots].tolist() for x in (hashes, los, his))):
                for column, x in zip(out, (h, doc, lo, hi, a, b, text[lo : hi + SPAN].tobytes())):
                    column.append(x)
            if hots.any():
                n = (his - los + 1)[hots]
                start = np.repeat(los[hots], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for k in range(0, len(start), 1 << 16):
                    own = start[k : k + (1 << 16)]
                    low = int(own.min())
                    rolling = Rolling(text[low : int(own.max()) + SPAN])
                    h = rolling.of(own - low, own - low + SPAN)
                    for column, x in zip(hot, (h, np.full(len(own), doc, np.int64), own, np.full(len(own), a, np.int64), np.full(len(own), b, np.int64))):
                        column.append(x)
        if out[0]:
            yield rows(np.zeros(len(out[0]), np.int8), *out)
        if hot[0]:
            columns = [np.concatenate(x) for x in hot]
            order = np.lexsort(tuple(columns[k] for k in (4, 3, 2, 1, 0)))
            h, doc, start, a, b = (x[order] for x in columns)
            new, other, later = Places().split([h], doc, start, a, b)
            first = new | other
            empty = pa.nulls(int(first.sum()), pa.binary())
            yield rows(np.full(len(empty), WINDOW, np.int8), mix64(h[first]).view(np.int64), doc[first], start[first], start[first] + SPAN, a[first], b[first], empty)
            if later.any():
                doc, a, b, start, end = merged([doc[later], a[later], b[later]], start[later], start[later] + SPAN)
                key = mix64(doc.astype(np.uint64) + np.uint64(1) ^ a.astype(np.uint64)).view(np.int64)
                yield rows(np.full(len(doc), REPEATED, np.int8), key, doc, start, end, a, b, pa.nulls(len(doc), pa.binary()))


def suffix_array(text: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The suffixes of text (uint8) in order, by two-stage sorting. Suffixes that share their first `depth` bytes may stand in
    any order among each other."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # a suffix is smaller than its successor if the next different byte is larger; the end counts as smaller than any byte
    change = np.flatnonzero(text[1:] != text[:-1])
    following = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    rising = np.zeros(n, bool)
    inner = following < n - 1
    rising[inner] = text[following[inner]] < text[following[inner] + 1]
    small = np.flatnonzero(rising)
    padded = np.append(text, np.zeros(depth, np.uint8))
    heads = np.lib.stride_tricks.sliding_window_view(padded, depth)[small]
    small = small[np.argsort(np.ascontiguousarray(heads).view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(text[small], np.arange(257))
    # induce the others: scanning the suffixes in order, the predecessor of each is next in the bucket of its first byte
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    buckets[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int64)
        scanned = []
        while len(wave):
            scanned.append(wave)
            before = wave[wave > 0] - 1
            wave = before[(text[before] == c) & ~rising[before]]
        scanned.append(small[bounds[c] : bounds[c + 1]])
        row = np.concatenate(scanned)
        out.append(row)
        before = row[row > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            edges = np.searchsorted(first[order], np.arange(257))
            for d in np.unique(first).tolist():
                buckets[d].append(before[order[edges[d] : edges[d + 1]]])
    return np.concatenate(out)


def shared_prefix(text: np.ndarray, order: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Whether each suffix shares its first `depth` bytes with the one before it in the order."""
    padded = np.append(text, np.zeros(depth + 8, np.uint8)).astype(np.uint64)
    words = np.zeros(len(text) + depth, np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)] << np.uint64(8 * j)
    same = np.zeros(len(order), bool)
    same[1:] = (order[1:] + depth <= len(text)) & (order[:-1] + depth <= len(text))
    for step in [*range(0, depth - 7, 8), depth - 8]:
        left = np.flatnonzero(same)
        same[left] = words[order[left] + step] == words[order[left - 1] + step]
    return same


def _repeats(doc: np.ndarray, start: np.ndarray, part: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(doc, part, start) of the 100-byte windows of the contexts that also stand in an earlier place among them. part: numbers that
    tell the rows of a doc apart."""
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(contexts), np.uint8)
    order = suffix_array(text)
    run = np.cumsum(~shared_prefix(text, order))
    owner = np.searchsorted(ends, order, "right")
    inside = order + SPAN <= ends[owner]
    order, run, owner = order[inside], run[inside], owner[inside]
    doc, part, start = doc[owner], part[owner], start[owner] + order - (ends - sizes)[owner]
    by = np.lexsort((part, start, doc, run))
    doc, part, start, run = doc[by], part[by], start[by], run[by]
    later = Places().split([run], doc, start, part, np.zeros(len(part), np.int64))[2]
    return doc[later], part[later], start[later]


def _sort_shards(batches):
    """Rows sorted by kind, key, doc, lo, a, b: repeated ranges (doc, a, b, start, end)."""
    names = ["doc", "a", "b", "start", "end"]
    windows = Places()

    def ranges(doc, a, b, start, end):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in merged([doc, a, b], start, end)], names)

    def rest(batch):
        """The rows of a batch that are no contexts."""
        kind, key, doc, lo, hi, a, b = _columns(batch)[:7]
        done, window = kind == REPEATED, kind == WINDOW
        if window.any():
            done[np.flatnonzero(window)[windows.split([key[window]], doc[window], lo[window], a[window], b[window])[2]]] = True
        if done.any():
            yield ranges(doc[done], a[done], b[done], lo[done], hi[done])

    def contexts():
        for batch in batches:
            own = batch.filter(pa.compute.equal(batch.column(0), CONTEXT))
            if own.num_rows:
                yield own
            if own.num_rows < batch.num_rows:
                found.extend(rest(batch))

    found: list[pa.RecordBatch] = []
    for _, _, doc, lo, _, a, b, context in _whole_groups(contexts(), (0, 1), most=SHARD // 135):
        named, part = np.unique(np.stack([a, b], 1), axis=0, return_inverse=True)
        doc, part, start = _repeats(doc, lo, part.reshape(-1), list(context))
        if len(doc):
            yield ranges(doc, *named[part].T, start, start + SPAN)
        yield from found
        found.clear()
    yield from found


def _remove(batches):
    for batch in batches:
        data, offsets = bytes_of(batch.column(1))
        n_removed, n_spans, digests, kept = [], [], [], []
        for i, found in enumerate(batch.column(2)):
            text = data[offsets[i] : offsets[i + 1]]
            spans = 0
            if found.is_valid and len(found.values):
                start, end = (c.to_numpy(zero_copy_only=False) for c in found.values.flatten())
                start, end = merged([np.zeros(len(start), np.int64)], start, end)[1:]
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, np.minimum(start, len(text)), 1)
                np.add.at(edge, np.minimum(end, len(text)), -1)
                inside = np.cumsum(edge[:-1]) > 0
                spans = int((inside & ~np.append(False, inside[:-1])).sum())
                left = text[~inside].tobytes()
            else:
                left = text.tobytes()
            n_removed.append(len(text) - len(left))
            n_spans.append(spans)
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _in_few_files(df: DataFrame) -> DataFrame:
    """df in a quarter of the session's shuffle partitions, or two for each core: where Hadoop has no native library, an executor
    starts several processes for each file that it writes."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // JOINED))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc, a, b, start, end: byte ranges whose union, for each row, is what 100-byte strings that start earlier cover. docs: doc,
    text, a, b; rows with equal doc, a and b have equal texts."""
    small_batches(docs.sparkSession)
    # the reader holds its rows' texts in arrays that grow by doubling; with 4,096 long texts the heap grows for them and stays so
    docs.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ))
    row = ["doc", "a", "b"]
    found = docs.select("doc", "text", "a", "b").mapInArrow(_find, ROWS)
    # the key comes first, since Spark compares by the first column before it reads rows; twice the partitions, since the rows of
    # anchors are several times their text and a task sorts them in memory
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = found.repartition(parts, "key").sortWithinPartitions("key", "kind", "digest", "hash", "doc", "lo", "a", "b").mapInArrow(_meet, ROWS)
    met = cut(_in_few_files(met))
    early = met.where(F.col("kind") == RANGE).select(*row, F.col("lo").alias("start"), F.col("hi").alias("end"))
    classes = met.where(F.col("kind") == BY_HASH).select("hash", *row, "lo", "hi")
    # a hash of many contexts would be a hot key of the join, so its contexts are dealt out by a salt
    salted = classes.withColumn("salt", F.pmod(F.xxhash64("doc", "lo"), F.lit(SALTS)).cast("int"))
    frequent = classes.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("hash", F.lit(True).alias("hot"))
    frequent = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    classes = salted.join(frequent, ["hash", "salt"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    # sets: what repeated rows ask for is the same, so an array is as long as its text allows
    wanted = classes.groupBy(*row).agg(F.collect_set(F.struct("hash", "lo", "hi", "hot")).alias("wanted"))
    asked = docs.join(wanted, row).select("doc", "text", "a", "b", "wanted")
    contexts = asked.mapInArrow(_contexts, CONTEXTS).repartition("key").sortWithinPartitions("kind", "key", "doc", "lo", "a", "b")
    return early.unionByName(contexts.mapInArrow(_sort_shards, "doc long, a long, b long, start long, end long"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that remain) for every row of docs.

    docs: doc_id, text; other columns are ignored. Texts count as UTF-8 bytes, a null text as empty. Earlier means a smaller
    doc_id, or the same one and an earlier start; a null doc_id counts as the smallest. Rows that repeat a doc_id are one
    document: equal strings at equal starts of them are not earlier than each other, those at different starts are. An empty
    table gives an empty result.
    """
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # 128 bits of the text name a row beside its doc_id; they are left out where no doc_id repeats
    once = docs.groupBy("doc").count().where("count > 1").isEmpty()
    key = [F.lit(0).cast("long")] * 2 if once else [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    docs = docs.withColumn("a", key[0]).withColumn("b", key[1])
    spans = cut(_in_few_files(repeated_ranges(docs))).groupBy("doc", "a", "b").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = docs.join(spans, ["doc", "a", "b"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return _in_few_files(joined.mapInArrow(_remove, schema))
