"""Words, shingles and byte ranges against plain Python, and the suffix array against sorting."""

import random
import re

import numpy as np
import pyarrow as pa

from bandweave.llm import suffix
from bandweave.llm.common import blocks, bytes_of, shingle_hashes, word_hashes

from .conftest import MESSY

DRAW = random.Random(1)


def texts():
    out = [t or "" for _, t in MESSY]
    return out + ["".join(DRAW.choice("ab é\n\tC") for _ in range(DRAW.randint(0, 60))) for _ in range(300)]


def test_words_and_shingles():
    ts = texts()
    data, offsets = bytes_of(pa.array(ts))
    words, at = word_hashes(data, offsets)
    shingles, sat = shingle_hashes(words, at, 5)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen_words, seen_shingles = {}, {}
    for i, t in enumerate(ts):
        want = re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower))
        got = words[at[i] : at[i + 1]].tolist()
        assert len(want) == len(got)
        for w, g in zip(want, got):
            assert seen_words.setdefault(w, g) == g
        grams = [tuple(want[k : k + 5]) for k in range(len(want) - 4)] if len(want) >= 5 else [tuple(want)] if want else []
        got = shingles[sat[i] : sat[i + 1]].tolist()
        assert len(grams) == len(got)
        for w, g in zip(grams, got):
            assert seen_shingles.setdefault(w, g) == g
    assert len(set(seen_words.values())) == len(seen_words) and len(set(seen_shingles.values())) == len(seen_shingles)


def test_blocks_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts()))), pa.array(texts())], ["doc_id", "text"])
    got = [x for b in blocks([batch], "text", 100) for x in b.column(0).to_pylist()]
    assert got == list(range(batch.num_rows))


def test_suffix_array_against_sorting():
    for alphabet in (b"a", b"ab", b"abc", bytes(range(1, 256))):
        for _ in range(40):
            text = bytes(DRAW.choice(alphabet) for _ in range(DRAW.randint(1, 200)))
            got = suffix.suffix_array(np.frombuffer(text, np.uint8), 300).tolist()
            assert got == sorted(range(len(text)), key=lambda i: text[i:])


def brute_repeats(ts):
    seen, marks = set(), []
    for t in ts:
        own = set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                own.update(range(i, i + 100))
            seen.add(t[i : i + 100])
        marks.append(own)
    return marks


def test_repeats_of_contexts():
    parts = [bytes(DRAW.choice(b"abcd \x00\xff") for _ in range(DRAW.randint(60, 300))) for _ in range(12)]
    for _ in range(30):
        contexts = [c for c in (b"".join(DRAW.choice(parts) for _ in range(DRAW.randint(1, 4))) for _ in range(6)) if len(c) >= 100] or [b"x" * 150]
        zero = np.zeros(len(contexts), np.int64)
        doc, _, start = suffix._repeats(np.arange(len(contexts)), zero, zero, contexts)
        marks = [set() for _ in contexts]
        for d, s in zip(doc.tolist(), start.tolist()):
            marks[d].update(range(s, s + 100))
        assert marks == brute_repeats(contexts)


def test_anchors_leave_in_small_batches():
    text = DRAW.randbytes(3_000_000).hex()[:3_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([text]), pa.array([1], pa.int64()), pa.array([2], pa.int64())], ["doc", "text", "a", "b"])
    out = list(suffix._find([batch]))
    assert max(x.num_rows for x in out) <= suffix.PIECE < sum(x.num_rows for x in out)
    found = [np.concatenate(c) for c in zip(*(suffix._columns(x) for x in out))]
    hashes, digest, _, lo, hi = suffix.anchors(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    by = np.argsort(found[5])
    assert (found[2][by].view(np.uint64) == hashes).all() and (found[3][by].view(np.uint64) == digest).all()
    assert (found[5][by] == lo).all() and (found[6][by] == hi).all() and set(zip(found[7].tolist(), found[8].tolist())) == {(1, 2)}
