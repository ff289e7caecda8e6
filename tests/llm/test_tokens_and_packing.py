"""Token counts, ids and packing against the tokenizers library."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from bandweave.llm import packing, tokens

from .conftest import MESSY

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def fuzz():
    draw = random.Random(4)
    alphabet = "aé ß'sS\t\n\r\x1c\xa0\x85 2²½ŉ!?_<|endoftext|>–’“€İıſ🎉語Σς"
    return ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(2000)] + ["a<|endoftext|>b", "<|startoftext|> x", "don't WE'LL 'S", "ΑΣ ΑΣ"]


def test_fast_paths_give_the_library_s_ids(plain):
    texts = [*plain.values(), *fuzz(), *(t or "" for _, t in MESSY)]
    library, encode = Tokenizer.from_file(BYTE), tokens.byte_level_encoder(BYTE)
    assert all(encode(t) == library.encode(t, add_special_tokens=False).ids for t in texts)
    library, counter = Tokenizer.from_file(WORD), tokens.Counter(WORD, tokens.whole_tokens(WORD))
    assert all(counter.count(t) == len(library.encode(t, add_special_tokens=False).ids) for t in texts)


def test_whole_tokens_are_proven():
    whole = tokens.whole_tokens(WORD)
    library = Tokenizer.from_file(WORD)
    assert len(whole) > 30_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in random.Random(5).sample(sorted(whole), 500))


def test_the_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    counter, library = tokens.Counter(WORD, frozenset()), Tokenizer.from_file(WORD)
    text = " ".join(f"w{i}q" for i in range(100))
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids) and len(counter) <= 10


def test_long_words_do_not_fill_the_memory(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_CHARACTERS", 1000)
    counter = tokens.Counter(WORD, frozenset())
    counter.count(" ".join("q" * 90 + chr(97 + k) for k in range(26)))
    assert sum(map(len, counter)) <= 1000


def test_a_file_that_splits_otherwise_is_left_to_the_library(tmp_path):
    setting = json.loads(open(WORD, encoding="utf-8").read())
    assert tokens.Counter(WORD, frozenset()).known
    setting["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\\p{L}]+|[^\\p{L}]"
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(setting, f)
    counter, library = tokens.Counter(path, tokens.whole_tokens(path)), Tokenizer.from_file(path)
    assert not counter.known and all(counter.count(t) == len(library.encode(t, add_special_tokens=False).ids) for t in ("don't 12", "a-b c!"))


def test_counts_of_messy_rows(messy, none):
    library = Tokenizer.from_file(WORD)
    got = sorted(tuple(r) for r in tokens.token_counts(messy.fillna(-1, ["doc_id"]), WORD).collect())
    size = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((-1 if i is None else i, len((t or "").encode()), size(t), size(t) > 2048) for i, t in MESSY)
    assert tokens.token_counts(none, WORD).count() == 0


def check_pieces(df, rows):
    library = Tokenizer.from_file(BYTE)
    got = packing.packed(df, BYTE).toPandas()
    by = {}
    for r in got.sort_values(["doc_id", "piece"]).itertuples():
        by.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        own = by[i]
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1]) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and (len(own) > 1) == (len(ids) > 2048)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == list(np.cumsum([0, *own.length])[:-1]) and own.length.sum() <= 2048
    return got


def test_packing_whole_documents(docs, plain):
    got = check_pieces(docs, plain.items())
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 2


def test_packing_of_messy_rows(spark, none):
    rows = [(k, t) for k, (_, t) in enumerate(MESSY)]
    check_pieces(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, length int"), rows)
    assert packing.packed(none, BYTE).count() == 0


def test_repeated_rows_are_packed_each(messy):
    got = packing.packed(messy, BYTE).toPandas()
    assert (got[got.doc_id == 7].length == 8).sum() == 2 and got.doc_id.isna().sum() == 1


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares(seed):
    draw = np.random.default_rng(seed)
    lengths = np.sort(draw.integers(1, 101, 3000))[::-1]
    bins, offsets = packing.sum_of_squares(lengths, 100)
    assert bins.max() + 1 <= -(-lengths.sum() // 100) * 1.03 + 1
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        assert list(offsets[own]) == list(np.cumsum([0, *lengths[own]])[:-1]) and lengths[own].sum() <= 100


@pytest.mark.parametrize("weigh_opening", [False, True])
def test_each_step_takes_the_smallest_sum(weigh_opening):
    lengths = np.random.default_rng(9).integers(1, 21, 200)
    bins, _ = packing.sum_of_squares(lengths, 20, weigh_opening)
    gaps: dict[int, int] = {}
    opened = 0
    for b, s in zip(bins.tolist(), lengths.tolist()):
        total = lambda g: sum(list(g.values()).count(x) ** 2 for x in set(g.values()) if x)
        fits = {c: total({**gaps, c: g - s}) for c, g in gaps.items() if g >= s}
        new = total({**gaps, -1: 20 - s})
        if weigh_opening:
            assert (fits[b] if b in gaps else new) == min([*fits.values(), new])
            opened += b not in gaps and bool(fits)
        elif fits:
            assert b in gaps and fits[b] == min(fits.values())
        gaps[b] = gaps.get(b, 20) - s
    assert opened > 0 or not weigh_opening


def test_sequences_of_both_rules():
    """Lengths of the documents of sf0.01, one shard: the restricted rule takes as many sequences as the tokens need, or one more."""
    import duckdb

    texts = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id").fetchall()]
    encode = tokens.byte_level_encoder(BYTE)
    lengths = []
    for t in texts:
        n = len(encode(t)) + 1
        lengths += [2048] * (n // 2048) + [n % 2048] * (n % 2048 > 0)
    lengths = np.sort(np.array(lengths))[::-1]
    least = -(-lengths.sum() // 2048)
    restricted, full = (int(packing.sum_of_squares(lengths, 2048, w)[0].max()) + 1 for w in (False, True))
    assert least <= restricted <= least + 1 < full <= least * 1.02


def test_small_tables_are_one_shard_and_shards_have_their_own_numbers(spark):
    df = spark.createDataFrame([(k, "word " * (k % 40)) for k in range(200)], "doc_id long, text string").repartition(3)
    one, several = (packing.packed(df, BYTE, shard=n).toPandas() for n in (1000, 20))
    assert one.sequence_id.nunique() == -(-one.length.sum() // 2048)
    assert several.groupby("sequence_id").length.sum().max() <= 2048 and len(several) == 200
