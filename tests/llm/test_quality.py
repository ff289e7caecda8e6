"""Quality rules against brute force, and both quality scores against labels."""

import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from bandweave.llm import quality_rules, quality_zstd

from .conftest import MESSY


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for own in windows.values() if len(own) > 1 for i in own for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def measures(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_rules_against_brute_force(spark, data, docs, plain):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    got = quality_rules.rules(docs, labels).collect()
    assert len(got) == len(plain)
    for r in got:
        assert measures(r) == brute(plain[r.doc_id]), r.doc_id
        assert r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    assert quality_rules.rules(docs, labels).where("kept").count() == sum(r.kept for r in got)
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert all(r.kept or r.base_failed for r in got if r.doc_id in good)


def grams(text):
    """The buckets of a text's words and pairs of words."""
    one = [xxhash.xxh64(w.encode(), 42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    chain = lambda x, seed: xxhash.xxh64(x.to_bytes(8, "little"), seed).intdigest()
    two = [chain(b, chain(a, 42)) for a, b in zip(one, one[1:])]
    return [x % quality_rules.BUCKETS for x in one + two]


def brute_scores(texts, trusted):
    b = quality_rules.BUCKETS
    raw, target = (np.bincount(np.array([g for t in own for g in grams(t)], int), minlength=b) + 1 for own in (texts, trusted))
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return [float(np.mean(ratio[g])) if (g := grams(t)) else 0.0 for t in texts]


def test_scores_and_verdicts_against_brute_force(spark, data, docs, plain):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    ids = sorted(plain)
    want = dict(zip(ids, brute_scores([plain[i] for i in ids], [plain[i] for i in ids if i in good])))
    got = quality_rules.rules(docs, labels).collect()
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.kept == (not brute(plain[r.doc_id])[5] and want[r.doc_id] >= quality_rules.THRESHOLD)
    assert 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got)


def test_kept_rows_keep_their_columns(spark):
    """Columns that are named like measures, repeated rows and a null doc_id."""
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, 111, 2.5, False), (1, text, 111, 2.5, False), (None, text, 7, 1.5, True), (2, "too short", 3, 0.5, True), (3, None, 4, 0.5, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words long, score double, kept boolean")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.kept(docs, labels)
    assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(rows[:3], key=repr)
    assert quality_rules.kept(docs.limit(0), labels).count() == 0


def test_repeats_in_a_row(spark):
    texts = ["a b c d e f g h " * 5, "x " * 30, " ".join(f"w{i}" for i in range(40)), "a b c d e f g h i " + "z " * 12 + "a b c d e f g h i", "l1\nl2\nl1\n \n\t\nl1"]
    got = quality_rules.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [0.0] * quality_rules.BUCKETS).collect()
    assert [measures(r) for r in sorted(got, key=lambda r: r.doc_id)] == [brute(t) for t in texts]


def test_rules_of_messy_rows(spark, messy, none):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, None), (7, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.rules(messy, labels)
    assert got.count() == len(MESSY)
    by = {r.doc_id: r for r in got.collect()}
    assert all(measures(by[i]) == brute(t) for i, t in MESSY)
    assert by[5].word == "x" and by[5]._words == "y" and by[5].text == dict(MESSY)[5] and by[1].text is None
    assert quality_rules.rules(none, labels).count() == 0
    assert {r.score for r in quality_rules.rules(messy, labels.limit(0)).collect()} == {0.0}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_compression_scores_tell_held_out_labels(spark):
    """At sf0.01: enough labelled rows that held-out accuracy means something."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_zstd.quality_scores(docs, labels).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    test = [(quality[r.doc_id], r.score, r.predicted) for r in got if r.held_out and r.doc_id in quality]
    good, bad = ([s for q, s, _ in test if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert np.mean([q == p for q, _, p in test]) > 0.9


def test_compression_scores_of_messy_rows(spark, messy, none):
    labels = spark.createDataFrame([(5, 1), (6, 0), (11, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    got = quality_zstd.quality_scores(messy, labels).collect()
    assert len(got) == len(MESSY) and all(0 <= r.score <= 1 for r in got)
    assert not [r for r in got if r.doc_id is None][0].held_out
    assert {r.score for r in quality_zstd.quality_scores(messy, labels.limit(0)).collect()} == {0.5}
    assert quality_zstd.quality_scores(none, labels).count() == 0


def test_compression_scores_against_brute_force(spark):
    """Which rows are learnt from, the sizes, and the calibrated score, each once more by plain loops."""
    draw = np.random.default_rng(1)
    text = lambda q: " ".join(f"{'gb'[q]}{int(k)}" for k in draw.integers(0, 60, 40))
    rows = [(i, text(i % 4 == 0)) for i in range(240)] + [(4, "a text that is smaller"), (500, None), (None, "x")]
    labels = [(i, int(i % 4 != 0)) for i in range(240) if i % 6] + [(1, 1), (2, 0), (None, 1), (900, 1), (7, None)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    kinds = {}
    for i, q in labels:
        if i is not None and q is not None and not held_out(i):
            kinds.setdefault(i, set()).add(q)
    sure = {i: min(q) for i, q in kinds.items() if len(q) == 1}
    sample, totals = quality_zstd.training_rows(docs, told)
    texts = {}
    for i, t in rows:
        texts[i] = min(texts.get(i, t or ""), t or "")
    assert sample == sorted((i, texts[i], q) for i, q in sure.items() if i in texts)
    assert totals == (sum(q == 0 for q in sure.values()), sum(q == 1 for q in sure.values()))
    assert len(quality_zstd.training_rows(docs, told, 5)[0]) <= 10
    half = {q: [t.encode() for k, t in enumerate(t for _, t, x in sample if x == q) if k % 2 == 0] for q in (0, 1)}
    rest = [(t.encode(), q) for q in (0, 1) for k, t in enumerate(t for _, t, x in sample if x == q) if k % 2]
    made = {q: zstandard.ZstdCompressionDict(quality_zstd.dictionary(half[q])) for q in (0, 1)}
    size = lambda t, q: len(zstandard.ZstdCompressor(level=quality_zstd.LEVEL, dict_data=made[q], write_content_size=False, write_dict_id=False).compress(t))
    x = lambda t: (size(t, 0) - size(t, 1)) / len(t) if t else 0.0
    xs, ys = np.array([x(t) for t, _ in rest]), np.array([q for _, q in rest])
    z = (xs - xs.mean()) / xs.std()
    w = np.zeros(2)  # gradient ascent on the same penalised likelihood
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(w[0] * z + w[1])))
        w += 0.02 * (np.array([((ys - p) * z).sum(), (ys - p).sum()]) - 1e-2 * w)
    shift = np.log(totals[1] / totals[0]) - np.log(ys.sum() / (len(ys) - ys.sum()))
    want = {i: 1 / (1 + np.exp(-np.clip(w[0] * (x((t or "").encode()) - xs.mean()) / xs.std() + w[1] + shift, -30, 30))) for i, t in rows if i != 4}
    got = quality_zstd.quality_scores(docs, told).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.doc_id == 4 or r.score == pytest.approx(want[r.doc_id], abs=1e-3)


def test_scores_do_not_depend_on_held_out_labels(spark, messy):
    labels = [(i, k % 2) for k, (i, _) in enumerate(MESSY) if i is not None]
    told = spark.createDataFrame(labels, "doc_id long, quality int")
    other = spark.createDataFrame([(i, 1 - q if held_out(i) else q) for i, q in labels], "doc_id long, quality int")
    a, b = (sorted((r.doc_id or -1, r.score) for r in quality_zstd.quality_scores(messy, x).collect()) for x in (told, other))
    assert a == b
