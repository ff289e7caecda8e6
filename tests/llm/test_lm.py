"""The language model: base scores by counting, a proper distribution, gradients, and held-out gain."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bandweave.llm import lm
from bandweave.llm.common import bytes_of, word_hashes

from .conftest import MESSY

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def check(df, rows, **limits):
    counts = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want.append((-1 if i is None else i, held_out(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 5)))
    got = lm.language_scores(df, **limits).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    return got


def test_base_scores_and_gain(docs, plain):
    got = check(docs, plain.items())
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.05  # log10 per held-out token


def test_rare_words_by_shuffle_give_the_same(docs, plain):
    check(docs, plain.items(), head=300)


def test_messy_rows(messy, none):
    got = check(messy, MESSY)
    same = [round(r.score, 6) for r in got if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
    assert lm.language_scores(none).count() == 0


def test_nothing_to_learn_from(spark):
    rows = [(i, "some words") for i in range(2000) if held_out(i)][:5]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    assert all(r.train_tokens == r.n_known == 0 for r in got)


def test_training_sees_all_tokens(spark):
    """The rounds' parts cover all remainders, and a round's messages carry the number of tokens that their weights have seen."""
    assert sum(n for n, _ in lm.ROUNDS) == 64 and not hasattr(lm, "SAMPLE")
    rows = [(i, "a b c d e " * (i % 7)) for i in range(300)] + [(None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    scorer = lm.Scorer(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    scorer.network = network()
    got = df.select("text").mapInArrow(lm._trained(scorer, 0.01), lm._MESSAGE).where("block = 0").collect()
    assert sum(r.tokens for r in got) == sum(len(words(t)) for _, t in rows) and len(got) == 3


def test_scores_against_brute_force_and_sums_to_one(spark, monkeypatch):
    """Words of the vocabulary, other words of the head, rare ones and unseen ones: a row's score, and all probabilities."""
    kept, learn = [], lm.language_model
    monkeypatch.setattr(lm, "VOCABULARY", 12)
    monkeypatch.setattr(lm, "CLASSES", 5)
    monkeypatch.setattr(lm, "language_model", lambda *a: kept.append(learn(*a)) or kept[-1])
    draw = np.random.default_rng(3)
    names = [f"w{k}" for k in range(40)]
    text = lambda: " ".join(names[min(39, int(k))] for k in draw.exponential(8, draw.integers(0, 12)))
    rows = [(i, text() + (" unseen other" if held_out(i) else "")) for i in range(400)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, head=20)
    model = kept[0]
    counts = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    named = [w for w, _ in sorted(((w, c) for w, c in counts.items() if w), key=lambda x: -x[1])]
    hashes = dict(zip([*names, "unseen"], word_hashes(*bytes_of(pa.array([" ".join([*names, "unseen"])])))[0]))
    number = {w: int(model.scorer.numbers(np.array([hashes[w]]))[0]) for w in [*named, "unseen"]} | {None: lm.END}
    assert sorted(set(number.values())) == list(range(12)) and number["unseen"] == lm.OTHER
    other = [w for w in named if number[w] == lm.OTHER]
    share = {w: (counts[w] + 0.1) / (sum(counts[x] for x in other) + 0.1 * (len(other) + 1)) for w in [*other, "unseen"]}
    net = model.scorer.network
    for r in got:
        own = [w if w is None or w in counts else "unseen" for w in words(dict(rows)[r.doc_id])]
        numbers = np.array([number[w] for w in own])
        want = net.score(numbers, np.array([0, len(own)]))[0] + sum(math.log10(share[w]) for w in own if number[w] == lm.OTHER)
        assert r.score == pytest.approx(want, rel=1e-4)
    state = net.states(np.array([[lm.END], [5]]), np.zeros((1, lm.HIDDEN), np.float32), net.gates())[0][-1]
    p = np.exp(net.log_likelihood(np.repeat(state, 12, 0), np.arange(12))[0].astype(float))
    assert sum(p[number[w]] * share.get(w, 1.0) for w in number) == pytest.approx(1, abs=1e-4)


def network():
    return lm.Network(np.arange(6000, 30, -1).astype(float)[: lm.VOCABULARY])


def test_classes_cover_the_vocabulary():
    net = network()
    sizes = np.diff(net.edges)
    assert net.edges[-1] == lm.VOCABULARY and (sizes >= 0).all() and list(sizes[:2]) == [1, 1]
    assert all(net.edges[c] <= w < net.edges[c + 1] for w, c in enumerate(net.class_of))


def test_probabilities_sum_to_one():
    net = network()
    state = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    n = lm.VOCABULARY
    logs, _ = net.log_likelihood(np.repeat(state, n, 0), np.arange(n))
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_carry_the_state_over_windows(monkeypatch):
    """A text scored alone, among others, and step by step."""
    monkeypatch.setattr(lm, "STEP", 64)
    net = network()
    draw = np.random.default_rng(1)
    texts = [np.append(draw.integers(2, 500, k), lm.END) for k in (0, 1, 19, 20, 21, 75, 300)]
    offsets = np.cumsum([0, *map(len, texts)])
    together = net.score(np.concatenate(texts), offsets)
    gate, value = net.gates(), net.p["value"]
    for t, got in zip(texts, together):
        state, before, total = np.zeros((1, lm.HIDDEN), np.float32), lm.END, 0.0
        for w in t:
            state = (0 if before == lm.END else (1 - gate[before]) * state) + gate[before] * value[before]
            total += float(net.log_likelihood(state.reshape(1, -1), np.array([w]))[0][0])
            before = w
        assert got == pytest.approx(total / math.log(10), rel=1e-4)
        assert net.score(t, np.array([0, len(t)]))[0] == pytest.approx(got, rel=1e-4)


def test_gradients_against_differences():
    net = network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    draw = np.random.default_rng(2)
    words_ = draw.integers(0, 500, (6, 3))
    words_[3, 1] = words_[2, 0] = lm.END
    before = np.concatenate([[[lm.END, 7, 9]], words_[:-1]])
    words_[4:, 2] = -1
    before[5:, 2] = lm.END
    start = draw.standard_normal((3, lm.HIDDEN))

    def likelihood():
        real = words_ >= 0
        return net.log_likelihood(net.states(before, start, net.gates())[0][real], words_[real])[0].sum()

    _, grad, n = net.gradient(words_, before, start)
    assert n == 16
    for name in net.p:
        flat = net.p[name].reshape(-1)
        for at in draw.choice(np.flatnonzero(np.abs(grad[name].reshape(-1)) > 1e-3), 3):
            kept = flat[at]
            flat[at] = kept + 1e-4
            up = likelihood()
            flat[at] = kept - 1e-4
            down = likelihood()
            flat[at] = kept
            assert grad[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=1e-3)
