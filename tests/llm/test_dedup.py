"""Near duplicates, suffix-array removal and decontamination against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import xxhash

from bandweave.llm import decontam, minhash, suffix

from .conftest import MESSY

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    pairs = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in pairs:
        c = len(sets[a] & sets[b])
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(docs, plain):
    want = brute_components({i: shingles(t) for i, t in plain.items()})
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingles(plain[i])) for i, r in got.items())


def test_a_chain_and_a_group_around_one_text(spark):
    """Copies of a text that are each near to it, but not to each other, and a chain of changes."""
    draw = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, "unrelated words that stand alone here today")]
    for k in range(1, 40):
        own = list(base)
        for at in draw.sample(range(0, 120, 6), 3):
            own[at] = f"new{k}x{at}"
        rows.append((k, " ".join(own)))
    rows.append((99, " ".join(base)))
    chain = [f"c{i}" for i in range(100)]
    for k in range(200, 210):
        chain = chain[4:] + [f"d{k}x{i}" for i in range(4)]
        rows.append((k, " ".join(chain)))
    want = brute_components({i: shingles(t) for i, t in rows})
    assert len(set(want.values())) == 3
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_near_duplicates_of_messy_rows(messy, none):
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(messy).collect())
    assert len(got) == len(MESSY)
    by = {g[0]: g[1:] for g in got}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[4] == (1, 4, True)
    assert by[6] == (3, 6, True) and by[7] == (3, 6, False) and by[8] == (3, 6, False) and by[-1] == (3, 6, False)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.representatives(messy)
    assert kept.columns == messy.columns and kept.count() == len(MESSY) - 4


def test_one_row_of_each_group_stays(spark):
    """Equal rows under several ids, null ids, different texts under one id, columns of clashing names, rows without words."""
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:58], "x", "y"]), " ".join(f"o{i}" for i in range(30))
    base = " ".join(base)
    rows = [(5, base, 1), (5, base, 1), (6, base, 2), (None, base, 3), (None, near, 4), (8, other, 5), (8, near, 6), (9, other, 7), (None, "alone with its words here now", 8), (7, None, 9), (7, None, 9), (7, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root int").repartition(3)
    got = minhash.representatives(docs)
    assert got.columns == docs.columns
    want = [(5, base, 1), (8, other, 5), (None, "alone with its words here now", 8), (7, None, 9), (7, None, 9), (7, "", 9)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    found = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert found == {(5, 56): (5, True), (6, 56): (5, False), (None, 56): (5, False), (8, 26): (8, True), (8, 56): (5, False), (9, 26): (8, False), (None, 2): (None, True), (7, 0): (7, True)}


def test_hubs_are_dealt_out(spark, monkeypatch):
    """Keys with more rows than a task may read: the same results by the salted joins."""
    monkeypatch.setattr(minhash, "HOT_ROWS", 2)
    texts = ["a b c d e f g h", "a b c d e f g h", "other words that stand alone here", None, "a b c d e f g h"]
    assert sorted(r.doc_id for r in minhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()) == [0, 2, 3]
    links = [(0, k) for k in range(1, 30)] + [(100 + k, 101 + k) for k in range(9)] + [(5, 200), (200, 300)]
    got = {r.id: r.component for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(30), 200, 300], 0), **dict.fromkeys(range(100, 110), 100)}


def test_cells_are_cut_by_the_shingles_they_hold(spark, monkeypatch):
    """The chain of changes and the group around one text once more, in cells of a few sets."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 300)
    test_a_chain_and_a_group_around_one_text(spark)


def brute_removed(rows):
    """rows: (place, bytes). Returns for each row (removed, spans, kept bytes)."""
    first = {}
    for place, t in rows:
        for i in range(len(t) - 99):
            w = t[i : i + 100]
            first[w] = min(first.get(w, (place, i)), (place, i))
    out = []
    for place, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            if first[t[i : i + 100]] < (place, i):
                gone[i : i + 100] = b"\1" * 100
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check_removal(df):
    rows = [(-(1 << 63) if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
    want = sorted((p, len(t), *w) for (p, t), w in zip(rows, brute_removed(rows)))
    got = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicated(df).collect())
    assert got == want
    return got


def test_removal_against_brute_force(docs):
    assert sum(g[2] for g in check_removal(docs)) > 0


def test_removal_of_messy_rows(messy, none):
    got = check_removal(messy)
    assert [g for g in got if g[0] == 10][0][2:4] == (4999, 1)
    assert suffix.deduplicated(none).count() == 0


def test_removal_from_rows_of_one_id(spark):
    """Rows of one doc_id with different texts, a passage in both at equal and at different starts, and once more elsewhere."""
    passage, fill = "the quick brown fox jumps over it " * 5, "abcdefghij" * 12
    rows = [(5, passage + fill), (5, passage + "z" * 150), (5, "y" * 40 + passage), (5, passage + fill), (7, fill + "x" * 10 + passage), (3, "w" * 120)]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    check_removal(spark.createDataFrame([*rows, (2, passage)], "doc_id long, text string").repartition(2))


def test_removal_with_frequent_passages(spark, monkeypatch):
    """Passages in most texts, also beyond the number of contexts that one task sorts and the size of a segment."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh ") for _ in range(draw.randint(5, 90)))
    passages = [word() * 3 for _ in range(3)]
    rows = [(i, "".join(draw.choice(passages) if draw.random() < 0.5 else word() for _ in range(draw.randint(0, 6)))) for i in range(60)]
    df = spark.createDataFrame([*rows, (100, passages[0] * 20)], "doc_id long, text string").repartition(3)
    check_removal(df)
    for name, value in (("HOT", 3), ("SENT", 2), ("CHUNK", 700), ("SEGMENT", 400), ("SHARD", 4000)):
        monkeypatch.setattr(suffix, name, value)
    docs = [(i, t) for i, t in [*rows, (100, passages[0] * 20)]]
    assert _local(docs) == [(r[0], r[1]) for r in brute_removed([(i, t.encode()) for i, t in docs])]


def _local(docs):
    """The same steps in this process, where the changed limits hold."""
    zeros = [0] * len(docs)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs]), *[pa.array(zeros, pa.int64())] * 2], ["doc", "text", "a", "b"])
    rows = [x for b in suffix._find(iter([batch])) for x in b.to_pylist()]
    rows.sort(key=lambda x: [x[k] for k in ("kind", "key", "digest", "hash", "doc", "lo", "a", "b")])
    schema = pa.schema(list(zip(suffix.NAMES, suffix.TYPES)))
    pieces = lambda rows, schema: (pa.RecordBatch.from_pylist(rows[i : i + 7], schema) for i in range(0, len(rows), 7))
    met = [x for b in suffix._meet(pieces(rows, schema)) for x in b.to_pylist()]
    spans = [(x["doc"], x["lo"], x["hi"]) for x in met if x["kind"] == suffix.RANGE]
    classes = [x for x in met if x["kind"] == suffix.BY_HASH]
    whole = [x for b in suffix._meet(iter([pa.RecordBatch.from_pylist(rows, schema)])) for x in b.to_pylist()]
    assert sorted(map(str, classes)) == sorted(str(x) for x in whole if x["kind"] == suffix.BY_HASH)
    count, wanted, texts = {}, {}, dict(docs)
    for x in classes:
        count[x["hash"]] = count.get(x["hash"], 0) + 1
    for x in classes:
        wanted.setdefault(x["doc"], []).append({k: x[k] for k in ("hash", "lo", "hi")} | {"hot": count[x["hash"]] > suffix.HOT})
    kind = pa.list_(pa.struct([*((k, pa.int64()) for k in ("hash", "lo", "hi")), ("hot", pa.bool_())]))
    ids = sorted(wanted)
    zeros = pa.array([0] * len(ids), pa.int64())
    asked = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([texts[i] for i in ids]), zeros, zeros, pa.array([wanted[i] for i in ids], kind)], ["doc", "text", "a", "b", "wanted"])
    rows = sorted((x for b in suffix._contexts(iter([asked])) for x in b.to_pylist()), key=lambda x: [x[k] for k in ("kind", "key", "doc", "lo", "a", "b")])
    schema = pa.schema([("kind", pa.int8()), *((k, pa.int64()) for k in ("key", "doc", "lo", "hi", "a", "b")), ("context", pa.binary())])
    spans += [(x["doc"], x["start"], x["end"]) for b in suffix._sort_shards(pieces(rows, schema)) for x in b.to_pylist()]
    found = {i: [] for i, _ in docs}
    for d, a, b in spans:
        found[d].append({"start": a, "end": b})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([texts[i] for i in found]), pa.array(list(found.values()), kind)], ["doc_id", "text", "spans"])
    return [(r["n_removed"], r["n_spans"]) for b in suffix._remove(iter([out])) for r in b.to_pylist()]


def test_many_texts_under_one_id(spark):
    """Texts without an id, or under one id, whose hashes once met in few bits: each keeps its own bytes."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghij ") for _ in range(30))
    rows = [(None if k % 2 else 7, "".join(word() for _ in range(draw.randint(3, 5)))) for k in range(3000)]
    rows += [(i, t + t) for i, t in rows[:40]] + [(9, rows[0][1] + rows[1][1])]
    assert sum(g[2] for g in check_removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) > 0


def test_texts_of_one_id_that_agree_in_few_bits(spark):
    """Two texts of one id with equal low bits of their hash; only the one that repeats itself loses bytes."""
    seen, pair = {}, None
    for k in range(20_000):
        text = f"{k} " + "".join(chr(97 + (k * 7 + j * j * 31 + j * k) % 26) for j in range(138))
        low = xxhash.xxh64(text.encode(), 42).intdigest() & ((1 << 22) - 1)
        if low in seen:
            pair = (seen[low], text)
            break
        seen[low] = text
    assert pair
    check_removal(spark.createDataFrame([(None, pair[0]), (None, pair[1]), (None, pair[1] * 3)], "doc_id long, text string"))


def brute_contained(docs, items):
    out = set()
    for i, t in items:
        s = shingles(t)
        for d, u in docs:
            n = len(s & shingles(u))
            if s and 100 * n >= 75 * len(s):
                out.add((d, i, n, len(s)))
    return out


def test_contained_items_against_brute_force(spark, data, docs, plain):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    want = brute_contained(plain.items(), [(r.item_id, r.text) for r in items.collect()])
    assert {tuple(r) for r in decontam.contained_items(docs, items).collect()} == want and want
    assert {tuple(r) for r in decontam.contained_items(docs, items, block=7).collect()} == want
    assert decontam.clean(docs, items).count() == len(plain) - len({w[0] for w in want})


def test_clean_judges_rows_by_themselves(spark):
    """Null and repeated ids, columns of clashing names, items in one block and in several."""
    item = " ".join(f"i{k}" for k in range(30))
    rows = [(None, "x " + item, 1), (None, "harmless text", 2), (5, item, 3), (5, "harmless", 4), (6, None, 5), (7, "", 6), (5, item, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item), (2, "some other item of eight words in all"), (3, None)], "item_id long, text string")
    want = sorted((r for r in rows if r[2] in (2, 4, 5, 6)), key=repr)
    for got in (decontam.clean(docs, items), decontam.clean(docs, items, 1)):
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=repr) == want
    assert decontam.clean(docs, items.limit(0)).count() == len(rows) and decontam.clean(docs.limit(0), items).count() == 0
    found = sorted((tuple(r) for r in decontam.contained_items(docs, items).collect()), key=repr)
    assert found == sorted([(None, 1, 26, 26), (5, 1, 26, 26), (5, 1, 26, 26)], key=repr)


def test_scattered_and_short_items(spark, messy, none):
    item = [f"i{k}" for k in range(40)]
    filler = [f"f{k}" for k in range(700)]
    spread = " ".join([*item[:20], *filler, *item[16:]])
    docs = [(1, spread), (2, " ".join(filler)), (3, "two words"), (4, " ".join(item[:25])), (5, None), (6, "")]
    items = [(0, " ".join(item)), (1, "Two Words"), (2, None), (3, ""), (4, " ".join(item)), (5, "words two")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contained(docs, items)
    assert {(w[0], w[1]) for w in want} == {(1, 0), (1, 4), (3, 1)}
    assert {tuple(r) for r in decontam.contained_items(a, b).collect()} == want
    assert decontam.contained_items(a, b.limit(0)).count() == 0 and decontam.contained_items(none, b).count() == 0
    assert decontam.clean(messy, b).count() == len(MESSY) - 1 and decontam.clean(messy, b).columns == messy.columns


def test_files_of_suffix_arrays(spark, monkeypatch):  # noqa: F811
    """What is checkpointed and returned is in few files, however many partitions the shuffles have."""
    made, cut = [], suffix.cut
    monkeypatch.setattr(suffix, "cut", lambda df: made.append(df.rdd.getNumPartitions()) or cut(df))
    text = "".join(f"{i} times {i * i}, " for i in range(60))
    docs = spark.createDataFrame([(i, text[i:]) for i in range(6)], "doc_id long, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = suffix.deduplicated(docs)
        assert [r.n_removed for r in out.orderBy("doc_id").collect()] == [0] + [len(text) - i for i in range(1, 6)]
        assert max(*made, out.rdd.getNumPartitions()) <= 12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
