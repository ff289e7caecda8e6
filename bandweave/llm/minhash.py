"""Near-duplicate classes: MinHash with banding, exact verification, and components by large-star and small-star.

1. A text's set is its distinct 5-word shingles (64-bit hashes). Texts with equal sets form one class, which is a node with a
   number; only one text of a class goes on.
2. A signature holds the minima of 240 universal hash functions. 48 bands of 5 minima each give bucket keys; a pair at
   similarity 0.75 shares no band with probability (1 - 0.75**5)**48 = 2e-6.
3. Candidates. First each member of a bucket is paired with the bucket's smallest node (a star, not all pairs). Then, in buckets
   whose members are still in several components, the members outside the largest one are compared, block by block, with all
   members by signature. Members that
   agree often enough with one of another component meet once more with their full sets; pairs are tried by falling
   agreement until what remains lies inside one component, so a cell of n members gives fewer than n links, and no link
   between components is missed.
4. Every candidate is confirmed on the full shingle sets before it counts.
5. Components come from alternating large-star and small-star steps until nothing changes; only counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bytes_of, cut, mix64, shingle_hashes, small_batches, spread_join, word_hashes

WIDTH, PERCENT = 5, 75
BANDS, ROWS = 48, 5
#: Members of a bucket that one task compares with as many others, and the shingles of members that meet with their full sets
#: (a single larger set is a block of its own).
BLOCK, BLOCK_SHINGLES = 512, 1 << 18
#: Rows of one key that a task may read; where a key has more, its rows are dealt out by a salt.
HOT_ROWS = 50_000
#: Standard deviations below the expected agreement at which a signature still leaves a pair to the exact check.
SLACK = 5.0


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
    a, b = seeds[::2], seeds[1::2]
    return (a >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (b >> np.uint64(32)).astype(np.uint32)


def least_agreement() -> int:
    """Equal minima of BANDS * ROWS below which a pair at the threshold is practically never found."""
    n, p = BANDS * ROWS, PERCENT / 100
    return int(n * p - SLACK * (n * p * (1 - p)) ** 0.5)


def minima(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The signature of each run of shingles that begins at `starts` (no run may be empty): the low 16 bits of each minimum.
    They are only compared for equality, and differing minima agree in them once in 65,536 times."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    a, b = _coefficients()
    out = np.empty((len(starts), len(a)), np.uint16)
    work = np.empty_like(x)
    for j in range(len(a)):
        np.multiply(x, a[j], out=work)
        np.add(work, b[j], out=work)
        out[:, j] = np.minimum.reduceat(work, starts).astype(np.uint16)
    return out


def _sets(batch: pa.RecordBatch, text: str) -> tuple[list[np.ndarray], np.ndarray]:
    data, offsets = bytes_of(batch.column(batch.schema.names.index(text)))
    words, at = word_hashes(data, offsets)
    shingles, at = shingle_hashes(words, at, WIDTH)
    return [np.unique(shingles[i:j]) for i, j in zip(at[:-1], at[1:])], at


def _set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, as rows (0 for an empty set), and the sets' sizes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    keys = np.zeros((2, len(sets)), np.uint64)
    if len(full):
        joined, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
        keys[0, full] = np.add.reduceat(mix64(joined), starts)
        keys[1, full] = np.add.reduceat(mix64(joined ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return keys.view(np.int64), sizes


def _signatures(batches):
    """Batches of (doc_id, a, b, text): the row's name, its set's size and keys, and its signature."""
    for batch in batches:
        for piece in blocks([batch], "text", 1 << 18):
            sets, _ = _sets(piece, "text")
            keys, sizes = _set_keys(sets)
            full = np.flatnonzero(sizes)
            rows: list = [None] * len(sets)
            if len(full):
                joined, starts = np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]
                for d, row in zip(full, minima(joined, starts)):
                    rows[d] = row.tobytes()
            columns = [*piece.columns[:3], pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "n_shingles", "k1", "k2", "signature"])


def _bands(batches):
    """A row for each band of each signature: the key, and the id."""
    for batch in batches:
        signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        key = np.zeros(signature.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for j in range(ROWS):
            key = mix64(key + signature[:, :, j].astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "id"])


def _shingle_sets(batches):
    """Batches of (id, text): each id with its full set."""
    for batch in batches:
        for piece in blocks([batch], "text"):
            sets, _ = _sets(piece, "text")
            at = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            column = pa.ListArray.from_arrays(pa.array(at), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column(0), column], ["id", "shingles"])


def _sides(batch: pa.RecordBatch):
    """The cells of a batch: key, and for either side a list of columns, signatures as a matrix."""
    for key, *cell in zip(*batch.columns):
        sides = []
        for side in cell:
            ids, comps, signatures, *rest = side.values.flatten()
            signatures = np.frombuffer(b"".join(signatures.to_pylist()), np.uint16).reshape(len(ids), -1)
            sides.append([ids.to_numpy(zero_copy_only=False), comps.to_numpy(zero_copy_only=False), signatures, *rest])
        yield key, *sides


def _agreeing(a: list, b: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of pairs of different components, one on each side, whose signatures agree often enough; and the equal minima."""
    least, found = least_agreement(), [(np.zeros(0, np.int64),) * 3]
    for i in range(len(a[0])):
        near = np.flatnonzero(b[1] != a[1][i])
        if len(near):
            equal = (b[2][near] == a[2][i]).sum(1)
            enough = equal >= least
            found.append((np.full(int(enough.sum()), i), near[enough], equal[enough]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _promising(batches):
    """key, id of the members of a cell that agree often enough with one of another component."""
    for batch in batches:
        for key, a, b in _sides(batch):
            i, j, _ = _agreeing(a, b)
            if len(i):
                ids = np.unique(np.concatenate([a[0][i], b[0][j]]))
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(ids)), pa.array(ids)], ["key", "id"])


def _linked(batches):
    """Confirmed links between the components of a cell, as a forest: pairs are tried by falling agreement, and one that lies
    inside what earlier links have joined adds nothing. A cell of n members gives fewer than n links."""
    for batch in batches:
        out: list[tuple[int, int]] = []
        for _, a, b in _sides(batch):
            i, j, equal = _agreeing(a, b)
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while root.get(c, c) != c:  # noqa: B023
                    root[c] = c = root.get(root[c], root[c])  # noqa: B023
                return c

            sets: list[dict[int, frozenset]] = [{}, {}]

            def held(side: int, place: int) -> frozenset:
                if place not in sets[side]:  # noqa: B023
                    sets[side][place] = frozenset((a, b)[side][3][place].values.to_numpy().tolist())  # noqa: B023
                return sets[side][place]  # noqa: B023

            order = np.lexsort((j, i, -equal))
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                ca, cb = find(int(a[1][x])), find(int(b[1][y]))
                if ca != cb:
                    sa, sb = held(0, x), held(1, y)
                    common = len(sa & sb)
                    if common * 100 >= (len(sa) + len(sb) - common) * PERCENT:
                        root[max(ca, cb)] = min(ca, cb)
                        out.append((int(a[0][x]), int(b[0][y])))
        columns = list(zip(*out)) if out else [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold; sets: (id, shingles).

    The side that differs from pair to pair is joined first, so that a much linked id meets rows as large as the sets they
    carry and the join's skew handling can split them.
    """
    one = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    other = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa").cast("long") + F.size("sb") - common
    return pairs.join(one, "b").join(other, "a").where(common * 100 >= union * percent).select("a", "b")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in the links; component is the smallest id that can be reached.

    Large-star links each larger neighbour to the smallest of a node's neighbourhood, small-star does so for the smaller
    ones; both keep the components. Each step is an aggregate and a join on the node; where a node has more than HOT_ROWS edges,
    they are dealt out by a salt. It ends when every edge points to a node that points nowhere itself.
    """

    def star(edges: DataFrame, large: bool, hot: bool) -> DataFrame:
        # edges point from the larger id u to the smaller id v
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = edges.unionByName(turned) if large else edges
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = spread_join(around, least, ["u"], ["v"]) if hot else around.join(least, "u")
        if large:
            moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v")

    def state(edges: DataFrame) -> tuple[bool, bool]:
        """Whether some node points to two others, or points and is pointed to; and whether some node has many edges."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("out")), F.struct(F.col("v").alias("id"), F.lit(0).alias("out"))))).select("col.*")
        nodes = ends.groupBy("id").agg(F.sum("out").alias("out"), F.count("*").alias("n"))
        got = nodes.agg(F.bool_or((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("n") > F.col("out")))), F.max("n")).first()
        return bool(got[0]), (got[1] or 0) > HOT_ROWS

    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while (now := state(edges))[0]:
        edges = cut(star(star(edges, True, now[1]), False, now[1]).distinct())
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _linked_rows(docs: DataFrame) -> DataFrame:
    """doc_id, a, b (two hashes of the text), n_shingles and first for every row of docs (doc_id, text). Rows with a, b and a doc_id
    as in first (none: the doc_id is null, doc_id, a, b) stand for the rows that are linked to them, which have the same first: the
    smallest doc_id, null being the largest. A row without shingles is linked to none and has no first."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, a long, b long, n_shingles long, k1 long, k2 long, signature binary"
    every = cut(docs.mapInArrow(_signatures, schema))
    real = every.where("n_shingles > 0")
    key = ["k1", "k2", "n_shingles"]
    classes = real.groupBy(*key).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b", "signature")).alias("x"), F.count("*").alias("rows"))
    # a node's number follows its smallest doc_id, since the first of near texts is often the one that the others come from; where
    # doc_ids are missing or repeat, numbers are given in that order (in a written table: the same wherever it is read)
    unique = every.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    classes = classes.select(*key, "rows", "x.none", "x.doc_id", "x.a", "x.b", "x.signature")
    if unique:
        classes = cut(classes.withColumn("id", F.col("doc_id")))
    else:
        ordered = classes.repartitionByRange("none", "doc_id", "a", "b").sortWithinPartitions("none", "doc_id", "a", "b")
        classes = cut(ordered.withColumn("id", F.monotonically_increasing_id()))
    every = cut(every.drop("signature"))
    # of equal rows one is as good as all
    repeated = not unique and not every.groupBy("doc_id", "a", "b").count().where("count > 1").isEmpty()
    # exact classes need no candidates of their own: their members share a node
    keyed = classes.select("id", "signature").mapInArrow(_bands, "key long, id long")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    members = cut(keyed.join(hubs, "key"))

    signatures = classes.select("id", "signature", "n_shingles")
    named = classes.select("id", F.col("doc_id").alias("of"), F.col("a").alias("ka"), F.col("b").alias("kb"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """id, shingles of the wanted nodes (id)."""
        if unique:
            texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
        else:
            asked = named.join(wanted, "id", "left_semi")
            texts = docs.join(asked, F.col("of").eqNullSafe(F.col("doc_id")) & (F.col("ka") == F.col("a")) & (F.col("kb") == F.col("b"))).select("id", "text")
        return (texts.dropDuplicates(["id"]) if repeated else texts).mapInArrow(_shingle_sets, "id long, shingles array<long>")

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        return verified(pairs, sets_of(wanted))

    first = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    small = signatures.select("id", F.col("n_shingles").alias("n"))
    first = first.join(small.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    first = first.join(small.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
    first = first.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b")
    links = cut(confirm(cut(first)))
    found = cut(components(links))

    # buckets that still hold several components; a bucket of two is settled by the star
    placed = members.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("c", "n").alias("main"))
    mixed = mixed.where("parts > 1 and n > 2").select("key", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("n") / BLOCK).cast("int").alias("many"))
    rows = cut(placed.join(mixed, "key").join(signatures, "id"))

    def cells(rows: DataFrame, *columns: str) -> DataFrame:
        """key, x, y: blocks of the members outside a bucket's largest component, each with every block of the bucket."""

        def blocks_of(own: DataFrame, count: str, place: str, other_count: str, other: str, name: str) -> DataFrame:
            dealt = own.withColumn(place, F.pmod(F.xxhash64("id"), F.col(count)).cast("int"))
            dealt = dealt.groupBy("key", place, other_count).agg(F.collect_list(F.struct("id", "c", "signature", *columns)).alias(name))
            return dealt.select("key", place, F.explode(F.sequence(F.lit(0), F.col(other_count) - 1)).alias(other), name)

        small = blocks_of(rows.where("c <> main"), "few", "i", "many", "j", "x")
        return small.join(blocks_of(rows, "many", "j", "few", "i", "y"), ["key", "i", "j"]).select("key", "x", "y")

    small_batches(docs.sparkSession, 16)  # a cell holds up to two blocks
    promising = cut(cells(rows).mapInArrow(_promising, "key long, id long").distinct())
    near = cut(rows.select("key", "id", "c", "main", "n_shingles").join(promising, ["key", "id"], "left_semi"))
    # with their full sets, blocks are cut by the shingles they hold
    outside = F.col("c") != F.col("main")
    slots = lambda n, held: F.ceil(F.greatest(n / BLOCK, held / BLOCK_SHINGLES, F.lit(1))).cast("int")
    held = near.groupBy("key").agg(
        slots(F.count_if(outside), F.sum(F.when(outside, F.col("n_shingles")).otherwise(0))).alias("few"), slots(F.count("*"), F.sum("n_shingles")).alias("many")
    )
    whole = sets_of(promising.select("id").distinct()).join(signatures.drop("n_shingles"), "id")
    late = cells(near.join(held, "key").join(whole, "id"), "shingles")
    late = cut(late.mapInArrow(_linked, "a long, b long"))
    small_batches(docs.sparkSession)
    # the first links are contracted: each component is one node, so only what the late ones join is worked on
    name = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    late = late.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(late).select(F.col("id").alias("component"), F.col("component").alias("top"))
    nodes = classes.select("id", *key, F.struct("none", "doc_id", "a", "b").alias("own")).join(found, "id", "left")
    nodes = nodes.withColumn("component", F.coalesce("component", "id"))
    if joined.count() <= HOT_ROWS:  # few enough rows of two numbers to be sent to all tasks
        nodes = nodes.join(F.broadcast(joined), "component", "left")
    else:
        nodes = spread_join(nodes, joined, ["component"], ["id"], "left")
    nodes = cut(nodes.select("id", *key, "own", F.coalesce("top", "component").alias("root")))
    roots = nodes.groupBy("root").agg(F.min("own").alias("first"), F.count("*").alias("n"))
    many = lambda df, c: (df.agg(F.max(c)).first()[0] or 0) > HOT_ROWS
    if many(roots, "n"):
        nodes = spread_join(nodes, roots.drop("n"), ["root"], ["id"])
    else:
        nodes = nodes.join(roots.drop("n"), "root")
    nodes = nodes.select(*key, "first")
    rows = spread_join(every, nodes, key, ["doc_id", "a"], "left") if many(classes, "rows") else every.join(nodes, key, "left")
    return rows.select("doc_id", "a", "b", "n_shingles", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string; other columns are ignored).

    component_id is the smallest doc_id among the rows that a row is linked to, its own included, and kept is whether it is the row's
    own. Null or empty texts and texts without words have no shingles: component_id is their own doc_id and kept is true. Rows that
    repeat a doc_id are linked by their own texts and are each returned. A null doc_id is larger than any other: such a row has the
    component_id of the rows it is linked to and is not kept, or a null component_id and is kept. An empty table gives an empty
    result.
    """
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return _linked_rows(docs).select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of linked rows, and every row that is linked to none; all columns kept.

    Rows are told apart by their doc_id and text. Of a group the row with the smallest doc_id stays (a null doc_id is the largest),
    of several texts under that doc_id one, of equal rows one (any: only other columns can differ). Rows with null or empty texts, or
    texts without words, are linked to none and all stay. An empty table gives an empty result.
    """
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    told = cut(_linked_rows(docs).where("first is not null").select("doc_id", "a", "b", (name == F.col("first")).alias("stays")))
    dropped = told.where(~F.col("stays")).select("doc_id", "a", "b").distinct()
    again = told.where("stays").groupBy("doc_id", "a", "b").count().where("count > 1").drop("count")
    plain = docs.toDF(*[f"_column_{k}" for k in range(len(docs.columns))])
    column = lambda c: F.col(f"_column_{docs.columns.index(c)}")
    plain = plain.withColumn("_id", column("doc_id").cast("long")).withColumn("_a", F.xxhash64(column("text"))).withColumn("_b", F.xxhash64(F.lit(1), column("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    kept = plain.join(dropped, same, "left_anti")
    if not again.isEmpty():  # equal rows among those that stay: only these are gathered by their name
        once = kept.join(again, same, "left_semi").dropDuplicates(["_id", "_a", "_b"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.drop("_id", "_a", "_b").toDF(*docs.columns)
