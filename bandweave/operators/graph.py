"""Nearest-neighbour graphs and personalised PageRank over edge tables (src, dst, w)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import dot
from ..plans.stages import cut
from .blocks import Side, block_pairs
from .similarity import DIGITS, _matrix, _pieces, half_up, measures, ranked, top_k

#: Edges up to which PageRank runs in one task, 24 bytes each; beyond it runs as joins.
LOCAL_EDGES = 4_000_000
#: Tasks that hold the edges, edges that travel in one row, and runs that such a task takes together.
GROUPS, EDGES, RUNS = 24, 262_144, 32


def knn_edges(sim: DataFrame, k: int) -> DataFrame:
    """src, dst, w: the k largest scores of each row i of sim (i, j, score); ties go to the smaller j."""
    order = W.partitionBy("i").orderBy(F.col("score").desc(), "j")
    best = sim.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("score").alias("w"))


def nearest_edges(objects: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """knn_edges() of the cosines of vectors (id, vec), without the table of all pairs: each task keeps the k best of its blocks."""
    top = top_k(objects, objects, "cosine", k, exclude_self, dict(objects.dtypes)["id"])
    return top.select(F.col("query_id").alias("src"), F.col("object_id").alias("dst"), F.col("score").alias("w"))


def edges_with(edges: DataFrame, node, scores: DataFrame, k: int) -> DataFrame:
    """nearest_edges() of a table with one more node, from those of the others (exclude_self) and its scores with them (id, w): no
    pair of the others is compared again."""
    into = scores.select(F.col("id").alias("i"), F.lit(node).cast(dict(edges.dtypes)["dst"]).alias("j"), F.col("w").alias("score"))
    held = knn_edges(edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("score")).unionByName(into), k)
    own = scores.orderBy(F.col("w").desc(), "id").limit(k).select(F.lit(node).cast(dict(edges.dtypes)["src"]).alias("src"), F.col("id").alias("dst"), "w")
    return held.unionByName(own)


def knn_edges_by_place(sim: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """The truncation that reads ranks as places: with nodes numbered from 0 in id order, cell (i, c) stays if the node at
    ascending place c of row i has a number above n - k (from n - k on, if not strict). Kept for comparison only."""
    nodes = sim.select(F.col("j").alias("id")).distinct()
    n = nodes.count()
    number = sim.where(F.col("i") == F.col("j")).select(F.col("i").alias("id"))
    number = nodes.join(number, "id").withColumn("no", F.row_number().over(W.orderBy("id")) - 1)  # one row for each node
    placed = sim.withColumn("place", F.row_number().over(W.partitionBy("i").orderBy("score", "j")) - 1)
    limit = n - k if strict else n - k - 1
    at = placed.join(number.withColumnRenamed("id", "j"), "j").where(F.col("no") > limit).select("i", F.col("place").alias("no"))
    cells = at.join(number.withColumnRenamed("id", "j"), "no").select("i", "j")
    return sim.join(cells, ["i", "j"]).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("score").alias("w"))


def place_edges(objects: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """knn_edges_by_place() of the cosines of vectors (id, vec), without the table of all pairs.

    Only the places of the nodes with the largest numbers are asked for: each pair of blocks counts, for each row and each of
    them, the scores before it, and the counts add up to its place. The driver holds these k vectors.
    """
    objects = objects.select("id", "vec")
    kind = dict(objects.dtypes)["id"]
    last = sorted((r.id, r.vec) for r in objects.orderBy(F.col("id").desc()).limit(k - 1 if strict else k).collect())
    ends, vecs = np.array([i for i, _ in last]), np.array([v for _, v in last], np.float64)

    def before(left: Side, right: Side):
        ids, others = np.asarray(left["id"]), np.asarray(right["id"])
        by_id = np.argsort(others, kind="stable")
        a, b, others = _matrix(left), _matrix(right)[by_id], others[by_id]
        wanted = np.round(measures(a, vecs, "cosine"), DIGITS) if len(ends) else np.zeros((len(a), 0))
        # equal scores count up to the node's own place by id, smaller ones on both sides of it
        place = list(zip(np.searchsorted(others, ends), np.searchsorted(others, ends, "right"))) if len(ends) else []
        for piece in _pieces(len(ids), len(others)):
            scores = np.round(measures(a[piece], b, "cosine"), DIGITS)
            n = [[np.count_nonzero(row[:p] <= x) + np.count_nonzero(row[q:] < x) for x, (p, q) in zip(own, place)] for row, own in zip(scores, wanted[piece])]
            yield {"src": np.repeat(ids[piece], len(ends)), "end": np.tile(np.arange(len(ends)), len(scores)), "no": np.array(n, np.int64).ravel()}

    places = block_pairs(objects, objects, "id", before, f"src {kind}, end long, no long").groupBy("src", "end").agg(F.sum("no").alias("no"))
    number = objects.select("id").withColumn("no", F.row_number().over(W.orderBy("id")) - 1)  # one row for each node
    cells = places.join(number.select(F.col("id").alias("dst"), "no"), "no").select("src", "dst")
    pairs = cells.join(objects.select(F.col("id").alias("src"), F.col("vec").alias("a")), "src").join(objects.select(F.col("id").alias("dst"), F.col("vec").alias("b")), "dst")
    length = F.sqrt(dot(F.col("a"), F.col("a"))) * F.sqrt(dot(F.col("b"), F.col("b")))
    return pairs.select("src", "dst", F.round(F.coalesce(F.try_divide(dot(F.col("a"), F.col("b")), length), F.lit(0.0)), DIGITS).alias("w"))


def column_normalised(edges: DataFrame, offset: float = 1e-7) -> DataFrame:
    """Weights divided by the sum of their column (dst) plus a small offset."""
    total = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    return edges.join(total, "dst").select("src", "dst", (F.col("w") / (F.col("total") + offset)).alias("w"))


def _layers(src: np.ndarray, dst: np.ndarray, w: np.ndarray, rows: int = 2_048) -> list[tuple]:
    """Edges, sorted by src, in parts that each have a row at most once: the first edges of a range of rows, their second ones, and
    so on, so that a part is added at once and stays near the core. Rows are a slice where none is missing."""
    layer = np.arange(len(src)) - np.searchsorted(src, src)
    order = np.lexsort((src, layer, src // rows))
    src, dst, w, layer = src[order], dst[order], w[order], layer[order]
    ends = np.flatnonzero(np.r_[(layer[1:] != layer[:-1]) | (src[1:] // rows != src[:-1] // rows), True][: len(src)]) + 1
    out = []
    for begin, end in zip(np.r_[0, ends[:-1]], ends):
        own = src[begin:end]
        whole = own[-1] - own[0] + 1 == len(own)
        out.append((slice(own[0], own[-1] + 1) if whole else own, dst[begin:end], w[begin:end, None]))
    return out


def _widths(n: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


#: Rounds that are pushed from a run's seeds before all nodes are worked on.
PUSHED = 4
#: For votes: rounds that are pushed, and those that are then pulled to the nodes that may be among a run's best, as long as that leaves
#: it open; and how many nodes are asked for at most.
STEPS, CONTESTED = ((4, 3), (5, 4)), 400
#: Added to every bound on scores, more than the error of adding them up.
NOISE = 1e-13


class _Walk:
    """PageRank rounds of single runs over edges sorted by src, whose weights include 1 - restart: pushed from the few nodes that a
    run has reached, or pulled to the few that are asked for."""

    def __init__(self, nodes: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, restart: float, rounds: int):
        self.nodes, self.src, self.dst, self.w, self.restart, self.rounds = nodes, src, dst, w, restart, rounds
        by_dst = np.argsort(dst, kind="stable")
        self.to, self.push, self.ends = src[by_dst], w[by_dst], np.searchsorted(dst[by_dst], np.arange(nodes + 1))
        self.begins = np.searchsorted(src, np.arange(nodes + 1))
        # what a change of at most 1 everywhere can still come to at a node in the rounds after it, the first m left out
        self.left, step = np.zeros((max(m for _, m in STEPS) + 1, nodes)), np.ones(nodes)
        for n in range(rounds):
            step = np.bincount(src, w * step[dst], minlength=nodes)
            self.left[: n + 1] += step

    def pushed(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The next round's scores."""
        held = np.flatnonzero(u)
        n = self.ends[held + 1] - self.ends[held]
        at = np.repeat(self.ends[held], n) + _widths(n)
        return np.bincount(self.to[at], self.push[at] * np.repeat(u[held], n), minlength=self.nodes) + v

    def pulled(self, u: np.ndarray, v: np.ndarray, asked: np.ndarray, rounds: int) -> np.ndarray:
        """The scores of the nodes asked for, `rounds` rounds later."""
        if not rounds:
            return u[asked]
        n = self.begins[asked + 1] - self.begins[asked]
        at = np.repeat(self.begins[asked], n) + _widths(n)
        if rounds == 1:
            known = u[self.dst[at]]
        else:
            others, place = np.unique(self.dst[at], return_inverse=True)
            known = self.pulled(u, v, others, rounds - 1)[place]
        return np.bincount(np.repeat(np.arange(len(asked)), n), self.w[at] * known, minlength=len(asked)) + v[asked]


def _best(score: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """The k of the held nodes with the largest scores; ties go to the smaller."""
    if len(held) > k:
        least = np.partition(score[held], len(held) - k)[len(held) - k]
        above = held[score[held] > least]
        held = np.r_[above, held[score[held] == least][: k - len(above)]]
    return held


def _settled(score: np.ndarray, gap: np.ndarray, asked: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The k asked nodes with the largest rounded scores and these, if scores that may still change by gap have settled them."""
    large = np.flatnonzero(asked & (score > 1e3 * 10.0**-digits))
    if len(large) <= k:  # the k-th of fewer nodes only makes the bound weaker
        large = np.flatnonzero(asked)
    if len(large) <= k:
        return None
    least = np.partition(score[large] - gap[large], len(large) - k)[len(large) - k] - NOISE
    may = np.flatnonzero(asked & (score + gap >= least - 1.1 * 10.0**-digits))
    low, high = half_up(score[may] - gap[may] - NOISE, digits), half_up(score[may] + gap[may] + NOISE, digits)
    if half_up(least, digits) <= 0 or (low != high).any():
        return None
    best = _best(low, np.arange(len(may)), k)
    return may[best], low[best]


def _elected(walk: _Walk, seeds: np.ndarray, voters: np.ndarray, classes: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The k voters with the largest scores and their scores, as far as needed to know for certain who they are and which class wins
    by number and by the sum of rounded scores; None if that takes more rounds. classes: of the voters, numbered."""
    if len(voters) <= k:
        return None
    last, u, v, done = None, seeds, walk.restart * seeds, 0
    for pushed, pulled in STEPS:
        if pushed + pulled > walk.rounds:
            return None
        for done in range(done + 1, pushed + 1):
            last, u = u, walk.pushed(u, v)
        moved, own = np.abs(u - last).max(), u[voters]
        gap = moved * walk.left[0][voters] + NOISE
        large = own > 1e3 * 10.0**-digits
        if np.count_nonzero(large) <= k:
            continue
        least = np.partition(own[large] - gap[large], -k)[-k]
        may = np.flatnonzero(own + gap >= least - 1.1 * 10.0**-digits)
        if len(may) > CONTESTED:
            continue
        asked = voters[may]
        score = walk.pulled(u, v, asked, pulled)
        gap = moved * walk.left[pulled][asked] + NOISE
        low, high = half_up(score - gap, digits), half_up(score + gap, digits)
        order = np.lexsort((asked, -score))
        first, rest = order[:k], order[k:]
        if low[first].min() <= 0 or high[rest].max(initial=0.0) >= low[first].min():
            continue
        group = classes[may[first]]
        lows, highs = np.bincount(group, low[first]), np.bincount(group, high[first])
        most = lows.argmax()
        if (np.delete(highs, most) < lows[most] - 2e-9).all():
            return asked[first], half_up(score[first], digits)
    return None


def _local(restart: float, rounds: int, k: int | None, digits: int, votes: bool = False):
    def run(edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([edges.src.to_numpy(), edges.dst.to_numpy(), seeds.node.to_numpy()]))
        asked, voters = np.ones(len(nodes), bool), None
        if "among" in edges and len(edges):
            marks = edges.among.to_numpy(bool)
            asked[:] = False
            at = np.searchsorted(nodes, edges.src.to_numpy()[marks])
            asked[at] = True
            if votes:  # the weight of a mark is its class
                voters, first = np.unique(at, return_index=True)
                classes = np.unique(edges.w.to_numpy()[marks][first], return_inverse=True)[1]
            edges = edges[~marks]
        edges = edges.sort_values("src", kind="stable")
        src, dst = np.searchsorted(nodes, edges.src.to_numpy()), np.searchsorted(nodes, edges.dst.to_numpy())
        w = edges.w.to_numpy() * (1 - restart)
        parts = _layers(src, dst, w)
        # bounds hold for weights that aren't negative
        walk = _Walk(len(nodes), src, dst, w, restart, rounds) if k is not None and len(seeds) and (w >= 0).all() else None
        largest = walk.left[0].max(initial=0.0) if walk is not None else 0.0
        names, number = np.unique(seeds.run.to_numpy(), return_inverse=True)
        own = seeds.assign(number=number, at=np.searchsorted(nodes, seeds.node.to_numpy())).sort_values("number", kind="stable")
        begins = np.searchsorted(own.number.to_numpy(), np.arange(len(names) + 1))
        places, shares = own["at"].to_numpy(), own.p.to_numpy()
        out = []

        def told(name, held: np.ndarray, score: np.ndarray) -> None:
            out.append((name, nodes[held], score))

        def seeded(number: int) -> np.ndarray:
            mine = slice(begins[number], begins[number + 1])
            return np.bincount(places[mine], shares[mine], minlength=len(nodes))

        open_runs = np.arange(len(names))
        if walk is not None and voters is not None:
            unsure = []
            for number in open_runs:
                found = _elected(walk, seeded(number), voters, classes, k, digits)
                if found is None:
                    unsure.append(number)
                else:
                    told(names[number], *found)
            open_runs = np.array(unsure, np.int64)
        for first in range(0, len(open_runs), RUNS):
            mine = open_runs[first : first + RUNS]
            own_seeds = [seeded(number) for number in mine]
            v, begun = restart * np.stack(own_seeds, axis=1), 0
            if walk is not None and begins[-1] <= 16 * len(names):  # few nodes are reached at first
                begun = min(PUSHED, rounds)
                for place, score in enumerate(own_seeds):
                    for _ in range(begun):
                        score = walk.pushed(score, restart * seeded(mine[place]))
                    own_seeds[place] = score
            u = np.stack(own_seeds, axis=1)
            for done in range(begun + 1, rounds + 1):
                after = v.copy()
                for rows, others, weight in parts:
                    after[rows] += np.take(u, others, axis=0) * weight
                last, u = u, after
                if walk is None or done <= PUSHED or done == rounds:
                    continue
                moved, open_places = np.abs(u - last).max(0), []
                for place, number in enumerate(mine):
                    found = None
                    if moved[place] * largest < 0.02 * 10.0**-digits:
                        found = _settled(u[:, place].copy(), moved[place] * walk.left[0], asked, k, digits)
                    if found is None:
                        open_places.append(place)
                    else:
                        told(names[number], *found)
                if len(open_places) < len(mine):
                    mine, u, v = mine[open_places], u[:, open_places].copy(), v[:, open_places].copy()
                if not len(mine):
                    break
            for place, number in enumerate(mine):
                score = u[:, place]
                held = np.flatnonzero((score > 0) & asked)
                if k is not None:
                    score = half_up(score, digits)
                    held = _best(score, held, k)
                told(names[number], held, score[held])
        if not out:
            return pd.DataFrame({"run": [], "node": [], "score": []})
        found, held, score = zip(*out)
        return pd.DataFrame({"run": np.repeat(np.array(found), [len(x) for x in held]), "node": np.concatenate(held), "score": np.concatenate(score)})

    return run


def pagerank(edges: DataFrame, seeds: DataFrame, restart: float, rounds: int, local_edges: int = LOCAL_EDGES, check_every: int = 5, k: int | None = None, digits: int = 8, among: DataFrame | None = None, votes: bool = False) -> DataFrame:
    """run, node, score: personalised PageRank u = (1 - restart) A u + restart v for each run, after a fixed number of rounds.

    edges: normalised (src, dst, w), A[src, dst] = w. seeds: run, node, p with p summing to 1 in a run. All runs share one
    frame keyed by (run, node). Small graphs (the number of edges is checked) go through in numpy, a task for each group of
    runs; larger ones as a join and an aggregate for each round, checkpointed every few rounds. Scores of 0 are left out.
    With k, the k best nodes of each run by their scores rounded to `digits`, which are returned; ties go to the smaller node; of
    the nodes `among` (node) if given. Small graphs then send no other scores, and leave out a run's further rounds where bounds
    prove that they can't change what it returns. With votes, among has a class too, and what they can't change is which nodes
    are returned and which class wins by number and by the sum of rounded scores to nine digits; the scores may still change.
    """
    kind = dict(edges.dtypes)["src"]
    schema = f"run {dict(seeds.dtypes)['run']}, node {kind}, score double"
    n_edges = edges.limit(local_edges + 1).count()
    if n_edges <= local_edges:
        # the edge table is bounded, so each group of runs reads all of it
        groups = max(1, seeds.select("run").distinct().limit(GROUPS).count())
        spread = seeds.select("run", "node", "p", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int").alias("g")).repartitionById(groups, "g")
        spread = spread.groupBy("g").agg(F.collect_list(F.struct("run", "node", "p")).alias("seeds"))
        held = edges.select("src", "dst", "w")
        if among is not None:  # a further edge marks a node
            mark = F.coalesce(F.col("class").cast("double"), F.lit(float("nan"))) if votes else F.lit(0.0)
            marks = among.select(F.col("node").alias("src"), F.col("node").alias("dst"), mark.alias("w"), F.lit(True).alias("among"))
            held = held.withColumn("among", F.lit(False)).unionByName(marks)
        rows = F.collect_list(F.struct(*held.columns)).alias("edges")
        if n_edges <= EDGES:
            parts = held.agg(rows)  # a row even without edges
        else:  # shuffled once; each group reads the rows of all parts
            slots = -(-n_edges // EDGES)
            parts = held.withColumn("slot", F.pmod(F.xxhash64("src", "dst"), F.lit(slots)).cast("int")).repartitionById(slots, "slot").groupBy("slot").agg(rows).coalesce(1)
        run = _local(restart, rounds, k, digits, votes)

        def in_groups(batches):
            seeded, parts = {}, {}
            for batch in batches:
                for g, own, part in zip(batch.column("g").to_pylist(), batch.column("seeds"), batch.column("edges")):
                    seeded.setdefault(g, own.values)
                    parts.setdefault(g, []).append(part.values)
            frame = lambda rows: pd.DataFrame({f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(rows.type, rows.flatten())})
            batch = part = None  # the copy is enough
            for g, own in seeded.items():
                rows = pa.concat_arrays(parts.pop(g))
                types = own.type.field("run").type, rows.type.field("src").type, pa.float64()
                rows = frame(rows)
                out = run(rows, frame(own))
                if len(out):
                    yield pa.RecordBatch.from_arrays([pa.array(out[c].to_numpy(), type=t) for c, t in zip(out.columns, types)], ["run", "node", "score"])

        return parts.select("edges").hint("shuffle_replicate_nl").crossJoin(spread).mapInArrow(in_groups, schema)
    edges = cut(edges)
    v = cut(seeds.groupBy("run", "node").agg(F.sum("p").alias("p")))
    u = v.withColumnRenamed("p", "score")
    for n in range(1, rounds + 1):
        moved = u.join(edges, u["node"] == edges["dst"]).select("run", F.col("src").alias("node"), (F.col("score") * F.col("w") * (1 - restart)).alias("score"))
        u = moved.unionByName(v.select("run", "node", (F.col("p") * restart).alias("score"))).groupBy("run", "node").agg(F.sum("score").alias("score"))
        if n % check_every == 0:
            u = cut(u)
    if k is None:
        return u
    u = u.where("score > 0") if among is None else u.where("score > 0").join(among.select("node"), "node", "left_semi")
    return ranked(u.select("run", "node", F.round("score", digits).alias("score")), k, False, "run", "node").select("run", "node", "score")


def uniform_seeds(nodes: DataFrame) -> DataFrame:
    """run, node, p with the same p for all nodes of a run. nodes: run, node (repeats count once)."""
    nodes = nodes.select("run", "node").distinct()
    return nodes.withColumn("p", 1.0 / F.count("*").over(W.partitionBy("run")))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """run and the sum of absolute differences of two score tables."""
    a, b = before.withColumnRenamed("score", "x"), after.withColumnRenamed("score", "y")
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return a.join(b, ["run", "node"], "full").groupBy("run").agg(F.sum(gap).alias("change"))


def with_refreshed(sim: DataFrame, fresh: DataFrame) -> DataFrame:
    """sim with the rows and columns of the nodes in fresh (i, j, score) replaced by it, in both directions."""
    nodes = fresh.select(F.col("i").alias("node")).distinct()
    kept = sim.join(nodes, sim["i"] == nodes["node"], "left_anti").join(nodes, F.col("j") == nodes["node"], "left_anti")
    back = fresh.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "score")
    return kept.unionByName(fresh).unionByName(back).dropDuplicates(["i", "j"])
