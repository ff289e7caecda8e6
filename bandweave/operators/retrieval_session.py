"""Relevance-feedback sessions over dense vectors: four searches with two rewritten queries each, and a choice among them.

A session's state is immutable; step() takes a judge and returns the next state. What the driver holds is the query vectors,
the judged objects of a round (at most k) and counts by dimension; vectors stay tables, and no table of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import dot, normalised
from ..plans.stages import cut
from . import graph, lsh, similarity
from .feedback import HIGH, LOW

KINDS = ("vect", "prob")
METHODS = tuple(f"{m}_{k}" for m in ("knn", "lsh", "ppr", "prob") for k in KINDS)


@dataclass(frozen=True)
class Session:
    """objects: id, vec. queries: the rewritten vector of each kind, which takes the place of the query object's own. coded: the
    objects' codes, and near: the nearest-neighbour edges among the objects but the query's, both written down once."""

    objects: DataFrame
    query_id: int
    queries: dict[str, list[float]]
    counts: list[int]
    size: int
    planes: np.ndarray
    coded: DataFrame
    near: DataFrame
    k: int = 10
    neighbours: int = 10
    seeds: frozenset = frozenset()
    previous: dict[str, list] = field(default_factory=dict)
    probability: float = 0.7
    round: int = 0

    @property
    def sim(self) -> dict[str, DataFrame]:
        """i, j, score of all pairs for each kind, the query's row and column from its rewritten vector; made only where it is read."""
        return {kind: refreshed(self, kind) for kind in KINDS}


def start(objects: DataFrame, query_id: int, k: int = 10, bits: int = 8, tables: int = 4, seed: int = 11) -> Session:
    """A session whose first queries are the query object's own vector."""
    vec = list(objects.where(F.col("id") == query_id).first().vec)
    held = objects.select(F.posexplode("vec").alias("d", "x")).where("x <> 0").groupBy("d").agg(F.count("*").alias("n")).collect()
    counts = [0] * len(vec)
    for r in held:
        counts[r.d] = r.n
    planes = lsh.planes(len(vec), bits, tables, seed)
    near = cut(graph.nearest_edges(objects.where(F.col("id") != query_id), Session.neighbours, exclude_self=True))
    return Session(objects, query_id, dict.fromkeys(KINDS, vec), counts, objects.count(), planes, cut(lsh.codes(objects, planes)), near, k)


def _asked(s: Session, kind: str) -> DataFrame:
    return s.objects.sparkSession.createDataFrame([(s.query_id, [float(x) for x in s.queries[kind]])], f"id {dict(s.objects.dtypes)['id']}, vec array<double>")


def _edges(s: Session, kind: str) -> DataFrame:
    """The neighbour graph with the query's vector in place of its object's: all that depends on it are the cosines with it."""
    q = F.array(*[F.lit(float(x)) for x in s.queries[kind]])
    length = F.sqrt(dot(F.col("vec"), F.col("vec"))) * float(np.linalg.norm(s.queries[kind]))
    cosine = F.round(F.coalesce(F.try_divide(dot(F.col("vec"), q), length), F.lit(0.0)), similarity.DIGITS)
    scores = cut(s.objects.where(F.col("id") != s.query_id).select("id", cosine.alias("w")))
    return graph.edges_with(s.near, s.query_id, scores, s.neighbours)


def search(s: Session, method: str) -> DataFrame:
    """query_id, object_id, score, rank of one of METHODS."""
    name, kind = method.split("_")
    query = _asked(s, kind)
    if name == "knn":
        return similarity.top_k(query, s.objects, "euclidean", s.k, exclude_self=True, kind=dict(s.objects.dtypes)["id"])
    if name == "lsh":
        bits = s.planes.shape[1]
        found = lsh.probe(cut(lsh.codes(query, s.planes)), s.coded, bits, s.k, exclude_self=True)
        return lsh.rerank(found, query, s.objects, s.k).drop("n_candidates")
    if name == "ppr":
        edges = cut(graph.column_normalised(cut(_edges(s, kind))))
        nodes = s.objects.where(F.col("id").isin(sorted(s.seeds | {s.query_id}))).select(F.lit(s.query_id).alias("run"), F.col("id").alias("node"))
        scores = graph.pagerank(edges, graph.uniform_seeds(nodes), 0.65, 25, k=s.k + 1, digits=9)  # the query may be among them
        named = scores.select(F.col("run").alias("query_id"), F.col("node").alias("object_id"), F.round("score", 9).alias("score"))
        return similarity.ranked(named.where("object_id <> query_id"), s.k, False)
    q = F.array(*[F.lit(float(x)) for x in s.queries[kind]])
    scored = s.objects.where(F.col("id") != s.query_id).select(F.lit(s.query_id).alias("query_id"), F.col("id").alias("object_id"), F.round(dot(F.col("vec"), q), 9).alias("score"))
    return similarity.ranked(scored, s.k, False)


def results(s: Session) -> DataFrame:
    """method, query_id, object_id, score, rank of all eight searches. While both kinds ask with one vector, as at the start, each
    search runs once for both."""
    searched = KINDS[:1] if s.queries[KINDS[0]] == s.queries[KINDS[1]] else KINDS
    out = None
    for name in ("knn", "lsh", "ppr", "prob"):
        for kind in searched:
            named = F.array(*[F.lit(f"{name}_{k}") for k in (KINDS if len(searched) == 1 else (kind,))])
            one = search(s, f"{name}_{kind}").select(F.explode(named).alias("method"), "query_id", "object_id", "score", "rank")
            out = one if out is None else out.unionByName(one)
    return out


def rewritten_vector(q: list[float], relevant: list[np.ndarray], others: list[np.ndarray]) -> list[float]:
    """The query plus the mean unit vector of the relevant objects, minus that of the others."""
    unit = lambda rows: np.mean([v / n if (n := np.linalg.norm(v)) else v for v in rows], 0) if rows else 0.0
    return (np.array(q) + unit(relevant) - unit(others)).tolist()


def rewritten_odds(q: list[float], relevant: list[np.ndarray], counts: list[int], size: int) -> list[float]:
    """Log odds of a dimension being present in relevant against other objects; half a count where the old query has a weight."""
    half = (np.array(q) != 0) * 0.5
    n, r = np.array(counts, float), np.sum([v != 0 for v in relevant], 0) if relevant else np.zeros(len(q))
    clamp = lambda p: np.where(p <= 0, LOW, np.where(p >= 1, HIGH, p))
    p = clamp((r + half + n / size) / (len(relevant) + half + 1))
    u = clamp((n - r - half + n / size) / (size - len(relevant) - half + 1))
    return np.log(p * (1 - u) / (u * (1 - p))).tolist()


def step(s: Session, judge: Callable[[list], dict], draw: np.random.Generator) -> tuple[Session, str, float]:
    """The next session, the method whose results were shown, and the share of relevant ones among them.

    judge maps the shown object ids to 1, 0 or -1. The method that found most relevant objects for its overlap with the round
    before is taken with the session's probability, which grows by a tenth each round; else a neighbour or hashing search.
    """
    found: dict[str, list] = {}
    for r in results(s).orderBy("method", "rank").collect():  # eight lists of k ids
        found.setdefault(r.method, []).append(r.object_id)
    fallback = [m for m in METHODS if m in ("knn_vect", "lsh_vect")]
    chosen = fallback[int(draw.integers(len(fallback)))]
    if s.previous and draw.uniform() <= s.probability:
        value = {m: len(s.seeds & set(ids)) / (len(set(ids) & set(s.previous.get(m, []))) + 1e-10) for m, ids in found.items()}
        chosen = max(sorted(value), key=value.get)
    shown = found.get(chosen, [])
    told = judge(shown)
    relevant, others = ([i for i in shown if told.get(i, 0) == x] for x in (1, -1))
    held = {r.id: np.array(r.vec) for r in s.objects.where(F.col("id").isin(shown)).collect()}
    base = s.queries[chosen.split("_")[1]]
    q_vect = rewritten_vector(base, [held[i] for i in relevant], [held[i] for i in others])
    q_prob = rewritten_odds(q_vect if chosen.endswith("vect") else base, [held[i] for i in relevant], s.counts, s.size)
    return replace(s, queries={"vect": q_vect, "prob": q_prob}, seeds=s.seeds | set(relevant), previous=found, probability=min(1.0, s.probability * 1.1), round=s.round + 1), chosen, len(relevant) / s.k


def refreshed(s: Session, kind: str) -> DataFrame:
    """The kind's similarities with the query's row and column taken from its rewritten vector."""
    q = np.array(s.queries[kind])
    unit = (q / (np.linalg.norm(q) or 1.0)).tolist()
    score = dot(normalised(F.col("vec")), F.array(*[F.lit(float(x)) for x in unit]))
    fresh = s.objects.select(F.lit(s.query_id).cast(dict(s.objects.dtypes)["id"]).alias("i"), F.col("id").alias("j"), score.alias("score"))
    return graph.with_refreshed(similarity.matrix(s.objects, "cosine", dict(s.objects.dtypes)["id"]), fresh)
