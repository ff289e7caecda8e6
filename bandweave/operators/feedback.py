"""Relevance feedback: query rewriting from judged objects, and rounds of it.

weights: object_id, dim, w (sparse, non-zero). feedback: object_id, relevance in {1, 0, -1}. A query is a table dim, q.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import cut

LOW, HIGH = 1e-5, 0.99


def _inside(p: Column) -> Column:
    """Probabilities of 0 and below, and of 1 and above, moved into the open interval."""
    return F.when(p <= 0, LOW).when(p >= 1, HIGH).otherwise(p)


def _odds(p: Column, u: Column) -> Column:
    return F.log(p * (1 - u) / (u * (1 - p)))


def initial_weights(weights: DataFrame, objects: int) -> DataFrame:
    """dim, q without judgements: p is one half, u the share of objects that have the dimension."""
    held = weights.groupBy("dim").agg(F.count("*").alias("n"))
    return held.select("dim", _odds(F.lit(0.5), _inside(F.col("n") / F.lit(float(objects)))).alias("q"))


def feedback_weights(weights: DataFrame, feedback: DataFrame, query: DataFrame, objects: int) -> DataFrame:
    """dim, q from judged objects; half a count is added where the old query (dim, q) has a weight."""
    relevant = feedback.where("relevance = 1").select("object_id").distinct()
    size = relevant.count()
    n = weights.groupBy("dim").agg(F.count("*").alias("n"))
    r = weights.join(relevant, "object_id", "left_semi").groupBy("dim").agg(F.count("*").alias("r"))
    met = n.join(r, "dim", "left").join(query, "dim", "left")
    half = F.when(F.coalesce("q", F.lit(0.0)) != 0, 0.5).otherwise(0.0)
    hits, judged, share = F.coalesce("r", F.lit(0)) + half, F.lit(float(size)) + half, F.col("n") / F.lit(float(objects))
    p = _inside((hits + share) / (judged + 1))
    u = _inside((F.col("n") - hits + share) / (F.lit(float(objects)) - judged + 1))
    return met.select("dim", _odds(p, u).alias("q"))


def scores(weights: DataFrame, query: DataFrame) -> DataFrame:
    """object_id, score = sum of w * q over common dimensions."""
    return weights.join(query, "dim").groupBy("object_id").agg(F.sum(F.col("w") * F.col("q")).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k objects with the largest score, nine decimals, ties to the smaller id."""
    rounded = scored.withColumn("score", F.round("score", 9))
    return rounded.orderBy(F.col("score").desc(), "object_id").limit(k)


def rocchio(query: DataFrame, weights: DataFrame, feedback: DataFrame) -> DataFrame:
    """dim, q: the old query plus the mean unit vector of relevant objects, minus that of the others judged. An empty class adds nothing."""
    length = weights.groupBy("object_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    judged = feedback.where("relevance <> 0").dropDuplicates(["object_id"])
    size = judged.groupBy("relevance").agg(F.count("*").alias("size"))
    unit = weights.join(judged, "object_id").join(length, "object_id").join(size, "relevance")
    part = F.coalesce(F.try_divide(F.col("w"), F.col("length")), F.lit(0.0)) * F.col("relevance") / F.col("size")
    moved = unit.groupBy("dim").agg(F.sum(part).alias("q"))
    return query.select("dim", "q").unionByName(moved).groupBy("dim").agg(F.sum("q").alias("q"))


def judged_by_class(results: DataFrame, labels: DataFrame, wanted: object) -> DataFrame:
    """Simulated judgements: 1 for objects of the wanted class, -1 for others. labels: object_id, class."""
    return results.select("object_id").join(labels, "object_id").select("object_id", F.when(F.col("class") == F.lit(wanted), 1).otherwise(-1).cast("byte").alias("relevance"))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Dimensions of two queries and how many of them differ."""
    a, b = before.withColumnRenamed("q", "a"), after.withColumnRenamed("q", "b")
    met = a.join(b, "dim", "full")
    differs = F.round(F.coalesce("a", F.lit(0.0)), 9) != F.round(F.coalesce("b", F.lit(0.0)), 9)
    return met.agg(F.count("*").alias("dims"), F.count_if(differs).alias("changed"))


def relative_importance(before: DataFrame, after: DataFrame, vocab: DataFrame) -> DataFrame:
    """level (component, sensor or word), component, sensor, dim, change, scaled: the sum of before - after for every sensor,
    every component and every word in one pass, and its place between the smallest and the largest change of the level."""
    from pyspark.sql import Window as W

    a, b = before.withColumnRenamed("q", "a"), after.withColumnRenamed("q", "b")
    gap = F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))
    met = a.join(b, "dim", "full").join(vocab, "dim").select("component", "sensor", "dim", gap.alias("gap"))
    sets = met.groupingSets([[met.component], [met.sensor], [met.dim]], "component", "sensor", "dim").agg(F.sum("gap").alias("change"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 3, "component").when(F.col("g") == 5, "sensor").otherwise("word")
    out = sets.select(level.alias("level"), "component", "sensor", "dim", F.round("change", 9).alias("change"))
    lo, hi = F.min("change").over(W.partitionBy("level")), F.max("change").over(W.partitionBy("level"))
    return out.withColumn("scaled", F.coalesce(F.try_divide(F.col("change") - lo, hi - lo), F.lit(0.0)))


def method_scores(results: DataFrame, previous: DataFrame, relevant: DataFrame) -> DataFrame:
    """method, score = relevant objects found / (objects also found the round before + 1e-10). results, previous: method, object_id."""
    now = results.select("method", "object_id").distinct()
    hits = now.join(relevant.select("object_id").distinct().withColumn("rel", F.lit(1)), "object_id", "left")
    met = hits.join(previous.select("method", "object_id").distinct().withColumn("prev", F.lit(1)), ["method", "object_id"], "left")
    return met.groupBy("method").agg((F.count("rel") / (F.count("prev") + F.lit(1e-10))).alias("score"))


def chosen_method(scored: DataFrame, probability: float, draw: float, fallback: list[str], pick: int) -> str:
    """The method with the best score if draw <= probability, else one of the fallback methods. One row for each method is read."""
    rows = scored.orderBy(F.col("score").desc(), "method").limit(1).collect()
    return rows[0]["method"] if rows and draw <= probability else sorted(fallback)[pick % len(fallback)]


def rounds(weights: DataFrame, labels: DataFrame, wanted: object, first: DataFrame, objects: int, n: int, k: int = 10, rewrite: str = "probabilistic") -> list[tuple[DataFrame, DataFrame]]:
    """(query, results) of each of n rounds with a simulated judge. first: the initial query (dim, q); results: object_id, score."""
    out, query = [], first
    for _ in range(n):
        found = cut(best(scores(weights, query), k))  # k rows; keeps later rounds' plans short
        out.append((query, found))
        told = judged_by_class(found, labels, wanted)
        query = cut(feedback_weights(weights, told, query, objects) if rewrite == "probabilistic" else rocchio(query, weights, told))
    return out
