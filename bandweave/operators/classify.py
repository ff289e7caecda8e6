"""Classification: nearest neighbours with growing k on ties, decision trees, votes, and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import cut
from .similarity import top_k


def knn_votes(neighbours: DataFrame, k: int, k_max: int | None = None) -> DataFrame:
    """query_id, predicted, k_used: the most frequent class among the k nearest; on a tie k grows until one class leads.

    neighbours: query_id, rank (from 1), class, for as many ranks as k may grow to. If no k up to the last rank settles it, the
    nearest neighbour's class is taken.
    """
    near = neighbours if k_max is None else neighbours.where(F.col("rank") <= k_max)
    # counts change by one class at each rank: join each rank with the classes seen up to it
    seen = near.alias("a").join(near.alias("b"), (F.col("a.query_id") == F.col("b.query_id")) & (F.col("b.rank") <= F.col("a.rank")))
    counts = seen.where(F.col("a.rank") >= k).groupBy(F.col("a.query_id").alias("query_id"), F.col("a.rank").alias("k"), F.col("b.class").alias("class")).agg(F.count("*").alias("n"))
    most = counts.withColumn("top", F.max("n").over(W.partitionBy("query_id", "k"))).where("n = top")
    unique = most.groupBy("query_id", "k").agg(F.count("*").alias("leaders"), F.min("class").alias("class")).where("leaders = 1")
    settled = unique.groupBy("query_id").agg(F.min_by("class", "k").alias("predicted"), F.min("k").alias("k_used"))
    nearest = near.where("rank = 1").select("query_id", F.col("class").alias("nearest"))
    out = nearest.join(settled, "query_id", "left")
    return out.select("query_id", F.coalesce("predicted", "nearest").alias("predicted"), F.coalesce("k_used", F.lit(1)).alias("k_used"))


def knn_classes(queries: DataFrame, objects: DataFrame, k: int, most: int = 20) -> DataFrame:
    """query_id, predicted, k_used of the votes of the nearest objects (euclidean), for every query. queries: id, vec; objects: id, vec, class.

    The `most` nearest are looked at first. Queries still tied there go through further rounds with twice as many, until one
    class leads or the objects end; only then is the nearest neighbour's class taken. k must be at least 2.
    """
    n, out = objects.count(), None
    classes = objects.select(F.col("id").alias("object_id"), "class")
    while True:
        near = top_k(queries, objects, "euclidean", most).join(classes, "object_id").select("query_id", "rank", "class")
        votes = cut(knn_votes(cut(near), k))
        tied = votes.where(F.col("k_used") < k)
        last = most >= n or tied.isEmpty()
        done = votes if last else votes.where(F.col("k_used") >= k)
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        queries = cut(queries.join(tied.select(F.col("query_id").alias("id")), "id", "left_semi"))
        most *= 2


def majority(votes: DataFrame) -> DataFrame:
    """query_id, predicted: the most frequent class of votes (query_id, class); the smallest on ties."""
    counted = votes.groupBy("query_id", "class").agg(F.count("*").alias("n"))
    first = W.partitionBy("query_id").orderBy(F.col("n").desc(), "class")
    return counted.withColumn("r", F.row_number().over(first)).where("r = 1").select("query_id", F.col("class").alias("predicted"))


def weighted_majority(votes: DataFrame) -> DataFrame:
    """query_id, predicted: the class with the largest sum of scores of votes (query_id, class, score)."""
    summed = votes.groupBy("query_id", "class").agg(F.round(F.sum("score"), 9).alias("total"))
    first = W.partitionBy("query_id").orderBy(F.col("total").desc(), "class")
    return summed.withColumn("r", F.row_number().over(first)).where("r = 1").select("query_id", F.col("class").alias("predicted"))


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """n and accuracy (a fraction) of predicted (query_id, predicted) against labels (object_id, class)."""
    met = predicted.join(labels, predicted["query_id"] == labels["object_id"])
    return met.agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("class")).cast("double")).alias("accuracy"))


def best_splits(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each node the split with the smallest weighted Gini impurity: keys..., feature, threshold, gini.

    rows: keys..., feature, value, class. Thresholds are midpoints of neighbouring different values; ties go to the smaller
    feature, then threshold. Class counts below a threshold come from one ordered pass for each (node, feature).
    """
    cell = [*keys, "feature"]
    by_value = rows.groupBy(*cell, "value", "class").agg(F.count("*").alias("n"))
    values = by_value.groupBy(*cell, "value").agg(F.collect_list(F.struct("class", "n")).alias("own"), F.sum("n").alias("n"))
    order = W.partitionBy(*cell).orderBy("value")
    # the sum of squared class counts on either side follows from running counts of each class
    running = by_value.withColumn("class_total", F.sum("n").over(W.partitionBy(*cell, "class")))
    points = values.select(*cell, "value", "n").withColumn("next", F.lead("value").over(order)).withColumn("left_n", F.sum("n").over(order))
    points = points.withColumn("total", F.sum("n").over(W.partitionBy(*cell))).where("next is not null")
    classes = running.select(*cell, "class", "class_total").distinct()
    grid = points.join(classes, cell).join(by_value.select(*cell, "value", "class", F.col("n").alias("here")), [*cell, "value", "class"], "left")
    grid = grid.withColumn("left_c", F.sum(F.coalesce("here", F.lit(0))).over(W.partitionBy(*cell, "class").orderBy("value")))
    right_c = F.col("class_total") - F.col("left_c")
    sums = grid.groupBy(*cell, "value", "next", "left_n", "total").agg(F.sum(F.col("left_c") * F.col("left_c")).alias("sl"), F.sum(right_c * right_c).alias("sr"))
    right_n = F.col("total") - F.col("left_n")
    gini = (F.col("left_n") - F.col("sl") / F.col("left_n") + right_n - F.col("sr") / right_n) / F.col("total")
    scored = sums.withColumn("gini", F.round(gini, 9)).withColumn("threshold", (F.col("value") + F.col("next")) / 2)
    first = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy("gini", "feature", "threshold")
    best = scored.groupBy(*cell).agg(F.min(F.struct("gini", "threshold")).alias("b")).select(*cell, F.col("b.gini").alias("gini"), F.col("b.threshold").alias("threshold"))
    return best.withColumn("r", F.row_number().over(first)).where("r = 1").select(*keys, "feature", "threshold", "gini")


def cart(train: DataFrame, test: DataFrame, depth: int = 4) -> DataFrame:
    """query_id, predicted of a decision tree (Gini, midpoints, strict improvement). train: id, vec, class; test: id, vec.

    The tree grows level by level: one best_splits for all open nodes, and one pass that moves every row to its child. Only
    the tree itself, at most 2 ** depth nodes, is held by the driver.
    """
    import math

    tree: dict[int, tuple] = {}
    held = train.select("id", "vec", "class", F.lit(1).alias("node"))
    apply = lambda df, splits: df.withColumn("node", _child(splits))
    for level in range(depth + 1):
        counts = held.groupBy("node", "class").agg(F.count("*").alias("n")).collect()  # nodes x classes rows
        by_node: dict[int, list] = {}
        for r in counts:
            by_node.setdefault(r.node, []).append((r.n, r["class"]))
        impurity = {k: 1 - sum((n / sum(m for m, _ in v)) ** 2 for n, _ in v) for k, v in by_node.items()}
        leaders = {k: min(c for n, c in v if n == max(m for m, _ in v)) for k, v in by_node.items()}
        splits = {}
        if level < depth:
            rows = held.where(F.col("node").isin([k for k, g in impurity.items() if g > 0]) if any(impurity.values()) else F.lit(False))
            rows = rows.select("node", "class", F.posexplode("vec").alias("feature", "value"))
            for r in best_splits(rows, ["node"]).collect():
                if r.gini < impurity[r.node] and not math.isclose(r.gini, impurity[r.node], abs_tol=1e-9):
                    splits[r.node] = (r.feature, r.threshold)
        for k, c in leaders.items():
            tree[k] = (splits.get(k), c)
        if not splits:
            break
        held = apply(held.where(F.col("node").isin(list(splits))), splits)
    out = test.select("id", "vec", F.lit(1).alias("node"))
    for _ in range(depth):
        out = apply(out, {k: s for k, (s, _) in tree.items() if s})
    leaf = F.create_map(*[F.lit(x) for k, (_, c) in tree.items() for x in (k, c)])
    return out.select(F.col("id").alias("query_id"), F.element_at(leaf, F.col("node")).alias("predicted"))


def _child(splits: dict[int, tuple]):
    node, out = F.col("node"), F.col("node")
    for k, (feature, threshold) in splits.items():
        below = F.element_at("vec", int(feature) + 1) <= float(threshold)
        out = F.when(node == k, F.when(below, 2 * k).otherwise(2 * k + 1)).otherwise(out)
    return out
