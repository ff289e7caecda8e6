"""Reports: side-by-side rankings, formatted lines, accuracy grids, dominant classes, and training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def side_by_side(ranked: DataFrame, methods: list[str]) -> DataFrame:
    """query_id, rank and a column with the object of each method. ranked: method, query_id, rank, object_id."""
    return ranked.groupBy("query_id", "rank").pivot("method", methods).agg(F.first("object_id"))


def zipped(tables: dict[str, DataFrame]) -> DataFrame:
    """Ranked tables (query_id, rank, object_id) joined on their place, a column for each name."""
    out = None
    for name, df in tables.items():
        own = df.select("query_id", "rank", F.col("object_id").alias(name))
        out = own if out is None else out.join(own, ["query_id", "rank"], "full")
    return out


def line(object_id: Column, score: Column) -> Column:
    """'& id & score' with the score at two decimals, half to even."""
    return F.concat(F.lit("& "), object_id.cast("string"), F.lit(" & "), F.format_string("%.2f", F.bround(score, 2).cast("double")))


def accuracy_grid(results: DataFrame) -> DataFrame:
    """feature, model, voting, weighted and the better of the two. results: feature, model, method (voting or weighted), accuracy."""
    out = results.groupBy("feature", "model").pivot("method", ["voting", "weighted"]).agg(F.first("accuracy"))
    return out.withColumn("best", F.greatest("voting", "weighted"))


def dominant_class(results: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, k, class, n: the most frequent class among each query's results; the smallest on ties."""
    met = results.join(labels, "object_id").groupBy("query_id", "class").agg(F.count("*").alias("n"))
    total = met.withColumn("k", F.sum("n").over(W.partitionBy("query_id")))
    first = W.partitionBy("query_id").orderBy(F.col("n").desc(), "class")
    return total.withColumn("r", F.row_number().over(first)).where("r = 1").select("query_id", "k", "class", "n")


def parent_id(object_id: Column) -> Column:
    """The number before the first underscore or dash of an object id."""
    return F.split(object_id.cast("string"), "[_-]")[0].cast("long")


def labelled(objects: DataFrame, classes: DataFrame) -> DataFrame:
    """object_id, class by the parent id. classes: parent, class."""
    return objects.withColumn("parent", parent_id(F.col("object_id"))).join(classes, "parent").select("object_id", "class")


def training_sample(labels: DataFrame, percent: int = 30) -> DataFrame:
    """Adds is_train, true for about `percent` of the objects, by a hash of the id: the same on every run and machine."""
    return labels.withColumn("is_train", F.pmod(F.xxhash64(F.col("object_id").cast("string")), F.lit(100)) < percent)


def relevance_at_k(judged: DataFrame) -> DataFrame:
    """round, relevance: the share of relevant ones among the judged results of each round. judged: round, relevance."""
    return judged.groupBy("round").agg(F.avg(F.when(F.col("relevance") == 1, 1.0).otherwise(0.0)).alias("relevance"))
