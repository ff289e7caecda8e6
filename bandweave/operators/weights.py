"""Word weights: counts, TF, IDF, TF-IDF, TF-IDF2, entropy, the vocabulary, and dense vectors on request.

Every table is sparse and long: a row for each word that occurs. words: object_id, component, sensor, t, word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.stages import cut
from .symbolic import SERIES

TERM = ("component", "sensor", "word")


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy(*SERIES, "word").agg(F.count("*").alias("n"))


def term_frequency(words: DataFrame) -> DataFrame:
    """n and tf = n / windows of the series."""
    total = F.sum("n").over(W.partitionBy(*SERIES))
    return word_counts(words).withColumn("tf", F.col("n") / total)


def inverse_document_frequency(tf: DataFrame, objects: int) -> DataFrame:
    """df, the objects in which a word occurs at its component and sensor, and idf = ln(objects / df)."""
    out = tf.groupBy(*TERM).agg(F.count("*").alias("df"))
    return out.withColumn("idf", F.log(F.lit(float(objects)) / F.col("df")))


def tf_idf(words: DataFrame) -> DataFrame:
    """n, tf, idf and tfidf of every word of every series."""
    tf = term_frequency(words)
    objects = words.select("object_id").distinct().count()
    return tf.join(inverse_document_frequency(tf, max(1, objects)), list(TERM)).select(*SERIES, "word", "n", "tf", "idf", (F.col("tf") * F.col("idf")).alias("tfidf"))


def tf_idf2(words: DataFrame, sensors: int | None = None, offset: float = 1e-7) -> DataFrame:
    """tfidf2 = tf * ln(sensors / sensors of this object with the word) + offset, so that no vector is zero."""
    tf = term_frequency(words)
    sensors = sensors or words.select("sensor").distinct().count()
    spread = W.partitionBy("object_id", "component", "word")
    out = tf.withColumn("idf2", F.log(F.lit(float(max(1, sensors))) / F.count("*").over(spread)))
    return out.withColumn("tfidf2", F.col("tf") * F.col("idf2") + offset)


def entropy(tf: DataFrame) -> DataFrame:
    """Adds entropy = -tf * log2(tf + 1e-7)."""
    return tf.withColumn("entropy", -F.col("tf") * F.log2(F.col("tf") + 1e-7))


def vocabulary(words: DataFrame) -> DataFrame:
    """dim, component, sensor, word: numbered from 0 by first appearance (component, object, sensor, t).

    Numbers are given within ranges of the order and shifted by the sizes of the ranges before them, so that no single task
    holds the vocabulary.
    """
    first = F.struct("component", "object_id", "sensor", "t", "word")
    seen = words.groupBy(*TERM).agg(F.min(first).alias("first"))
    placed = seen.repartitionByRange("first").sortWithinPartitions("first").withColumn("part", F.spark_partition_id())
    placed = placed.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy("first")))
    placed = cut(placed)  # both uses must see the same ranges
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = placed.join(before.select("part", "before"), "part")
    return out.select((F.col("place") - 1 + F.col("before")).alias("dim"), *TERM)


def dense(weights: DataFrame, vocab: DataFrame, objects: DataFrame, weight: str) -> DataFrame:
    """object_id and vec, an array over the whole vocabulary with zeros for absent words. Only for consumers that need it."""
    n = vocab.count()
    pairs = weights.join(vocab, list(TERM)).groupBy("object_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("dim"), F.col(weight)))).alias("held"))
    every = objects.select("object_id").distinct().join(pairs, "object_id", "left")
    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda d: F.coalesce(F.try_element_at("held", d), F.lit(0.0)))
    return every.select("object_id", (vec if n else F.array().cast("array<double>")).alias("vec"))


def sequences(words: DataFrame, weights: DataFrame, columns: list[str]) -> DataFrame:
    """For each series its words in order, with their weights: seq, an array of structs (t, word, avg, *columns)."""
    joined = words.join(weights.select(*SERIES, "word", *columns), [*SERIES, "word"])
    item = F.struct("t", "word", *(["avg"] if "avg" in words.columns else []), *columns)
    return joined.groupBy(*SERIES).agg(F.array_sort(F.collect_list(item)).alias("seq"))
