"""Quality rules on native expressions: text statistics, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted: one of the trusted target (documents labelled good and not toxic), one of
the raw corpus (all documents). The n-grams of a text are its words and its pairs of neighbouring words, as they stand. A
document's score is the mean, over its n-grams, of the log-likelihood ratio of target to raw; a document below a fixed threshold
is rejected.

Everything is DataFrame functions. The n-grams of a text stay in its row; only counts by bucket, a fixed number of rows, are
shuffled and collected. The trusted texts are found by a join on doc_id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the hashed n-grams, and the score in nats for each n-gram below which a document is rejected.
BUCKETS, THRESHOLD = 1 << 14, -0.3
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30


def _with_words(docs: DataFrame) -> DataFrame:
    """Adds _words. Steps that use a column more than once are columns of their own, so that none is computed twice."""
    return docs.withColumn("_words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))


def _bucket(gram: Column) -> Column:
    """The bucket of an n-gram's hash: that of a word, or of the hashes of two words one after the other."""
    return gram.bitwiseAND(BUCKETS - 1).cast("int")


def _next(column: str, by: int = 1) -> Column:
    """The elements of an array from the `by`-th on; zipped with the array they stand beside their predecessors."""
    return F.slice(column, by + 1, F.greatest(F.size(column), F.lit(1)))


def _counts(docs: DataFrame) -> dict[int, int]:
    # outer: an inner generator makes Spark push a filter on the array below it, and so compute the array once more
    pairs = _with_words(docs).select(F.inline_outer(F.arrays_zip(F.col("_words").alias("a"), _next("_words").alias("b"))))
    pair = F.when(F.col("b").isNotNull(), F.xxhash64(F.xxhash64("a"), F.xxhash64("b")))  # none after the last word
    grams = pairs.where("a is not null").select(F.explode(F.array(_bucket(F.xxhash64("a")), _bucket(pair))).alias("bucket")).where("bucket is not null")
    return {r.bucket: r.n for r in grams.groupBy("bucket").agg(F.count("*").alias("n")).collect()}


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """The log-likelihood ratio of target to raw for each bucket, with one added to every count. docs, trusted: text."""
    raw, target = _counts(docs), _counts(trusted)
    total_raw, total_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    if total_target == BUCKETS:
        return [0.0] * BUCKETS  # nothing is trusted: no evidence against any document
    return [math.log((target.get(b, 0) + 1) / total_target) - math.log((raw.get(b, 0) + 1) / total_raw) for b in range(BUCKETS)]


def _repeated_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words in windows of eight that stand twice or more in the text."""
    both = lambda a, b: F.xxhash64(a, b)
    docs = docs.withColumn("_one", F.transform("_words", lambda w: F.xxhash64(w)))
    # hashes of two, four and eight words from each word on; those that would pass the end are cut off
    docs = docs.withColumn("_two", F.zip_with("_one", _next("_one"), both))
    docs = docs.withColumn("_four", F.zip_with("_two", _next("_two", 2), both))
    docs = docs.withColumn("_eight", F.zip_with("_four", _next("_four", 4), both))
    docs = docs.withColumn("_windows", F.slice("_eight", 1, F.greatest(F.size("_eight") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    docs = docs.withColumn("_sorted", F.when(repeats, placed))
    near = lambda s, i: F.coalesce(F.get("_sorted", i)["x"] == s["x"], F.lit(False))
    again = F.filter("_sorted", lambda s, i: near(s, i - 1) | near(s, i + 1))
    docs = docs.withColumn("_places", F.sort_array(F.transform(again, lambda s: s["i"])))
    reach = F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_places", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def scored(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs but those named here, and the measures of rules() of each row's text."""
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    # the rows travel as one column, so no name of theirs can meet one used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in measures])
    docs = docs.select(row.alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = _repeated_words(_with_words(docs))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    add = lambda t, h: t + F.get(table, _bucket(h))
    pairs = F.slice("_two", 1, F.greatest(F.size("_two") - 1, F.lit(0)))
    total = F.aggregate(pairs, F.aggregate("_one", F.lit(0.0), add), add)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    measured = F.struct(
        long(F.size("_words")).alias("n_words"),
        long(F.length(F.array_join("_words", ""))).alias("word_chars"),
        long(F.size(F.split("text", "[#*$%&|<>]")) - 1).alias("n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.col("n_repeat_words"),
        F.when(F.size("_words") > 0, total / (F.size("_words") * 2 - 1)).otherwise(0.0).alias("score"),
    )
    # through a generator of one row, since a later filter on a measure is not pushed below it, where it would compute it twice
    docs = docs.withColumn("_lines", lines).select("_row.*", F.inline_outer(F.array(measured)))
    failed: Column = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    return docs.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept.

    docs: doc_id, text and any other columns, which are kept unless they have these names. labels: doc_id, quality, toxic.
    Null and empty texts have no words, score 0, and fail. Rows are judged one by one, so repeated rows get equal results; a
    null doc_id is judged like any other and is never trusted. Without trusted texts every ratio is 0. Empty tables give an
    empty result.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("_good")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # labels grow with the documents, so they are never broadcast, at no size
    trusted = texts.join(good.hint("merge"), F.col("_id") == F.col("_good"), "left_semi")
    return scored(docs, log_ratios(texts, trusted), threshold)


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that rules() keeps, with all their columns as they are, whatever their names.

    Every row is judged by itself, so equal rows are kept or dropped together and a null doc_id is a doc_id like any other. Null and
    empty texts are dropped; an empty table gives an empty result.
    """
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"_column_{k}" for k, c in enumerate(docs.columns)])
    return rules(plain, labels, threshold).where("kept").select(plain.columns).toDF(*docs.columns)
