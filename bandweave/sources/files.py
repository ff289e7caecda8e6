"""Word files, dense vectors, similarity matrices, labels and ranked results on disk."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import Bands
from ..functions.ids import canonical


def _json_files(spark: SparkSession, path: str) -> DataFrame:
    """path, value: whole files as text."""
    return spark.read.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_word_files(spark: SparkSession, path: str, bands: Bands | None = None) -> DataFrame:
    """object_id, component, sensor, t, labels (array<double>), avg of JSON files with words_<component> entries
    [[object, sensor, t], [labels], mean]. The entries are of mixed types, so each file is read as JSON text. With the bands whose
    representatives the labels are, also word: the bands' numbers joined by dashes, as the weights take it."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                for name, entries in json.loads(text).items():
                    if name.startswith("words_"):
                        rows += [(str(k[0]), name[6:], int(k[1]), int(k[2]), [float(x) for x in labels], float(avg)) for k, labels, avg in entries]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64()]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["object_id", "component", "sensor", "t", "labels", "avg"])

    out = _json_files(spark, path).mapInArrow(run, "object_id string, component string, sensor int, t int, labels array<double>, avg double")
    if bands is None:
        return out
    middles = [(a + b) / 2 for a, b in zip(bands.labels, bands.labels[1:])]  # a label belongs to the nearest representative
    number = lambda x: sum((F.when(x > m, 1).otherwise(0) for m in middles), F.lit(0)).cast("string")
    return out.withColumn("word", F.array_join(F.transform("labels", number), "-"))


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """path, component, sensor, mean, deviation of the same files (avg_<component> and std_<component>)."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = json.loads(text)
                for key in held:
                    if key.startswith("avg_"):
                        rows += [(name, key[4:], i, float(m), float(s)) for i, (m, s) in enumerate(zip(held[key], held["std_" + key[4:]]))]
            types = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "component", "sensor", "mean", "deviation"])

    return _json_files(spark, path).mapInArrow(run, "path string, component string, sensor int, mean double, deviation double")


def read_nested_vector(spark: SparkSession, path: str) -> DataFrame:
    """path, vec of files that hold a JSON string which itself holds a JSON array of numbers."""
    return _json_files(spark, path).select("path", F.from_json(F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x"), "array<double>").alias("vec"))


def read_nested_matrix(spark: SparkSession, path: str) -> DataFrame:
    """path, i, vec of files that hold a JSON string which itself holds a JSON matrix, a row for each row of the matrix."""
    rows = _json_files(spark, path).select("path", F.from_json(F.get_json_object(F.concat(F.lit('{"x":'), "value", F.lit("}")), "$.x"), "array<array<double>>").alias("rows"))
    return rows.select("path", F.posexplode("rows").alias("i", "vec"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """object_id (canonical, as in the series), class of two-column CSV files without header."""
    labels = spark.read.schema("object_id string, class string").csv(path)
    return labels.select(canonical(F.trim("object_id")).alias("object_id"), "class")


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Rankings as JSON lines."""
    ranked.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_comparison(wide: DataFrame, path: str) -> None:
    """A side-by-side report as CSV with a header."""
    wide.write.mode("overwrite").option("header", "true").csv(path)
