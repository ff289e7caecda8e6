"""Series from wide text files and from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ids import canonical


def read_wide_csv(spark: SparkSession, root: str, width: int = 7) -> DataFrame:
    """object_id, component, sensor, t, value of files <root>/<component>/<object>.csv without header: a line for each sensor, a
    field for each step. Sensors and steps are numbered from 0 by place. Empty lines and fields are skipped."""
    files = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.csv").load(f"{root.rstrip('/')}/*")
    path = F.col("_metadata.file_path")
    files = files.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("component"), canonical(F.regexp_extract(path, r"([^/]+)\.csv$", 1), width).alias("object_id"), "value")
    lines = files.select("object_id", "component", F.posexplode(F.split("value", r"\r?\n")).alias("sensor", "line")).where(F.trim("line") != "")
    cells = lines.select("object_id", "component", "sensor", F.posexplode(F.split("line", ",")).alias("t", "cell")).where(F.trim("cell") != "")
    return cells.select("object_id", "component", "sensor", "t", F.trim("cell").cast("double").alias("value"))


def series_of(table: DataFrame, object_id: str, component: str, sensor: str, order: list[str], value: str) -> DataFrame:
    """Rows of any table as series, t numbered from 0 in the given order."""
    w = W.partitionBy(object_id, sensor).orderBy(*order)
    t: Column = F.row_number().over(w) - 1
    return table.select(F.col(object_id).alias("object_id"), F.lit(component).alias("component"), F.col(sensor).alias("sensor"), t.alias("t"), F.col(value).cast("double").alias("value"))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user and type, in time order."""
    return series_of(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", "E", "event_type", ["ts", "event_id"], "value")


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order totals of each customer and priority, in date order."""
    return series_of(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_custkey", "O", "o_orderpriority", ["o_orderdate", "o_orderkey"], "o_totalprice")
