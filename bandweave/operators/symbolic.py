"""From series to words: scaling, statistics, bands and sliding windows.

series: object_id, component, sensor, t, value. A series is one (object_id, component, sensor), ordered by t from 0. All
steps need a series' rows together; they share one partitioning, so scaling, banding and windows are a single shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bands import Bands

SERIES = ("object_id", "component", "sensor")


def minmax(series: DataFrame, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Adds scaled: value mapped to [low, high] within its series. A constant series becomes low. Null or NaN values are dropped."""
    w = W.partitionBy(*SERIES)
    series = series.where(F.col("value").isNotNull() & ~F.isnan("value"))
    least, most = F.min("value").over(w), F.max("value").over(w)
    scaled = F.when(most > least, (F.col("value") - least) * (high - low) / (most - least) + low).otherwise(F.lit(low))
    return series.withColumn("scaled", F.greatest(F.lit(low), F.least(F.lit(high), scaled)))


def statistics(scaled: DataFrame) -> DataFrame:
    """Mean and population deviation of the scaled values of each series."""
    return scaled.groupBy(*SERIES).agg(F.avg("scaled").alias("mean"), F.stddev_pop("scaled").alias("deviation"))


def quantise(scaled: DataFrame, bands: Bands, left_closed: bool = False) -> DataFrame:
    """Adds band (from 0) and its representative, label."""
    band: Column = bands.left_closed(F.col("scaled")) if left_closed else bands.right_closed(F.col("scaled"))
    return scaled.withColumn("band", band).withColumn("label", bands.label(F.col("band")))


def windows(quantised: DataFrame, width: int, stride: int) -> DataFrame:
    """Words: the bands of windows that start every `stride` steps and hold `width` steps, fewer at the end of a series.

    Returns object_id, component, sensor, t, word (bands joined by dashes) and avg (mean label over the window's own length).
    """
    w = W.partitionBy(*SERIES).orderBy("t").rowsBetween(W.currentRow, width - 1)
    out = quantised.withColumn("word", F.array_join(F.collect_list(F.col("band").cast("string")).over(w), "-"))
    out = out.withColumn("avg", F.avg("label").over(w)).where(F.col("t") % stride == 0)
    return out.select(*SERIES, "t", "word", "avg")


def words_of(series: DataFrame, bands: Bands, width: int = 3, stride: int = 3) -> DataFrame:
    return windows(quantise(minmax(series), bands), width, stride)


def tumbling_mean(series: DataFrame, width: int = 3) -> DataFrame:
    """The mean of every `width` values of a series in order."""
    step = F.floor(F.col("t") / width).cast("int")
    return series.groupBy(*SERIES, step.alias("step")).agg(F.avg("value").alias("mean"))
