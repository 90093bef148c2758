"""One-factor statistics over a stream, from which the likelihood is evaluated at any time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(stream: DataFrame, factor: str, y: Column) -> DataFrame:
    """level, n, sy, syy, the state of each level; sums only, so that micro-batches add up."""
    rows = stream.select(F.col(factor).alias("level"), y.cast("double").alias("y")).where("level is not null and y is not null and not isnan(y)")
    return rows.groupBy("level").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))


def windowed(stream: DataFrame, factor: str, y: Column, time: str, width: str, late: str) -> DataFrame:
    """The same for each window of event time; records later than the watermark are left out."""
    rows = stream.withWatermark(time, late).select(F.window(time, width).alias("window"), F.col(factor).alias("level"), y.cast("double").alias("y"))
    rows = rows.where("level is not null and y is not null")
    return rows.groupBy("window", "level").agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"))


def statistics(state: DataFrame) -> DataFrame:
    """The state as the statistics that one-factor models take."""
    mean = F.col("sy") / F.col("n")
    return state.select("level", "n", mean.alias("mean"), F.greatest(F.col("syy") - F.col("sy") * mean, F.lit(0.0)).alias("ss"))
