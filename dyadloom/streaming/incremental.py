"""Means by group over a stream of values; order statistics cannot be kept so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, grp, n, nnz, total, mean) of (ts, grp, value), batch or streaming."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", width), "grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") != 0).alias("nnz"), F.sum("value").alias("total"))
    return out.withColumn("mean", F.col("total") / F.col("n"))
