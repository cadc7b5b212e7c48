"""A control-chart monitor over a stream: an extension, not part of the batch charts.

Limits come from a reference period; the stream is aggregated in event-time windows and
points outside the limits are flagged.  State is one window's sums for each group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def monitor(stream: DataFrame, limits: DataFrame, group: str, ts: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """group, start, v, outside; limits: group, lcl, ucl (one row for each group)."""
    points = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    points = points.groupBy(F.window("_ts", window).alias("w"), group).agg(F.avg(value).alias("v"))
    return points.join(limits.select(group, "lcl", "ucl"), group).select(group, F.col("w.start").alias("start"), "v", ((F.col("v") > F.col("ucl")) | (F.col("v") < F.col("lcl"))).alias("outside"))
