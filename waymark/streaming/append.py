"""Appending points as a stream: micro-batches of raw points become chunks of open trajectories.

An extension: snapshots themselves are static.  Late points beyond the watermark are dropped by
Structured Streaming; chunks are cut by time (``span``), since a stream has no final order to count by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_chunks(points: DataFrame, span: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """vehicle_id, window, n_points, extents and points of each vehicle and time span.

    ``points`` is a streaming (or static) DataFrame with vehicle_id, t_ms, x_m and y_m.  Points of one
    vehicle and instant count once.
    """
    timed = points.withColumn("ts", F.timestamp_millis("t_ms")).withWatermark("ts", late)
    unique = timed.dropDuplicatesWithinWatermark(["vehicle_id", "t_ms"]) if points.isStreaming else timed.dropDuplicates(["vehicle_id", "t_ms"])
    return unique.groupBy("vehicle_id", F.window("ts", span)).agg(
        F.count("*").alias("n_points"), F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max"), F.min("x_m").alias("min_x"), F.min("y_m").alias("min_y"), F.max("x_m").alias("max_x"), F.max("y_m").alias("max_y"),
        F.array_sort(F.collect_list(F.struct(F.col("t_ms").alias("t"), F.col("x_m").alias("x"), F.col("y_m").alias("y")))).alias("points"),
    )
