"""Weekly trajectories of an ``events`` table (event_id, ts, user_id, value, props).

A user is a vehicle and each calendar week a trajectory; x is the value and y the number in props.k.
All expressions are free of the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_points(events: DataFrame) -> DataFrame:
    """vehicle_id, trajectory_id, pos (event_id), t_ms, x_m, y_m."""
    day = "datediff(to_date(ts), DATE'1970-01-01')"
    t_ms = F.expr(f"CAST({day} AS BIGINT) * 86400000 + hour(ts) * 3600000 + minute(ts) * 60000 + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT)")
    week = F.expr("date_format(trunc(to_date(ts), 'week'), 'yyyyMMdd')")
    vehicle = F.col("user_id").cast("string")
    return events.select(
        vehicle.alias("vehicle_id"), F.concat_ws("-", vehicle, week).alias("trajectory_id"), F.col("event_id").alias("pos"), t_ms.alias("t_ms"),
        F.col("value").alias("x_m"), F.get_json_object("props", "$.k").cast("double").alias("y_m"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_points(spark.read.parquet(f"{sf_dir}/events.parquet"))
