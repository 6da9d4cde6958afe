"""Cleaning, numbering and chunking of raw points.

Raw points: vehicle_id, trajectory_id, pos (place in the input), t_ms, x_m, y_m.  Only windows over a
trajectory are used; numbering trajectories sorts the distinct ids by range, never in one task.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import codes, projection
from waymark.storage import new_path


def project_points(raw: DataFrame, crs: str = "EPSG:32650") -> DataFrame:
    """lon and lat in degrees become x_m and y_m in metres."""
    x, y = projection.metres(F.col("lon"), F.col("lat"), crs)
    return raw.withColumns({"x_m": x, "y_m": y}).drop("lon", "lat")


class Cleaned(NamedTuple):
    points: DataFrame  # vehicle_id, trajectory_id, seq, t_ms, x_m, y_m
    rejects: DataFrame  # trajectory_id, reason
    removed: DataFrame  # trajectory_id, n_exact, n_same_time


def judged(raw: DataFrame, domain: codes.Domain | None = None) -> DataFrame:
    """All raw points with what cleaning decides: removed (EXACT, SAME_TIME or null), outside (of the whole
    trajectory), seq.  One exchange, by trajectory."""
    dealt = raw.repartition("trajectory_id")
    order = Window.partitionBy("trajectory_id").orderBy("t_ms", "pos")
    same = Window.partitionBy("trajectory_id", "t_ms").orderBy("pos")
    first = dealt.withColumns({"__n": F.row_number().over(same), "__x": F.first("x_m").over(same), "__y": F.first("y_m").over(same)})
    exact = (F.col("x_m") == F.col("__x")) & (F.col("y_m") == F.col("__y"))
    found = first.withColumn("removed", F.when(F.col("__n") > 1, F.when(exact, "EXACT").otherwise("SAME_TIME")))
    outside = F.lit(False)
    if domain is not None:
        outside = ~(F.col("x_m").between(domain.min_x, domain.max_x) & F.col("y_m").between(domain.min_y, domain.max_y))
    off = F.max(F.col("removed").isNull() & F.coalesce(outside, F.lit(True))).over(Window.partitionBy("trajectory_id"))
    place = F.count(F.when(F.col("removed").isNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return found.withColumns({"outside": off, "seq": place.cast("int")}).select("vehicle_id", "trajectory_id", "seq", "t_ms", "x_m", "y_m", "removed", "outside")


def sorted_out(found: DataFrame) -> Cleaned:
    """Points, rejects and counts of removed points from what ``judged`` gives."""
    kept = found.where("removed IS NULL")
    points = kept.where("NOT outside").select("vehicle_id", "trajectory_id", "seq", "t_ms", "x_m", "y_m")
    rejects = kept.where("outside AND seq = 0").select("trajectory_id", F.lit("OUT_OF_DOMAIN").alias("reason"))
    times = lambda name: F.count(F.when(F.col("removed") == name, 1))
    return Cleaned(points, rejects, found.groupBy("trajectory_id").agg(times("EXACT").alias("n_exact"), times("SAME_TIME").alias("n_same_time")))


def clean(raw: DataFrame, domain: codes.Domain | None = None) -> Cleaned:
    """Stable order by time; of points with one time the first stays; trajectories that leave the closed
    domain are rejected whole; seq counts from 0.

    A removed point counts as exact if it equals the kept point of its time in place too.
    """
    return sorted_out(judged(raw, domain))


def empty_rejects(accepted: DataFrame) -> DataFrame:
    """Parsed trajectories without points: trajectory_id, reason EMPTY."""
    return accepted.where(F.size("pts") <= 0).select("trajectory_id", F.lit("EMPTY").alias("reason"))


def number_ids(ids: DataFrame, column: str, name: str = "tid") -> DataFrame:
    """``column`` and its 1-based place in ascending order; ``ids`` must be distinct.

    Ids are sorted by range and written once; a partition's place is the sum of the counts before it,
    so only one row per partition is ever ordered in one task.
    """
    spark = ids.sparkSession
    path = new_path(spark, "numbered")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ids.select(column).repartitionByRange(n, column).sortWithinPartitions(column)
    placed.select(column, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).write.parquet(path)
    placed = spark.read.parquet(path)
    counts = placed.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").select(column, (F.col("__before") + F.col("__at") + 1).alias(name))


def assign_tids(points: DataFrame) -> DataFrame:
    """Points with tid: trajectories numbered from 1 in the order of their ids."""
    tids = number_ids(points.select("trajectory_id").distinct(), "trajectory_id")
    return points.join(tids, "trajectory_id").select("vehicle_id", "trajectory_id", "tid", "seq", "t_ms", "x_m", "y_m")


def chunk(points: DataFrame, max_points: int = 256) -> DataFrame:
    """One row per chunk of at most ``max_points`` consecutive points, with its extent and its points."""
    numbered = points.withColumn("chunk_id", F.floor(F.col("seq") / max_points).cast("int"))
    return numbered.groupBy("tid", "chunk_id").agg(
        F.first("vehicle_id").alias("vehicle_id"), F.min("seq").cast("int").alias("seq_first"), F.max("seq").cast("int").alias("seq_last"), F.count("*").alias("n_points"),
        F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max"), F.min("x_m").alias("min_x"), F.min("y_m").alias("min_y"), F.max("x_m").alias("max_x"), F.max("y_m").alias("max_y"),
        F.array_sort(F.collect_list(F.struct("seq", F.col("t_ms").alias("t"), F.col("x_m").alias("x"), F.col("y_m").alias("y")))).alias("points"),
    )


def trajectory_meta(points: DataFrame, max_points: int = 256) -> DataFrame:
    """One row per trajectory: ids, point and chunk counts, first and last time."""
    return points.groupBy("tid", "trajectory_id", "vehicle_id").agg(
        F.count("*").alias("n_points"), F.ceil(F.count("*") / max_points).cast("bigint").alias("n_chunks"), F.min("t_ms").alias("t0"), F.max("t_ms").alias("t1")
    )


def concatenate(chunks: DataFrame) -> DataFrame:
    """The inverse of chunking: tid and all points in order."""
    return chunks.groupBy("tid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "points"))), lambda c: c["points"])).alias("pts"))


def profile(points: DataFrame, bucket_ms: int = 600_000, margin: float = 1000.0) -> DataFrame:
    """Counts, ranges, length percentiles (value at floor(q (n-1))) and suggested domain and epoch: one row."""
    lengths = points.groupBy("trajectory_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("trajectory_id").orderBy("t_ms", "seq")
    repeat = (F.col("t_ms") == F.lag("t_ms").over(order)) & (F.col("x_m") == F.lag("x_m").over(order)) & (F.col("y_m") == F.lag("y_m").over(order))
    flat = points.withColumn("__repeat", repeat).agg(
        F.count("*").alias("n_points"), F.countDistinct("trajectory_id").alias("n_trajectories"), F.countDistinct("vehicle_id").alias("n_vehicles"), F.count(F.when(F.col("__repeat"), 1)).alias("n_repeats"),
        F.min("t_ms").alias("t_min"), F.max("t_ms").alias("t_max"), F.min("x_m").alias("min_x"), F.max("x_m").alias("max_x"), F.min("y_m").alias("min_y"), F.max("y_m").alias("max_y"),
    )
    # The histogram of lengths is small (one row per length), whatever the number of trajectories.
    histogram = lengths.groupBy("n").agg(F.count("*").alias("c"))
    order = Window.orderBy("n")
    ranked = histogram.withColumns({"upto": F.sum("c").over(order), "total": F.sum("c").over(Window.partitionBy())})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("total") - 1)), F.col("n")))
    quantiles = ranked.agg(at(0.5).alias("length_p50"), at(0.95).alias("length_p95"), F.max("n").alias("length_max"))
    both = flat.withColumn("__k", F.lit(1)).join(quantiles.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return both.withColumns(
        {
            "domain_min_x": F.col("min_x") - margin, "domain_min_y": F.col("min_y") - margin, "domain_max_x": F.col("max_x") + margin, "domain_max_y": F.col("max_y") + margin,
            "epoch_ms": (F.floor(F.col("t_min") / bucket_ms) * bucket_ms).cast("bigint"),
        }
    )
