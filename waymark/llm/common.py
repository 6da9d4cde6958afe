"""Shared plumbing of the text operators: the scratch folder, row identity and Arrow helpers."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a session on one machine (unit tests) uses a folder of our own; a
    cluster is refused, since its machines don't share one.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, not a recomputation, and every
    later use sees the same rows even if an expression upstream was not deterministic.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API, so any store works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*written: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more."""
    for df in written:
        if files := df.inputFiles():
            delete_path(df.sparkSession, files[0].rsplit("/", 1)[0])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, total: int, each: int) -> int:
    """How many parts to deal ``total`` bytes to, so that one holds about ``each`` bytes at most."""
    return max(partitions(spark), -(-total // each))


def slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose string column holds about ``limit`` bytes at most (one row at least)."""
    array = batch.column(column)
    sizes = np.asarray(pc.binary_length(array).fill_null(0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers with good avalanche (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A key with this share of all rows, and so many rows at least, is too frequent for one task; there are
#: at most 1 / FREQUENT_SHARE such keys.
FREQUENT_SHARE = 1e-4
FREQUENT_ROWS = 200


def attach(rows: DataFrame, lookup: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``lookup``, which has each ``key`` once; nulls where it lacks the key.

    ``lookup`` has a column n besides, the number of rows of each key, of ``total`` rows.  The rows of a
    frequent key are dealt to several tasks, by a hash of all their columns, and what they look up goes
    to each of these; only the frequent keys and their number of tasks are sent to all.  The column
    __salt, by which rows were dealt besides the key, comes along; equal rows have equal ones.
    """
    names = [c for c in lookup.columns if c not in (key, "n")]
    least = max(FREQUENT_ROWS, math.ceil(total * FREQUENT_SHARE))
    hot = lookup.where(F.col("n") >= least).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / least).alias("__parts"))
    salt = F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*rows.columns), F.col("__parts"))).otherwise(F.lit(0).cast("bigint"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").select(*rows.columns, salt.alias("__salt"))
    parts = F.when(F.col("n") >= least, F.ceil(F.col("n") / least)).otherwise(F.lit(1).cast("bigint"))
    spread = lookup.select(F.col(key).alias("__found"), *(F.col(c).alias(f"__{c}") for c in names), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("__at"))
    found = dealt.join(spread, (F.col(key) == F.col("__found")) & (F.col("__salt") == F.col("__at")), "left")
    return found.select(*rows.columns, "__salt", *(F.col(f"__{c}").alias(c) for c in names))
