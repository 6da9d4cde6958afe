"""Where the engine writes: a folder that driver and executors share."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it is not set and the session
    is on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def append_json(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document as a further text file of a folder, by Spark's writer, so it is there whole or not at all."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("append").text(path)


def read_json_lines(spark: SparkSession, path: str) -> list[dict]:
    """The documents of a folder, a few."""
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]


def delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
