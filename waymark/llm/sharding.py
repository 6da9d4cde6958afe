"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows lie in P source partitions.  How many rows each partition sends to each shard is drawn
first, from the multivariate hypergeometric distribution: exactly the distribution those counts have
under a uniformly random permutation of all rows.  Each partition is then permuted locally, cut by
its row of the matrix, exchanged, and every shard is permuted again.  Shard sizes are exact (at most
one row apart) and no task ever sorts a whole shard: inside a shard the second permutation is an
order by (random bucket, random key), with the buckets' offsets counted beforehand.

Only DataFrame operations run on the executors.  What reaches the driver, and goes back to the
executors as the matrix, is one row per source partition (``ROWS_PER_PARTITION`` rows each), so a row
for every 200,000 of the input.

Defined cases: nulls, ties and repeated rows are placed like any other row, since a place depends on a
row number taken once and written out; a null text counts as empty; long texts only count their size;
an empty table gives an empty result; columns called ``shard`` or ``slot`` are replaced, all other names
are free, as the input's columns travel in one struct.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import materialize

ROWS_PER_PARTITION = 200_000


def communication_matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact partition-to-shard counts; row i sums to ``counts[i]``, columns differ by one at most."""
    total = sum(counts)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], dtype=np.int64)
    rng = np.random.default_rng(seed)
    rows = []
    for n in counts:
        drawn = rng.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros_like(left)
        left = left - drawn
        rows.append(drawn)
    return np.array(rows, dtype=np.int64).reshape(len(counts), shards)


def communication_shuffle(df: DataFrame, shards: int = 40, seed: int = 1, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long, gapless from 0 inside each shard).

    Every row is kept; its other columns pass through.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    whole = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.lit(0)
    rows = materialize(df.select(whole.alias("row"), F.monotonically_increasing_id().alias("__row")), "shuffle-rows")
    n = rows.count()
    sources = max(1, -(-n // rows_per_partition))
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(seed)), F.lit(sources)).cast("int"))
    found = {r["__part"]: r["count"] for r in rows.groupBy("__part").count().collect()}
    bounds = communication_matrix([found.get(p, 0) for p in range(sources)], shards, seed).cumsum(axis=1)
    cells = spark.createDataFrame([(p, b) for p, b in enumerate(bounds.tolist())], "__part int, __bounds array<bigint>")

    local = Window.partitionBy("__part").orderBy(F.xxhash64("__row", F.lit(seed + 1)), "__row")
    sent = (
        rows.withColumn("__rank", F.row_number().over(local) - 1)
        .join(cells, "__part")
        .withColumn("shard", F.size(F.filter("__bounds", lambda b: b <= F.col("__rank"))).cast("int"))
        .withColumn("__key", F.xxhash64("__row", F.lit(seed + 2)))
    )
    buckets = max(1, -(-n // (shards * rows_per_partition)))
    sent = materialize(sent.withColumn("__bucket", F.pmod("__key", F.lit(buckets)).cast("int")).drop("__bounds", "__rank", "__part"), "shuffle-sent")

    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "__bucket").count().select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    again = Window.partitionBy("shard", "__bucket").orderBy("__key", "__row")
    return (
        sent.withColumn("__rank", F.row_number().over(again) - 1)
        .join(offsets, ["shard", "__bucket"])
        .withColumn("slot", (F.col("__offset") + F.col("__rank")).cast("long"))
        .select(*(F.col("row").getField(c).alias(c) for c in kept), "shard", "slot")
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """The placement of documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as empty: size 16, checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    placed = communication_shuffle(narrow, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
