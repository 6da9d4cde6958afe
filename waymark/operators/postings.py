"""Posting tables: code to chunk, six kinds, with their statistics and their verification."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import codes

KINDS = ("time", "zorder", "hash", "xz", "tshape", "xzt")


class Layout(NamedTuple):
    """How a snapshot is laid out; defaults as the system's, the domain and epoch from the data."""

    domain: codes.Domain
    epoch_ms: int
    horizon_ms: tuple[int, int]
    bucket_ms: int = 600_000
    chunk_max_points: int = 256
    zorder_level: int = 8
    xz_level: int = 12
    tshape_level: int = 12
    xzt_level: int = 12

    def to_json(self) -> dict:
        return self._asdict() | {"domain": list(self.domain), "horizon_ms": list(self.horizon_ms)}

    @staticmethod
    def from_json(value: dict) -> Layout:
        return Layout(**value | {"domain": codes.Domain(*value["domain"]), "horizon_ms": tuple(value["horizon_ms"])})


REF = ("tid", "chunk_id")


def time_codes(layout: Layout) -> Column:
    """A chunk is posted to every bucket from its first to its last time; one before the epoch is an error."""
    bucket = lambda c: codes.time_bucket(F.col(c), layout.epoch_ms, layout.bucket_ms)
    return F.sequence(bucket("t_min"), bucket("t_max"))


def zorder_codes(layout: Layout) -> Column:
    """A chunk is posted to every grid cell that its extent touches."""
    d, level, zero = layout.domain, layout.zorder_level, F.lit(0).cast("bigint")
    cell = lambda c, low, high: codes.quantize(F.col(c), low, high, level)
    xs = F.transform(F.sequence(cell("min_x", d.min_x, d.max_x), cell("max_x", d.min_x, d.max_x)), lambda x: codes.interleave(x, zero, level))
    ys = F.transform(F.sequence(cell("min_y", d.min_y, d.max_y), cell("max_y", d.min_y, d.max_y)), lambda y: codes.interleave(zero, y, level))
    # Both are bound as a lambda's variable, so the bits are spread once per column and row of cells.
    sides = F.array(F.struct(xs.alias("xs"), ys.alias("ys")))
    return F.element_at(F.transform(sides, lambda s: F.flatten(F.transform(s["xs"], lambda x: F.transform(s["ys"], lambda y: x.bitwiseOR(y))))), 1)


def hash_codes(layout: Layout) -> Column:
    """One posting per chunk under the hash of its vehicle."""
    return F.array(F.xxhash64("vehicle_id"))


def _extent(layout: Layout, level: int):
    return F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), layout.domain, level


def xz_codes(layout: Layout) -> Column:
    return F.array(codes.xz_code(*_extent(layout, layout.xz_level)))


def tshape_codes(layout: Layout) -> Column:
    # The element is bound as a lambda's variable, so it is computed once for all points of a chunk.
    element = F.array(codes.xz_element(*_extent(layout, layout.tshape_level)))

    def shaped(e):
        return codes.tshape_code(e["code"], codes.shape_mask(F.col("points"), F.col("min_x"), F.col("min_y"), e["level"], layout.domain))

    return F.transform(element, shaped)


def xzt_codes(layout: Layout) -> Column:
    return F.array(codes.xzt_code(F.col("t_min"), F.col("t_max"), *layout.horizon_ms, layout.xzt_level))


#: The codes of one chunk, an array of distinct ones.
CODES = {"time": time_codes, "zorder": zorder_codes, "hash": hash_codes, "xz": xz_codes, "tshape": tshape_codes, "xzt": xzt_codes}


def build(kind: str, chunks: DataFrame, layout: Layout) -> DataFrame:
    """code, tid, chunk_id; of hash also the vehicle, to reject collisions."""
    return chunks.select(F.explode(CODES[kind](layout)).alias("code"), *REF, *(["vehicle_id"] if kind == "hash" else []))


def verify(kind: str, stored: DataFrame, chunks: DataFrame, layout: Layout) -> DataFrame:
    """Differences from the expected postings: code, tid, chunk_id, fault (MISSING or EXTRA); none if sound.
    A posting that differs is one row, however often it is stored.

    The codes of a chunk are compared as arrays, one row per chunk.  Posting files are so small for their
    rows that Spark would take either side of a join of single postings for one to broadcast; a full outer
    join is never broadcast.
    """
    expected = chunks.select(*REF, CODES[kind](layout).alias("expected"))
    found = stored.groupBy(*REF).agg(F.collect_list("code").alias("found"), F.count(F.when(F.col("code").isNull(), 1)).alias("nulls"))
    found = found.select(*REF, F.when(F.col("nulls") > 0, F.concat("found", F.array(F.lit(None).cast("bigint")))).otherwise(F.col("found")).alias("found"))
    none = F.array().cast("array<bigint>")
    both = expected.join(found, list(REF), "full").select(*REF, F.coalesce("expected", none).alias("expected"), F.coalesce("found", none).alias("found"))
    faults = lambda a, b, name: F.transform(F.array_except(a, b), lambda c: F.struct(c.alias("code"), F.lit(name).alias("fault")))
    differing = F.concat(faults("expected", "found", "MISSING"), faults("found", "expected", "EXTRA"))
    return both.select(*REF, F.explode(differing).alias("f")).select("f.code", *REF, "f.fault")


def posting_counts(stored: DataFrame) -> DataFrame:
    """Postings of each code."""
    return stored.groupBy("code").agg(F.count("*").alias("n"))


# The bins of the length histograms.
LENGTH_BINS = ((1, 1, "1"), (2, 16, "2-16"), (17, 64, "17-64"), (65, 256, "65-256"), (257, None, "257+"))


def length_histogram(rows: DataFrame, column: str = "n_points") -> DataFrame:
    """bin, n: how many rows have a length in each of five bins."""
    label = F.lit(None).cast("string")
    for lo, hi, name in LENGTH_BINS:
        label = F.when(F.col(column).between(lo, hi) if hi else F.col(column) >= lo, name).otherwise(label)
    return rows.groupBy(label.alias("bin")).agg(F.count("*").alias("n")).where("bin IS NOT NULL")


def chunk_sample(chunks: DataFrame, per_mille: int = 10) -> DataFrame:
    """A repeatable sample of chunks by the hash of their reference (1 % by default)."""
    return chunks.where(F.pmod(F.xxhash64("tid", "chunk_id"), F.lit(1000)) < per_mille)


def pass_rate(chunks: DataFrame, per_mille: int = 10) -> DataFrame:
    """samples, hits and smoothed rate (hits + 1) / (samples + 2) of the sample's chunks that have a point in
    the middle half of the time range: one row."""
    span = chunks.agg(F.min("t_min").alias("lo"), F.max("t_max").alias("hi"))
    sample = chunk_sample(chunks, per_mille).withColumn("__k", F.lit(1)).join(F.broadcast(span.withColumn("__k", F.lit(1))), "__k")
    quarter = (F.col("hi") - F.col("lo")) / 4
    hit = F.exists("points", lambda p: (p["t"] >= F.col("lo") + quarter) & (p["t"] < F.col("hi") - quarter))
    counted = sample.agg(F.count("*").alias("samples"), F.count(F.when(hit, 1)).alias("hits"))
    return counted.withColumn("rate", (F.col("hits") + 1) / (F.col("samples") + 2))
