"""Snapshots: the stored form of a data set, built once and then read by every query.

Tables (Parquet) under one path: ``points`` (flat, the exact filters' scan), ``chunks`` (extents and
nested points), both in the order of time bucket and grid cell, so that files and row groups have
narrow ranges of time and place and scans skip those off the query; ``trajectories`` (whole point
arrays) and ``meta`` in the order of tid; ``rejects``; one posting table per kind, ``stats_*``, and
``manifest``.  A posting table enters the manifest only after it is verified in both directions; a
rebuilt one is a new folder, and the manifest's next version names it.  The manifest is appended to,
one line a version, and a snapshot without a READY one is not opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import codes
from waymark.operators import ingest, postings
from waymark.operators.postings import Layout
from waymark.storage import append_json, delete, new_path, read_json_lines

TABLES = ("points", "chunks", "trajectories", "meta")
VERSION = "1.0"
DAY_MS = 86_400_000


class SnapshotError(RuntimeError):
    """A snapshot is missing, not READY, or its postings don't agree with its chunks."""


class Snapshot:
    """An opened snapshot."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict) -> None:
        self.spark, self.path, self.manifest = spark, path, manifest
        self.layout = Layout.from_json(manifest["layout"])
        self.dataset_id = manifest["dataset_id"]
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    @property
    def size(self) -> tuple[int, int]:
        """Chunks and points."""
        if "n_chunks" not in self.manifest:
            self.manifest |= {"n_chunks": self.chunks.count(), "n_points": self.points.count()}
        return self.manifest["n_chunks"], self.manifest["n_points"]

    def postings(self, kind: str) -> DataFrame:
        """The posting table; one that was not built with the snapshot is built and verified at its first use."""
        if kind not in self.manifest["indexes"]:
            store_postings(self, kind)
        return self.table(self.manifest["indexes"][kind])


def store_postings(snapshot: Snapshot, kind: str, verify: bool = True) -> None:
    """Write a posting table to a new folder, verify it, and publish it by the manifest's next version."""
    name = f"idx_{kind}_{snapshot.manifest['version'] + 1}"
    path = f"{snapshot.path}/{name}"
    postings.build(kind, snapshot.chunks, snapshot.layout).write.mode("overwrite").option("compression", "zstd").parquet(path)
    if verify and postings.verify(kind, snapshot.spark.read.parquet(path), snapshot.chunks, snapshot.layout).limit(1).count():
        raise SnapshotError(f"postings of kind {kind} don't agree with the chunks")
    publish(snapshot, snapshot.manifest | {"indexes": snapshot.manifest["indexes"] | {kind: name}})


def publish(snapshot: Snapshot, manifest: dict) -> None:
    """Append the manifest's next version; readers take the greatest."""
    snapshot.manifest = manifest | {"version": manifest["version"] + 1}
    append_json(snapshot.spark, f"{snapshot.path}/manifest", snapshot.manifest)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    try:
        manifest = max(read_json_lines(spark, f"{path}/manifest"), key=lambda m: m["version"])
    except Exception as e:
        raise SnapshotError(f"no snapshot at {path}") from e
    if manifest.get("status") != "READY":
        raise SnapshotError(f"the snapshot at {path} is not READY")
    return Snapshot(spark, path, manifest)


def layout_of(points: DataFrame, chunk_max_points: int, bucket_ms: int, margin: float, domain: codes.Domain | None = None) -> Layout:
    """Domain, epoch and horizon from one aggregate over the points."""
    row = points.agg(F.min("x_m"), F.min("y_m"), F.max("x_m"), F.max("y_m"), F.min("t_ms"), F.max("t_ms")).first()
    if row[0] is None:
        return Layout(domain or codes.Domain(0.0, 0.0, 1.0, 1.0), 0, (0, 1), bucket_ms, chunk_max_points)
    domain = domain or codes.Domain(row[0] - margin, row[1] - margin, row[2] + margin, row[3] + margin)
    epoch = row[4] // bucket_ms * bucket_ms
    return Layout(domain, epoch, (epoch, row[5] + 30 * 86_400_000), bucket_ms, chunk_max_points)


def clustered(df: DataFrame, layout: Layout, t: str, x: str, y: str, *last: str) -> DataFrame:
    """Rows in the order of day, grid cell and time, dealt to files by it."""
    d, level = layout.domain, min(layout.zorder_level, 8)
    cell = codes.interleave(codes.quantize(F.col(x), d.min_x, d.max_x, level), codes.quantize(F.col(y), d.min_y, d.max_y, level), level)
    placed = df.withColumns({"__day": F.floor(F.col(t) / DAY_MS), "__cell": cell})
    order = ["__day", "__cell", t, *last]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__day", "__cell")


def build_snapshot(
    spark: SparkSession, raw: DataFrame, path: str | None = None, dataset_id: str = "dataset", chunk_max_points: int = 256, bucket_ms: int = 600_000, margin: float = 1000.0,
    domain: codes.Domain | None = None, kinds: tuple[str, ...] = postings.KINDS, verify: bool = True, layout: Layout | None = None, rejects: DataFrame | None = None,
) -> Snapshot:
    """Clean, number, chunk, index, verify and publish raw points (see ``operators.ingest``).

    ``rejects`` (trajectory_id, reason) are those of parsing; they are stored with those of cleaning.
    """
    path = path or new_path(spark, f"snapshot-{dataset_id}")
    write = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    # Cleaning sorts every point: it is done once, and written out.
    scratch = new_path(spark, "cleaned")
    ingest.judged(raw, domain).write.option("compression", "zstd").parquet(scratch)
    cleaned = ingest.sorted_out(spark.read.parquet(scratch))
    numbered = ingest.assign_tids(cleaned.points)
    layout = layout or layout_of(cleaned.points, chunk_max_points, bucket_ms, margin, domain)
    write(clustered(numbered, layout, "t_ms", "x_m", "y_m", "tid", "seq"), "points")
    points = read("points")
    chunks = ingest.chunk(points, layout.chunk_max_points)
    write(clustered(chunks, layout, "t_min", "min_x", "min_y", "tid", "chunk_id"), "chunks")
    chunks = read("chunks")
    write(ingest.concatenate(chunks).repartitionByRange("tid").sortWithinPartitions("tid"), "trajectories")
    write(ingest.trajectory_meta(points, layout.chunk_max_points).repartitionByRange("tid").sortWithinPartitions("tid"), "meta")
    write(cleaned.rejects if rejects is None else cleaned.rejects.unionByName(rejects.select("trajectory_id", "reason")), "rejects")
    delete(spark, scratch)
    manifest = {
        "manifest_id": f"{dataset_id}_ready", "status": "READY", "dataset_id": dataset_id, "layout": layout.to_json(), "semantics_version": VERSION, "kinds": list(postings.KINDS), "indexes": {}, "version": 0,
        "n_chunks": chunks.count(), "n_points": points.count(), "n_rejects": read("rejects").count(),
    }
    made = Snapshot(spark, path, manifest)
    indexes = {}
    for kind in kinds:
        indexes[kind] = f"idx_{kind}_1"
        write(postings.build(kind, chunks, layout), indexes[kind])
        if verify and postings.verify(kind, read(indexes[kind]), chunks, layout).limit(1).count():
            raise SnapshotError(f"postings of kind {kind} don't agree with the chunks")
    publish(made, manifest | {"indexes": indexes})
    return made


def write_stats(snapshot: Snapshot) -> None:
    """Posting counts, length histograms, chunk sample and pass rate beside the tables."""
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{snapshot.path}/stats_{name}")
    for kind in snapshot.manifest["kinds"]:
        write(postings.posting_counts(snapshot.postings(kind)), kind)
    write(postings.length_histogram(snapshot.meta), "trajectory_length")
    write(postings.length_histogram(snapshot.chunks), "chunk_size")
    write(postings.chunk_sample(snapshot.chunks), "chunk_sample")
    write(postings.pass_rate(snapshot.chunks), "pass_rate")


def rebuild_postings(snapshot: Snapshot, kind: str) -> None:
    """Write one posting table anew; the snapshot keeps the old one until the new one is verified."""
    store_postings(snapshot, kind)
