"""The nineteen plan operators, each a function from DataFrames to a DataFrame.

Chunk references are rows (tid, chunk_id).  Scans read posting tables by code range and keep only exact
codes; they may over-select, and EXACT_ST_FILTER always follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import codes, distance
from waymark.functions.codes import Rect
from waymark.operators.postings import REF
from waymark.plans import predicates

REFS = list(REF)


class DataIntegrityError(RuntimeError):
    """A referenced chunk is not stored."""


class ResourceExhausted(RuntimeError):
    """A query would exceed a stated budget; there is no partial answer."""


# --- access paths: chunk references -----------------------------------------------------------------


def scan_codes(posted: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    return posted.where(codes.in_ranges(F.col("code"), ranges)).select(*REFS).distinct()


def time_range_scan(posted: DataFrame, window: tuple[int, int], layout) -> DataFrame:
    """TIME_RANGE_SCAN: chunks posted to a bucket of the window."""
    span = codes.buckets_covering(*window, layout.epoch_ms, layout.bucket_ms)
    return scan_codes(posted, [span] if span else [])


def zorder_range_scan(posted: DataFrame, box: Rect, layout, max_ranges: int | None = 64) -> DataFrame:
    """ZORDER_RANGE_SCAN: chunks posted to a cell of the box; coarse ranges are filtered to its exact cells."""
    fine = codes.morton_ranges(box, layout.domain, layout.zorder_level)
    coarse = codes.merge_ranges(fine, max_ranges)
    scanned = posted.where(codes.in_ranges(F.col("code"), coarse))
    return (scan_codes(scanned, fine) if coarse != fine else scanned.select(*REFS).distinct())


def xz_range_scan(posted: DataFrame, box: Rect, layout, max_ranges: int | None = 64) -> DataFrame:
    """XZ_RANGE_SCAN: chunks whose element's doubled cell touches the box."""
    return scan_codes(posted, codes.xz_ranges(box, layout.domain, layout.xz_level, max_ranges))


def tshape_range_scan(posted: DataFrame, box: Rect, layout, max_ranges: int | None = 64) -> DataFrame:
    """TSHAPE_RANGE_SCAN: the same over shape codes."""
    return scan_codes(posted, codes.tshape_ranges(box, layout.domain, layout.tshape_level, max_ranges))


def xzt_range_scan(posted: DataFrame, window: tuple[int, int], layout, max_ranges: int | None = 64) -> DataFrame:
    """XZT_RANGE_SCAN: chunks whose interval's element can overlap the window."""
    return scan_codes(posted, codes.xzt_ranges(*window, layout.horizon_ms, layout.xzt_level, max_ranges))


def equality_lookup(posted: DataFrame, vehicle: str) -> DataFrame:
    """EQUALITY_LOOKUP: chunks under the vehicle's hash whose stored value is the vehicle."""
    return posted.where((F.col("code") == F.xxhash64(F.lit(vehicle))) & (F.col("vehicle_id") == vehicle)).select(*REFS)


def full_scan_chunks(chunks: DataFrame) -> DataFrame:
    """FULL_SCAN_CHUNKS."""
    return chunks


# --- sets of references -----------------------------------------------------------------------------

MERGES = {"HASH_SET": "shuffle_hash", "SORT_MERGE": "merge"}


def intersect(inputs: list[DataFrame], merge: str) -> DataFrame:
    """INTERSECT of two or more reference sets; ``merge`` names the join: HASH_SET or SORT_MERGE."""
    if len(inputs) < 2:
        raise ValueError("INTERSECT needs two inputs or more")
    out = inputs[0]
    for other in inputs[1:]:
        out = out.join(other.hint(MERGES[merge]), REFS, "left_semi")
    return out


def union(inputs: list[DataFrame]) -> DataFrame:
    """UNION of two or more reference sets."""
    if len(inputs) < 2:
        raise ValueError("UNION needs two inputs or more")
    out = inputs[0]
    for other in inputs[1:]:
        out = out.unionByName(other)
    return out.distinct()


def deduplicate(refs: DataFrame) -> DataFrame:
    """DEDUPLICATE."""
    return refs.dropDuplicates(REFS)


# --- chunks -----------------------------------------------------------------------------------------


def chunk_meta_filter(refs: DataFrame, chunks: DataFrame, ir: dict) -> DataFrame:
    """CHUNK_META_FILTER: references whose stored extent can match; the extent columns alone are read."""
    return refs.join(chunks.where(predicates.chunk_predicate(ir)).select(*REFS), REFS, "left_semi")


def check_chunks(refs: DataFrame, chunks: DataFrame) -> None:
    """Raise if a referenced chunk is not stored."""
    if refs.join(chunks.select(*REFS), REFS, "left_anti").limit(1).count():
        raise DataIntegrityError("a referenced chunk is not stored")


def fetch_trajectory_chunk(refs: DataFrame, chunks: DataFrame, check: bool = False) -> DataFrame:
    """FETCH_TRAJECTORY_CHUNK: the chunks of references; with ``check`` a missing one is an error."""
    if check:
        check_chunks(refs, chunks)
    return chunks.join(refs.select(*REFS).distinct(), REFS, "left_semi")


def exact_st_filter(chunks: DataFrame, ir: dict) -> DataFrame:
    """EXACT_ST_FILTER: chunks with a sample that satisfies everything the query asks."""
    return chunks.where(predicates.chunk_matches(ir))


# --- trajectories -----------------------------------------------------------------------------------


def project_trajectory_ids(chunks: DataFrame) -> DataFrame:
    """PROJECT_TRAJECTORY_IDS."""
    return chunks.select("tid").distinct()


def exclude_reference(tids: DataFrame, reference_tid: int) -> DataFrame:
    """EXCLUDE_REFERENCE."""
    return tids.where(F.col("tid") != reference_tid)


def batch_get_trajectory(tids: DataFrame, trajectories: DataFrame) -> DataFrame:
    """BATCH_GET_TRAJECTORY: tid and all points in order."""
    return trajectories.join(tids, "tid", "left_semi")


Points = list[tuple[float, float]]


def reference_points(trajectories: DataFrame, reference_tid: int) -> Points:
    """The reference's points in order: one trajectory, so they come to the driver and go to every task."""
    row = trajectories.where(F.col("tid") == reference_tid).select("pts.x", "pts.y").first()
    if row is None:
        raise DataIntegrityError("the reference trajectory is not stored")
    return list(zip(row[0], row[1]))


def check_cells(candidates: DataFrame, reference: Points, metric: str, max_cells: int, max_bytes: int | None = None) -> None:
    """Raise before scoring if the comparisons in all, or the candidates' points, exceed their budget."""
    size = F.size("pts")
    cells, points = candidates.agg(F.sum(distance.cells(metric, size, len(reference))), F.sum(size.cast("bigint"))).first()
    if (cells or 0) > max_cells:
        raise ResourceExhausted(f"{cells} point comparisons; the budget is {max_cells}")
    if max_bytes is not None and (points or 0) * POINT_BYTES > max_bytes:
        raise ResourceExhausted(f"{points * POINT_BYTES} bytes of candidates; the budget is {max_bytes}")


def similarity(candidates: DataFrame, metric: str, reference: Points) -> DataFrame:
    """SIMILARITY: tid and distance of each candidate (tid, pts); an empty candidate is an error."""
    scorer = distance.Scorer(metric, reference)
    return candidates.select("tid", "pts").mapInArrow(scorer.score, "tid bigint, distance double")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """TOP_K by distance, ties by tid; with fewer candidates than k, all."""
    return scored.orderBy("distance", "tid").limit(k)


def return_trajectory_ids(tids: DataFrame, meta: DataFrame) -> DataFrame:
    """RETURN_TRAJECTORY_IDS: external ids in tid order."""
    return meta.join(tids, "tid", "left_semi").orderBy("tid").select("tid", "trajectory_id")


# --- pruned top-k -----------------------------------------------------------------------------------

SLACK = 1e-9
POINT_BYTES = 32


def top_k_pruned(candidates: DataFrame, metric: str, k: int, reference: Points) -> DataFrame:
    """TOP_K with an exact lower bound, in one pass: tid, distance, as ``top_k`` of ``similarity``.

    Each task scores its candidates in the order of their bounds and stops where a bound is strictly over
    its kth distance, with a relative slack; so it passes on k rows at most.
    """
    scorer = distance.Scorer(metric, reference)
    best = candidates.select("tid", "pts").mapInArrow(lambda batches: scorer.best(batches, k, SLACK), "tid bigint, distance double")
    return top_k(best, k)


def ranked(scored: DataFrame) -> DataFrame:
    """Scores with their rank (for small results)."""
    return scored.withColumn("rank", F.row_number().over(Window.orderBy("distance", "tid")))
