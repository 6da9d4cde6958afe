"""Exact predicates, and the predicates they imply for whole chunks.

Windows are half-open, boxes closed, and one sample must satisfy both; several windows (boxes) are
alternatives.  A chunk predicate must hold for every chunk with such a sample and may hold for others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.codes import Rect
from waymark.plans import ir as _ir

TRUE = F.lit


def any_of(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a | b, parts) if parts else None


def all_of(parts: list[Column | None]) -> Column:
    kept = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, kept) if kept else F.lit(True)


def in_window(t: Column, window: tuple[int, int]) -> Column:
    return (t >= window[0]) & (t < window[1])


def in_box(x: Column, y: Column, box: Rect) -> Column:
    return (x >= box.min_x) & (x <= box.max_x) & (y >= box.min_y) & (y <= box.max_y)


def sample_matches(ir: dict, t: Column, x: Column, y: Column) -> Column | None:
    """Whether a sample satisfies time and space; None if the query asks for neither."""
    parts = [any_of([in_window(t, w) for w in _ir.windows(ir)]), any_of([in_box(x, y, b) for b in _ir.boxes(ir)])]
    return all_of(parts) if any(p is not None for p in parts) else None


def vehicle_matches(ir: dict) -> Column | None:
    return all_of([F.col("vehicle_id") == v for v in _ir.vehicles(ir)]) if _ir.vehicles(ir) else None


def point_predicate(ir: dict) -> Column:
    """The exact predicate on the flat points table."""
    return all_of([sample_matches(ir, F.col("t_ms"), F.col("x_m"), F.col("y_m")), vehicle_matches(ir)])


def chunk_overlaps_window(window: tuple[int, int]) -> Column:
    return (F.col("t_min") < window[1]) & (F.col("t_max") >= window[0])


def chunk_overlaps_box(box: Rect) -> Column:
    return (F.col("min_x") <= box.max_x) & (F.col("max_x") >= box.min_x) & (F.col("min_y") <= box.max_y) & (F.col("max_y") >= box.min_y)


def chunk_predicate(ir: dict) -> Column:
    """The implied predicate on chunk extents; plain comparisons, so it reaches the Parquet scan."""
    return all_of([any_of([chunk_overlaps_window(w) for w in _ir.windows(ir)]), any_of([chunk_overlaps_box(b) for b in _ir.boxes(ir)]), vehicle_matches(ir)])


def chunk_matches(ir: dict) -> Column:
    """The exact predicate on a chunk with its points."""
    exact = sample_matches(ir, F.lit(0), F.lit(0), F.lit(0))
    if exact is None:
        return all_of([vehicle_matches(ir)])
    return all_of([F.exists("points", lambda p: sample_matches(ir, p["t"], p["x"], p["y"])), vehicle_matches(ir)])
