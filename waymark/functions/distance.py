"""Trajectory distances: of many trajectories to one reference, and as native column expressions.

A point array is ``array<struct<..., x: double, y: double>>``.  All three metrics use the Euclidean
distance of points, no window and no normalisation.  A distance to an empty trajectory is an error.

``Scorer`` takes Arrow batches: trajectories of like length advance together, one anti-diagonal of the
dynamic program a step, so a distance costs n*m cells and memory for three diagonals.  The column
expressions, which the SQL functions share, fold the left array row by row and copy each row as it
grows: they are for short arrays.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Scorers travel whole, so executors need not have this package to score.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

METRICS = ("DTW", "FRECHET", "HAUSDORFF")
EMPTY = "an empty trajectory has no distance"
#: Cells of a diagonal, or of a table of distances, held at once.
CELLS = 1 << 18
#: Points of a trajectory that its lower bound looks at.
BOUND_POINTS = 8


def euclid(p: Column, q: Column) -> Column:
    dx, dy = p["x"] - q["x"], p["y"] - q["y"]
    return F.sqrt(dx * dx + dy * dy)


def _fold_rows(a: Column, b: Column, first_row, next_cell) -> Column:
    """Fold ``a``; a row is array<double> over ``b``, built left to right."""

    def next_row(row: Column, p: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            d = euclid(p, F.element_at(b, j))
            left = F.when(j > 1, F.element_at(acc, -1))
            above = F.element_at(row, j)
            corner = F.when(j > 1, F.element_at(row, F.greatest(j - 1, F.lit(1))))
            return F.array_append(acc, next_cell(d, left, above, corner))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array().cast("array<double>"), cell)

    start = first_row(F.element_at(a, 1))
    rest = F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    return _if_points(a, b, F.element_at(F.aggregate(rest, start, next_row), -1))


def _if_points(a: Column, b: Column, value: Column) -> Column:
    some = (F.coalesce(F.size(a), F.lit(0)) > 0) & (F.coalesce(F.size(b), F.lit(0)) > 0)
    return F.when(some, value).otherwise(F.raise_error(F.lit(EMPTY)).cast("double"))


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping: D(i,j) = d(i,j) + min(D(i-1,j), D(i,j-1), D(i-1,j-1))."""

    def first(p: Column) -> Column:
        return F.aggregate(b, F.array().cast("array<double>"), lambda acc, q: F.array_append(acc, euclid(p, q) + F.coalesce(F.when(F.size(acc) > 0, F.element_at(acc, -1)), F.lit(0.0))))

    return _fold_rows(a, b, first, lambda d, left, above, corner: d + F.least(above, left, corner))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Fréchet: C(i,j) = max(d(i,j), min of the three predecessors)."""

    def first(p: Column) -> Column:
        return F.aggregate(b, F.array().cast("array<double>"), lambda acc, q: F.array_append(acc, F.greatest(euclid(p, q), F.when(F.size(acc) > 0, F.element_at(acc, -1)))))

    return _fold_rows(a, b, first, lambda d, left, above, corner: F.greatest(d, F.least(above, left, corner)))


def nearest(a: Column, b: Column) -> Column:
    """For each point of ``a`` the distance to its nearest point of ``b``."""
    return F.transform(a, lambda p: F.array_min(F.transform(b, lambda q: euclid(p, q))))


def hausdorff(a: Column, b: Column) -> Column:
    """Symmetric Hausdorff: the larger of both directed distances."""
    return _if_points(a, b, F.greatest(F.array_max(nearest(a, b)), F.array_max(nearest(b, a))))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Dispatch by name; an unknown or missing metric is an error, never defaulted."""
    found = {"DTW": dtw, "FRECHET": frechet, "HAUSDORFF": hausdorff}.get(str(metric).upper() if metric else "")
    if found is None:
        raise ValueError(f"no metric is called {metric!r}; there are {', '.join(METRICS)}")
    return found(a, b)


def cells(metric: str, n: Column, m) -> Column:
    """Point comparisons that a distance costs: n*m, for Hausdorff twice that."""
    return n.cast("bigint") * m * (2 if metric.upper() == "HAUSDORFF" else 1)


def point_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and all x and all y one after the other, of a column of point arrays."""
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    points = column.flatten()
    return sizes, *(points.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))


class Scorer:
    """Distances and lower bounds to one reference."""

    def __init__(self, metric: str, reference: list[tuple[float, float]]) -> None:
        self.metric = metric.upper() if metric else ""
        if self.metric not in METRICS:
            raise ValueError(f"no metric is called {metric!r}; there are {', '.join(METRICS)}")
        if not reference:
            raise ValueError(EMPTY)
        self.bx, self.by = np.array(reference, dtype=float).T

    def _to(self, x: np.ndarray, y: np.ndarray, j) -> np.ndarray:
        dx, dy = x - self.bx[j], y - self.by[j]
        return np.sqrt(dx * dx + dy * dy)

    def _nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each point its nearest reference point's distance, and the other way round."""
        out, back = np.empty(len(x)), np.full(len(self.bx), np.inf)
        step = max(1, CELLS // len(self.bx))
        for lo in range(0, len(x), step):
            d = self._to(x[lo : lo + step, None], y[lo : lo + step, None], slice(None))
            out[lo : lo + step] = d.min(1)
            np.minimum(back, d.min(0), out=back)
        return out, back

    def _diagonals(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The dynamic program for rows of ``x`` and ``y``, padded to one length."""
        rows, length = x.shape
        m = len(self.bx)
        out = np.empty(rows)
        before, last = np.full((rows, length + 1), np.inf), np.full((rows, length + 1), np.inf)  # place i + 1: cell (i, s - i)
        for s in range(length + m - 1):
            lo, hi = max(0, s - m + 1), min(s, length - 1) + 1
            d = self._to(x[:, lo:hi], y[:, lo:hi], np.arange(s - lo, s - hi, -1))
            least = np.minimum(np.minimum(last[:, lo + 1 : hi + 1], last[:, lo:hi]), before[:, lo:hi]) if s else np.zeros_like(d)
            now = np.full_like(last, np.inf)
            now[:, lo + 1 : hi + 1] = d + least if self.metric == "DTW" else np.maximum(d, least)
            before, last = last, now
            done = np.flatnonzero(sizes + m - 2 == s)
            out[done] = now[done, sizes[done]]
        return out

    def distances(self, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not sizes.all():
            raise ValueError(EMPTY)
        ends = np.cumsum(sizes)
        out = np.empty(len(sizes))
        if self.metric == "HAUSDORFF":
            for i, (a, z) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
                there, back = self._nearest(x[a:z], y[a:z])
                out[i] = max(there.max(), back.max())
            return out
        order = np.argsort(sizes, kind="stable")
        hi = 0
        while hi < len(order):
            lo = hi
            while hi < len(order) and (hi == lo or (hi + 1 - lo) * sizes[order[hi]] <= CELLS):
                hi += 1
            own = order[lo:hi]
            at = np.minimum(np.arange(sizes[own].max()), sizes[own, None] - 1) + (ends - sizes)[own, None]
            out[own] = self._diagonals(x[at], y[at], sizes[own])
        return out

    def bounds(self, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """No distance is less: some points' nearest distances, and the pairs of first and of last points, which
        the dynamic programs always align."""
        if not sizes.all():
            raise ValueError(EMPTY)
        ends = np.cumsum(sizes)
        k = np.linspace(0, 1, BOUND_POINTS)
        at = (ends - sizes)[:, None] + np.round(k * (sizes[:, None] - 1)).astype(np.int64)
        near = self._nearest(x[at.ravel()], y[at.ravel()])[0].reshape(at.shape)
        if self.metric == "HAUSDORFF":
            return near.max(1)
        first, last = self._to(x[ends - sizes], y[ends - sizes], 0), self._to(x[ends - 1], y[ends - 1], -1)
        if self.metric == "FRECHET":
            return np.maximum(np.maximum(first, last), near.max(1))
        # Points that occur in the sample once, and are neither first nor last, add their nearest distance.
        inner = np.ones(at.shape, bool)
        inner[:, 1:] &= at[:, 1:] != at[:, :-1]
        inner &= (at > (ends - sizes)[:, None]) & (at < ends[:, None] - 1)
        both = np.where((sizes > 1) | (len(self.bx) > 1), first + last, np.maximum(first, last))
        return both + np.where(inner, near, 0.0).sum(1)

    def score(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """tid and distance of each row (tid, pts)."""
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(self.distances(*point_arrays(batch.column(1))))], names=["tid", "distance"])

    def best(self, batches: Iterator[pa.RecordBatch], k: int, slack: float) -> Iterator[pa.RecordBatch]:
        """The k nearest of all rows (tid, pts), by distance and tid.

        Rows are scored in the order of their bounds, until a bound exceeds the kth distance so far by
        more than the relative slack.
        """
        tids, found = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            sizes, x, y = point_arrays(batch.column(1))
            own = batch.column(0).to_numpy()
            bound = self.bounds(sizes, x, y)
            starts = np.cumsum(sizes) - sizes
            order = np.argsort(bound, kind="stable")
            at, step = 0, max(k, 64)
            while at < len(order):
                limit = found[-1] * (1 + slack) if len(found) == k else np.inf
                some = order[at : at + step]
                some = some[bound[some] <= limit]
                if not len(some):
                    break
                at += step
                place = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[some].tolist(), sizes[some].tolist())])
                tids, found = np.concatenate([tids, own[some]]), np.concatenate([found, self.distances(sizes[some], x[place], y[place])])
                keep = np.lexsort((tids, found))[:k]
                tids, found = tids[keep], found[keep]
        yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(found, pa.float64())], names=["tid", "distance"])


def register(spark: SparkSession) -> None:
    """SQL functions traj_dtw, traj_frechet and traj_hausdorff over two point arrays."""
    kind = "array<struct<x: double, y: double>>"
    d = "sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y))"
    near = lambda s, t: f"array_max(transform({s}, p -> array_min(transform({t}, q -> {d}))))"
    fold = "aggregate(a, CAST(NULL AS array<double>), (row, p) -> aggregate(sequence(1, size(b)), CAST(array() AS array<double>), (acc, j) -> array_append(acc, {cell})), r -> element_at(r, -1))"
    dd = "sqrt((p.x - element_at(b, j).x) * (p.x - element_at(b, j).x) + (p.y - element_at(b, j).y) * (p.y - element_at(b, j).y))"
    before = "least(element_at(row, j), IF(j > 1, element_at(acc, -1), NULL), IF(j > 1, element_at(row, greatest(j - 1, 1)), NULL))"
    for name, body in (
        ("traj_dtw", fold.format(cell=f"{dd} + coalesce({before}, 0D)")),
        ("traj_frechet", fold.format(cell=f"greatest({dd}, {before})")),
        ("traj_hausdorff", f"greatest({near('a', 'b')}, {near('b', 'a')})"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a {kind}, b {kind}) RETURNS double RETURN {body}")
