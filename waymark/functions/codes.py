"""Space and time codes: as columns for data, as plain integers for query ranges.

Time buckets have a fixed width from an epoch.  Z-order (Morton) codes number the cells of a 2^level
grid over the domain, x on the even bits.  XZ codes number quadtree elements: an extent gets the
deepest element whose doubled cell covers it.  Shape codes add which quarters of the doubled cell hold
points.  Interval codes treat [t0, t1] as the point square (t0, t0)-(t1, t1) of the unit square.

Ranges only ever over-select: exact predicates always follow.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Domain(NamedTuple):
    min_x: float
    min_y: float
    max_x: float
    max_y: float


class Rect(NamedTuple):
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def touches(self, o: Rect) -> bool:
        return self.min_x <= o.max_x and o.min_x <= self.max_x and self.min_y <= o.max_y and o.min_y <= self.max_y

    def covers(self, o: Rect) -> bool:
        return self.min_x <= o.min_x and self.min_y <= o.min_y and self.max_x >= o.max_x and self.max_y >= o.max_y


# --- time buckets ----------------------------------------------------------------------------------


def time_bucket(t_ms, epoch_ms: int, bucket_ms: int):
    """Bucket of an instant (column or int); instants before the epoch are an error when indexing."""
    if isinstance(t_ms, Column):
        early = F.raise_error(F.lit("an instant before the epoch has no bucket")).cast("bigint")
        return F.when(t_ms < epoch_ms, early).otherwise(F.floor((t_ms - epoch_ms) / F.lit(bucket_ms)).cast("bigint"))
    if t_ms < epoch_ms:
        raise ValueError("an instant before the epoch has no bucket")
    return (t_ms - epoch_ms) // bucket_ms


def buckets_covering(start_ms: int, end_ms: int, epoch_ms: int, bucket_ms: int) -> tuple[int, int] | None:
    """Buckets of the half-open window, both ends included; None if it is empty or all before the epoch."""
    if end_ms <= start_ms or end_ms <= epoch_ms:
        return None
    return (max(start_ms, epoch_ms) - epoch_ms) // bucket_ms, (end_ms - 1 - epoch_ms) // bucket_ms


# --- Z-order ---------------------------------------------------------------------------------------


def quantize(v, low: float, high: float, level: int):
    """Cell number of a coordinate, clamped to the grid (column or float)."""
    if not 1 <= level <= 16:
        raise ValueError("level must be 1..16")
    n = 1 << level
    cell = (high - low) / n
    if isinstance(v, Column):
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / cell))).cast("bigint")
    return max(0, min(n - 1, math.floor((v - low) / cell)))


def interleave(x, y, level: int):
    """Morton code: bit i of x at 2i, of y at 2i + 1 (columns or ints)."""
    if isinstance(x, Column):
        out = F.lit(0).cast("bigint")
        for i in range(level):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), 2 * i)).bitwiseOR(F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)), 2 * i + 1))
        return out
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(level))


def deinterleave(code: int, level: int) -> tuple[int, int]:
    return sum((code >> 2 * i & 1) << i for i in range(level)), sum((code >> 2 * i + 1 & 1) << i for i in range(level))


def cell_rect(rect: Rect, domain: Domain, level: int) -> tuple[int, int, int, int]:
    """Cells of a rectangle's corners, in order: x from, y from, x to, y to."""
    xs = sorted(quantize(v, domain.min_x, domain.max_x, level) for v in (rect.min_x, rect.max_x))
    ys = sorted(quantize(v, domain.min_y, domain.max_y, level) for v in (rect.min_y, rect.max_y))
    return xs[0], ys[0], xs[1], ys[1]


def merge_ranges(ranges: list[tuple[int, int]], most: int | None = None, weight=None) -> list[tuple[int, int]]:
    """Sorted disjoint closed ranges; over ``most``, the cheapest gaps are filled (left one on a tie).

    A gap costs its length, or ``weight(lo, hi)`` if given (postings in it).  Nothing is dropped.
    """
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    cost = weight or (lambda lo, hi: hi - lo + 1)
    while most is not None and len(out) > max(1, most):
        gaps = [(cost(a[1] + 1, b[0] - 1), i) for i, (a, b) in enumerate(zip(out, out[1:]))]
        _, i = min(gaps)
        out[i : i + 2] = [[out[i][0], out[i + 1][1]]]
    return [(lo, hi) for lo, hi in out]


def morton_ranges(rect: Rect, domain: Domain, level: int, most: int | None = None) -> list[tuple[int, int]]:
    """Code ranges that cover every cell of the rectangle."""
    x0, y0, x1, y1 = cell_rect(rect, domain, level)
    found: list[tuple[int, int]] = []
    stack = [(0, 0, level)]
    while stack:
        x, y, up = stack.pop()
        size = 1 << up
        if x > x1 or y > y1 or x + size - 1 < x0 or y + size - 1 < y0:
            continue
        if x0 <= x and y0 <= y and x + size - 1 <= x1 and y + size - 1 <= y1 or up == 0:
            base = interleave(x, y, level)
            found.append((base, base + size * size - 1))
        else:
            half = size // 2
            stack += [(x + i * half, y + j * half, up - 1) for i in (0, 1) for j in (0, 1)]
    return merge_ranges(found, most)


def ranges_cover(rect: Rect, ranges: list[tuple[int, int]], domain: Domain, level: int) -> bool:
    """Whether every cell of the rectangle lies in a range."""
    x0, y0, x1, y1 = cell_rect(rect, domain, level)
    return all(any(lo <= interleave(x, y, level) <= hi for lo, hi in ranges) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1))


def in_ranges(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a code lies in one of the ranges."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | (code == lo if lo == hi else code.between(lo, hi))
    return out


# --- quadtree elements -----------------------------------------------------------------------------


def element_count(level: int) -> int:
    """Elements at and below one element whose quarters go ``level`` deeper."""
    return (4 ** (level + 1) - 1) // 3


def xz_element(min_x: Column, min_y: Column, max_x: Column, max_y: Column, domain: Domain, depth: int) -> Column:
    """Element of an extent, as struct<ok, level, code>: the deepest cell of its lower corner whose doubled
    cell covers the extent.

    Elements are numbered in depth-first order, so a subtree is one range.  Extents are clamped to the
    domain.
    """
    unit = lambda v, low, high: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    box = F.struct(
        unit(min_x, domain.min_x, domain.max_x).alias("x0"), unit(min_y, domain.min_y, domain.max_y).alias("y0"),
        unit(max_x, domain.min_x, domain.max_x).alias("x1"), unit(max_y, domain.min_y, domain.max_y).alias("y1"),
    )
    steps = F.array(*(F.struct(F.lit(float(1 << k)).alias("n"), F.lit(element_count(depth - k)).cast("bigint").alias("below")) for k in range(1, depth + 1)))
    start = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("code"), box.alias("b"))

    def descend(acc: Column, step: Column) -> Column:
        n, b = step["n"], acc["b"]
        cx, cy = F.least(n - 1, F.floor(b["x0"] * n)), F.least(n - 1, F.floor(b["y0"] * n))
        ok = acc["ok"] & (b["x1"] <= (cx + 2) / n) & (b["y1"] <= (cy + 2) / n)
        quarter = (cx % 2 + 2 * (cy % 2)).cast("bigint")
        code = acc["code"] + F.when(ok, 1 + quarter * step["below"]).otherwise(F.lit(0).cast("bigint"))
        return F.struct(ok.alias("ok"), (acc["level"] + ok.cast("int")).alias("level"), code.alias("code"), b.alias("b"))

    return F.aggregate(steps, start, descend)


def xz_code(min_x: Column, min_y: Column, max_x: Column, max_y: Column, domain: Domain, depth: int) -> Column:
    return xz_element(min_x, min_y, max_x, max_y, domain, depth)["code"]


def element_level(code: int, depth: int) -> tuple[int, int, int]:
    """Level, x and y of an element by its number."""
    level = x = y = 0
    while code:
        level += 1
        quarter, code = divmod(code - 1, element_count(depth - level))
        x, y = 2 * x + quarter % 2, 2 * y + quarter // 2
    return level, x, y


def xz_ranges(rect: Rect, domain: Domain, depth: int, most: int | None = None) -> list[tuple[int, int]]:
    """Ranges of the elements whose doubled cells touch the rectangle."""
    w, h = domain.max_x - domain.min_x, domain.max_y - domain.min_y
    clamp = lambda v: max(0.0, min(1.0, v))
    q = Rect(clamp((rect.min_x - domain.min_x) / w), clamp((rect.min_y - domain.min_y) / h), clamp((rect.max_x - domain.min_x) / w), clamp((rect.max_y - domain.min_y) / h))
    found: list[tuple[int, int]] = []
    stack = [(0, 0, 0, 0)]
    while stack:
        level, x, y, code = stack.pop()
        n = 1 << level
        doubled = Rect(x / n, y / n, (x + 2) / n, (y + 2) / n)
        if not doubled.touches(q):
            continue
        cell = Rect(x / n, y / n, (x + 1) / n, (y + 1) / n)
        if q.covers(cell) or level == depth:
            found.append((code, code + element_count(depth - level) - 1))
            continue
        found.append((code, code))
        stack += [(level + 1, 2 * x + i, 2 * y + j, code + 1 + (i + 2 * j) * element_count(depth - level - 1)) for i in (0, 1) for j in (0, 1)]
    return merge_ranges(found, most)


def shape_mask(points: Column, min_x: Column, min_y: Column, level: Column, domain: Domain) -> Column:
    """Which of the four cells of the doubled element hold a point, as bits 0..3 (x first)."""
    n = F.pow(F.lit(2.0), level)
    cell = lambda v, low, high: F.greatest(F.lit(0.0), F.least(n - 1, F.floor((v - low) / F.lit(high - low) * n)))
    bx, by = cell(min_x, domain.min_x, domain.max_x), cell(min_y, domain.min_y, domain.max_y)

    def bit(p: Column) -> Column:
        dx = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cell(p["x"], domain.min_x, domain.max_x) - bx))
        dy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cell(p["y"], domain.min_y, domain.max_y) - by))
        return F.pow(F.lit(2.0), dx + 2 * dy).cast("int")

    return F.aggregate(points, F.lit(0), lambda acc, p: acc.bitwiseOR(bit(p)))


def tshape_code(xz: Column, mask: Column) -> Column:
    """Element number and shape: location << 4 | mask."""
    return F.shiftleft(xz, 4).bitwiseOR(mask.cast("bigint"))


def tshape_ranges(rect: Rect, domain: Domain, depth: int, most: int | None = None) -> list[tuple[int, int]]:
    """Ranges of shape codes: the elements touched, whatever their shapes."""
    return [(lo << 4, hi << 4 | 15) for lo, hi in xz_ranges(rect, domain, depth, most)]


def xzt_code(t0: Column, t1: Column, start_ms: int, end_ms: int, depth: int) -> Column:
    """Element of the interval's square over the horizon; instants outside are clamped."""
    d = Domain(float(start_ms), float(start_ms), float(end_ms), float(end_ms))
    a, b = t0.cast("double"), t1.cast("double")
    return xz_code(a, a, b, b, d, depth)


def xzt_ranges(start_ms: int, end_ms: int, horizon: tuple[int, int], depth: int, most: int | None = None) -> list[tuple[int, int]]:
    """Elements that can hold an interval with t0 < end and t1 >= start."""
    lo, hi = map(float, horizon)
    return xz_ranges(Rect(lo, lo, min(float(end_ms), hi), hi), Domain(lo, lo, hi, hi), depth, most)
