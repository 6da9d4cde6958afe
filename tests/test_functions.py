import math
import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import codes, distance, instants, projection
from waymark.functions.codes import Domain, Rect

POINTS = "array<struct<x: double, y: double>>"


def reference_distance(metric, a, b):
    d = lambda p, q: math.sqrt((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2)
    if metric == "HAUSDORFF":
        return max(max(min(d(p, q) for q in b) for p in a), max(min(d(p, q) for q in a) for p in b))
    grid = {}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            before = [grid[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in grid]
            if metric == "DTW":
                grid[i, j] = d(p, q) + (min(before) if before else 0)
            else:
                grid[i, j] = max(d(p, q), min(before)) if before else d(p, q)
    return grid[len(a) - 1, len(b) - 1]


def test_distances_against_plain_recurrences(spark):
    rng = random.Random(4)
    line = lambda n: [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(n)]
    rows = [(i, line(rng.randint(1, 7)), line(rng.randint(1, 7))) for i in range(30)]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in a], [{"x": x, "y": y} for x, y in b]) for i, a, b in rows], f"i int, a {POINTS}, b {POINTS}")
    distance.register(spark)
    df.createOrReplaceTempView("pairs")
    got = {r["i"]: r for r in df.select("i", *(distance.distance(m, F.col("a"), F.col("b")).alias(m) for m in distance.METRICS)).collect()}
    by_sql = {r["i"]: r for r in spark.sql("SELECT i, traj_dtw(a, b) AS DTW, traj_frechet(a, b) AS FRECHET, traj_hausdorff(a, b) AS HAUSDORFF FROM pairs").collect()}
    for i, a, b in rows:
        for m in distance.METRICS:
            want = reference_distance(m, a, b)
            assert got[i][m] == pytest.approx(want, rel=1e-12)
            assert by_sql[i][m] == pytest.approx(want, rel=1e-12)


def test_hand_calculated_distances(spark):
    rows = [("FRECHET", [(0, 0), (1, 0), (2, 0)], [(0, 0), (1, 0), (2, 0)], 0.0), ("FRECHET", [(0, 0), (1, 0), (2, 0)], [(0, 0), (0, 1), (0, 2)], math.sqrt(8)), ("HAUSDORFF", [(0, 0), (2, 0)], [(0, 0), (1, 0)], 1.0)]
    for m, a, b, want in rows:
        df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in a], [{"x": float(x), "y": float(y)} for x, y in b])], f"a {POINTS}, b {POINTS}")
        assert df.select(distance.distance(m, F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)
    empty = spark.createDataFrame([([], [])], f"a {POINTS}, b {POINTS}")
    for m in distance.METRICS:
        with pytest.raises(Exception, match="empty trajectory"):
            empty.select(distance.distance(m, F.col("a"), F.col("b"))).collect()


def point_batch(lines):
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    return pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), pa.array([[{"x": x, "y": y} for x, y in a] for a in lines], kind)], names=["tid", "pts"])


@pytest.mark.parametrize("cells", [1, 20, 1 << 18])
@pytest.mark.parametrize("metric", distance.METRICS)
def test_scorer_against_plain_recurrences(metric, cells, monkeypatch):
    monkeypatch.setattr(distance, "CELLS", cells)
    rng = random.Random(cells)
    line = lambda n: [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(n)]
    for size in (1, 2, 9):
        reference, lines = line(size), [line(rng.randint(1, 14)) for _ in range(25)]
        scorer = distance.Scorer(metric, reference)
        batch = point_batch([[(0.0, 0.0)], *lines]).slice(1)
        want = [reference_distance(metric, a, reference) for a in lines]
        got = next(scorer.score(iter([batch])))
        assert got.column("distance").to_pylist() == pytest.approx(want, rel=1e-12)
        assert all(b <= w * (1 + 1e-12) for b, w in zip(scorer.bounds(*distance.point_arrays(batch.column(1))), want))
        best = next(scorer.best(iter([batch.slice(0, 9), batch.slice(9)]), 4, 1e-9))
        assert best.column("tid").to_pylist() == [t + 1 for _, t in sorted((w, i) for i, w in enumerate(want))[:4]]
    with pytest.raises(ValueError, match="empty trajectory"):
        next(scorer.score(iter([point_batch([[]])])))
    with pytest.raises(ValueError, match="empty trajectory"):
        distance.Scorer(metric, [])


def test_pruning_scores_few(monkeypatch):
    rng = random.Random(0)
    reference = [(0.1 * i, 0.0) for i in range(40)]
    lines = [[(0.1 * i + rng.uniform(0, 90), 5.0 * k) for i in range(40)] for k in range(400)]
    scorer, scored = distance.Scorer("DTW", reference), []
    plain = distance.Scorer.distances
    monkeypatch.setattr(distance.Scorer, "distances", lambda self, sizes, x, y: scored.append(len(sizes)) or plain(self, sizes, x, y))
    next(scorer.best(iter([point_batch(lines)]), 3, 1e-9))
    assert sum(scored) < 200


@pytest.mark.parametrize("metric", distance.METRICS)
def test_long_trajectories_take_seconds(metric):
    rng = random.Random(1)
    walk = lambda: [(float(i), rng.uniform(0, 9)) for i in range(5000)]
    began = time.time()
    assert distance.Scorer(metric, walk()).score(iter([point_batch([walk()])])).__next__().column("distance")[0].as_py() > 0
    assert time.time() - began < 10


def test_metric_is_never_defaulted():
    for name in (None, "", "LCSS"):
        with pytest.raises(ValueError):
            distance.distance(name, F, F)


@given(st.integers(0, 2**16 - 1), st.integers(0, 2**16 - 1))
def test_morton_round_trip(x, y):
    assert codes.deinterleave(codes.interleave(x, y, 16), 16) == (x, y)


BOXES = st.tuples(*[st.floats(0, 100) for _ in range(4)]).map(lambda v: Rect(min(v[0], v[1]), min(v[2], v[3]), max(v[0], v[1]), max(v[2], v[3])))
DOMAIN = Domain(0.0, 0.0, 100.0, 100.0)


@settings(max_examples=60, deadline=None)
@given(BOXES, st.integers(1, 5), st.one_of(st.none(), st.integers(1, 6)))
def test_morton_ranges_cover_all_cells(box, level, most):
    ranges = codes.morton_ranges(box, DOMAIN, level, most)
    assert codes.ranges_cover(box, ranges, DOMAIN, level)
    assert most is None or len(ranges) <= most
    if most is None:
        x0, y0, x1, y1 = codes.cell_rect(box, DOMAIN, level)
        assert sum(b - a + 1 for a, b in ranges) == (x1 - x0 + 1) * (y1 - y0 + 1)


def test_element_codes_have_full_recall(spark):
    rng = random.Random(9)
    boxes = []
    for i in range(150):
        x, y, w, h = rng.uniform(-5, 100), rng.uniform(-5, 100), rng.choice([0, 1, 10, 60]) * rng.random(), rng.choice([0, 1, 10, 60]) * rng.random()
        boxes.append((i, x, y, x + w, y + h))
    df = spark.createDataFrame(boxes, "i int, a double, b double, c double, d double")
    element = codes.xz_element(F.col("a"), F.col("b"), F.col("c"), F.col("d"), DOMAIN, 6)
    found = {r["i"]: (r["e"]["code"], r["e"]["level"]) for r in df.select("i", element.alias("e")).collect()}
    assert all(codes.element_level(code, 6)[0] == level for code, level in found.values())
    for _ in range(40):
        x, y = rng.uniform(0, 90), rng.uniform(0, 90)
        q = Rect(x, y, x + rng.uniform(0, 30), y + rng.uniform(0, 30))
        ranges = codes.xz_ranges(q, DOMAIN, 6)
        for i, a, b, c, d in boxes:
            if Rect(max(a, 0), max(b, 0), max(c, 0), max(d, 0)).touches(q):
                assert any(lo <= found[i][0] <= hi for lo, hi in ranges)


def test_ranges_merge_the_cheapest_gap():
    assert codes.merge_ranges([(0, 1), (3, 4), (10, 11)], 2) == [(0, 4), (10, 11)]
    assert codes.merge_ranges([(5, 6), (0, 4)]) == [(0, 6)]
    assert codes.merge_ranges([(0, 0), (2, 2), (9, 9)], 2, weight=lambda lo, hi: 100 if lo == 1 else 1) == [(0, 0), (2, 9)]


def test_time_buckets():
    assert codes.buckets_covering(10, 10, 0, 5) is None
    assert codes.buckets_covering(-20, 0, 0, 5) is None
    assert codes.buckets_covering(-20, 1, 0, 5) == (0, 0)
    assert codes.buckets_covering(4, 11, 0, 5) == (0, 2)
    with pytest.raises(ValueError):
        codes.time_bucket(-1, 0, 5)


def test_projection_round_trip_and_column(spark):
    for crs, lon, lat in (("EPSG:32650", 116.4, 39.9), ("EPSG:32629", -8.61, 41.15), ("EPSG:32634", 18.9, 54.5)):
        x, y = projection.to_metres(lon, lat, crs)
        back = projection.to_degrees(x, y, crs)
        assert abs(back[0] - lon) < 1e-9 and abs(back[1] - lat) < 1e-9
        cx, cy = projection.metres(F.lit(lon), F.lit(lat), crs)
        got = spark.range(1).select(cx, cy).first()
        assert got[0] == pytest.approx(x, abs=1e-6) and got[1] == pytest.approx(y, abs=1e-6)
    # On the central meridian the easting is the false one, and the equator has northing 0.
    assert projection.to_metres(117.0, 0.0) == pytest.approx((500000.0, 0.0), abs=1e-6)
    # The meridian from the equator to 45 degrees is 4984944.378 m long; UTM scales it by 0.9996.
    assert projection.to_metres(117.0, 45.0)[1] == pytest.approx(4984944.378 * 0.9996, abs=0.01)


def test_instants():
    assert instants.parse_instant("2008-02-02T08:00:00") == 1201910400000
    assert instants.parse_instant("2008-02-02 08:00:00") == instants.parse_instant("2008-02-02T08:00:00+08:00") == instants.parse_instant("2008-02-02T00:00:00+0000")
    assert instants.parse_instant("2008-02-02") == 1201881600000
    now = 1_000_000_000_000
    assert instants.parse_instant("now", now) == now
    assert instants.parse_instant("last_2d", now) == instants.parse_instant("-2d", now) == instants.parse_instant("P2D", now) == now - 2 * 86_400_000
    assert instants.parse_instant("pt3h", now) == now - 3 * 3_600_000
    with pytest.raises(instants.NeedNow):
        instants.parse_instant("last_1h")
    with pytest.raises(ValueError):
        instants.parse_instant("yesterday", now)
