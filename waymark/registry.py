"""The registered trajectory queries over the ``events`` table, and their SQL.

A snapshot of the table is built once per session and folder; every query reads it through the engine
or the operators.  The SQL rebuilds the same view from the table itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import codes, distance
from waymark.functions.codes import Domain, Rect
from waymark.operators import ingest, plan_ops, postings
from waymark.operators.postings import Layout
from waymark.plans import frontends, ir, planner
from waymark.plans.engine import Engine
from waymark.sources import events
from waymark.sources.snapshot import Snapshot, build_snapshot

HOUR = 3_600_000
DAY = 24 * HOUR
START = 1_704_067_200_000  # 2024-01-01T00:00:00Z
LAYOUT = Layout(Domain(0.0, 0.0, 640.0, 128.0), START, (START, START + 60 * DAY), bucket_ms=HOUR, chunk_max_points=8, zorder_level=5, xz_level=8, tshape_level=8, xzt_level=8)

WINDOW = (START + 8 * DAY, START + 11 * DAY)
WINDOW2 = (START + 16 * DAY, START + 18 * DAY)
BOX = Rect(20.0, 10.0, 120.0, 60.0)
BOX2 = Rect(200.0, 50.0, 400.0, 99.0)
VEHICLE = "7"
REFERENCE = "3-20240108"
K = 10

_snapshots: dict[tuple[str, str], Snapshot] = {}


def snapshot(spark: SparkSession, sf_dir: str) -> Snapshot:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _snapshots:
        _snapshots[key] = build_snapshot(spark, events.read_events(spark, sf_dir), dataset_id="events", layout=LAYOUT, kinds=())
    return _snapshots[key]


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    local = {"downtown": ir.Region(tuple(BOX), local=True), "uptown": ir.Region(tuple(BOX2), local=True)}
    return Engine(snapshot(spark, sf_dir), regions=local)


def bound(temporal=(), spatial=(), vehicle: str | None = None, similar: dict | None = None, k: int | None = None) -> dict:
    """A BoundIR of windows, boxes, vehicle and similarity."""
    ts = [{"start_ms": a, "end_ms": b} for a, b in temporal]
    ss = [b._asdict() | {"relation": "INTERSECTS", "boundary": "INCLUDED"} for b in spatial]
    out: dict = {"ir_version": "1.0", "source": {"dataset_id": "events", "entity": "trajectory"}, "semantics": {"mode": "OBSERVED_POINT", "coupling": "SAME_POINT"}, "predicates": []}
    out |= {"temporal": ts[0]} if len(ts) == 1 else {"temporal_parts": ts} if ts else {}
    out |= {"spatial": ss[0]} if len(ss) == 1 else {"spatial_parts": ss} if ss else {}
    if vehicle is not None:
        out["predicates"] = [{"field": "vehicle_id", "op": "EQ", "value": vehicle}]
    out["result"] = {"mode": "TOP_K", "k": k, "tie_breaker": "TID_ASC"} if similar else {"mode": "TRAJECTORY_IDS", "tie_breaker": "TID_ASC"}
    if similar:
        out["similarity"] = similar
    return out


def similar_to(e: Engine, metric: str, exclude: bool = True) -> dict:
    found = e.lookup(REFERENCE)
    if found is None:
        raise plan_ops.DataIntegrityError(f"{REFERENCE} is not stored")
    return {"metric": metric, "reference_tid": found[0], "scope": "FULL_TRAJECTORY", "exclude_reference": exclude, "local_distance": "EUCLIDEAN", "normalization": "NONE"}


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- SQL of the view --------------------------------------------------------------------------------

VIEW = f"""
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS vehicle_id, CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS trajectory_id, event_id AS pos,
         epoch_us(ts) // 1000 AS t_ms, value AS x_m, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y_m
  FROM events),
points AS (
  SELECT vehicle_id, trajectory_id, dense_rank() OVER (ORDER BY trajectory_id) AS tid, row_number() OVER (PARTITION BY trajectory_id ORDER BY t_ms, pos) - 1 AS seq, t_ms, x_m, y_m FROM raw),
chunks AS (
  SELECT tid, CAST(seq // 8 AS INTEGER) AS chunk_id, min(vehicle_id) AS vehicle_id, CAST(min(seq) AS INTEGER) AS seq_first, CAST(max(seq) AS INTEGER) AS seq_last, count(*) AS n_points,
         min(t_ms) AS t_min, max(t_ms) AS t_max, min(x_m) AS min_x, min(y_m) AS min_y, max(x_m) AS max_x, max(y_m) AS max_y FROM points GROUP BY tid, seq // 8),
meta AS (
  SELECT tid, trajectory_id, vehicle_id, count(*) AS n_points, CAST((count(*) + 7) // 8 AS BIGINT) AS n_chunks, min(t_ms) AS t0, max(t_ms) AS t1 FROM points GROUP BY ALL),
lists AS (SELECT tid, list([x_m, y_m] ORDER BY seq) AS pts FROM points GROUP BY tid),
cells AS (
  SELECT tid, chunk_id, vehicle_id, CAST(greatest(0, least(31, floor(min_x / 20))) AS BIGINT) AS cx0, CAST(greatest(0, least(31, floor(max_x / 20))) AS BIGINT) AS cx1,
         CAST(greatest(0, least(31, floor(min_y / 4))) AS BIGINT) AS cy0, CAST(greatest(0, least(31, floor(max_y / 4))) AS BIGINT) AS cy1 FROM chunks),
buckets AS (SELECT tid, chunk_id, (t_min - {START}) // {HOUR} AS b0, (t_max - {START}) // {HOUR} AS b1 FROM chunks)"""


def sql_window(w: tuple[int, int], t: str = "t_ms") -> str:
    return f"({t} >= {w[0]} AND {t} < {w[1]})"


def sql_box(b: Rect) -> str:
    return f"(x_m >= {b.min_x} AND x_m <= {b.max_x} AND y_m >= {b.min_y} AND y_m <= {b.max_y})"


def sql_overlap(w: tuple[int, int] | None = None, b: Rect | None = None) -> str:
    parts = [f"t_min < {w[1]} AND t_max >= {w[0]}"] if w else []
    if b:
        parts.append(f"min_x <= {b.max_x} AND max_x >= {b.min_x} AND min_y <= {b.max_y} AND max_y >= {b.min_y}")
    return " AND ".join(parts)


def sql_where(temporal=(), spatial=(), vehicle: str | None = None) -> str:
    parts = [" OR ".join(map(sql_window, temporal)), " OR ".join(map(sql_box, spatial)), f"vehicle_id = '{vehicle}'" if vehicle is not None else ""]
    return " AND ".join(f"({p})" for p in parts if p)


def register(name: str, oracle: str | None):
    """Register a query with the SELECT that follows the view."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = f"WITH {VIEW} {oracle}" if not oracle.startswith(",") else f"WITH {VIEW}{oracle}"
        return f

    return add


REFS = "tid, chunk_id"

# --- scans ------------------------------------------------------------------------------------------


@register("full_scan_chunks", "SELECT * FROM chunks")
def _(spark, d):
    return plan_ops.full_scan_chunks(snapshot(spark, d).chunks).drop("points")


W_BUCKETS = ((WINDOW[0] - START) // HOUR, (WINDOW[1] - 1 - START) // HOUR)
TIME_REFS = f"SELECT {REFS} FROM buckets WHERE b0 <= {W_BUCKETS[1]} AND b1 >= {W_BUCKETS[0]}"
CELLS = codes.cell_rect(BOX, LAYOUT.domain, LAYOUT.zorder_level)
Z_REFS = f"SELECT {REFS} FROM cells WHERE cx0 <= {CELLS[2]} AND cx1 >= {CELLS[0]} AND cy0 <= {CELLS[3]} AND cy1 >= {CELLS[1]}"
H_REFS = f"SELECT {REFS} FROM chunks WHERE vehicle_id = '{VEHICLE}'"


def time_refs(s: Snapshot, window=WINDOW) -> DataFrame:
    return plan_ops.time_range_scan(s.postings("time"), window, s.layout)


def z_refs(s: Snapshot, box=BOX) -> DataFrame:
    return plan_ops.zorder_range_scan(s.postings("zorder"), box, s.layout)


@register("time_range_scan", TIME_REFS)
def _(spark, d):
    return time_refs(snapshot(spark, d))


@register("zorder_range_scan", Z_REFS)
def _(spark, d):
    return z_refs(snapshot(spark, d))


@register("zorder_range_scan_merged", Z_REFS)
def _(spark, d):
    s = snapshot(spark, d)
    return plan_ops.zorder_range_scan(s.postings("zorder"), BOX, s.layout, max_ranges=2)


@register("equality_lookup", H_REFS)
def _(spark, d):
    return plan_ops.equality_lookup(snapshot(spark, d).postings("hash"), VEHICLE)


def overlapping(s: Snapshot, refs: DataFrame, **parts) -> DataFrame:
    """Codes only over-select: what is left after the extent filter is exact."""
    return plan_ops.chunk_meta_filter(refs, s.chunks, bound(**parts)).select("tid", "chunk_id")


@register("xz_range_scan", f"SELECT {REFS} FROM chunks WHERE {sql_overlap(b=BOX)}")
def _(spark, d):
    s = snapshot(spark, d)
    return overlapping(s, plan_ops.xz_range_scan(s.postings("xz"), BOX, s.layout), spatial=[BOX])


@register("tshape_range_scan", f"SELECT {REFS} FROM chunks WHERE {sql_overlap(b=BOX)}")
def _(spark, d):
    s = snapshot(spark, d)
    return overlapping(s, plan_ops.tshape_range_scan(s.postings("tshape"), BOX, s.layout), spatial=[BOX])


@register("xzt_range_scan", f"SELECT {REFS} FROM chunks WHERE {sql_overlap(w=WINDOW)}")
def _(spark, d):
    s = snapshot(spark, d)
    return overlapping(s, plan_ops.xzt_range_scan(s.postings("xzt"), WINDOW, s.layout), temporal=[WINDOW])


# --- sets -------------------------------------------------------------------------------------------

for _merge in plan_ops.MERGES:

    @register(f"intersect_{_merge.lower()}", f"{TIME_REFS} INTERSECT {Z_REFS}")
    def _(spark, d, merge=_merge):
        s = snapshot(spark, d)
        return plan_ops.intersect([time_refs(s), z_refs(s)], merge)


@register("intersect_three", f"{TIME_REFS} INTERSECT {Z_REFS} INTERSECT {H_REFS}")
def _(spark, d):
    s = snapshot(spark, d)
    return plan_ops.intersect([time_refs(s), z_refs(s), plan_ops.equality_lookup(s.postings("hash"), VEHICLE)], "HASH_SET")


@register("union_time_bipart", TIME_REFS)
def _(spark, d):
    s, middle = snapshot(spark, d), (WINDOW[0] + WINDOW[1]) // 2
    return plan_ops.union([time_refs(s, (WINDOW[0], middle)), time_refs(s, (middle, WINDOW[1]))])


@register("union_z_quad", Z_REFS)
def _(spark, d):
    s, mx, my = snapshot(spark, d), (BOX.min_x + BOX.max_x) / 2, (BOX.min_y + BOX.max_y) / 2
    quarters = [Rect(x0, y0, x1, y1) for x0, x1 in ((BOX.min_x, mx), (mx, BOX.max_x)) for y0, y1 in ((BOX.min_y, my), (my, BOX.max_y))]
    return plan_ops.union([z_refs(s, q) for q in quarters])


@register("deduplicate", TIME_REFS)
def _(spark, d):
    refs = time_refs(snapshot(spark, d))
    return plan_ops.deduplicate(refs.unionByName(refs))


@register("chunk_meta_filter", f"SELECT {REFS} FROM chunks WHERE {sql_overlap(WINDOW, BOX)}")
def _(spark, d):
    s = snapshot(spark, d)
    return overlapping(s, plan_ops.intersect([time_refs(s), z_refs(s)], "HASH_SET"), temporal=[WINDOW], spatial=[BOX])


@register("fetch_chunks", f"SELECT c.tid, c.chunk_id, n_points, t_min, t_max, round(sx, 4) AS sum_x FROM chunks c JOIN ({H_REFS}) USING (tid, chunk_id) JOIN (SELECT tid, seq // 8 AS chunk_id, sum(x_m) AS sx FROM points GROUP BY ALL) USING (tid, chunk_id)")
def _(spark, d):
    s = snapshot(spark, d)
    got = plan_ops.fetch_trajectory_chunk(plan_ops.equality_lookup(s.postings("hash"), VEHICLE), s.chunks, check=True)
    return got.select("tid", "chunk_id", "n_points", "t_min", "t_max", F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"]), 4).alias("sum_x"))


# --- exact queries ----------------------------------------------------------------------------------

EXACT: dict[str, dict] = {
    "exact_time": {"temporal": [WINDOW]},
    "exact_space": {"spatial": [BOX]},
    "exact_st": {"temporal": [WINDOW], "spatial": [BOX]},
    "exact_vehicle": {"vehicle": VEHICLE},
    "exact_time_vehicle": {"temporal": [WINDOW], "vehicle": VEHICLE},
    "exact_st_vehicle": {"temporal": [WINDOW], "spatial": [BOX], "vehicle": VEHICLE},
    "exact_multi_window": {"temporal": [WINDOW, WINDOW2]},
    "exact_multi_box": {"spatial": [BOX, BOX2]},
    "exact_mixed_parts": {"temporal": [WINDOW, WINDOW2], "spatial": [BOX, BOX2]},
}


def sql_ids(**parts) -> str:
    return f"SELECT DISTINCT tid, trajectory_id FROM points WHERE {sql_where(**parts)}"


for _name, _parts in EXACT.items():

    @register(_name, sql_ids(**_parts))
    def _(spark, d, parts=_parts):
        return engine(spark, d).query(bound(**parts))


for _path in ("chunks", "indexed"):

    @register(f"exact_st_by_{_path}", sql_ids(**EXACT["exact_st"]))
    def _(spark, d, path=_path):
        return engine(spark, d).query(bound(**EXACT["exact_st"]), path=path)


# Every plan, on a query with many answers: those without the vehicle's lookup on time and space, those
# with it on a wide window and box.
WIDE = {"temporal": [(START, START + 45 * DAY)], "spatial": [Rect(5.0, 5.0, 500.0, 95.0)], "vehicle": VEHICLE}

for _plan in planner.candidates(bound(**EXACT["exact_st_vehicle"])):
    _parts = WIDE if _plan.vehicle else EXACT["exact_st"]

    @register(f"plan_{_plan.plan_id[2:].lower()}", sql_ids(**_parts))
    def _(spark, d, plan=_plan, parts=_parts):
        return engine(spark, d).query(bound(**parts), path="indexed", plan=plan)


for _plan in planner.split_plans():

    @register(f"plan_{_plan.plan_id[2:].lower()}", sql_ids(**EXACT["exact_st"]))
    def _(spark, d, plan=_plan):
        return engine(spark, d).query(bound(**EXACT["exact_st"]), path="indexed", plan=plan)


@register("exclude_reference", f"SELECT DISTINCT tid FROM points WHERE {sql_where(**EXACT['exact_time'])} AND trajectory_id <> '{REFERENCE}'")
def _(spark, d):
    e = engine(spark, d)
    return plan_ops.exclude_reference(e.matching(bound(**EXACT["exact_time"])), e.lookup(REFERENCE)[0])


@register("batch_get_trajectory", f"SELECT tid, count(*) AS n_points, min(t_ms) AS first_t, max(t_ms) AS last_t, round(sum((seq + 1) * x_m), 3) AS checksum FROM points WHERE tid IN (SELECT tid FROM points WHERE {sql_where(**EXACT['exact_st'])}) GROUP BY tid")
def _(spark, d):
    e = engine(spark, d)
    got = plan_ops.batch_get_trajectory(e.matching(bound(**EXACT["exact_st"])), e.snapshot.trajectories)
    terms = F.transform("pts", lambda p, i: (i + 1) * p["x"])
    return got.select("tid", F.size("pts").cast("bigint").alias("n_points"), F.element_at("pts", 1)["t"].alias("first_t"), F.element_at("pts", -1)["t"].alias("last_t"), F.round(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v), 3).alias("checksum"))


# --- similarity -------------------------------------------------------------------------------------

D = "sqrt((p[1] - q[1]) * (p[1] - q[1]) + (p[2] - q[2]) * (p[2] - q[2]))"
E = D.replace("q[", "e[")
GRID = (
    "list_reduce(a.pts, lambda row, p: list_reduce(list_transform(range(1, len(b.pts) + 1), lambda j: [b.pts[j][1], b.pts[j][2], row[j + 1], row[j]]), "
    "lambda acc, e: list_append(acc, {cell}), ['inf'::DOUBLE]), list_prepend(0.0::DOUBLE, list_transform(b.pts, lambda q: 'inf'::DOUBLE)))[-1]"
)
DIRECTED = f"list_max(list_transform({{s}}.pts, lambda p: list_min(list_transform({{t}}.pts, lambda q: {D}))))"
SQL_DISTANCE = {
    "DTW": GRID.format(cell=f"{E} + least(e[3], e[4], acc[-1])"),
    "FRECHET": GRID.format(cell=f"greatest({E}, least(e[3], e[4], acc[-1]))"),
    "HAUSDORFF": f"greatest({DIRECTED.format(s='a', t='b')}, {DIRECTED.format(s='b', t='a')})",
}


def sql_scored(metric: str, where: str, exclude: bool = True) -> str:
    return (
        f", cand AS (SELECT DISTINCT tid, trajectory_id FROM points WHERE {where}{f''' AND trajectory_id <> '{REFERENCE}' ''' if exclude else ''}), "
        f"b AS (SELECT pts FROM lists WHERE tid IN (SELECT tid FROM meta WHERE trajectory_id = '{REFERENCE}')), "
        f"scored AS (SELECT tid, trajectory_id, {SQL_DISTANCE[metric]} AS distance FROM lists a JOIN cand USING (tid) CROSS JOIN b) "
    )


TOPK_WHERE = {"temporal": [(START + 7 * DAY, START + 9 * DAY)], "spatial": [Rect(20.0, 10.0, 300.0, 90.0)]}


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


for _metric in distance.METRICS:

    @register(f"similarity_{_metric.lower()}", sql_scored(_metric, sql_where(**TOPK_WHERE)) + "SELECT tid, round(distance, 6) AS distance FROM scored")
    def _(spark, d, metric=_metric):
        e = engine(spark, d)
        s = similar_to(e, metric)
        tids = plan_ops.exclude_reference(e.matching(bound(**TOPK_WHERE)), s["reference_tid"])
        candidates = plan_ops.batch_get_trajectory(tids, e.snapshot.trajectories)
        return rounded(plan_ops.similarity(candidates, metric, plan_ops.reference_points(e.snapshot.trajectories, s["reference_tid"])))

    _top = sql_scored(_metric, sql_where(**TOPK_WHERE)) + f"SELECT tid, trajectory_id, round(distance, 6) AS distance FROM scored ORDER BY scored.distance, tid LIMIT {K}"

    @register(f"topk_{_metric.lower()}", _top)
    def _(spark, d, metric=_metric):
        e = engine(spark, d)
        return rounded(e.query(bound(**TOPK_WHERE, similar=similar_to(e, metric), k=K)))

    @register(f"topk_{_metric.lower()}_lb_pruned", _top)
    def _(spark, d, metric=_metric):
        e = engine(spark, d)
        return rounded(e.query(bound(**TOPK_WHERE, similar=similar_to(e, metric), k=K), pruned=True))


@register("topk_include_reference", sql_scored("DTW", sql_where(temporal=TOPK_WHERE["temporal"]), exclude=False) + f"SELECT tid, trajectory_id, round(distance, 6) AS distance FROM scored ORDER BY scored.distance, tid LIMIT {K}")
def _(spark, d):
    e = engine(spark, d)
    return rounded(e.query(bound(temporal=TOPK_WHERE["temporal"], similar=similar_to(e, "DTW", exclude=False), k=K)))


@register("topk_k_gt_n", sql_scored("HAUSDORFF", sql_where(vehicle=VEHICLE)) + "SELECT tid, trajectory_id, round(distance, 6) AS distance FROM scored ORDER BY scored.distance, tid LIMIT 1000")
def _(spark, d):
    e = engine(spark, d)
    return rounded(e.query(bound(vehicle=VEHICLE, similar=similar_to(e, "HAUSDORFF"), k=1000)))


# --- ingest -----------------------------------------------------------------------------------------

DIRTY = """, dirty AS (
  SELECT * FROM raw UNION ALL SELECT vehicle_id, trajectory_id, pos + 1000000000, t_ms, x_m, y_m FROM raw WHERE pos % 50 = 0
  UNION ALL SELECT vehicle_id, trajectory_id, pos + 2000000000, t_ms, x_m + 1, y_m FROM raw WHERE pos % 70 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, t_ms ORDER BY pos) AS n, first(x_m) OVER (PARTITION BY trajectory_id, t_ms ORDER BY pos) AS fx, first(y_m) OVER (PARTITION BY trajectory_id, t_ms ORDER BY pos) AS fy FROM dirty),
outside AS (SELECT DISTINCT trajectory_id FROM numbered WHERE n = 1 AND NOT (x_m BETWEEN 0 AND 300 AND y_m BETWEEN 0 AND 128)) """


def dirty(spark: SparkSession, d: str) -> DataFrame:
    raw = events.read_events(spark, d)
    exact = raw.where("pos % 50 = 0").withColumn("pos", F.col("pos") + 1_000_000_000)
    other = raw.where("pos % 70 = 0").withColumns({"pos": F.col("pos") + 2_000_000_000, "x_m": F.col("x_m") + 1})
    return raw.unionByName(exact).unionByName(other)


CLEAN_DOMAIN = Domain(0.0, 0.0, 300.0, 128.0)


@register("clean_points", DIRTY + "SELECT vehicle_id, trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY t_ms, pos) - 1 AS INTEGER) AS seq, t_ms, x_m, y_m FROM numbered WHERE n = 1 AND trajectory_id NOT IN (SELECT trajectory_id FROM outside)")
def _(spark, d):
    return ingest.clean(dirty(spark, d), CLEAN_DOMAIN).points


@register("clean_rejects", DIRTY + "SELECT trajectory_id, 'OUT_OF_DOMAIN' AS reason FROM outside")
def _(spark, d):
    return ingest.clean(dirty(spark, d), CLEAN_DOMAIN).rejects


@register("clean_removed", DIRTY + "SELECT trajectory_id, count(*) FILTER (n > 1 AND x_m = fx AND y_m = fy) AS n_exact, count(*) FILTER (n > 1 AND NOT (x_m = fx AND y_m = fy)) AS n_same_time FROM numbered GROUP BY trajectory_id")
def _(spark, d):
    return ingest.clean(dirty(spark, d), CLEAN_DOMAIN).removed


@register("assign_tid", "SELECT DISTINCT trajectory_id, tid FROM points")
def _(spark, d):
    return ingest.number_ids(events.read_events(spark, d).select("trajectory_id").distinct(), "trajectory_id")


@register("chunk_points", "SELECT tid, chunk_id, seq_first, seq_last, n_points FROM chunks")
def _(spark, d):
    return ingest.chunk(snapshot(spark, d).points, LAYOUT.chunk_max_points).select("tid", "chunk_id", "seq_first", "seq_last", "n_points")


@register("concatenate_chunks", "SELECT tid, count(*) AS n_points, round(sum((seq + 1) * y_m), 3) AS checksum FROM points GROUP BY tid")
def _(spark, d):
    got = ingest.concatenate(snapshot(spark, d).chunks)
    terms = F.transform("pts", lambda p, i: (i + 1) * p["y"])
    return got.select("tid", F.size("pts").cast("bigint").alias("n_points"), F.round(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v), 3).alias("checksum"))


@register("traj_meta", "SELECT * FROM meta")
def _(spark, d):
    return ingest.trajectory_meta(snapshot(spark, d).points, LAYOUT.chunk_max_points)


@register(
    "profile",
    f""", h AS (SELECT n, count(*) AS c FROM (SELECT count(*) AS n FROM points GROUP BY trajectory_id) GROUP BY n), r AS (SELECT n, sum(c) OVER (ORDER BY n) AS upto, sum(c) OVER () AS total FROM h)
SELECT *, min_x - 1000 AS domain_min_x, min_y - 1000 AS domain_min_y, max_x + 1000 AS domain_max_x, max_y + 1000 AS domain_max_y, (t_min // {HOUR}) * {HOUR} AS epoch_ms FROM (
  SELECT count(*) AS n_points, count(DISTINCT trajectory_id) AS n_trajectories, count(DISTINCT vehicle_id) AS n_vehicles, count(*) FILTER (rep) AS n_repeats,
         min(t_ms) AS t_min, max(t_ms) AS t_max, min(x_m) AS min_x, max(x_m) AS max_x, min(y_m) AS min_y, max(y_m) AS max_y
  FROM (SELECT *, t_ms = lag(t_ms) OVER w AND x_m = lag(x_m) OVER w AND y_m = lag(y_m) OVER w AS rep FROM points WINDOW w AS (PARTITION BY trajectory_id ORDER BY seq)))
CROSS JOIN (SELECT min(n) FILTER (upto > floor(0.5 * (total - 1))) AS length_p50, min(n) FILTER (upto > floor(0.95 * (total - 1))) AS length_p95, max(n) AS length_max FROM r)""",
)
def _(spark, d):
    return ingest.profile(snapshot(spark, d).points, HOUR)


SPREAD_Z = "SELECT tid, chunk_id, x, y FROM (SELECT tid, chunk_id, unnest(range(cx0, cx1 + 1)) AS x, cy0, cy1 FROM cells), LATERAL (SELECT unnest(range(cy0, cy1 + 1)) AS y)"
MORTON = " | ".join(f"(((x >> {i}) & 1) << {2 * i}) | (((y >> {i}) & 1) << {2 * i + 1})" for i in range(5))


@register("stats_time_postings", "SELECT code, count(*) AS n FROM (SELECT unnest(range(b0, b1 + 1)) AS code FROM buckets) GROUP BY code")
def _(spark, d):
    return postings.posting_counts(snapshot(spark, d).postings("time"))


@register("stats_zorder_postings", f"SELECT {MORTON} AS code, count(*) AS n FROM ({SPREAD_Z}) GROUP BY 1")
def _(spark, d):
    return postings.posting_counts(snapshot(spark, d).postings("zorder"))


@register("stats_vehicle_postings", "SELECT vehicle_id, count(*) AS n FROM chunks GROUP BY vehicle_id")
def _(spark, d):
    return snapshot(spark, d).postings("hash").groupBy("vehicle_id").agg(F.count("*").alias("n"))


@register("stats_length_hist", "SELECT CASE WHEN n_points = 1 THEN '1' WHEN n_points <= 16 THEN '2-16' WHEN n_points <= 64 THEN '17-64' WHEN n_points <= 256 THEN '65-256' ELSE '257+' END AS bin, count(*) AS n FROM meta GROUP BY 1")
def _(spark, d):
    return postings.length_histogram(snapshot(spark, d).meta)


@register("stats_pass_rate", ", q AS (SELECT min(t_min) AS lo, max(t_max) AS hi FROM chunks), hit AS (SELECT count(DISTINCT (tid, seq // 8)) AS h FROM points, q WHERE t_ms >= lo + (hi - lo) / 4 AND t_ms < hi - (hi - lo) / 4) SELECT (SELECT count(*) FROM chunks) AS samples, h AS hits, (h + 1) / ((SELECT count(*) FROM chunks) + 2) AS rate FROM hit")
def _(spark, d):
    return postings.pass_rate(snapshot(spark, d).chunks, per_mille=1000)


DAMAGED = f", expected AS (SELECT unnest(range(b0, b1 + 1)) AS code, tid, chunk_id FROM buckets) "


def damaged(s: Snapshot, kind: str = "time") -> DataFrame:
    """Differences of an index that lost the postings of every tenth trajectory and has strange ones."""
    good = s.postings(kind)
    stored = good.where("tid % 10 <> 3").unionByName(good.where("tid % 10 = 4 AND chunk_id = 0").withColumn("code", F.col("code") + 100_000))
    return postings.verify(kind, stored, s.chunks, s.layout)


@register("posting_verify_missing", DAMAGED + "SELECT code, tid, chunk_id, 'MISSING' AS fault FROM expected WHERE tid % 10 = 3")
def _(spark, d):
    return damaged(snapshot(spark, d)).where("fault = 'MISSING'")


@register("posting_verify_extra", DAMAGED + "SELECT code + 100000 AS code, tid, chunk_id, 'EXTRA' AS fault FROM expected WHERE tid % 10 = 4 AND chunk_id = 0")
def _(spark, d):
    return damaged(snapshot(spark, d)).where("fault = 'EXTRA'")


@register("posting_verify_zorder", f", expected AS (SELECT {MORTON} AS code, tid, chunk_id FROM ({SPREAD_Z})) SELECT code, tid, chunk_id, 'MISSING' AS fault FROM expected WHERE tid % 10 = 3 UNION ALL SELECT code + 100000, tid, chunk_id, 'EXTRA' FROM expected WHERE tid % 10 = 4 AND chunk_id = 0")
def _(spark, d):
    return damaged(snapshot(spark, d), "zorder")


@register("stats_posting_totals", f"SELECT 'time' AS kind, CAST(sum(b1 - b0 + 1) AS BIGINT) AS n FROM buckets UNION ALL SELECT 'zorder', count(*) FROM ({SPREAD_Z}) UNION ALL SELECT unnest(['hash', 'xz', 'tshape', 'xzt']), count(*) FROM chunks")
def _(spark, d):
    s = snapshot(spark, d)
    counts = [s.postings(k).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in postings.KINDS]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


# --- front-ends -------------------------------------------------------------------------------------

TEXT_WINDOW = ("2024-01-09T00:00:00+00:00", "2024-01-12T00:00:00+00:00")


def drafted(spark: SparkSession, d: str, draft: dict) -> DataFrame:
    result, df = engine(spark, d).query_draft(draft)
    if df is None:
        raise ValueError(f"{result.status}: {result.error}")
    return df


@register("sql_dialect_st", sql_ids(**EXACT["exact_st"]))
def _(spark, d):
    text = f"SELECT DISTINCT trajectory_id FROM trajectory_point WHERE event_time >= '{TEXT_WINDOW[0]}' AND event_time < '{TEXT_WINDOW[1]}' AND region_name = 'downtown'"
    return drafted(spark, d, frontends.sql_to_draft(text, "events"))


@register("mql_dialect_st", sql_ids(**EXACT["exact_st"]))
def _(spark, d):
    pipeline = [{"$match": {"event_time": {"$gte": TEXT_WINDOW[0], "$lt": TEXT_WINDOW[1]}, "region_name": "downtown"}}, {"$group": {"_id": "$trajectory_id"}}]
    return drafted(spark, d, frontends.mql_to_draft(pipeline, "events"))


@register("draft_ir_bind_st", sql_ids(**EXACT["exact_st"]))
def _(spark, d):
    return drafted(spark, d, frontends.draft("events", temporal=TEXT_WINDOW, area={"region_name": "Downtown"}))


@register("draft_ir_bind_parts", sql_ids(spatial=[BOX, BOX2]))
def _(spark, d):
    query = frontends.draft("events")
    query["spatial_parts"] = [{"region_name": "downtown"}, {"region_name": "uptown"}]
    return drafted(spark, d, query)


@register("nl_scripted_st", sql_ids(**EXACT["exact_st"]))
def _(spark, d):
    from waymark.plans.dialog import Dialog, ScriptedClient

    answer = frontends.draft("events", temporal=TEXT_WINDOW, area={"region_name": "downtown"})
    outcome = Dialog(ScriptedClient([answer]), engine(spark, d).binder()).run("Which trajectories were in downtown between 2024-01-09T00:00:00+00:00 and 2024-01-12T00:00:00+00:00?")
    return engine(spark, d).query(outcome.ir)


@register("sql_dialect_topk", sql_scored("FRECHET", sql_where(temporal=[WINDOW])) + f"SELECT tid, trajectory_id, round(distance, 6) AS distance FROM scored ORDER BY scored.distance, tid LIMIT {K}")
def _(spark, d):
    text = f"SELECT trajectory_id FROM trajectory_point WHERE event_time >= '{TEXT_WINDOW[0]}' AND event_time < '{TEXT_WINDOW[1]}' ORDER BY TRAJ_SIM(FRECHET, '{REFERENCE}') ASC LIMIT {K}"
    return rounded(drafted(spark, d, frontends.sql_to_draft(text, "events")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
