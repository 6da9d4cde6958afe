import json
import random

import pytest
from pyspark.sql import functions as F

from waymark import registry
from waymark.functions.codes import Domain, Rect
from waymark.operators import plan_ops, postings
from waymark.plans import dialog, frontends, ir, planner
from waymark.plans.engine import Engine, Limits
from waymark.sources import snapshot

T0, STEP = 1_201_910_400_000, 300_000
GOLDEN = {"A": [(1, 1), (5, 5), (9, 9)], "B": [(20, 20), (6, 6), (20, 20)], "C": [(30, 30), (31, 31)], "R": [(1, 1), (2, 2), (3, 3)]}
RAW = "vehicle_id string, trajectory_id string, pos bigint, t_ms bigint, x_m double, y_m double"


def build(spark, trajectories, **options):
    rows = [(v, t, i, ms, float(x), float(y)) for t, (v, pts) in trajectories.items() for i, (ms, x, y) in enumerate(pts)]
    return snapshot.build_snapshot(spark, spark.createDataFrame(rows, RAW), dataset_id="test", domain=Domain(0.0, 0.0, 100.0, 100.0), **options)


@pytest.fixture(scope="module")
def golden(spark):
    made = build(spark, {k: (k, [(T0 + i * STEP, x, y) for i, (x, y) in enumerate(pts)]) for k, pts in GOLDEN.items()})
    return Engine(made, regions={"centre": ir.Region((4.0, 4.0, 8.0, 8.0), local=True)})


def golden_query(metric="DTW", exclude=True, k=2):
    similar = {"metric": metric, "reference_tid": 4, "scope": "FULL_TRAJECTORY", "exclude_reference": exclude, "local_distance": "EUCLIDEAN", "normalization": "NONE"}
    return registry.bound([(T0, T0 + 2 * STEP)], [Rect(4.0, 4.0, 8.0, 8.0)], similar=similar, k=k)


@pytest.mark.parametrize(("metric", "a", "b"), [("DTW", 12.727922061357855, 56.568542494923804), ("FRECHET", 8.48528137423857, 26.870057685088806), ("HAUSDORFF", 8.48528137423857, 24.041630560342615)])
def test_golden_topk(golden, metric, a, b):
    for pruned in (False, True):
        got = golden.query(golden_query(metric), pruned=pruned).collect()
        assert [r.trajectory_id for r in got] == ["A", "B"]
        assert [r.distance for r in got] == pytest.approx([a, b])


def test_time_is_half_open_and_boxes_are_closed(golden):
    ids = lambda **q: [r.trajectory_id for r in golden.query(registry.bound(**q)).collect()]
    assert ids(temporal=[(T0 + 2 * STEP, T0 + 3 * STEP)]) == ["A", "B", "R"]
    assert ids(temporal=[(T0 + 2 * STEP + 1, T0 + 3 * STEP)]) == []
    assert ids(spatial=[Rect(9.0, 9.0, 20.0, 20.0)]) == ["A", "B"]
    # One sample must satisfy both.
    assert ids(temporal=[(T0, T0 + 1)], spatial=[Rect(4.0, 4.0, 8.0, 8.0)]) == []
    # Boxes are alternatives, not their hull.
    assert ids(spatial=[Rect(0.0, 0.0, 1.0, 1.0), Rect(31.0, 31.0, 40.0, 40.0)]) == ["A", "C", "R"]


def test_statuses(golden):
    assert golden.run(golden_query()).status == "OK"
    tight = Engine(golden.snapshot, limits=Limits(max_candidate_chunks=1, max_cells=1))
    refused = tight.run(golden_query())
    assert refused.status == "RESOURCE_EXHAUSTED" and not refused.rows
    assert tight.run(registry.bound(spatial=[Rect(0.0, 0.0, 50.0, 50.0)]), path="chunks").status == "RESOURCE_EXHAUSTED"
    assert golden.run({"ir_version": "1.0"}).status == "FAILED"
    refs = golden.snapshot.chunks.select("tid", "chunk_id")
    with pytest.raises(plan_ops.DataIntegrityError):
        plan_ops.fetch_trajectory_chunk(refs, golden.snapshot.chunks.where("tid <> 2"), check=True)
    assert Engine(golden.snapshot, limits=Limits(max_candidate_bytes=1)).run(golden_query()).status == "RESOURCE_EXHAUSTED"
    late = Engine(golden.snapshot, limits=Limits(deadline_s=0.0)).run(golden_query())
    assert late.status == "RESOURCE_EXHAUSTED" and not late.rows and "within" in late.error
    assert Engine(golden.snapshot, limits=Limits(deadline_s=300)).run(golden_query()).status == "OK"
    nobody = golden_query()
    nobody["similarity"]["reference_tid"] = 99
    assert golden.run(nobody).status == "DATA_INTEGRITY_ERROR"
    with pytest.raises(plan_ops.DataIntegrityError):
        golden.query(nobody)


def test_budgets_count_the_reference_if_it_is_compared(golden):
    # Points of A and B with R's three, and of R itself: 18 and 27 cells.
    for exclude, cells in ((True, 18), (False, 18)):
        run = lambda n: Engine(golden.snapshot, limits=Limits(max_cells=n)).run(golden_query(exclude=exclude)).status  # noqa: B023, E731
        assert run(cells) == "OK" and run(cells - 1) == "RESOURCE_EXHAUSTED"
    wide = registry.bound([(T0, T0 + 9 * STEP)], similar=golden_query(exclude=False)["similarity"], k=2)
    run = lambda n: Engine(golden.snapshot, limits=Limits(max_cells=n)).run(wide).status
    assert run(33) == "OK" and run(32) == "RESOURCE_EXHAUSTED"  # A, B, R with three points and C with two


@pytest.mark.parametrize("topk", [False, True])
def test_a_lost_chunk_is_an_error_and_no_answer(spark, topk):
    made = build(spark, {k: (k, [(T0 + i * STEP, x, y) for i, (x, y) in enumerate(pts)]) for k, pts in GOLDEN.items()}, verify=False)
    kept = made.chunks.where("tid <> 1").collect()
    made._tables["chunks"] = spark.createDataFrame(kept, made.chunks.schema)
    engine = Engine(made)
    q = golden_query() if topk else registry.bound([(T0, T0 + 2 * STEP)], [Rect(4.0, 4.0, 8.0, 8.0)])
    result = engine.run(q, path="indexed")
    assert result.status == "DATA_INTEGRITY_ERROR" and not result.rows
    with pytest.raises(plan_ops.DataIntegrityError):
        engine.matching(q, "indexed", check=True)


def test_unsound_plans_do_not_run(golden, monkeypatch):
    q = registry.bound([(T0, T0 + 1)], [Rect(0.0, 0.0, 9.0, 9.0)])
    good = planner.document
    monkeypatch.setattr(planner, "document", lambda ir, plan: good(ir, plan) | {"root": "n0"})
    assert golden.run(q, path="indexed").status == "NO_SAFE_PLAN"
    with pytest.raises(planner.NoSafePlan):
        golden.query(q, path="indexed")


def test_snapshots_are_clustered_and_rebuilt_beside_the_old(spark, monkeypatch):
    rng = random.Random(3)
    trajectories = {f"t{i:03d}": (f"v{i % 5}", sorted({T0 + rng.randrange(20 * 86_400_000): (rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(30)}.items())) for i in range(60)}
    trajectories = {t: (v, [(ms, x, y) for ms, (x, y) in pts]) for t, (v, pts) in trajectories.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = build(spark, trajectories, kinds=("time",))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    day = 86_400_000
    spans = made.points.groupBy(F.input_file_name()).agg(F.floor(F.min("t_ms") / day).alias("lo"), F.floor(F.max("t_ms") / day).alias("hi")).orderBy("lo").collect()
    assert len(spans) > 1 and all(a.hi <= b.lo for a, b in zip(spans, spans[1:]))
    assert made.size == (made.chunks.count(), 1800)
    before = dict(made.manifest["indexes"])
    monkeypatch.setattr(snapshot.postings, "verify", lambda kind, *a: made.points)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.rebuild_postings(made, "time")
    with pytest.raises(snapshot.SnapshotError):
        made.postings("zorder")
    assert snapshot.open_snapshot(spark, made.path).manifest["indexes"] == before
    monkeypatch.undo()
    snapshot.rebuild_postings(made, "time")
    made.postings("hash")
    again = snapshot.open_snapshot(spark, made.path)
    assert again.manifest["indexes"]["time"] != before["time"] and "hash" in again.manifest["indexes"]
    assert again.postings("time").count() == postings.build("time", made.chunks, made.layout).count()


def test_instants_before_the_epoch_are_an_error(golden):
    early = golden.snapshot.layout._replace(epoch_ms=T0 + STEP)
    with pytest.raises(Exception, match="before the epoch"):
        postings.build("time", golden.snapshot.chunks, early).collect()


def test_the_flat_path_is_a_candidate(golden):
    q = registry.bound([(T0, T0 + 1)], [Rect(0.0, 0.0, 9.0, 9.0)])
    names = [p.plan_id if p else "FLAT" for _, p in planner.costed(golden, q)]
    assert names[0] == "FLAT" and {"P_TZ", "P_TZ_MERGED", "P_TZ_BIPART", "P_TZ_QUAD", "P_TZ_BIPART_QUAD_MERGED", "P_FULL"} <= set(names) and len(set(names)) == len(names)
    assert planner.choose_path(golden, q) == ("flat", None)
    assert [r.trajectory_id for r in golden.query(q, path="auto").collect()] == [r.trajectory_id for r in golden.query(q).collect()] == ["A", "R"]
    assert golden.run(q, path="auto").status == "OK" and "chosen: FLAT" in golden.explain(q)


def test_run_artifacts_are_written(golden, tmp_path):
    q = registry.bound([(T0, T0 + 1)])
    golden.artifacts(q, f"file://{tmp_path}/run")
    body = json.loads(golden.spark.read.text(f"file://{tmp_path}/run").first()[0])
    assert body["ir"] == q and body["candidates"][0]["plan_id"] and "Scan parquet" in body["explain"]


def test_postings_are_verified_in_both_directions(golden):
    s = golden.snapshot
    for kind in postings.KINDS:
        assert postings.verify(kind, s.postings(kind), s.chunks, s.layout).count() == 0
    lost = postings.verify("hash", s.postings("hash").where("tid <> 1"), s.chunks, s.layout).collect()
    assert [(r.tid, r.fault) for r in lost] == [(1, "MISSING")]
    with pytest.raises(snapshot.SnapshotError):
        snapshot.open_snapshot(s.spark, s.path + "-nowhere")
    assert snapshot.open_snapshot(s.spark, s.path).manifest["status"] == "READY"


def test_verification_broadcasts_no_postings(golden):
    """Posting files are tiny for their rows: a join of single postings is broadcast, through the driver."""
    s = golden.snapshot
    s.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        for kind in postings.KINDS:
            assert "Broadcast" not in postings.verify(kind, s.postings(kind), s.chunks, s.layout)._jdf.queryExecution().executedPlan().toString()
    finally:
        s.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("kind", ["time", "zorder"])
def test_verification_finds_each_fault_once(golden, kind):
    s = golden.snapshot
    good = postings.build(kind, s.chunks, s.layout)
    first = good.orderBy("tid", "chunk_id", "code").first()
    strange = [(first.code + 9999, first.tid, first.chunk_id)] * 2 + [(first.code, 999, 0), (None, first.tid, first.chunk_id), (first.code, None, 0), (first.code, first.tid, None)]
    stored = good.where(f"NOT (tid = {first.tid} AND chunk_id = {first.chunk_id} AND code = {first.code})").unionByName(s.spark.createDataFrame(strange, "code bigint, tid bigint, chunk_id int"))
    found = sorted(map(tuple, postings.verify(kind, stored.unionByName(stored), s.chunks, s.layout).collect()), key=str)
    assert found == sorted([(*first, "MISSING"), *((*x, "EXTRA") for x in set(strange))], key=str)
    # A chunk that lost all its postings.
    lost = good.where(f"tid = {first.tid}").count()
    assert [r.fault for r in postings.verify(kind, good.where(f"tid <> {first.tid}"), s.chunks, s.layout).collect()] == ["MISSING"] * lost


def oracle(trajectories, q):
    out = []
    for t in sorted(trajectories):
        v, pts = trajectories[t]
        if ir.vehicles(q) and v not in ir.vehicles(q):
            continue
        hit = any((not ir.windows(q) or any(a <= ms < b for a, b in ir.windows(q))) and (not ir.boxes(q) or any(r.min_x <= x <= r.max_x and r.min_y <= y <= r.max_y for r in ir.boxes(q))) for ms, x, y in pts)
        if hit:
            out.append(t)
    return out


def test_every_plan_gives_the_oracle_answer(spark):
    rng = random.Random(11)
    trajectories = {f"t{i:02d}": (f"v{i % 4}", [(T0 + rng.randrange(3 * 600_000), rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(2, 6))]) for i in range(25)}
    made = build(spark, {t: (v, sorted({p[0]: p for p in pts}.values())) for t, (v, pts) in trajectories.items()}, chunk_max_points=3)
    engine = Engine(made)
    trajectories = {t: (v, list({p[0]: p for p in pts}.values())) for t, (v, pts) in trajectories.items()}
    start = lambda: T0 + rng.randrange(2 * 600_000)

    def box():
        x, y = rng.uniform(0, 90), rng.uniform(0, 90)
        return Rect(x, y, x + rng.uniform(1, 40), y + rng.uniform(1, 40))

    for n in range(3):
        w, boxes = start(), [box() for _ in range(1 + n % 2)]
        q = registry.bound([(w, w + rng.randrange(60_000, 900_000))], boxes, vehicle="v1" if n == 2 else None)
        want = oracle(trajectories, q)
        assert [r.trajectory_id for r in engine.query(q).collect()] == want
        assert [r.trajectory_id for r in engine.query(q, path="chunks").collect()] == want
        for plan in [*rng.sample(planner.candidates(q), 3), rng.choice(planner.twins(planner.Plan("time", "zorder", False)))]:
            planner.validate(planner.document(q, plan), q)
            assert [r.trajectory_id for r in engine.query(q, path="indexed", plan=plan).collect()] == want


def test_pruning_predicates_reach_the_scan(golden):
    text = golden.explain(registry.bound([(T0, T0 + 1)], [Rect(0.0, 0.0, 1.0, 1.0)]))
    assert "PushedFilters" in text and "LessThan(t_ms" in text and "candidates:" in text


def test_plan_documents_that_must_be_refused():
    q = golden_query()
    good = planner.document(q, planner.Plan("time", "zorder", False))
    planner.validate(good, q)
    for change in (
        lambda p: p["nodes"][2].pop("params"),  # INTERSECT without a merge
        lambda p: p.update(root="n99"),
        lambda p: p["nodes"][1].update(inputs=["n3"]),
        lambda p: next(n for n in p["nodes"] if n["op"] == "EXACT_ST_FILTER")["params"].update(predicate_refs=["/temporal"]),
        lambda p: next(n for n in p["nodes"] if n["op"] == "TOP_K")["params"].update(k=9),
        lambda p: p["nodes"].append({"id": "n77", "op": "FULL_SCAN_CHUNKS", "inputs": []}),
        lambda p: p["nodes"][0]["params"].update(predicate_ref="/spatial"),
        lambda p: p["nodes"][0]["params"].update(predicate_ref="/temporal/7"),
        lambda p: p["nodes"][0]["params"].pop("predicate_ref"),
        lambda p: p["nodes"][1]["params"].update(max_ranges=0),
        lambda p: p["nodes"][1]["params"].update(max_ranges=5000),
        lambda p: p["nodes"][0]["params"].update(max_ranges=5),
        lambda p: next(n for n in p["nodes"] if n["op"] == "FETCH_TRAJECTORY_CHUNK").update(params={"fetch_batch": True}),
        lambda p: next(n for n in p["nodes"] if n["op"] == "BATCH_GET_TRAJECTORY").update(params={"topk_lb_b0": 8, "topk_lb_k": 3}),
        lambda p: next(n for n in p["nodes"] if n["op"] == "BATCH_GET_TRAJECTORY").update(params={"topk_lb_b0": 8, "topk_lb_k": 2, "topk_lb_growth": 1}),
        lambda p: next(n for n in p["nodes"] if n["op"] == "INTERSECT")["params"].update(merge="GUESS"),
    ):
        bad = planner.document(q, planner.Plan("time", "zorder", False))
        change(bad)
        with pytest.raises(planner.NoSafePlan):
            planner.validate(bad, q)


def test_schema_refuses_unknown_and_physical_fields():
    for change in ({"startRow": "x"}, {"temporal": {"start_ms": 1, "end_ms": 1}}, {"result": {"mode": "COUNT"}}, {"similarity": {"metric": "DTW"}}):
        with pytest.raises(ir.IrError):
            ir.validate_bound(registry.bound([(0, 1)]) | change)


def test_binder(golden):
    b = golden.binder()
    window = ("2008-02-02T08:00:00", "2008-02-02T08:10:00")
    assert b.bind(frontends.draft("d", window)).ir["temporal"] == {"start_ms": T0, "end_ms": T0 + 600_000}
    assert b.bind(frontends.draft("d")).status == ir.BIND_ERROR
    assert b.bind(frontends.draft("d", area={"region_name": "atlantis"})).clarify == "spatial"
    assert b.bind(frontends.draft("d", ("last_1d", "now"))).status == ir.NEED_CLARIFICATION
    assert b.bind(frontends.draft("d", window) | {"result": {"mode": "COUNT"}}).status == ir.UNSUPPORTED
    similar = lambda metric, ref: frontends.draft("d", window, similar={"metric": metric, "reference_trajectory_id": ref}, k=2)
    assert b.bind(similar("LCSS", "R")).status == ir.UNSUPPORTED
    assert b.bind(similar("DTW", "nobody")).status == ir.BIND_ERROR
    bound = b.bind(similar("DTW", "R")).ir["similarity"]
    assert bound["reference_tid"] == 4 and bound["exclude_reference"] and bound["reference_chunk_count"] == 1
    area = {"geometry": {"type": "RECTANGLE", "min_lon": 116.3, "min_lat": 39.9, "max_lon": 116.4, "max_lat": 40.0}}
    box = b.bind(frontends.draft("d", area=area)).ir["spatial"]
    assert 400_000 < box["min_x"] < box["max_x"] < 500_000


def test_sql_dialect():
    full = "SELECT DISTINCT trajectory_id FROM trajectory_point p WHERE event_time >= '2008-02-02' AND event_time < \"2008-02-03\" AND vehicle_id = '7' AND lon BETWEEN 1 AND 2 AND lat >= 3 AND lat <= 4 ORDER BY TRAJ_SIM(dtw, 'R') ASC LIMIT 5;"
    got = frontends.sql_to_draft(full)
    assert got["result"] == {"mode": "TOP_K", "k": 5} and got["similarity"]["reference_trajectory_id"] == "R"
    assert got["spatial"]["geometry"] == {"type": "RECTANGLE", "min_lon": 1.0, "min_lat": 3.0, "max_lon": 2.0, "max_lat": 4.0}
    for text in (
        "", "SELECT count(*) FROM trajectory_point", "SELECT trajectory_id, lon FROM trajectory_point", "SELECT trajectory_id FROM trajectory_point", "SELECT trajectory_id FROM other WHERE vehicle_id='1'",
        "SELECT trajectory_id FROM trajectory_point WHERE lon >= 1", "SELECT trajectory_id FROM trajectory_point WHERE event_time >= 'a'", "SELECT trajectory_id FROM trajectory_point WHERE vehicle_id = '1' OR vehicle_id = '2'",
        "SELECT trajectory_id FROM trajectory_point WHERE vehicle_id='1' AND vehicle_id='2'", "SELECT trajectory_id FROM trajectory_point JOIN x WHERE vehicle_id='1'",
        "SELECT trajectory_id FROM trajectory_point WHERE vehicle_id='1' GROUP BY 1", "SELECT trajectory_id FROM trajectory_point WHERE vehicle_id='1' ORDER BY TRAJ_SIM(DTW,'R') DESC LIMIT 1",
    ):
        with pytest.raises(frontends.TranslateError):
            frontends.sql_to_draft(text)


def test_pipeline_dialect():
    match = {"event_time": {"$gte": "2008-02-02", "$lt": "2008-02-03"}, "$and": [{"vehicle_id": 7}]}
    got = frontends.mql_to_draft({"pipeline": [{"$match": match}, {"$group": {"_id": "$trajectory_id"}}, {"$topk": {"metric": "dtw", "reference_trajectory_id": "R", "k": 3}}]})
    assert got["predicates"][0]["value"] == "7" and got["result"]["k"] == 3
    group = {"$group": {"_id": "$trajectory_id"}}
    for bad in ("{", [], [{"$match": {}}], [{"$match": {}}, group], [{"$match": {"speed": 1}}, group], [{"$match": match}, {"$group": {"_id": "$trajectory_id", "n": {"$sum": 1}}}], [{"$match": match}, group, {"$limit": 3}],
                [{"$match": match}, group, {"$topk": {"metric": "DTW", "reference_trajectory_id": "R", "k": True}}]):
        with pytest.raises(frontends.TranslateError):
            frontends.mql_to_draft(bad)


def test_dialog(golden):
    draft = frontends.draft("d", ("2008-02-02T08:00:00", "2008-02-02T08:10:00"), {"region_name": "centre"})
    run = lambda text, *replies, **o: dialog.Dialog(dialog.ScriptedClient(list(replies)), golden.binder(), **o).run(text)
    assert run("How many cars were in centre?", draft).status == ir.UNSUPPORTED
    assert run("who passed centre that morning", "no json", draft).status == ir.OK
    # A region that the question does not hold is the model's invention.
    assert run("who drove that morning", draft).clarify == "spatial"
    topk = frontends.draft("d", similar={"metric": "DTW", "reference_trajectory_id": "R"}, k=2, area={"region_name": "centre"})
    asked = []
    got = run("the 2 nearest to R in centre", topk, ask=lambda q: asked.append(q) or "by DTW")
    assert got.status == ir.OK and len(asked) == 1 and "metric" in asked[0]
    assert run("centre", draft, confirm=lambda s: False).status == ir.NEED_CLARIFICATION


@pytest.mark.parametrize("text", [
    "Trajectories of taxi 8857 with average speed under 10 km/h between 21:00 and 22:00", "COUNT how many trajectories", "Find trajectories whose continuous path segment crosses the ring road",
    "Use continuous Fréchet distance to find neighbors of 8857-8857_14", "Top-3 trajectories most similar to 8857-8857_14 using EDIT_DISTANCE", "Find pairs of taxis that were within 50m of each other in beijing_core tonight",
    "Taxis with a stay point in guomao", "dwell over ten minutes", "平均速度低于 10 的出租车", "有多少条轨迹经过国贸", "停留点在望京的轨迹", "两两相遇的出租车", "trajectories by LCSS",
])
def test_what_cannot_be_expressed_is_refused_early(golden, text):
    client = dialog.ScriptedClient([frontends.draft("d", vehicle="8857")])
    assert dialog.Dialog(client, golden.binder()).run(text).status == ir.UNSUPPORTED and not client.asked


@pytest.mark.parametrize("text", ["Find trajectories of taxi 8857 between 2008-02-03T21:00:00+08:00 and 2008-02-03T22:00:00+08:00", "Use FRECHET distance to find neighbors of 8857-8857_14", "Trajectories in country roads"])
def test_what_can_be_expressed_is_not(text):
    assert dialog.early_refusal(text) is None


def similar_draft(**more):
    return frontends.draft("d", similar={"metric": "DTW", "reference_trajectory_id": "8857-8857_14"}, k=3, **more)


def test_grounding():
    regions, window = ir.registered(), ("2008-02-03T20:50:00+08:00", "2008-02-03T21:20:00+08:00")
    made_up = dialog.ground(similar_draft(temporal=window), "Find k=3 trajectories most similar to 8857-8857_14 between then and then", regions)
    assert "metric" not in made_up["similarity"] and dialog.missing(made_up) == ["metric", "spatial"]
    place = dialog.ground(frontends.draft("d", area={"region_name": "beijing_core"}), "Trajectories through 火星广场 yesterday", regions)
    assert "spatial" not in place and "spatial" in dialog.missing(place)
    text = "Top-3 DTW neighbors of 8857-8857_14 intersecting tdrive_smoke_anchor between then and then"
    assert dialog.ground(similar_draft(vehicle="8857"), text, regions)["predicates"] == []
    assert len(dialog.ground(similar_draft(vehicle="8857"), "Among taxi 8857 trajectories, find 3 DTW neighbors of 8857-8857_14", regions)["predicates"]) == 1
    several = "List trajectory ids that intersect ANY of the registered regions [tdrive_topk_box, tdrive_smoke_anchor] between then and then"
    got = dialog.ground(frontends.draft("d", window) | {"missing": ["spatial"]}, several, regions)
    assert [a["region_name"] for a in got["spatial_parts"]] == ["tdrive_smoke_anchor", "tdrive_topk_box"] and dialog.missing(got) == []
    chinese = "查找期间经过【中关村、望京】任一注册区域的轨迹ID（对应 region: zhongguancun, wangjing）"
    parts = frontends.draft("d", window) | {"spatial_parts": [{"region_name": "zhongguancun"}, {"region_name": "wangjing"}, {"region_name": "guomao"}]}
    assert sorted(a["region_name"] for a in dialog.ground(parts, chinese, regions)["spatial_parts"]) == ["wangjing", "zhongguancun"]
    assert dialog.named_regions("porto ribeira or the Ribeira", regions) == ["porto_ribeira", "ribeira"] and dialog.named_regions("in porto_ribeira", regions) == ["porto_ribeira"]


def test_an_answer_sets_the_asked_field_alone(golden):
    regions = golden.regions
    draft = similar_draft(area={"region_name": "centre"})
    for field, answer, path in (("metric", "by Fréchet, in uptown, 7 of them", ("similarity", "metric")), ("k", "DTW, 7", ("result", "k")), ("reference_trajectory_id", "like R.", ("similarity", "reference_trajectory_id"))):
        got = dialog.answered(draft, field, answer, regions)
        changed = {(k, n) for k in ("similarity", "result") for n in got[k] if got[k][n] != draft[k].get(n)}
        assert changed == {path} and {k: v for k, v in got.items() if k != path[0]} == {k: v for k, v in draft.items() if k != path[0]}
    assert dialog.answered(draft, "temporal", "2008-02-02T08:00:00 to 2008-02-02T09:00:00 by DTW", regions) == draft | {"temporal": {"start": "2008-02-02T08:00:00", "end": "2008-02-02T09:00:00"}}
    assert dialog.answered(draft, "spatial", "1 2 3.5 -4", regions)["spatial"]["geometry"]["max_lat"] == -4.0
    assert dialog.answered(draft, "metric", "the best one", regions)["similarity"] == draft["similarity"]
    # The model is asked once, whatever is asked back.
    client, said = dialog.ScriptedClient([similar_draft() | {"similarity": {"metric": "DTW", "reference_trajectory_id": "R"}}]), iter(["no idea", "DTW", "nowhere", "centre"])
    asked = []
    got = dialog.Dialog(client, golden.binder(), ask=lambda q: asked.append(q) or next(said)).run("the 3 most similar to R")
    assert len(client.asked) == 1 and [q.split()[0] for q in asked] == ["metric", "metric", "constraint", "constraint"] and got.status in (ir.OK, ir.NEED_CLARIFICATION)


@pytest.mark.parametrize("name", ["exact_st", "topk_dtw", "fetch_chunks", "posting_verify_extra"])
def test_registered_queries_match_their_sql(spark, name):
    import duckdb
    from conftest import SMALL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SMALL}/events.parquet'")
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    result = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted(tuple(dict(zip(names, r))[c] for c in columns) for r in result.fetchall())
    assert sorted(names) == columns and sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
