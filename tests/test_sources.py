from pyspark.sql import functions as F

from waymark.functions.codes import Domain
from waymark.operators import ingest
from waymark.sources import parsers


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_tdrive(spark):
    got = parsers.parse_tdrive(lines(spark, "1001-5-MULTIPOINT Z((116.3 39.9 1201910400000), (116.4 39.95 1201910700000))", "7-1-MULTIPOINT Z((116.3 39.9 x))", "nothing here", "  "))
    row = got.accepted.collect()
    assert len(row) == 1 and (row[0].vehicle_id, row[0].trajectory_id) == ("1001", "1001-5")
    assert [(p.lon, p.lat, p.t_ms) for p in row[0].pts] == [(116.3, 39.9, 1201910400000), (116.4, 39.95, 1201910700000)]
    assert sorted(r.detail for r in got.rejected.collect()) == ["bad point", "no MULTIPOINT Z marker"]


def test_porto(spark):
    good = '"T1","C","","","20000589","1372636858","A","False","[[-8.618643,41.141412],[-8.618499,41.141376]]"'
    bad = ['"T2","C","","","2","1372636858","A","True","[]"', '"TRIP_ID","","","","TAXI_ID","TIMESTAMP","","MISSING_DATA","POLYLINE"', '"T3","C","","","2","1372636858","A","False","[]"', '"T4","C","","","2","5","A","False","[[1.0,2.0]]"']
    got = parsers.parse_porto(lines(spark, good, *bad))
    row = got.accepted.collect()
    assert [(r.vehicle_id, r.trajectory_id, [p.t_ms for p in r.pts]) for r in row] == [("20000589", "20000589-T1", [1372636858000, 1372636873000])]
    assert sorted(r.detail for r in got.rejected.collect()) == ["MISSING_DATA", "empty polyline", "header", "outside the city"]


def test_ais(spark):
    got = parsers.parse_ais(lines(spark, "5|2020-01-01 00:00:00|2020-01-01 00:00:10|18.1,54.2;18.2,54.3;18.4,54.5", "5|x|y|1,2"))
    row = got.accepted.first()
    assert row.trajectory_id == "ais-5" and [p.t_ms for p in row.pts] == [1577836800000, 1577836805000, 1577836810000]
    assert got.rejected.first().detail == "bad time"


RAW = "vehicle_id string, trajectory_id string, pos bigint, t_ms bigint, x_m double, y_m double"


def test_cleaning(spark):
    rows = [("v", "t", 0, 20, 1.0, 1.0), ("v", "t", 1, 10, 2.0, 2.0), ("v", "t", 2, 20, 1.0, 1.0), ("v", "t", 3, 20, 9.0, 9.0), ("w", "u", 0, 5, 500.0, 0.0), ("w", "u", 1, 6, 1.0, 1.0)]
    got = ingest.clean(spark.createDataFrame(rows, RAW), Domain(0.0, 0.0, 100.0, 100.0))
    assert [(r.trajectory_id, r.seq, r.t_ms, r.x_m) for r in got.points.orderBy("seq").collect()] == [("t", 0, 10, 2.0), ("t", 1, 20, 1.0)]
    assert [tuple(r) for r in got.rejects.collect()] == [("u", "OUT_OF_DOMAIN")]
    assert {r.trajectory_id: (r.n_exact, r.n_same_time) for r in got.removed.collect()} == {"t": (1, 1), "u": (0, 0)}


def test_chunk_edges_and_concatenation(spark):
    rows = [("v", "t", i, i, float(i), 0.0) for i in range(257)] + [("w", "s", i, i, float(i), 0.0) for i in range(256)]
    points = ingest.assign_tids(ingest.clean(spark.createDataFrame(rows, RAW)).points)
    chunks = ingest.chunk(points, 256)
    assert sorted((r.tid, r.chunk_id, r.n_points) for r in chunks.collect()) == [(1, 0, 256), (2, 0, 256), (2, 1, 1)]
    back = {r.tid: [p.x for p in r.pts] for r in ingest.concatenate(chunks).collect()}
    assert back[2] == [float(i) for i in range(257)]


def test_numbering_is_in_order(spark):
    ids = spark.createDataFrame([(f"{i}-x",) for i in range(500)], "k string")
    got = sorted((r["k"], r["n"]) for r in ingest.number_ids(ids, "k", "n").collect())
    assert [n for _, n in got] == list(range(1, 501))
    assert ingest.number_ids(ids.limit(0), "k", "n").count() == 0


def test_stream_chunks_static(spark):
    from waymark.streaming.append import stream_chunks

    rows = [("v", 1000, 1.0, 2.0), ("v", 1000, 1.0, 2.0), ("v", 2000, 3.0, 4.0), ("v", 700_000, 5.0, 6.0)]
    got = stream_chunks(spark.createDataFrame(rows, "vehicle_id string, t_ms bigint, x_m double, y_m double")).orderBy("t_min").collect()
    assert [(r.n_points, r.min_x, r.max_x) for r in got] == [(2, 1.0, 3.0), (1, 5.0, 5.0)]


def test_stream_of_files(spark, tmp_path):
    from waymark.streaming.append import stream_chunks

    schema = "vehicle_id string, t_ms bigint, x_m double, y_m double"
    spark.createDataFrame([("v", 1000, 1.0, 2.0), ("v", 1000, 1.0, 2.0), ("v", 2000, 3.0, 4.0)], schema).write.parquet(f"{tmp_path}/in")
    stream = stream_chunks(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("chunks_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("chunks_out").agg(F.max("n_points")).first()[0] == 2
