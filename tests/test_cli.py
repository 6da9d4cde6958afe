import json

from waymark import __main__ as cli

LINES = ["7-1-MULTIPOINT Z((116.45 39.90 1201910400000), (116.46 39.91 1201910700000))", "8-1-MULTIPOINT Z((116.30 39.99 1201910400000))", "broken"]


def call(spark, capsys, *args):
    code = cli.run(cli.parser().parse_args(list(args)), spark)
    return code, capsys.readouterr().out.strip().splitlines()[-1:]


def test_commands(spark, capsys, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-0").write_text("\n".join(LINES))
    out = f"{tmp_path}/snapshot"
    assert call(spark, capsys, "doctor")[0] == 0
    code, said = call(spark, capsys, "profile-data", f"{tmp_path}/in")
    profile = json.loads(said[0])
    assert code == 0 and (profile["n_points"], profile["min_lon"], profile["max_lat"]) == (3, 116.30, 39.99)
    code, said = call(spark, capsys, "build-snapshot", f"{tmp_path}/in", "--out", out, "--dataset-id", "tdrive_v1")
    assert code == 0 and json.loads(said[0])["status"] == "READY"
    assert json.loads(said[0])["rejects"] == {"PARSE": 1}
    code, said = call(spark, capsys, "verify-snapshot", out)
    assert code == 0 and json.loads(said[0]) == {k: 0 for k in cli.postings.KINDS}
    where = "event_time >= '2008-02-02T08:00:00' AND event_time < '2008-02-02T09:00:00' AND region_name = 'guomao'"
    code, said = call(spark, capsys, "query-sql", out, f"SELECT trajectory_id FROM trajectory_point WHERE {where}", "--path", "indexed")
    assert code == 0 and [r["trajectory_id"] for r in json.loads(said[0])["rows"]] == ["7-1"]
    draft = {"ir_version": "1.0", "source": {"dataset_id": "d", "entity": "trajectory"}, "semantics": {"mode": "OBSERVED_POINT", "coupling": "SAME_POINT"}, "result": {"mode": "TRAJECTORY_IDS"}, "predicates": [{"field": "vehicle_id", "op": "EQ", "value": "8"}]}
    (tmp_path / "replies.json").write_text(json.dumps([draft]))
    code, said = call(spark, capsys, "query-nl", out, "where did vehicle 8 go", "--replies", f"{tmp_path}/replies.json")
    assert code == 0 and [r["trajectory_id"] for r in json.loads(said[0])["rows"]] == ["8-1"]
    code, said = call(spark, capsys, "query-mql", out, json.dumps([{"$match": {"region_name": "nowhere"}}, {"$group": {"_id": "$trajectory_id"}}]))
    assert code == 1 and json.loads(said[0])["status"] == "NEED_CLARIFICATION"
