"""Command line: python -m waymark COMMAND ...

doctor | profile-data | build-snapshot | build-stats | verify-snapshot | rebuild-postings | query-ir |
query-draft | query-sql | query-mql | query-nl | explain
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from waymark.functions import projection
from waymark.operators import ingest, postings
from waymark.plans import dialog, frontends
from waymark.plans.engine import AUTO, PATHS, Engine
from waymark.sources import parsers, snapshot


def session() -> SparkSession:
    return SparkSession.builder.appName("waymark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def raw_points(spark: SparkSession, args: argparse.Namespace):
    parsed = parsers.read_raw(spark, args.input, args.kind)
    return ingest.project_points(parsers.flatten(parsed.accepted), projection.DATASET_CRS[args.kind])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="waymark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("doctor")
    for name in ("profile-data", "build-snapshot"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("--kind", choices=sorted(parsers.PARSERS), default="tdrive")
        if name == "build-snapshot":
            p.add_argument("--out", required=True)
            p.add_argument("--dataset-id", default="dataset")
            p.add_argument("--chunk-points", type=int, default=256)
            p.add_argument("--bucket-ms", type=int, default=600_000)
    for name in ("build-stats", "verify-snapshot", "rebuild-postings", "query-ir", "query-draft", "query-sql", "query-mql", "query-nl", "explain"):
        p = sub.add_parser(name)
        p.add_argument("snapshot")
        if name == "rebuild-postings":
            p.add_argument("postings", choices=postings.KINDS)
        elif name.startswith("query") or name == "explain":
            p.add_argument("query", help="the query's text, or @file")
            p.add_argument("--path", choices=(*PATHS, AUTO), default=AUTO)
            p.add_argument("--crs", default="EPSG:32650")
            p.add_argument("--now-ms", type=int)
            if name == "query-nl":
                p.add_argument("--replies", required=True, help="file with a JSON list of the language model's replies")
    return top


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    out = lambda value: print(json.dumps(value, default=str))
    if args.command == "doctor":
        out({"spark": spark.version, "rows": spark.range(3).count()})
        return 0
    if args.command == "profile-data":
        degrees = parsers.flatten(parsers.read_raw(spark, args.input, args.kind).accepted)
        ranges = degrees.agg(*(f(c).alias(f"{n}_{c}") for c in ("lon", "lat") for n, f in (("min", F.min), ("max", F.max)))).first().asDict()
        cleaned = ingest.clean(raw_points(spark, args))
        out(ingest.profile(cleaned.points).first().asDict() | ranges)
        return 0
    if args.command == "build-snapshot":
        parsed = parsers.read_raw(spark, args.input, args.kind)
        # A line that can't be parsed has no id: the stored reject shows how it begins.
        rejects = parsed.rejected.select(F.col("line_preview").alias("trajectory_id"), "reason").unionByName(ingest.empty_rejects(parsed.accepted))
        made = snapshot.build_snapshot(spark, raw_points(spark, args), args.out, args.dataset_id, args.chunk_points, args.bucket_ms, rejects=rejects)
        reasons = {r["reason"]: r["count"] for r in made.table("rejects").groupBy("reason").count().collect()}
        out(made.manifest | {"rejects": reasons})
        return 0
    opened = snapshot.open_snapshot(spark, args.snapshot)
    if args.command == "build-stats":
        snapshot.write_stats(opened)
        return 0
    if args.command == "rebuild-postings":
        snapshot.rebuild_postings(opened, args.postings)
        return 0
    if args.command == "verify-snapshot":
        faults = {k: postings.verify(k, opened.postings(k), opened.chunks, opened.layout).count() for k in opened.manifest["indexes"]}
        out(faults)
        return int(any(faults.values()))
    text = open(args.query[1:]).read() if args.query.startswith("@") else args.query
    engine = Engine(opened, crs=args.crs, now_ms=args.now_ms)
    if args.command in ("query-ir", "explain"):
        ir = json.loads(text)
    elif args.command == "query-nl":
        with open(args.replies) as f:
            client = dialog.ScriptedClient(json.load(f))
        bound = dialog.Dialog(client, engine.binder()).run(text)
        ir = bound.ir
    else:
        make = {"query-draft": json.loads, "query-sql": lambda t: frontends.sql_to_draft(t, opened.dataset_id), "query-mql": lambda t: frontends.mql_to_draft(t, opened.dataset_id)}[args.command]
        bound = engine.binder().bind(make(text))
        ir = bound.ir
    if ir is None:
        out({"status": bound.status, "error": bound.error, "clarify": bound.clarify})
        return 1
    if args.command == "explain":
        print(engine.explain(ir, args.path))
        return 0
    result = engine.run(ir, args.path)
    out({"status": result.status, "error": result.error, "rows": result.rows})
    return int(result.status != "OK")


if __name__ == "__main__":
    sys.exit(run(parser().parse_args(), session()))
