"""Raw trajectory files as DataFrames: three text formats, all parsed by native expressions.

Each parser takes a DataFrame with a column ``value`` (one line per row) and gives
  accepted  vehicle_id, trajectory_id, pts array<struct<lon, lat, t_ms>>
  rejected  line_preview (120 characters at most), reason, detail
A single bad token rejects the whole line; blank lines are passed over.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW = 120
POINT = "struct<lon: double, lat: double, t_ms: bigint>"
# Fixed values of the formats.
MULTIPOINT = "-MULTIPOINT Z("
PORTO_STEP_MS = 15_000
PORTO_LON, PORTO_LAT = (-10.0, -7.0), (40.5, 42.0)


class Parsed(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def _split(lines: DataFrame, vehicle: Column, trajectory: Column, pts: Column, detail: Column) -> Parsed:
    rows = lines.where(F.trim("value") != "").select("value", vehicle.alias("vehicle_id"), trajectory.alias("trajectory_id"), pts.alias("pts"), detail.alias("detail"))
    accepted = rows.where("detail IS NULL").select("vehicle_id", "trajectory_id", "pts")
    rejected = rows.where("detail IS NOT NULL").select(F.substring("value", 1, PREVIEW).alias("line_preview"), F.lit("PARSE").alias("reason"), "detail")
    return Parsed(accepted, rejected)


def _points(tokens: Column, build) -> Column:
    return F.transform(tokens, build)


def _bad(pts: Column) -> Column:
    return F.exists(pts, lambda p: p["lon"].isNull() | p["lat"].isNull() | p["t_ms"].isNull())


def _first_fault(*faults: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in faults), F.lit(None).cast("string"))


def parse_tdrive(lines: DataFrame) -> Parsed:
    """``<taxi>-<segment>-MULTIPOINT Z((lon lat ms), ...)``; the vehicle is the text before the first dash."""
    line = F.trim("value")
    at = F.instr(line, MULTIPOINT)
    trajectory = F.when(at > 1, F.substring_index(line, MULTIPOINT, 1))
    body = F.when(at > 0, F.substr(line, at + len(MULTIPOINT), F.length(line) - at - len(MULTIPOINT)))
    tokens = F.split(F.regexp_extract(body, r"^\((.*)\)$", 1), r"\)\s*,\s*\(")

    def point(token: Column) -> Column:
        parts = F.split(F.trim(token), r"\s+")
        number = lambda i, kind: F.when(F.size(parts) == 3, F.get(parts, F.lit(i)).try_cast(kind))
        return F.struct(number(0, "double").alias("lon"), number(1, "double").alias("lat"), number(2, "bigint").alias("t_ms"))

    pts = _points(tokens, point)
    dash = F.instr(trajectory, "-")
    vehicle = F.when(dash > 1, F.substring_index(trajectory, "-", 1))
    detail = _first_fault((at <= 1, "no MULTIPOINT Z marker"), (~line.endswith(")"), "no closing bracket"), (vehicle.isNull(), "no vehicle id"), (_bad(pts), "bad point"))
    return _split(lines, vehicle, trajectory, pts, detail)


def parse_porto(lines: DataFrame) -> Parsed:
    """Quoted CSV of nine columns: trip id, ..., taxi id (5th), start in seconds (6th), missing flag (8th),
    polyline (9th) of [lon, lat] every 15 seconds."""
    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), F.trim("value")), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), 1), lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"'))
    get = lambda i: F.get(fields, F.lit(i))
    start = get(5).try_cast("bigint")
    polyline = F.from_json(get(8), "array<array<double>>", {"mode": "PERMISSIVE"})
    pts = F.transform(polyline, lambda p, i: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"), (start * 1000 + i * PORTO_STEP_MS).cast("bigint").alias("t_ms")))
    outside = F.exists(pts, lambda p: ~(p["lon"].between(*PORTO_LON) & p["lat"].between(*PORTO_LAT)))
    detail = _first_fault(
        (F.size(fields) < 9, "fewer than nine columns"), (get(0) == "TRIP_ID", "header"), (F.lower(get(7)) == "true", "MISSING_DATA"), (start.isNull(), "bad TIMESTAMP"),
        (polyline.isNull(), "bad polyline"), (F.size(polyline) == 0, "empty polyline"), (_bad(pts), "bad point"), (outside, "outside the city"),
    )
    return _split(lines, get(4), F.concat_ws("-", get(4), get(0)), pts, detail)


def parse_ais(lines: DataFrame) -> Parsed:
    """``tid|start|end|lon,lat;...`` in UTC; point times are interpolated linearly and rounded."""
    fields = F.split(F.trim("value"), r"\|")
    get = lambda i: F.get(fields, F.lit(i))
    millis = lambda c: F.unix_millis(F.try_to_timestamp(F.concat(F.regexp_replace(F.trim(c), "Z$", ""), F.lit("Z")), F.lit("yyyy-MM-dd[' ']['T']HH:mm:ssX")))
    start, end = millis(get(1)), millis(get(2))
    tokens = F.filter(F.split(get(3), ";"), lambda t: F.trim(t) != "")
    n = F.size(tokens)

    def point(token: Column, i: Column) -> Column:
        parts = F.split(F.trim(token), ",")
        number = lambda k: F.when(F.size(parts) == 2, F.trim(F.get(parts, F.lit(k))).try_cast("double"))
        share = F.when(n > 1, i / (n - 1)).otherwise(F.lit(0.0))
        return F.struct(number(0).alias("lon"), number(1).alias("lat"), (start + F.floor((end - start) * share + 0.5)).cast("bigint").alias("t_ms"))

    pts = F.transform(tokens, point)
    detail = _first_fault((F.size(fields) != 4, "not four fields"), (start.isNull() | end.isNull(), "bad time"), (end < start, "end before start"), (n == 0, "no points"), (_bad(pts), "bad point"))
    return _split(lines, F.concat(F.lit("ais-"), F.trim(get(0))), F.concat(F.lit("ais-"), F.trim(get(0))), pts, detail)


PARSERS = {"tdrive": parse_tdrive, "porto": parse_porto, "ais": parse_ais}


def read_raw(spark: SparkSession, path: str, kind: str) -> Parsed:
    """Parse a text file or folder of one of the formats."""
    return PARSERS[kind](spark.read.text(path))


def flatten(accepted: DataFrame) -> DataFrame:
    """One row per raw point with its place in the input: vehicle_id, trajectory_id, pos, lon, lat, t_ms."""
    return accepted.select("vehicle_id", "trajectory_id", F.posexplode("pts").alias("pos", "p")).select("vehicle_id", "trajectory_id", "pos", "p.lon", "p.lat", "p.t_ms")
