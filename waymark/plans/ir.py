"""The typed query form: strict validation, accessors, and binding of drafts.

BoundIR is canonical (metres, epoch milliseconds, tids); DraftIR is what front-ends make (instants as
text, degrees or region names, external ids).  Unknown keys are refused everywhere, physical storage
keys (startRow, stopRow, rowkey) included.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from waymark.functions import instants, projection
from waymark.functions.codes import Rect
from waymark.functions.distance import METRICS

OK, UNSUPPORTED, BIND_ERROR, NEED_CLARIFICATION = "OK", "UNSUPPORTED_QUERY", "BIND_ERROR", "NEED_CLARIFICATION"
VERSION = "1.0"


class IrError(ValueError):
    """A query document does not have the required form."""


def _object(required: dict, optional: dict | None = None) -> Callable[[Any, str], None]:
    fields = required | (optional or {})

    def check(value: Any, at: str) -> None:
        if not isinstance(value, dict):
            raise IrError(f"{at}: an object is required")
        if unknown := sorted(set(value) - set(fields)):
            raise IrError(f"{at}: unknown field {unknown[0]}")
        for name, rule in fields.items():
            if name in value and not (value[name] is None and name in (optional or {})):
                rule(value[name], f"{at}/{name}")
            elif name in required:
                raise IrError(f"{at}: {name} is required")

    return check


def _type(kinds: tuple, name: str) -> Callable[[Any, str], None]:
    def check(value: Any, at: str) -> None:
        if isinstance(value, bool) and bool not in kinds or not isinstance(value, kinds):
            raise IrError(f"{at}: {name} is required")

    return check


def _enum(*allowed: str) -> Callable[[Any, str], None]:
    def check(value: Any, at: str) -> None:
        if value not in allowed:
            raise IrError(f"{at}: must be one of {', '.join(allowed)}")

    return check


def _array(rule: Callable[[Any, str], None], least: int = 0) -> Callable[[Any, str], None]:
    def check(value: Any, at: str) -> None:
        if not isinstance(value, list) or len(value) < least:
            raise IrError(f"{at}: an array of {least} or more is required")
        for i, x in enumerate(value):
            rule(x, f"{at}/{i}")

    return check


TEXT, INTEGER, NUMBER, FLAG = _type((str,), "text"), _type((int,), "an integer"), _type((int, float), "a number"), _type((bool,), "true or false")


def _at_least(n: int) -> Callable[[Any, str], None]:
    def check(value: Any, at: str) -> None:
        INTEGER(value, at)
        if value < n:
            raise IrError(f"{at}: must be {n} or more")

    return check


SOURCE = _object({"dataset_id": TEXT, "entity": _enum("trajectory")})
SEMANTICS = _object({"mode": _enum("OBSERVED_POINT"), "coupling": _enum("SAME_POINT")})
PREDICATES = _array(_object({"field": _enum("vehicle_id"), "op": _enum("EQ"), "value": TEXT}))
WINDOW = _object({"start_ms": INTEGER, "end_ms": INTEGER})
BOX = _object({"min_x": NUMBER, "min_y": NUMBER, "max_x": NUMBER, "max_y": NUMBER, "relation": _enum("INTERSECTS"), "boundary": _enum("INCLUDED")}, {"region_name": TEXT})
BOUND = _object(
    {"ir_version": _enum(VERSION), "source": SOURCE, "semantics": SEMANTICS, "result": _object({"mode": _enum("TRAJECTORY_IDS", "TOP_K")}, {"k": _at_least(1), "tie_breaker": _enum("TID_ASC")})},
    {
        "query_id": TEXT, "temporal": WINDOW, "temporal_parts": _array(WINDOW, 1), "spatial": BOX, "spatial_parts": _array(BOX, 1), "predicates": PREDICATES,
        "similarity": _object(
            {"metric": _enum(*METRICS), "reference_tid": INTEGER, "scope": _enum("FULL_TRAJECTORY"), "exclude_reference": FLAG, "local_distance": _enum("EUCLIDEAN"), "normalization": _enum("NONE")},
            {"reference_chunk_count": INTEGER},
        ),
        "snapshot": _object({"manifest_id": TEXT, "semantics_version": TEXT}),
    },
)
RECTANGLE = _object({"type": _enum("RECTANGLE"), "min_lon": NUMBER, "min_lat": NUMBER, "max_lon": NUMBER, "max_lat": NUMBER})
AREA = _object({}, {"geometry": RECTANGLE, "region_name": TEXT, "relation": _enum("INTERSECTS"), "boundary": _enum("INCLUDED")})
DRAFT = _object(
    {"ir_version": _enum(VERSION), "source": SOURCE, "semantics": SEMANTICS, "result": _object({"mode": _enum("TRAJECTORY_IDS", "TOP_K")}, {"k": _at_least(1)})},
    {
        "query_id": TEXT, "temporal": _object({"start": TEXT, "end": TEXT}, {"boundary": _enum("[start,end)")}), "spatial": AREA, "spatial_parts": _array(AREA, 1), "predicates": PREDICATES,
        "similarity": _object({"metric": TEXT, "reference_trajectory_id": TEXT}, {"exclude_reference": FLAG}), "sources": _type((dict,), "an object"), "missing": _array(TEXT),
    },
)


def validate_bound(ir: dict) -> dict:
    """The document itself, if it is a sound BoundIR; IrError otherwise."""
    BOUND(ir, "")
    for w in windows(ir):
        if w[0] >= w[1]:
            raise IrError("/temporal: start must be before end")
    for b in boxes(ir):
        if b.min_x > b.max_x or b.min_y > b.max_y:
            raise IrError("/spatial: the least corner must not exceed the greatest")
    topk = ir["result"]["mode"] == "TOP_K"
    if topk and (not ir.get("similarity") or not ir["result"].get("k")):
        raise IrError("/result: TOP_K needs similarity and k")
    if not topk and ir.get("similarity"):
        raise IrError("/similarity: TRAJECTORY_IDS has none")
    return ir


def windows(ir: dict) -> list[tuple[int, int]]:
    """The half-open windows, any of which may hold; temporal_parts override temporal."""
    parts = ir.get("temporal_parts") or ([ir["temporal"]] if ir.get("temporal") else [])
    return [(p["start_ms"], p["end_ms"]) for p in parts]


def boxes(ir: dict) -> list[Rect]:
    """The closed boxes, any of which may hold; spatial_parts override spatial."""
    parts = ir.get("spatial_parts") or ([ir["spatial"]] if ir.get("spatial") else [])
    return [Rect(float(p["min_x"]), float(p["min_y"]), float(p["max_x"]), float(p["max_y"])) for p in parts]


def vehicles(ir: dict) -> list[str]:
    return [p["value"] for p in ir.get("predicates") or []]


# --- regions ---------------------------------------------------------------------------------------

# Registered regions, as min lon, min lat, max lon, max lat.
REGIONS: dict[str, tuple[float, float, float, float]] = {
    "beijing_core": (116.28, 39.82, 116.48, 39.98),
    "tdrive_smoke_anchor": (116.565, 40.055, 116.739, 40.213),
    "tdrive_topk_box": (116.642, 40.126, 116.662, 40.142),
    "tdrive_topk_wide": (116.638167, 40.123236, 116.666448, 40.144943),
    "tdrive_topk_s1": (116.644061, 40.127758, 116.660558, 40.140421),
    "tdrive_topk_mid": (116.609394, 40.094615, 116.695275, 40.173549),
    "zhongguancun": (116.28, 39.95, 116.35, 40.01),
    "wangjing": (116.44, 39.97, 116.51, 40.03),
    "guomao": (116.43, 39.89, 116.48, 39.93),
    "beijing_cbd": (116.43, 39.89, 116.48, 39.93),
    "tiananmen": (116.37, 39.89, 116.41, 39.92),
    "capital_airport": (116.55, 40.04, 116.65, 40.1),
    "haidian_central": (116.25, 39.95, 116.36, 40.05),
    "chaoyang_central": (116.42, 39.9, 116.55, 40.02),
    "porto_smoke_anchor": (-8.613437, 41.1495, -8.612635, 41.1501),
    "porto_topk_box": (-8.613658, 41.149334, -8.612414, 41.150266),
    "porto_topk_wide": (-8.613658, 41.149334, -8.612414, 41.150266),
    "porto_topk_mid": (-8.613285, 41.149613, -8.612787, 41.149987),
    "porto_core": (-8.65, 41.14, -8.58, 41.18),
    "porto_ribeira": (-8.625, 41.138, -8.608, 41.145),
    "porto_boa_vista": (-8.635, 41.155, -8.615, 41.170),
    "porto_campanha": (-8.595, 41.145, -8.575, 41.160),
    "porto_airport": (-8.691, 41.227, -8.651, 41.257),
    "baixa": (-8.6225, 41.1435, -8.6065, 41.1555),
    "campanha": (-8.596, 41.1415, -8.576, 41.1565),
    "cedofeita": (-8.63, 41.151, -8.614, 41.163),
    "aliados": (-8.617, 41.1445, -8.605, 41.1535),
    "ribeira": (-8.621, 41.136, -8.609, 41.145),
    "matosinhos": (-8.702, 41.173, -8.678, 41.191),
    "boavista": (-8.638, 41.152, -8.622, 41.164),
    "trindade": (-8.615, 41.14825, -8.605, 41.15575),
    "foz": (-8.687, 41.1445, -8.667, 41.1595),
}


@dataclass(frozen=True)
class Region:
    """A named rectangle, in degrees or (``local``) already in metres."""

    box: tuple[float, float, float, float]
    local: bool = False


def registered() -> dict[str, Region]:
    return {name: Region(box) for name, box in REGIONS.items()}


# --- binding ---------------------------------------------------------------------------------------


@dataclass
class Bound:
    """What binding a draft gave: a status, then an IR or an error with the field to ask for."""

    status: str
    ir: dict | None = None
    error: str | None = None
    clarify: str | None = None


class Binder:
    """Turns drafts into BoundIR.

    ``lookup`` gives (tid, chunk count) of an external trajectory id, or None.  A query constrained by
    spatial parts alone is accepted.
    """

    def __init__(self, lookup: Callable[[str], tuple[int, int] | None], crs: str = "EPSG:32650", regions: dict[str, Region] | None = None, manifest_id: str = "ready", now_ms: int | None = None) -> None:
        self.lookup, self.crs, self.manifest_id, self.now_ms = lookup, crs, manifest_id, now_ms
        self.regions = {k.lower(): v for k, v in (registered() if regions is None else regions).items()}

    def bind(self, draft: dict) -> Bound:
        mode = (draft.get("result") or {}).get("mode") if isinstance(draft, dict) else None
        if not isinstance(draft, dict) or not (draft.get("source") or {}).get("dataset_id"):
            return Bound(BIND_ERROR, error="the draft names no data set")
        if not mode:
            return Bound(BIND_ERROR, error="the draft does not say what kind of result it wants")
        if mode not in ("TRAJECTORY_IDS", "TOP_K"):
            return Bound(UNSUPPORTED, error=f"a result of kind {mode} can't be given")
        try:
            DRAFT(draft, "")
            return self._bind(draft, mode)
        except instants.NeedNow as e:
            return Bound(NEED_CLARIFICATION, error=str(e), clarify="temporal")
        except ValueError as e:
            return Bound(BIND_ERROR, error=str(e))

    def _box(self, area: dict) -> dict | Bound:
        name = (area.get("region_name") or "").strip()
        if name:
            region = self.regions.get(name.lower())
            if region is None:
                return Bound(NEED_CLARIFICATION, error=f"no region is called {name}", clarify="spatial")
            rect = region.box if region.local else projection.envelope(*region.box, self.crs)
        elif geometry := area.get("geometry"):
            rect = projection.envelope(geometry["min_lon"], geometry["min_lat"], geometry["max_lon"], geometry["max_lat"], self.crs)
        else:
            return Bound(NEED_CLARIFICATION, error="where? a region or a rectangle is wanted", clarify="spatial")
        return dict(zip(("min_x", "min_y", "max_x", "max_y"), rect)) | {"relation": "INTERSECTS", "boundary": "INCLUDED"} | ({"region_name": name} if name else {})

    def _bind(self, draft: dict, mode: str) -> Bound:
        ir: dict = {"ir_version": VERSION, "query_id": draft.get("query_id") or f"q_{uuid.uuid4().hex[:8]}", "source": dict(draft["source"]), "semantics": dict(draft["semantics"])}
        if when := draft.get("temporal"):
            start, end = (instants.parse_instant(when[k], self.now_ms) for k in ("start", "end"))
            if start >= end:
                return Bound(BIND_ERROR, error="the window is empty: it begins at its end or later")
            ir["temporal"] = {"start_ms": start, "end_ms": end}
        areas = draft.get("spatial_parts") or ([draft["spatial"]] if draft.get("spatial") else [])
        rects = [self._box(a) for a in areas]
        if refused := next((r for r in rects if isinstance(r, Bound)), None):
            return refused
        if draft.get("spatial_parts"):
            ir["spatial_parts"] = rects
        elif rects:
            ir["spatial"] = rects[0]
        ir["predicates"] = [dict(p) for p in draft.get("predicates") or []]
        ir["result"] = {"mode": mode, "tie_breaker": "TID_ASC"}
        similar = draft.get("similarity")
        if mode == "TRAJECTORY_IDS" and similar:
            return Bound(BIND_ERROR, error="similarity goes with TOP_K only")
        if mode == "TOP_K":
            if not similar:
                return Bound(BIND_ERROR, error="similar to what? TOP_K compares with a reference")
            metric = (similar.get("metric") or "").strip()
            if metric not in METRICS:
                return Bound(UNSUPPORTED, error=f"no metric is called {metric!r}; there are {', '.join(METRICS)}")
            found = self.lookup(similar["reference_trajectory_id"])
            if found is None:
                return Bound(BIND_ERROR, error=f"the data set has no trajectory {similar['reference_trajectory_id']} to compare with")
            exclude = similar.get("exclude_reference")
            ir["similarity"] = {
                "metric": metric, "reference_tid": found[0], "scope": "FULL_TRAJECTORY", "exclude_reference": True if exclude is None else exclude,
                "local_distance": "EUCLIDEAN", "normalization": "NONE", "reference_chunk_count": found[1],
            }
            if not draft["result"].get("k"):
                return Bound(BIND_ERROR, error="how many? k is 1 or more")
            ir["result"]["k"] = draft["result"]["k"]
        if not (windows(ir) or boxes(ir) or vehicles(ir)):
            return Bound(BIND_ERROR, error="without a time, place or vehicle the answer would be everything")
        ir["snapshot"] = {"manifest_id": self.manifest_id, "semantics_version": VERSION}
        return Bound(OK, ir=validate_bound(ir))
