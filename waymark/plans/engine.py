"""Answering queries over a snapshot.

The default path filters the flat points table, where the exact predicate is plain comparisons that
reach the Parquet scan.  The chunk path prunes by extents first; indexed paths run an access plan of
posting scans; "auto" takes the cheapest of all.  All give the same answer; ``check`` compares them.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import plan_ops as ops
from waymark.plans import ir as _ir
from waymark.plans import planner, predicates
from waymark.sources.snapshot import Snapshot, SnapshotError

PATHS = ("flat", "chunks", "indexed")
AUTO = "auto"


@dataclass
class Limits:
    """Budgets; a query that exceeds one is RESOURCE_EXHAUSTED, with no partial answer."""

    max_candidate_chunks: int = 200_000
    max_cells: int = 500_000_000
    max_candidate_bytes: int = 8 << 30
    deadline_s: float | None = None


@dataclass
class Result:
    """An answer with its status: OK, RESOURCE_EXHAUSTED, DATA_INTEGRITY_ERROR, NO_SAFE_PLAN or FAILED."""

    status: str
    frame: DataFrame | None = None
    error: str | None = None

    @property
    def rows(self) -> list[dict]:
        """The answer on the driver, fetched partition by partition; for answers known to be small."""
        return [r.asDict() for r in self.frame.toLocalIterator()] if self.frame is not None else []


class Engine:
    """Queries over one snapshot."""

    def __init__(self, snapshot: Snapshot, crs: str = "EPSG:32650", regions: dict[str, _ir.Region] | None = None, limits: Limits | None = None, now_ms: int | None = None) -> None:
        self.snapshot, self.crs, self.regions, self.limits, self.now_ms = snapshot, crs, regions, limits or Limits(), now_ms

    @property
    def spark(self) -> SparkSession:
        return self.snapshot.spark

    def lookup(self, trajectory_id: str) -> tuple[int, int] | None:
        """tid and chunk count of an external id."""
        row = self.snapshot.meta.where(F.col("trajectory_id") == trajectory_id).select("tid", "n_chunks").first()
        return (row[0], row[1]) if row else None

    def binder(self) -> _ir.Binder:
        return _ir.Binder(self.lookup, self.crs, self.regions, self.snapshot.manifest["manifest_id"], self.now_ms)

    # --- matching trajectories ---

    def plan(self, ir: dict, plan: planner.Plan | None = None) -> planner.Plan:
        """The given or the cheapest posting plan, if its document is sound; NoSafePlan otherwise."""
        plan = plan or planner.choose(self, ir)
        planner.validate(planner.document(ir, plan), ir)
        return plan

    def matching(self, ir: dict, path: str = "flat", plan: planner.Plan | None = None, check: bool = False) -> DataFrame:
        """tids of the trajectories with a matching sample; with ``check``, a posted chunk that is not
        stored is an error on the indexed path."""
        if path == AUTO:
            path, plan = planner.choose_path(self, ir)
        if path == "flat":
            return self.snapshot.points.where(predicates.point_predicate(ir)).select("tid").distinct()
        if path not in PATHS:
            raise ValueError(f"no path is called {path}; there are {', '.join((*PATHS, AUTO))}")
        chunks = self.snapshot.chunks
        near = chunks.where(predicates.chunk_predicate(ir))
        if path == "indexed":
            refs = planner.references(self.snapshot, ir, self.plan(ir, plan))
            if refs is not None:
                if check:
                    ops.check_chunks(refs, chunks)
                # CHUNK_META_FILTER and FETCH_TRAJECTORY_CHUNK are one scan: the extents are filtered in it.
                near = ops.fetch_trajectory_chunk(refs, near)
        return ops.project_trajectory_ids(ops.exact_st_filter(near, ir))

    def candidates(self, ir: dict, path: str = "flat", plan: planner.Plan | None = None, check: bool = False) -> DataFrame:
        """tid and points of the trajectories that a TOP_K query compares."""
        tids = self.matching(ir, path, plan, check)
        if ir["similarity"]["exclude_reference"]:
            tids = ops.exclude_reference(tids, ir["similarity"]["reference_tid"])
        return ops.batch_get_trajectory(tids, self.snapshot.trajectories)

    def query(self, ir: dict, path: str = "flat", plan: planner.Plan | None = None, pruned: bool = False) -> DataFrame:
        """tid, trajectory_id [, distance], ordered: by tid, or by distance and tid.

        The frame is lazy, so budgets and deadline, which ``run`` keeps, are not looked at.
        """
        _ir.validate_bound(ir)
        if ir["result"]["mode"] == "TRAJECTORY_IDS":
            return ops.return_trajectory_ids(self.matching(ir, path, plan), self.snapshot.meta)
        s, k = ir["similarity"], ir["result"]["k"]
        reference = ops.reference_points(self.snapshot.trajectories, s["reference_tid"])
        found = self.candidates(ir, path, plan)
        best = ops.top_k_pruned(found, s["metric"], k, reference) if pruned else ops.top_k(ops.similarity(found, s["metric"], reference), k)
        return best.join(self.snapshot.meta.select("tid", "trajectory_id"), "tid").select("tid", "trajectory_id", "distance").orderBy("distance", "tid")

    def run(self, ir: dict, path: str = "flat", pruned: bool = False) -> Result:
        """Check the budgets and that posted chunks are stored, then answer; a failure gives a status and
        no answer.  With a deadline the answer is computed at once, else when the frame is used."""
        tag = f"waymark-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop() -> None:
            late.set()
            self.spark.interruptTag(tag)

        timer = threading.Timer(self.limits.deadline_s, stop) if self.limits.deadline_s is not None else None
        try:
            if timer:
                self.spark.addTag(tag)
                timer.start()
            _ir.validate_bound(ir)
            plan = None
            if path == AUTO:
                path, plan = planner.choose_path(self, ir)
            if path == "indexed":
                plan = self.plan(ir, plan)
            if path != "flat":
                n = self.snapshot.chunks.where(predicates.chunk_predicate(ir)).count()
                if n > self.limits.max_candidate_chunks:
                    raise ops.ResourceExhausted(f"{n} candidate chunks; the budget is {self.limits.max_candidate_chunks}")
            if path == "indexed" and (refs := planner.references(self.snapshot, ir, plan)) is not None:
                ops.check_chunks(refs, self.snapshot.chunks)
            if ir["result"]["mode"] == "TOP_K":
                s = ir["similarity"]
                reference = ops.reference_points(self.snapshot.trajectories, s["reference_tid"])
                ops.check_cells(self.candidates(ir, path, plan), reference, s["metric"], self.limits.max_cells, self.limits.max_candidate_bytes)
            frame = self.query(ir, path, plan, pruned)
            if timer:
                frame.count()
            if late.is_set():
                raise ops.ResourceExhausted(self._late())
            return Result("OK", frame)
        except ops.ResourceExhausted as e:
            return Result("RESOURCE_EXHAUSTED", error=str(e))
        except (ops.DataIntegrityError, SnapshotError) as e:
            return Result("DATA_INTEGRITY_ERROR", error=str(e))
        except planner.NoSafePlan as e:
            return Result("NO_SAFE_PLAN", error=str(e))
        except Exception as e:  # the contract: no partial answers, whatever went wrong
            return Result("RESOURCE_EXHAUSTED", error=self._late()) if late.is_set() else Result("FAILED", error=str(e))
        finally:
            if timer:
                timer.cancel()
                self.spark.removeTag(tag)

    def _late(self) -> str:
        return f"not done within {self.limits.deadline_s} s"

    def query_draft(self, draft: dict, **options) -> tuple[_ir.Bound, DataFrame | None]:
        bound = self.binder().bind(draft)
        return bound, self.query(bound.ir, **options) if bound.ir else None

    # --- inspection ---

    def check(self, ir: dict) -> bool:
        """Whether all paths give the same trajectories."""
        exact = self.matching(ir, "flat")
        return not any(exact.exceptAll(o).limit(1).count() or o.exceptAll(exact).limit(1).count() for o in (self.matching(ir, p) for p in PATHS[1:]))

    def explain(self, ir: dict, path: str = "flat") -> str:
        """The candidate plans with their costs, the chosen one, and Spark's physical plan."""
        _ir.validate_bound(ir)
        costed = planner.costed(self, ir)
        lines = [f"{p.plan_id if p else 'FLAT'}: {cost:.0f}" for cost, p in costed]
        df = self.query(ir, path)
        physical = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join(["candidates:", *lines, f"chosen: {costed[0][1].plan_id if costed[0][1] else 'FLAT'}", physical])

    def artifacts(self, ir: dict, path: str) -> None:
        """Write the query, its candidates and its plan beside each other as text."""
        body = {"ir": ir, "candidates": [{"plan_id": p.plan_id if p else "FLAT", "cost": c} for c, p in planner.costed(self, ir)], "explain": self.explain(ir)}
        self.spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
