"""The engine as its users see it."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import fs
from tidegate.engine.checkpoints import CheckpointManager, FileCheckpoints, MemoryCheckpoints
from tidegate.engine.config import EngineConfig
from tidegate.engine.executor import Execution, PipelineExecutor
from tidegate.engine.metrics import Metrics
from tidegate.engine.schemas import StoredSchemas
from tidegate.errors import TidegateError
from tidegate.lineage.graph import LineageGraph, LineageStore
from tidegate.operators.transforms import TRANSFORMS, load_plugins, register_function
from tidegate.plans.dag import build_dag
from tidegate.plans.model import PipelineDefinition, StepType, load_pipeline, parse_pipeline
from tidegate.quality import html
from tidegate.quality.rules import parse_rules
from tidegate.sources import Config, Health, ReadContext, Registry


@dataclass(frozen=True)
class ExecutionInfo:
    """What ``execute`` and ``execution`` answer."""

    execution_id: str
    pipeline_id: str
    state: str
    started_at: str | None
    finished_at: str | None
    error: str | None
    steps: list[dict[str, Any]] = field(default_factory=list)


@dataclass(frozen=True)
class LineageInfo:
    dataset: str
    field: str
    direction: str
    nodes: list[dict[str, str]]


@dataclass(frozen=True)
class Validation:
    valid: bool
    errors: list[str]
    levels: list[list[str]]
    health: list[Health]


class Engine:
    """Pipelines, their executions, lineage and health. ``storage`` keeps run tables, lineage, checkpoints and reports."""

    def __init__(self, spark: SparkSession, registry: Registry | None = None, config: EngineConfig | None = None, storage: str | None = None, checkpoints: CheckpointManager | None = None, lineage=None):
        self.spark, self.storage = spark, storage.rstrip("/") if storage else None
        self.config = config or EngineConfig(storage=f"{self.storage}/outputs" if self.storage else None)
        self.metrics = Metrics()
        #: Where graphs are kept: a store with ``save`` and ``load``, by default Parquet under ``storage``.
        self.lineage_store = lineage or (LineageStore(spark, f"{self.storage}/lineage") if self.storage else None)
        kept = checkpoints or (FileCheckpoints(spark, f"{self.storage}/checkpoints") if self.storage else MemoryCheckpoints())
        schemas = StoredSchemas(spark, f"{self.storage}/schemas") if self.storage else None
        self.executor = PipelineExecutor(spark, registry, self.config, kept, self.metrics, schemas)
        load_plugins(list(self.config.plugins))
        self.pipelines: dict[str, PipelineDefinition] = {}
        self._runs: dict[str, Execution] = {}
        self._slots = threading.BoundedSemaphore(self.config.max_concurrent_pipelines)

    # Pipelines

    def register(self, pipeline: PipelineDefinition | str) -> PipelineDefinition:
        """Add a definition, a YAML text or the path of a YAML file."""
        if isinstance(pipeline, str):
            pipeline = parse_pipeline(pipeline) if "\n" in pipeline else load_pipeline(pipeline)
        self.pipelines[pipeline.id] = pipeline
        return pipeline

    def _pipeline(self, pipeline_id: str) -> PipelineDefinition:
        if pipeline_id not in self.pipelines:
            raise KeyError(f"no pipeline '{pipeline_id}'")
        return self.pipelines[pipeline_id]

    def validate(self, pipeline: PipelineDefinition | str) -> Validation:
        """Document, graph, transforms, quality rules and the health of every connector; runs nothing."""
        errors, levels, health = [], [], []
        try:
            if isinstance(pipeline, str):
                pipeline = parse_pipeline(pipeline) if "\n" in pipeline else load_pipeline(pipeline)
            levels = build_dag(pipeline).levels()
            for s in pipeline.steps:
                if s.type is StepType.TRANSFORM and s.transform.lower() not in TRANSFORMS:
                    errors.append(f"step {s.id}: unknown transform '{s.transform}'")
                if s.quality:
                    parse_rules(s.quality.rules)
                if s.connector:
                    found = self.executor.registry.get(s.connector)
                    if found is None:
                        errors.append(f"step {s.id}: no connector '{s.connector}'")
                    else:
                        health.append(found.health(ReadContext(self.spark), Config(s.config)))
        except (TidegateError, ValueError, OSError) as e:
            errors.append(str(e))
        errors += [f"connector {h.connector}: {h.reason}" for h in health if not h.ok]
        return Validation(not errors, errors, levels, health)

    def health(self) -> dict[str, str]:
        """Each connector's state: ``UP`` or ``DOWN`` and why, as the steps of the registered pipelines find it, or ``UNUSED``."""
        found: dict[str, str] = dict.fromkeys(sorted(self.executor.registry.all()), "UNUSED")
        for pipeline in self.pipelines.values():
            for s in pipeline.steps:
                connector = self.executor.registry.get(s.connector) if s.connector else None
                if connector is None or found[connector.type.lower()].startswith("DOWN"):
                    continue
                h = connector.health(ReadContext(self.spark), Config(s.config))
                found[connector.type.lower()] = "UP" if h.ok else f"DOWN: {s.id}: {h.reason}"
        return found

    def register_function(self, name: str, f, returns: str | None = None) -> None:
        """Add a function that expressions and queries of steps can call: a UDF, an aggregate or a table function."""
        register_function(self.spark, name, f, returns)

    # Executions

    def execute(self, pipeline_id: str, params: dict | None = None) -> ExecutionInfo:
        return self._run(self._pipeline(pipeline_id), params or {}, str(uuid.uuid4()), None)

    def resume(self, pipeline_id: str, execution_id: str, params: dict | None = None, restart: bool = False) -> ExecutionInfo:
        """Go on with an execution: finished steps are skipped. ``restart`` forgets them first."""
        before = self._runs.get(execution_id)
        if restart:
            self.executor.checkpoints.delete_all(execution_id)
        if before is not None and before.succeeded:
            raise TidegateError(f"execution {execution_id} is completed")
        return self._run(self._pipeline(pipeline_id), params if params is not None else (before.params if before else {}), execution_id, before)

    def _run(self, pipeline: PipelineDefinition, params: dict, execution_id: str, before: Execution | None) -> ExecutionInfo:
        with self._slots:
            run = self.executor.execute(pipeline, params, execution_id, before)
        self._runs[run.id] = run
        info = self._info(run)
        if self.storage:
            self._keep(run, info)
        if self.lineage_store is not None and run.lineage.graph.nodes:
            self.lineage_store.save(run.id, run.lineage.graph)
        return info

    def _info(self, run: Execution) -> ExecutionInfo:
        steps = [
            {"step_id": s.step_id, "state": s.state.value, "rows_read": s.rows_read, "rows_written": s.rows_written, "rows_rejected": s.rows_rejected, "duration_ms": s.duration_ms, "error": s.error, "attempts": s.attempts, "started_at": s.started_at, "finished_at": s.finished_at}
            for s in (run.steps[p.id] for p in run.pipeline.steps if p.id in run.steps)
        ]
        return ExecutionInfo(run.id, run.pipeline.id, run.machine.state.value, run.started_at, run.finished_at, run.error, steps)

    def execution(self, execution_id: str) -> ExecutionInfo | None:
        """An execution of this process, or one that the storage knows."""
        run = self._runs.get(execution_id)
        return self._info(run) if run else self._stored(execution_id)

    def executions(self, pipeline_id: str) -> list[ExecutionInfo]:
        """All executions of a pipeline, the earliest first."""
        found = {r.id: self._info(r) for r in self._runs.values() if r.pipeline.id == pipeline_id}
        if self.storage and fs.children(self.spark, f"{self.storage}/runs"):
            # One row per execution of one pipeline: what the caller asked to have listed.
            ids = [r["id"] for r in self.run_table("runs").filter(F.col("pipeline_id") == pipeline_id).select("id").collect()]
            found |= {i: info for i in ids if i not in found and (info := self._stored(i))}
        return sorted(found.values(), key=lambda i: (i.started_at or "", i.execution_id))

    def _stored(self, execution_id: str) -> ExecutionInfo | None:
        if not self.storage or not fs.exists(self.spark, f"{self.storage}/runs/{execution_id}.json"):
            return None
        rows = lambda name: [json.loads(x) for x in fs.read_text(self.spark, f"{self.storage}/{name}/{execution_id}.json").splitlines() if x]
        r = rows("runs")[0]
        steps = [{k: v for k, v in s.items() if k != "execution_id"} for s in rows("step_runs")]
        return ExecutionInfo(r["id"], r["pipeline_id"], r["state"], r["started_at"], r["finished_at"], r["error_message"], steps)

    def frame(self, execution_id: str, dataset: str) -> DataFrame:
        """A dataset of an execution as a lazy frame."""
        return self._runs[execution_id].frames[dataset]

    # Lineage

    def _graph(self, execution_id: str) -> LineageGraph:
        if execution_id in self._runs:
            return self._runs[execution_id].lineage.graph
        if self.lineage_store is not None:
            return self.lineage_store.load(execution_id)
        raise KeyError(f"no execution '{execution_id}'")

    def impact(self, execution_id: str, dataset: str, name: str) -> LineageInfo:
        """What depends on a field."""
        return self._lineage(execution_id, dataset, name, "downstream")

    def origin(self, execution_id: str, dataset: str, name: str) -> LineageInfo:
        """What a field depends on."""
        return self._lineage(execution_id, dataset, name, "upstream")

    def _lineage(self, execution_id: str, dataset: str, name: str, direction: str) -> LineageInfo:
        if not execution_id:
            raise ValueError("an execution id is needed")
        nodes = getattr(self._graph(execution_id), direction)(dataset, name)
        return LineageInfo(dataset, name, direction, [{"dataset": n.dataset, "field": n.field, "type": n.type, "step": n.step} for n in nodes])

    def lineage(self, execution_id: str) -> dict[str, Any]:
        graph = self._graph(execution_id)
        return {
            "execution_id": execution_id, "node_count": len(graph.nodes), "edge_count": len(graph.edges),
            "nodes": [{"dataset": n.dataset, "field": n.field, "type": n.type, "step": n.step} for n in graph.nodes.values()],
            "edges": [{"source": ".".join(e.source), "target": ".".join(e.target), "kind": e.kind, "step": e.step} for e in graph.edges],
        }

    # Run tables

    def _keep(self, run: Execution, info: ExecutionInfo) -> None:
        """One small JSON file per execution and table: runs, step_runs, quality_results; reports as HTML."""
        put = lambda table, rows: fs.write_text(self.spark, f"{self.storage}/{table}/{run.id}.json", "\n".join(map(json.dumps, rows)))
        put("runs", [{"id": info.execution_id, "pipeline_id": info.pipeline_id, "pipeline_version": run.pipeline.version, "state": info.state, "started_at": info.started_at, "finished_at": info.finished_at, "error_message": info.error, "parameters": json.dumps(run.params, default=str)}])
        put("step_runs", [{"execution_id": run.id, **s} for s in info.steps])
        reports = [s.quality for s in run.steps.values() if s.quality]
        put("quality_results", [{"execution_id": run.id, "dataset": q.dataset, "field": r.field, "rule": r.rule, "passed": r.passed, "failed": r.failed, "failure_rate": round(r.failure_rate, 4), "threshold": r.threshold} for q in reports for r in q.results])
        for q in reports:
            fs.write_text(self.spark, f"{self.storage}/reports/{run.id}/{html.file_name(q)}", html.render(q))

    def run_table(self, name: str) -> DataFrame:
        """``runs``, ``step_runs`` or ``quality_results`` of all executions."""
        return self.spark.read.json(f"{self.storage}/{name}")
