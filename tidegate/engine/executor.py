"""Runs a pipeline: levels of independent steps, lazily up to sinks, gates and checkpoints."""

from __future__ import annotations

import json
import logging
import threading
import time
import traceback
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidegate.engine.checkpoints import CheckpointManager, MemoryCheckpoints, StepCheckpoint
from tidegate.engine.config import EngineConfig, now, resolve
from tidegate.engine.metrics import Metrics
from tidegate.engine.schemas import Schemas
from tidegate.errors import DefinitionError, QualityGateError, StepTimeoutError, TidegateError
from tidegate.lineage.graph import LineageRecorder
from tidegate.operators import transforms
from tidegate.plans.dag import Dag, build_dag
from tidegate.plans.model import PipelineDefinition, QualityConfig, StepDefinition, StepType
from tidegate.plans.schema import check_drift, fields_of
from tidegate.plans.states import PipelineState, StateMachine, StepState
from tidegate.quality.rules import QualityReport, evaluate, parse_rules
from tidegate.session import shared_dir
from tidegate.sources import Config, ReadContext, Registry, WriteResult, default_registry

log = logging.getLogger("tidegate")


@dataclass
class StepResult:
    step_id: str
    state: StepState
    rows_read: int = 0
    rows_written: int = 0
    rows_rejected: int = 0
    duration_ms: float = 0.0
    error: str | None = None
    attempts: int = 0
    write: WriteResult | None = None
    quality: QualityReport | None = None
    started_at: str | None = None
    finished_at: str | None = None


@dataclass
class Execution:
    """One run of a pipeline and all that is known of it."""

    id: str
    pipeline: PipelineDefinition
    params: dict[str, Any]
    machine: StateMachine
    frames: dict[str, DataFrame] = field(default_factory=dict)
    steps: dict[str, StepResult] = field(default_factory=dict)
    machines: dict[str, StateMachine] = field(default_factory=dict)
    lineage: LineageRecorder = field(default_factory=LineageRecorder)
    drift: dict[str, list[str]] = field(default_factory=dict)
    error: str | None = None
    started_at: str | None = None
    finished_at: str | None = None
    kept: list[DataFrame] = field(default_factory=list)
    lock: threading.Lock = field(default_factory=threading.Lock)

    @property
    def succeeded(self) -> bool:
        return self.machine.state is PipelineState.COMPLETED


class PipelineExecutor:
    """Holds what all executions share: connectors, checkpoints, metrics and settings."""

    def __init__(
        self, spark: SparkSession, registry: Registry | None = None, config: EngineConfig | None = None, checkpoints: CheckpointManager | None = None,
        metrics: Metrics | None = None, schemas: Schemas | None = None,
    ):
        self.spark, self.registry = spark, registry or default_registry()
        self.config, self.checkpoints = config or EngineConfig(), checkpoints if checkpoints is not None else MemoryCheckpoints()
        self.metrics = metrics or Metrics()
        #: The last schema of each source, against which drift is reported.
        self.schemas = schemas if schemas is not None else Schemas()

    # Executions

    def execute(self, pipeline: PipelineDefinition, params: dict | None = None, execution_id: str | None = None, before: Execution | None = None) -> Execution:
        """Run a pipeline to its end. ``before`` is a failed execution to go on with; errors end up in the result."""
        history = before.machine.history if before else None
        run = Execution(execution_id or str(uuid.uuid4()), pipeline, dict(params or {}), StateMachine(pipeline.id, PipelineState.CREATED, history))
        run.started_at = before.started_at if before else now().isoformat()
        began = time.perf_counter()
        self.metrics.pipeline_started(pipeline.id)
        try:
            resuming = before is not None or bool(execution_id and self.checkpoints.find_all(execution_id))
            dag = build_dag(pipeline)
            levels = dag.levels()
            if resuming:
                run.machine.go(PipelineState.RESUMING)
                self.metrics.resumed(pipeline.id)
            else:
                run.machine.go(PipelineState.VALIDATED)
            run.machine.go(PipelineState.RUNNING)
            for s in pipeline.steps:
                run.machines[s.id] = StateMachine(s.id, StepState.PENDING)
            for level in levels:
                self._level(run, dag, level)
                failed = [s for s in level if not run.steps[s].state.succeeded]
                if failed:
                    raise TidegateError("; ".join(f"step {s}: {run.steps[s].error}" for s in failed))
            run.machine.go(PipelineState.COMPLETED)
        except Exception as e:
            run.error = str(e)
            run.machine.go(PipelineState.FAILED)
            log.error("pipeline %s, execution %s failed: %s", pipeline.id, run.id, e)
        finally:
            for df in run.kept:
                df.unpersist()
            run.finished_at = now().isoformat()
            self.metrics.pipeline_finished(pipeline.id, run.machine.state.value, time.perf_counter() - began)
        return run

    def _level(self, run: Execution, dag: Dag, level: list[str]) -> None:
        if len(level) == 1:
            run.steps[level[0]] = self._step(run, dag, level[0])
            return
        # Threads that carry the session's local properties, so that job tags and pools stay with their step.
        from pyspark import inheritable_thread_target

        with ThreadPoolExecutor(min(len(level), self.config.max_concurrent_steps)) as pool:
            found = {s: pool.submit(inheritable_thread_target(self.spark)(self._step), run, dag, s) for s in level}
            for s, f in found.items():
                run.steps[s] = f.result()

    # Steps

    def _step(self, run: Execution, dag: Dag, step_id: str) -> StepResult:
        step, machine = run.pipeline.step(step_id), run.machines[step_id]
        said = logging.LoggerAdapter(log, {"execution": run.id, "pipeline": run.pipeline.id, "step": step_id})
        began, result = time.perf_counter(), StepResult(step_id, StepState.PENDING, started_at=now().isoformat())
        tag = f"tidegate-{run.id}-{step_id}-{uuid.uuid4().hex[:8]}"
        sc = self.spark.sparkContext
        expired = threading.Event()

        def expire() -> None:
            expired.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.config.step_timeout_seconds, expire)
        timer.daemon = True
        try:
            sc.addJobTag(tag)
            sc.setJobDescription(f"{run.pipeline.id} / {step_id} ({run.id})")
            timer.start()
            saved = self.checkpoints.find(run.id, step_id)
            if saved is not None and self._recover(run, dag, step, saved):
                machine.go(StepState.SKIPPED)
            else:
                machine.go(StepState.RUNNING)
                self._attempts(run, dag, step, result, expired)
                machine.go(StepState.COMPLETED)
        except Exception as e:
            if machine.state is StepState.PENDING:
                machine.go(StepState.RUNNING)
            machine.go(StepState.FAILED)
            result.error = str(e) or type(e).__name__
            said.debug("%s", traceback.format_exc())
        finally:
            timer.cancel()
            sc.removeJobTag(tag)
            sc.setLocalProperty("spark.job.description", None)
        result.state, result.duration_ms, result.finished_at = machine.state, (time.perf_counter() - began) * 1000, now().isoformat()
        self.metrics.step_finished(run.pipeline.id, step_id, result.state.value, result.duration_ms / 1000)
        self.metrics.rows(run.pipeline.id, step_id, result.rows_read, result.rows_written, result.rows_rejected)
        said.info("%s in %.0f ms", result.state.value, result.duration_ms)
        return result

    def _attempts(self, run: Execution, dag: Dag, step: StepDefinition, result: StepResult, expired: threading.Event) -> None:
        """Up to ``max_retries`` repetitions with growing pauses. Errors of definition, analysis and gates are final."""
        pause = self.config.retry_initial_seconds
        for attempt in range(self.config.max_retries + 1):
            result.attempts = attempt + 1
            try:
                return self._once(run, dag, step, result)
            except (AnalysisException, ParseException, DefinitionError, QualityGateError, ValueError):
                raise
            except Exception:
                if expired.is_set():
                    raise StepTimeoutError(f"step {step.id} ran longer than {self.config.step_timeout_seconds:g} s") from None
                if step.connector:
                    self.metrics.connector_error(step.connector)
                if attempt == self.config.max_retries:
                    raise
                if expired.wait(pause):
                    raise StepTimeoutError(f"step {step.id} ran longer than {self.config.step_timeout_seconds:g} s") from None
                pause = min(pause * 2, self.config.retry_max_seconds)

    def _context(self, run: Execution) -> ReadContext:
        return ReadContext(self.spark, run.id, run.params)

    def _settings(self, run: Execution, step: StepDefinition) -> Config:
        settings = Config(resolve(step.config, run.params))
        if step.input is not None:
            settings.setdefault("input", step.input)
        return settings

    def _define(self, run: Execution, step: StepDefinition) -> DataFrame:
        """The lazy frame of a source or transform, with its lineage."""
        settings = self._settings(run, step)
        if step.type is StepType.SOURCE:
            df = self.registry.need(step.connector).read(self._context(run), settings)
            run.lineage.source(step.dataset, fields_of(df.schema), step.id)
            if found := check_drift(self.schemas.get(step.dataset) or fields_of(df.schema), df, self.config.drift_mode):
                run.drift[step.dataset] = found
            self.schemas.put(step.dataset, fields_of(df.schema))
            return df
        direct = [run.pipeline.step(d).dataset for d in step.depends_on]
        inputs = transforms.Inputs(self.spark, dict(run.frames), [d for d in direct if d in run.frames], run.params)
        out = transforms.apply(step.transform, inputs, settings)
        fields = fields_of(out.df.schema)
        theirs = {n: fields_of(run.frames[n].schema) for n in out.inputs if n in run.frames}
        if out.sources is not None:
            run.lineage.traced(out.kind, step.dataset, fields, out.sources, step.id)
        elif out.origins is not None and len(out.inputs) == 1:
            run.lineage.mapped(out.kind, out.inputs[0], step.dataset, fields, out.origins, step.id)
        else:
            run.lineage.same_names(out.kind, theirs, step.dataset, fields, step.id)
        return out.df

    def _once(self, run: Execution, dag: Dag, step: StepDefinition, result: StepResult) -> None:
        if step.type is StepType.SINK:
            return self._sink(run, dag, step, result)
        df = self._define(run, step)
        location, rows = None, None
        if self._stores(dag, step):
            df, location, rows = self._store(run, step, df)
            result.rows_written = rows
        elif step.quality and step.quality.rules and len(dag.feeds[step.id]) > 0:
            df = df.persist()
            with run.lock:
                run.kept.append(df)
        self._quality(run, step, df, result)
        run.frames[step.dataset] = df
        self._save(run, step, location, rows, df)

    def _sink(self, run: Execution, dag: Dag, step: StepDefinition, result: StepResult) -> None:
        settings = self._settings(run, step)
        direct = [run.pipeline.step(d).dataset for d in step.depends_on]
        name, df = transforms.Inputs(self.spark, run.frames, [d for d in direct if d in run.frames]).one(settings)
        checked = bool(step.quality and step.quality.rules)
        if checked:  # the rules and the write see one computation
            df = df.persist()
        try:
            self._quality(run, step, df, result)
            written = self.registry.need(step.connector).write(self._context(run), df, settings)
        finally:
            if checked:
                df.unpersist()
        result.write, result.rows_read, result.rows_written = written, written.written + written.rejected, written.written
        result.rows_rejected = written.rejected + (result.quality.rows_rejected if result.quality else 0)
        target = settings.text("table") or settings.text("topic") or settings.text("path") or "unknown"
        run.lineage.same_names("SINK", {name: fields_of(df.schema)}, target, fields_of(df.schema), step.id)
        self._save(run, step, None, written.written, df)

    # Quality, checkpoints

    def _quality(self, run: Execution, step: StepDefinition, df: DataFrame, result: StepResult) -> None:
        q: QualityConfig | None = step.quality
        if q is None or not q.rules:
            return
        report = evaluate(df, parse_rules(q.rules), step.dataset if step.type is not StepType.SINK else (step.input or step.id), q.threshold, reference=lambda n: run.frames[n])
        result.quality, result.rows_rejected = report, report.rows_rejected
        for r in report.results:
            self.metrics.quality(report.dataset, r.field, r.rule, r.failure_rate)
        if not report.passed and (q.mode == "fail" or self.config.fail_on_quality):
            raise QualityGateError(report)

    def _stores(self, dag: Dag, step: StepDefinition) -> bool:
        if step.checkpoint is not None:
            return step.checkpoint
        policy = self.config.checkpoint
        return policy == "all" or (policy == "shared" and step.type is StepType.TRANSFORM and len(dag.feeds[step.id]) > 1)

    def _store(self, run: Execution, step: StepDefinition, df: DataFrame) -> tuple[DataFrame, str, int]:
        """Write an output once, so that its readers and a resumed execution need not compute it again."""
        from tidegate.sources.base import counted

        root = (self.config.storage or f"{shared_dir(self.spark)}/tidegate-outputs").rstrip("/")
        at = f"{root}/{run.id}/{step.id}"
        rows = counted(df, lambda d: d.write.mode("overwrite").parquet(at))
        return self.spark.read.schema(df.schema).parquet(at), at, rows

    def _save(self, run: Execution, step: StepDefinition, location: str | None, rows: int | None, df: DataFrame) -> None:
        self.checkpoints.save(StepCheckpoint(run.id, step.id, now().isoformat(), step.dataset, location, rows, df.schema.json()))
        self.metrics.checkpoint_saved(run.pipeline.id)

    def _recover(self, run: Execution, dag: Dag, step: StepDefinition, saved: StepCheckpoint) -> bool:
        """Bring back the output of a finished step: stored rows, or the definition again (which costs nothing)."""
        if step.type is StepType.SINK:
            return True
        if saved.location:
            from tidegate import fs

            if not fs.exists(self.spark, f"{saved.location}/_SUCCESS"):
                return False
            df = self.spark.read.parquet(saved.location)
            if saved.schema_json and T.StructType.fromJson(json.loads(saved.schema_json)).simpleString() != df.schema.simpleString():
                return False  # not what was stored
            if saved.rows is not None and df.count() != saved.rows:
                return False
            self._define(run, step)  # for the lineage
            run.frames[step.dataset] = df
        else:
            run.frames[step.dataset] = self._define(run, step)
        return True
