import json
import time

import pytest
from pyspark.sql import functions as F

from tidegate.engine import Engine, EngineConfig
from tidegate.engine.checkpoints import FileCheckpoints, MemoryCheckpoints, NoCheckpoints, StepCheckpoint
from tidegate.engine.config import resolve
from tidegate.engine.jdbc_stores import JdbcCheckpoints, JdbcLineageStore
from tidegate.errors import DefinitionError, TidegateError
from tidegate.operators import transforms
from tidegate.sources import BaseConnector, default_registry

FAST = EngineConfig(max_retries=2, retry_initial_seconds=0.01)
CSV = """
pipeline:
  id: copy
  steps:
    - {{id: read, type: SOURCE, connector: csv, config: {{path: "{d}/in.csv"}}, output: raw}}
    - {{id: keep, type: TRANSFORM, depends_on: [read], transform: filter, config: {{condition: "CAST(total AS DOUBLE) > ${{least}}"}}, output: kept}}
    - {{id: write, type: SINK, depends_on: [keep], connector: csv, config: {{path: "{d}/out"}}}}
    - {{id: write2, type: SINK, depends_on: [keep], connector: parquet, config: {{path: "{d}/out2"}}}}
"""


def engine(spark, tmp_path, **more):
    (tmp_path / "in.csv").write_text("order_id,customer_id,total\n1,101,150.50\n2,102,200.00\n3,103,75.25\n")
    e = Engine(spark, config=more.pop("config", FAST), storage=str(tmp_path / "store"), **more)
    e.register(CSV.format(d=tmp_path))
    return e


def test_from_file_to_files(spark, tmp_path):
    e = engine(spark, tmp_path)
    info = e.execute("copy", {"least": 100})
    assert info.state == "COMPLETED" and info.error is None
    assert [(s["step_id"], s["state"], s["rows_written"]) for s in info.steps] == [("read", "COMPLETED", 0), ("keep", "COMPLETED", 2), ("write", "COMPLETED", 2), ("write2", "COMPLETED", 2)]
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 2
    assert e.execution(info.execution_id) == info and e.executions("copy") == [info] and e.execution("none") is None
    assert e.run_table("runs").first()["state"] == "COMPLETED" and e.run_table("step_runs").count() == 4
    impact = e.impact(info.execution_id, "raw", "total")
    assert impact.nodes[0]["dataset"] == "kept" and sorted((n["dataset"], n["field"]) for n in impact.nodes) == sorted([("kept", "total"), (f"{tmp_path}/out", "total"), (f"{tmp_path}/out2", "total")])
    again = Engine(spark, storage=str(tmp_path / "store"))
    assert len(again.impact(info.execution_id, "raw", "total").nodes) == 3 and again.lineage(info.execution_id)["node_count"] == 12
    assert [n["dataset"] for n in again.origin(info.execution_id, f"{tmp_path}/out", "total").nodes] == ["kept", "raw"]
    assert 'tidegate_pipeline_finished_total{pipeline="copy",state="COMPLETED"} 1' in e.metrics.text()
    with pytest.raises(KeyError):
        e.execute("nothing")


def test_missing_file_fails_without_retries(spark, tmp_path):
    e = engine(spark, tmp_path)
    (tmp_path / "in.csv").unlink()
    info = e.execute("copy", {"least": 1})
    assert info.state == "FAILED" and "read" in info.error and info.steps[0]["attempts"] == 1 and len(info.steps) == 1


class Flaky(BaseConnector):
    type = "flaky"

    def __init__(self, failures):
        self.failures, self.calls = failures, 0

    def write(self, ctx, df, config):
        from tidegate.sources import WriteResult

        self.calls += 1
        if self.calls <= self.failures:
            raise OSError("not now")
        return WriteResult(df.count(), 0, "nowhere")


def flaky_engine(spark, tmp_path, failures, config=FAST):
    registry, sink = default_registry(), Flaky(failures)
    registry.register(sink)
    e = engine(spark, tmp_path, registry=registry, config=config)
    e.register(CSV.format(d=tmp_path).replace("connector: parquet", "connector: flaky"))
    return e, sink


def test_retries_until_it_works(spark, tmp_path):
    e, sink = flaky_engine(spark, tmp_path, 2)
    info = e.execute("copy", {"least": 100})
    assert info.state == "COMPLETED" and sink.calls == 3 and info.steps[3]["attempts"] == 3


@pytest.mark.parametrize("kind", ["memory", "file"])
def test_resume_skips_what_is_done(spark, tmp_path, kind):
    e, sink = flaky_engine(spark, tmp_path, 3)
    if kind == "memory":
        e.executor.checkpoints = MemoryCheckpoints()
    info = e.execute("copy", {"least": 100})
    assert info.state == "FAILED" and "not now" in info.error
    assert {s["step_id"]: s["state"] for s in info.steps}["write"] == "COMPLETED"  # siblings finish
    (tmp_path / "in.csv").write_text("order_id,customer_id,total\n9,9,999\n")  # the stored output counts
    after = e.resume("copy", info.execution_id)
    assert after.state == "COMPLETED" and [s["state"] for s in after.steps] == ["SKIPPED", "SKIPPED", "SKIPPED", "COMPLETED"]
    assert after.steps[3]["rows_written"] == 2 and after.started_at == info.started_at
    states = [t.after.value for t in e._runs[info.execution_id].machine.history]
    assert states == ["CREATED", "VALIDATED", "RUNNING", "FAILED", "RESUMING", "RUNNING", "COMPLETED"]
    with pytest.raises(TidegateError, match="completed"):
        e.resume("copy", info.execution_id)


def test_preloaded_checkpoint(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.executor.checkpoints.save(StepCheckpoint("x1", "read", "2025-01-01"))
    info = e.resume("copy", "x1", {"least": 0})
    assert [s["state"] for s in info.steps] == ["SKIPPED", "COMPLETED", "COMPLETED", "COMPLETED"]
    forgot = e.resume("copy", "x2", {"least": 0}, restart=True)
    assert forgot.steps[0]["state"] == "COMPLETED"


def test_steps_of_a_level_run_together_and_time_out(spark, tmp_path):
    def slow(inputs, config):
        time.sleep(1.5)
        return inputs.one(config)[1]

    transforms.register("slow", slow)
    steps = "".join(f"\n    - {{id: s{i}, type: TRANSFORM, depends_on: [read], transform: slow, output: o{i}}}" for i in range(4))
    e = engine(spark, tmp_path)
    e.register(f'pipeline:\n  id: wide\n  steps:\n    - {{id: read, type: SOURCE, connector: csv, config: {{path: "{tmp_path}/in.csv"}}}}{steps}')
    e.execute("wide")  # code is loaded and compiled in the first run
    began = time.perf_counter()
    assert e.execute("wide").state == "COMPLETED"
    assert time.perf_counter() - began < 5

    def stuck(inputs, config):
        spark.range(50_000_000_000).select(F.sum(F.hash(F.col("id") + 1))).collect()

    transforms.register("stuck", stuck)
    e = engine(spark, tmp_path, config=EngineConfig(step_timeout_seconds=1.5, max_retries=3, retry_initial_seconds=0.01))
    e.register(f'pipeline:\n  id: stuck\n  steps:\n    - {{id: read, type: SOURCE, connector: csv, config: {{path: "{tmp_path}/in.csv"}}}}\n    - {{id: s, type: TRANSFORM, depends_on: [read], transform: stuck}}')
    info = e.execute("stuck")
    assert info.state == "FAILED" and "longer than 1.5 s" in info.error


QUALITY = """
      quality:
        threshold: 0.9
        mode: {mode}
        rules:
          - field: total
            checks: [NOT_NULL, {{type: RANGE, min: 100, max: 1000}}]
"""


@pytest.mark.parametrize("mode", ["warn", "fail"])
def test_quality_gate(spark, tmp_path, mode):
    e = engine(spark, tmp_path)
    doc = f"""
pipeline:
  id: gated
  steps:
    - id: read
      type: SOURCE
      connector: csv
      config: {{path: "{tmp_path}/in.csv"}}
      output: raw{QUALITY.format(mode=mode)}
    - {{id: write, type: SINK, depends_on: [read], connector: csv, config: {{path: "{tmp_path}/gated"}}}}
"""
    e.register(doc)
    info = e.execute("gated")
    assert info.state == ("COMPLETED" if mode == "warn" else "FAILED") and (tmp_path / "gated").exists() == (mode == "warn")
    if mode == "warn":
        assert info.steps[0]["rows_rejected"] == 1
        found = {r["rule"]: r["failed"] for r in e.run_table("quality_results").collect()}
        assert found == {"NOT_NULL": 0, "RANGE": 1}
        assert list((tmp_path / "store" / "reports" / info.execution_id).glob("quality-raw-*.html"))
    else:
        assert "total/RANGE" in info.error and info.steps[0]["attempts"] == 1


def test_bad_graph_ends_in_failed(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.register("pipeline:\n  id: loop\n  steps:\n    - {id: a, type: TRANSFORM, transform: filter, depends_on: [b]}\n    - {id: b, type: TRANSFORM, transform: filter, depends_on: [a]}")
    info = e.execute("loop")
    assert info.state == "FAILED" and "cycle" in info.error


def test_validation(spark, tmp_path):
    e = engine(spark, tmp_path)
    good = e.validate(CSV.format(d=tmp_path))
    assert good.valid and [len(x) for x in good.levels] == [1, 1, 2] and all(h.ok for h in good.health)
    bad = e.validate(CSV.format(d=tmp_path).replace("transform: filter", "transform: melt").replace("connector: parquet", "connector: pigeon"))
    assert not bad.valid and "melt" in bad.errors[0] and "pigeon" in bad.errors[1]
    assert not e.validate("pipeline:\n  id: x\n  colour: red").valid and e.health()["csv"] == "UP" and e.health()["jdbc"] == "UNUSED"


def test_drift_between_executions(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.execute("copy", {"least": 0})
    (tmp_path / "in.csv").write_text("order_id,total,discount\n1,2,3\n")
    second = e.execute("copy", {"least": 0})
    assert e._runs[second.execution_id].drift == {"raw": ["new field: discount (STRING)", "removed field: customer_id"]}
    strict = engine(spark, tmp_path, config=EngineConfig(drift_mode="STRICT", max_retries=0))
    strict.executor.schemas.put("raw", [("order_id", "LONG")])
    assert "type changed" in strict.execute("copy", {"least": 0}).error


def test_parameters():
    assert resolve({"a": ["${x}-${execution.date}", 5]}, {"x": 1, "date": "2025-01-01"}) == {"a": ["1-2025-01-01", 5]}
    with pytest.raises(DefinitionError, match="nothing"):
        resolve("${nothing}", {})


DERBY = {"url": "jdbc:derby:memory:stores;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.mark.parametrize("kind", ["memory", "file", "none", "jdbc"])
def test_checkpoint_managers(spark, tmp_path, kind):
    m = {"memory": MemoryCheckpoints, "file": lambda: FileCheckpoints(spark, str(tmp_path)), "none": NoCheckpoints, "jdbc": lambda: JdbcCheckpoints(spark, DERBY)}[kind]()
    for i in range(1, 7):
        m.save(StepCheckpoint("e", f"s{i}", f"2025-01-0{7 - i}"))
    m.save(StepCheckpoint("e", "s1", "2025-02-01", rows=5))
    m.save(StepCheckpoint("other", "s1", "2025-01-01"))
    if kind == "none":
        assert not m.exists("e", "s1") and m.find_all("e") == [] and m.find("e", "s1") is None
        return m.delete_all("e")
    assert [c.step_id for c in m.find_all("e")] == ["s6", "s5", "s4", "s3", "s2", "s1"] and m.find("e", "s1").rows == 5
    assert m.exists("e", "s6") and not m.exists("e", "s7") and m.find("none", "s1") is None
    m.delete_all("e")
    assert m.find_all("e") == [] and len(m.find_all("other")) == 1


def test_runs_kept_in_a_database(spark, tmp_path):
    e, _ = flaky_engine(spark, tmp_path, 3)
    e.executor.checkpoints, e.lineage_store = JdbcCheckpoints(spark, DERBY, "steps_done"), JdbcLineageStore(spark, DERBY)
    info = e.execute("copy", {"least": 100})
    assert info.state == "FAILED"
    other = engine(spark, tmp_path, registry=e.executor.registry, checkpoints=JdbcCheckpoints(spark, DERBY, "steps_done"), lineage=JdbcLineageStore(spark, DERBY))
    other.pipelines = e.pipelines
    before = other.lineage(info.execution_id)
    assert before == e.lineage(info.execution_id) and before["edge_count"] > 3
    after = other.resume("copy", info.execution_id, {"least": 100})
    assert [s["state"] for s in after.steps] == ["SKIPPED", "SKIPPED", "SKIPPED", "COMPLETED"]
    again = JdbcLineageStore(spark, DERBY).load(info.execution_id)
    assert len(again.nodes) == other.lineage(info.execution_id)["node_count"]


def test_metrics_text():
    from tidegate.engine.metrics import Metrics

    m = Metrics()
    m.step_finished("p", 'a"b', "COMPLETED", 0.7)
    m.quality("d", "f", "RANGE", 0.25)
    text = m.text()
    assert 'le="0.5"} 0' in text and 'le="1"} 1' in text and 'step="a\\"b"' in text and 'rule="RANGE"} 0.25' in text
    json.dumps(text)


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    import pytest

    from tidegate.errors import TidegateError
    from tidegate.session import shared_dir

    context = SimpleNamespace(getConf=dict, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(TidegateError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_another_engine_knows_stored_runs_and_schemas(spark, tmp_path):
    first = engine(spark, tmp_path)
    info = first.execute("copy", {"least": 100})
    second = engine(spark, tmp_path)
    assert second.execution(info.execution_id) == info and second.executions("copy") == [info] and second.executions("other") == []
    (tmp_path / "in.csv").write_text("order_id,total\n1,200\n")
    third = second.execute("copy", {"least": 0})
    assert second._runs[third.execution_id].drift == {"raw": ["removed field: customer_id"]}
    assert [i.execution_id for i in second.executions("copy")] == [info.execution_id, third.execution_id]


def test_health_says_which_step_cannot_work(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.register("pipeline:\n  id: db\n  steps:\n    - {id: take, type: SOURCE, connector: jdbc, config: {url: 'jdbc:nothing:x', table: T}, output: t}")
    found = e.health()
    assert found["csv"] == found["parquet"] == "UP" and found["jdbc"].startswith("DOWN: take:") and found["kafka"] == "UNUSED"


def test_a_stored_output_that_is_not_whole_is_made_again(spark, tmp_path):
    config = EngineConfig(checkpoint="all", max_retries=0, storage=str(tmp_path / "outputs"))
    e, _ = flaky_engine(spark, tmp_path, 1, config)
    info = e.execute("copy", {"least": 100})
    at = f"{tmp_path}/outputs/{info.execution_id}/keep"
    spark.range(1).selectExpr("'9' AS order_id", "'9' AS customer_id", "'900' AS total").write.mode("overwrite").parquet(at)
    after = e.resume("copy", info.execution_id)
    assert {s["step_id"]: s["state"] for s in after.steps} == {"read": "SKIPPED", "keep": "COMPLETED", "write": "SKIPPED", "write2": "COMPLETED"}


def test_queries_of_executions_that_run_together_see_their_own_datasets(spark):
    from concurrent.futures import ThreadPoolExecutor

    spark.range(1).createOrReplaceTempView("numbers")

    def run(i):
        frames = {"numbers": spark.range(i, i + 3)}
        return [r["x"] for r in transforms.apply("sql", transforms.Inputs(spark, frames, ["numbers"]), transforms.Config({"query": "SELECT id + 1 AS x FROM numbers ORDER BY x"})).df.collect()]

    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(run, range(20))) == [[i + 1, i + 2, i + 3] for i in range(20)]
    assert spark.table("numbers").count() == 1
    spark.catalog.dropTempView("numbers")


def test_origins_of_queries(spark):
    from tidegate.operators.origins import origins_of

    a = spark.createDataFrame([(1, 2, "x")], "id int, n int, s string")
    b = spark.createDataFrame([(1, 5)], "id int, m int")
    run = lambda q: transforms.apply("sql", transforms.Inputs(spark, {"a": a, "b": b}, ["a", "b"]), transforms.Config({"query": q}))
    got = run("WITH t AS (SELECT id, n * 2 AS twice FROM a) SELECT t.twice + m AS both, upper(s) AS `Two words`, 1 AS one FROM t JOIN b USING (id) JOIN a ON a.id = t.id").sources
    assert got == {"both": [("a", "n"), ("b", "m")], "Two words": [("a", "s")], "one": []}
    assert run("SELECT n AS x FROM a UNION ALL SELECT m FROM b").sources == {"x": [("a", "n"), ("b", "m")]}
    assert run("SELECT s, sum(n) AS total FROM a GROUP BY s").sources == {"s": [("a", "s")], "total": [("a", "n")]}
    assert origins_of(a, {}) == {"id": [], "n": [], "s": []}
    assert transforms._names(a, "`n` + length(s) + CASE WHEN 'id' = s THEN 1 END") == ["n", "s"]


def test_functions_and_plugins(spark, tmp_path, monkeypatch):
    (tmp_path / "plug_in_of_mine.py").write_text("from tidegate.operators import transforms\ntransforms.register('plus_one', lambda inputs, config: inputs.one(config)[1].selectExpr('id + 1 AS id'))\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    e = Engine(spark, config=EngineConfig(plugins=("plug_in_of_mine",)))
    frames = transforms.Inputs(spark, {"r": spark.range(3)}, ["r"])
    assert [r["id"] for r in transforms.apply("plus_one", frames, transforms.Config()).df.collect()] == [1, 2, 3]
    e.register_function("times_three", lambda x: x * 3, "bigint")
    assert [r["y"] for r in transforms.apply("derive", frames, transforms.Config({"columns": {"y": "times_three(id)"}})).df.collect()] == [0, 3, 6]

    class Upto:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    e.register_function("upto", Upto, "i int")
    assert transforms.apply("sql", frames, transforms.Config({"query": "SELECT * FROM upto(4)"})).df.count() == 4
