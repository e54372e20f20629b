import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.errors import CyclicDependencyError, DefinitionError, InvalidTransitionError, SchemaDriftError, UnknownDependencyError
from tidegate.plans.dag import build_dag
from tidegate.plans.model import PipelineDefinition, StepDefinition, StepType, load_yaml, parse_pipeline
from tidegate.plans.schema import check_drift, drift, fields_of
from tidegate.plans.states import PipelineState, StateMachine, StepState

DEMO = """
pipeline:
  id: meter-readings
  name: "Readings of all meters"
  steps:
    - {id: readings-in, type: SOURCE, connector: csv, config: {path: r.csv}, output: readings}
    - {id: meters-in, type: SOURCE, connector: csv, config: {path: m.csv}, output: meters}
    - id: place
      type: TRANSFORM
      depends_on: [readings-in, meters-in]
      transform: join
      config:
        left: readings
        right: meters
        on: meter
        type: INNER
      output: placed
      quality:
        threshold: 0.8
        rules:
          - field: meter
            checks: [NOT_NULL]
          - field: kilowatts
            checks: [{type: RANGE, min: -5, max: 4200.5}]
    - {id: sieve, type: TRANSFORM, depends_on: place, transform: filter, config: {condition: "kilowatts > 0"}, output: sound}
    - {id: out-files, type: SINK, depends_on: [sieve], connector: csv, config: {path: a}, input: sound}
    - {id: out-topic, type: SINK, depends_on: [sieve], connector: kafka, config: {topic: t, partitionBy: meter}, input: sound}
"""


def pipeline(edges):
    return PipelineDefinition("p", tuple(StepDefinition(n, StepType.TRANSFORM, transform="passthrough", depends_on=tuple(d)) for n, d in edges.items()))


def test_document():
    p = parse_pipeline(DEMO)
    assert [s.type.value for s in p.steps] == ["SOURCE", "SOURCE", "TRANSFORM", "TRANSFORM", "SINK", "SINK"]
    assert p.version == "1.0.0" and p.step("place").depends_on == ("readings-in", "meters-in")
    assert p.step("place").config["on"] == "meter" and len(p.step("place").quality.rules) == 2
    assert p.step("sieve").depends_on == ("place",)


def test_words_that_look_like_booleans():
    assert load_yaml("on: 1\nyes: no\noff: true\ny: False") == {"on": 1, "yes": "no", "off": True, "y": False}


@pytest.mark.parametrize("change", [("pipeline:", "pipe:"), ("id: meter-readings", "name2: x"), ("type: SOURCE", "type: WELL"), ("transform: join", "colour: red"), ("threshold:", "limit:"), ("connector: kafka, ", "")])
def test_bad_documents(change):
    with pytest.raises(DefinitionError):
        parse_pipeline(DEMO.replace(*change, 1))


def test_levels_of_the_demo():
    dag = build_dag(parse_pipeline(DEMO))
    assert dag.roots == ["readings-in", "meters-in"]
    assert [len(x) for x in dag.levels()] == [2, 1, 1, 2]
    assert dag.order()[2:4] == ["place", "sieve"]


def test_small_graphs():
    assert build_dag(pipeline({})).levels() == []
    assert build_dag(pipeline({"a": []})).levels() == [["a"]]
    assert build_dag(pipeline({"c": ["b"], "b": ["a"], "a": []})).levels() == [["a"], ["b"], ["c"]]


@pytest.mark.parametrize("edges, cycle", [({"a": ["b"], "b": ["a"]}, {"a", "b"}), ({"a": ["c"], "b": ["a"], "c": ["b"], "d": []}, {"a", "b", "c"}), ({"a": ["a"]}, {"a"})])
def test_cycles(edges, cycle):
    with pytest.raises(CyclicDependencyError) as e:
        build_dag(pipeline(edges)).levels()
    assert set(e.value.path) == cycle and len(e.value.path) == len(cycle)
    assert str(e.value).endswith(" -> ".join([*e.value.path, e.value.path[0]]))


def test_unknown_and_repeated_steps():
    with pytest.raises(UnknownDependencyError, match="load.*nothing"):
        build_dag(pipeline({"load": ["nothing"]}))
    with pytest.raises(DefinitionError, match="two steps"):
        build_dag(PipelineDefinition("p", (StepDefinition("a", StepType.SOURCE), StepDefinition("a", StepType.SOURCE))))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 25), st.integers(0, 10_000))
def test_random_graphs(n, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(n)]
    edges = {m: rng.sample(names[:i], rng.randint(0, min(i, 3))) for i, m in enumerate(names)}
    shuffled = dict(rng.sample(list(edges.items()), n))
    levels = build_dag(pipeline(shuffled)).levels()
    at = {m: i for i, level in enumerate(levels) for m in level}
    assert sorted(at) == sorted(names) and sum(map(len, levels)) == n
    for m, before in edges.items():
        assert at[m] == (max(at[b] for b in before) + 1 if before else 0)


def test_pipeline_states():
    m, seen = StateMachine("p", PipelineState.CREATED), []
    m.listen(seen.append)
    for s in ("VALIDATED", "RUNNING", "FAILED", "RESUMING", "RUNNING", "COMPLETED"):
        m.go(PipelineState[s])
    assert len(seen) == 6 and len(m.history) == 7 and m.history[0].before is None
    with pytest.raises(InvalidTransitionError, match="none"):
        m.go(PipelineState.RUNNING)
    with pytest.raises(InvalidTransitionError, match="VALIDATED"):
        StateMachine("p", PipelineState.CREATED).go(PipelineState.COMPLETED)


def test_step_states():
    m = StateMachine("s", StepState.PENDING)
    assert m.can(StepState.SKIPPED) and not m.can(StepState.COMPLETED)
    m.go(StepState.RUNNING)
    m.go(StepState.COMPLETED)
    assert m.state.succeeded and StepState.SKIPPED.succeeded and not StepState.FAILED.succeeded


def test_drift(spark):
    before = [("order_id", "LONG"), ("meter", "INTEGER"), ("old", "STRING")]
    after = spark.createDataFrame([], "order_id bigint, meter string, discount double")
    said = drift(before, fields_of(after.schema))
    assert [s.split(":")[0] for s in said] == ["new field", "removed field", "type changed"]
    assert "discount" in said[0] and "old" in said[1] and "INTEGER" in said[2] and "STRING" in said[2]
    assert drift(before, before) == [] and check_drift(before, after, "IGNORE") == []
    with pytest.raises(SchemaDriftError, match="discount"):
        check_drift(before, after, "STRICT")
