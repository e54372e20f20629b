from tests.conftest import DATA
from tidegate.engine import Engine, EngineConfig

DOC = """
pipeline:
  id: corpus
  steps:
    - {{id: documents, type: SOURCE, connector: parquet, config: {{path: "{d}/documents.parquet"}}, output: documents}}
    - {{id: items, type: SOURCE, connector: parquet, config: {{path: "{d}/eval_items.parquet"}}, output: items}}
    - {{id: targets, type: SOURCE, connector: parquet, config: {{path: "{d}/mix_targets.parquet"}}, output: targets}}
    - {{id: samples, type: SOURCE, connector: parquet, config: {{path: "{d}/lang_samples.parquet"}}, output: samples}}
    - {{id: runs, type: SOURCE, connector: parquet, config: {{path: "{d}/step_executions.parquet"}}, output: runs}}
    - {{id: leaks, type: TRANSFORM, depends_on: [documents, items], transform: leaks, config: {{documents: documents, items: items}}, output: leaks}}
    - {{id: mix, type: TRANSFORM, depends_on: [documents, targets], transform: mix, config: {{documents: documents, targets: targets, tokenizer: /opt/tokenizers/byte_bpe_50k.tiktoken, shards: 4, report: true}}, output: shares}}
    - {{id: langs, type: TRANSFORM, depends_on: [documents, samples], transform: languages, config: {{documents: documents, samples: samples, cases: true}}, output: cases}}
    - {{id: counts, type: TRANSFORM, depends_on: [runs], transform: sketch, config: {{groups: [step_id, state], value: latency_ms}}, output: counts}}
    - {{id: merged, type: TRANSFORM, depends_on: [counts], transform: merge_sketches, config: {{groups: step_id}}, output: merged}}
    - {{id: medians, type: TRANSFORM, depends_on: [merged], transform: percentiles, config: {{groups: step_id, points: "0.5,0.99"}}, output: medians}}
    - {{id: direct, type: TRANSFORM, depends_on: [runs], transform: percentiles, config: {{groups: step_id, points: "0.5,0.99", value: latency_ms}}, output: direct}}
"""


def test_a_document_names_all_of_them(spark):
    from tidegate.llm.queries import QUERIES

    e = Engine(spark, config=EngineConfig(plugins=("tidegate.llm.transforms",), max_retries=0))
    e.register(DOC.format(d=DATA))
    assert e.validate(DOC.format(d=DATA)).valid
    info = e.execute("corpus")
    assert info.state == "COMPLETED", info.error
    rows = lambda name: {tuple(r) for r in e.frame(info.execution_id, name).collect()}
    assert rows("leaks") == {tuple(r) for r in QUERIES["p7_found"](spark, str(DATA)).collect()}
    assert rows("cases") == {tuple(r) for r in QUERIES["p9_found"](spark, str(DATA)).collect()}
    assert rows("medians") == rows("direct") and sum(r[-1] for r in rows("shares")) > 0.99
