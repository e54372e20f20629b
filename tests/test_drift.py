import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegate.operators.drift import Migration, SchemaMachine, dataset_table, schema_changes, schema_versions, unified_records

NODES = "id bigint, execution_id string, dataset_name string, field_name string, data_type string, change string"
RUNS = "id string, started_at timestamp_ntz, state string"
T0 = dt.datetime(2025, 1, 1)


def runs(spark, n, missing=()):
    return spark.createDataFrame([(f"e{i}", None if i in missing else T0 + dt.timedelta(hours=i), "x") for i in range(n)], RUNS)


def nodes(spark, *versions):
    rows, i = [], 0
    for e, fields in versions:
        for name, kind in fields:
            i += 1
            rows.append((i, e, " DS" if i % 2 else "ds ", name, kind, None))
    return spark.createDataFrame(rows, NODES)


def changes(df):
    return {tuple(r) for r in df.select("execution_id", "change", "field_before", "field_after").collect()}


VERSIONS = [
    ("e0", [("a", "LONG"), ("b", "STRING"), ("c", "DATE")]),
    ("e1", [("A ", "long "), ("b2", " String"), ("c", None)]),
    ("e2", [("a", "DOUBLE"), ("b2", None), ("c", "DATE"), ("d", "LONG")]),
    ("e3", [("b2", "STRING"), ("c", "DATE"), ("d", "LONG")]),
]
WANT = {("e1", "renamed", "b", "b2"), ("e2", "type_changed", "a", "a"), ("e2", "added", "", "d"), ("e3", "removed", "a", "")}


@pytest.mark.parametrize("target", [100_000, 1])
def test_every_kind_of_change(spark, target):
    found = schema_changes(nodes(spark, *VERSIONS), runs(spark, 4), target)
    assert changes(found) == WANT


def test_repeated_rows_change_nothing(spark):
    n = nodes(spark, *VERSIONS)
    assert changes(schema_changes(n.unionByName(n), runs(spark, 4).unionByName(runs(spark, 4)))) == WANT


def test_chunks_carry_types_and_schemas_over(spark):
    versions = [(f"e{i}", [("k", "LONG" if i == 0 else None), (f"f{i // 7}", "STRING")]) for i in range(60)]
    want = {(f"e{i}", "renamed", f"f{i // 7 - 1}", f"f{i // 7}") for i in range(7, 60, 7)}
    assert changes(schema_changes(nodes(spark, *versions), runs(spark, 60), 10)) == want


def test_nulls_unknown_types_and_runs_without_start(spark):
    n = nodes(spark, ("e0", [("a", None), (None, "LONG")]), ("e1", [("b", None)]), ("e2", [("b", "LONG")]), (None, [("x", "LONG")]), ("gone", [("y", "LONG")]))
    assert changes(schema_changes(n, runs(spark, 3))) == {("e1", "removed", "a", ""), ("e1", "added", "", "b")}
    assert changes(schema_changes(n, runs(spark, 3, missing=(1,)))) == {("e2", "removed", "a", ""), ("e2", "added", "", "b")}


def test_empty(spark):
    assert schema_changes(spark.createDataFrame([], NODES), spark.createDataFrame([], RUNS)).count() == 0


def test_state_survives_text():
    m = SchemaMachine()
    m.step([("a", "long")], 1)
    again = SchemaMachine(m.state())
    assert again.step([("b", "long")], 2) == [("renamed", "a", "b", 0, "long", "long")]


def test_records_in_the_last_schema(spark):
    records = spark.createDataFrame(
        [(1, "e0", "ds", '{"a": "7", "b": "x", "c": "2025-01-02"}'), (2, "e1", "DS ", '{"a": 8.0, "b2": null}'), (3, "e2", "ds", '{"a": 1.5, "b2": 4, "d": "no"}'), (4, "e3", "ds", '{"b2": "cut'), (5, "e3", "ds", None), (6, "e3", "ds", '{"B2 ": "y", "c": "2025-02-30", "d": 9, "z": [1]}'), (7, None, "ds", '{"d": 1}'), (8, "e3", "other", '{"q": 1}')],
        "record_id bigint, execution_id string, dataset_name string, payload string",
    )
    got = {r["record_id"]: r for r in unified_records(records, nodes(spark, *VERSIONS), runs(spark, 4)).collect()}
    assert got[1]["fields"] == {"b2": "x", "c": "2025-01-02", "d": None} and got[1]["extra"] == {"a": "7"}
    assert got[3]["fields"]["b2"] == "4" and got[3]["misfits"] == "d" and got[3]["extra"] == {"a": "1.5", "d": "no"}
    assert [got[i]["status"] for i in (1, 7)] == ["whole", "no_run"] and got[7]["fields"]["d"] == "1"
    assert [got[i]["status"] for i in (4, 5)] == ["broken", "broken"]
    assert got[6]["fields"] == {"b2": "y", "c": None, "d": "9"} and got[6]["misfits"] == "c" and got[6]["extra"] == {"c": "2025-02-30", "z": "[1]"}
    assert got[8]["extra"] == {"q": "1"}
    last = schema_versions(nodes(spark, *VERSIONS), runs(spark, 4)).orderBy(F.desc("started_us")).first()["fields"]
    typed = dataset_table(unified_records(records, nodes(spark, *VERSIONS), runs(spark, 4)), [(f["name"], f["type"]) for f in last], "ds")
    assert dict(typed.dtypes) == {"record_id": "bigint", "execution_id": "string", "b2": "string", "c": "date", "d": "bigint"}
    assert typed.filter("record_id = 6").first()["d"] == 9


def test_a_removed_field_does_not_meet_a_later_one_of_its_name(spark):
    versions = [("e0", [("a", "long"), ("b", "long")]), ("e1", [("a", "long")]), ("e2", [("b", "long")])]
    records = spark.createDataFrame([(1, "e0", "ds", '{"a": 1, "b": 2}'), (2, "e1", "ds", '{"b": 2, "a": 1}'), (3, "e2", "ds", '{"b": 3}')], "record_id bigint, execution_id string, dataset_name string, payload string")
    got = {r["record_id"]: r for r in unified_records(records, nodes(spark, *versions), runs(spark, 3)).collect()}
    assert [(got[i]["fields"], got[i]["extra"], got[i]["misfits"]) for i in (1, 2, 3)] == [({"b": "1"}, {"b": "2"}, ""), ({"b": "1"}, {"b": "2"}, "b"), ({"b": "3"}, {}, "")]


def test_routes_end_at_a_removal_though_the_name_comes_again(spark):
    chain = Migration()
    chain.before([("added", "", "b", None)])
    assert chain.way("b") == ("b", [], None) and chain.defaults == {"b": (None, [])}
    chain.before([("removed", "b", "", None)])
    chain.before([("renamed", "a", "b", "long")])
    assert chain.way("a") == chain.way("b") == (None, [], "b")
    versions = [("e0", [("b", "long"), ("k", "date")]), ("e1", [("k", "date")]), ("e2", [("k", "date"), ("b", "long")])]
    records = spark.createDataFrame([(i, f"e{i}", "ds", '{"b": %d}' % i) for i in range(3)], "record_id bigint, execution_id string, dataset_name string, payload string")
    got = {r["record_id"]: (r["fields"]["b"], r["extra"]) for r in unified_records(records, nodes(spark, *versions), runs(spark, 3)).collect()}
    assert got == {0: (None, {"b": "0"}), 1: ("1", {}), 2: ("2", {})}


def test_values_pass_every_cast_on_their_way_and_new_fields_get_defaults(spark):
    versions = [("e0", [("a", "string")]), ("e1", [("a", "double")]), ("e2", [("a", "long"), ("n", "long")]), ("e3", [("a", "string"), ("n", "double")])]
    records = spark.createDataFrame([(0, "e0", "ds", '{"a": "7"}'), (1, "e0", "ds", '{"a": "x"}'), (2, "e1", "ds", '{"a": 2.0}'), (3, "e1", "ds", '{"a": 2.5}'), (4, "e2", "ds", '{"a": "y"}'), (5, "e3", "ds", '{"a": "z"}')], "record_id bigint, execution_id string, dataset_name string, payload string")
    got = {r["record_id"]: (r["fields"]["a"], r["fields"]["n"], r["extra"], r["misfits"]) for r in unified_records(records, nodes(spark, *versions), runs(spark, 4), {"ds": {"n": "5"}}).collect()}
    assert got == {0: ("7", "5.0", {}, ""), 1: (None, "5.0", {"a": "x"}, "a"), 2: ("2", "5.0", {}, ""), 3: (None, "5.0", {"a": "2.5"}, "a"), 4: ("y", None, {}, ""), 5: ("z", None, {}, "")}
