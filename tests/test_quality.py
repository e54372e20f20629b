import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.errors import DefinitionError
from tidegate.quality import html
from tidegate.quality.rules import QualityReport, Rule, RuleResult, evaluate, load_rules, parse_rules, violations

AS_OF = dt.datetime(2025, 6, 1, 12, tzinfo=dt.UTC)


def failed(spark, values, kind, rule, **params):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return evaluate(df, [Rule("x", rule, params)], as_of=AS_OF).results[0].failed


def each(spark, values, kind, rule, **params):
    """F or P for each value by itself."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    bad = {r["i"] for r in violations(df, [Rule("x", rule, params)], ["i"], AS_OF).collect()}
    return "".join("F" if i in bad else "P" for i in range(len(values)))


def test_not_null(spark):
    assert each(spark, ["Juan", "", None, "   ", "\t", " ", "\xa0", "v", "\n x"], "string", "NOT_NULL") == "PFFFFFPPP"
    assert each(spark, [123, None], "int", "NOT_NULL") == "PF"


def test_range(spark):
    assert each(spark, [0.0, 100.0, 50.5, -1.0, 101.0, None, float("nan"), float("inf")], "double", "RANGE", min=0, max=100) == "PPPFFPPF"
    assert each(spark, ["5", " 5 ", "1d", "inf", "abc", "", None, "1e1"], "string", "RANGE", min=0, max=100) == "PPPFFFPP"
    assert each(spark, [True, None], "boolean", "RANGE", min=0, max=100) == "FP"
    assert each(spark, [dt.datetime(1970, 1, 1)], "timestamp", "RANGE", min=0, max=100) == "F"
    assert each(spark, [5, 11], "bigint", "RANGE", min=10) == "FP"


def test_regex(spark):
    email = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
    assert each(spark, ["juan@example.com", "no-es-email", "otro@dominio.pe", None], "string", "REGEX", pattern=email) == "PFPP"
    assert each(spark, ["ab", "ab\n", "a", "xab"], "string", "REGEX", pattern="a|ab") == "PFPF"
    assert each(spark, ["v", None], "string", "REGEX", pattern="[broken") == each(spark, ["v", None], "string", "REGEX") == "FP"
    assert each(spark, [12, 3], "int", "REGEX", pattern=r"\d\d") == "PF"


def test_freshness(spark):
    at = [AS_OF - dt.timedelta(hours=1), AS_OF - dt.timedelta(hours=24), AS_OF - dt.timedelta(hours=25), None]
    assert each(spark, at, "timestamp", "FRESHNESS") == "PPFP"
    assert each(spark, at, "timestamp", "FRESHNESS", max_age_hours=30) == "PPPP"
    assert each(spark, [int(t.timestamp() * 1000) if t else None for t in at], "bigint", "FRESHNESS", maxAgeHours=24) == "PPFP"
    assert each(spark, ["2025-06-01T11:00:00Z", "2025-06-01T11:00:00", "yesterday", "2025-05-01T11:00:00+02:00", "2025-99-01T11:00:00Z"], "string", "FRESHNESS") == "PFFFF"
    assert each(spark, [5, None], "int", "FRESHNESS") == "FP"


def test_unique(spark):
    assert failed(spark, [1, 2, 1, 3], "int", "UNIQUE") == 2
    assert failed(spark, [None, None, "a"], "string", "UNIQUE") == failed(spark, [], "int", "UNIQUE") == 0


def test_referential_and_distribution(spark):
    df = spark.createDataFrame([(1,), (2,), (9,), (None,)], "x int")
    reference = {"t": spark.createDataFrame([(1, 0), (2, 0), (2, 0)], "id int, x int")}
    rules = [Rule("x", "REFERENTIAL", {"dataset": "t", "key": "id"}), Rule("x", "DISTRIBUTION", {"expected": {"1": 0.34, "2": 0.33, "9": 0.33}}), Rule("x", "DISTRIBUTION", {"expected": {"0": 1.0}, "bounds": [5]})]
    assert [r.failed for r in evaluate(df, rules, reference=reference.get).results] == [1, 0, 4]


def test_missing_field_and_empty_table(spark):
    df = spark.createDataFrame([(1,), (2,)], "y int")
    assert [evaluate(df, [Rule("x", t, {"pattern": "a"})]).results[0].failed for t in ("NOT_NULL", "RANGE", "REGEX", "FRESHNESS", "UNIQUE")] == [2, 0, 0, 0, 0]
    report = evaluate(df.limit(0), [Rule("y", "NOT_NULL"), Rule("y", "UNIQUE")])
    assert report.passed and report.overall_pass_rate == 1.0


@pytest.mark.parametrize("nulls, ok", [(1, True), (5, True), (10, True), (20, False), (25, False)])
def test_thresholds(spark, nulls, ok):
    df = spark.range(100).selectExpr(f"CASE WHEN id < {nulls} THEN NULL ELSE id END AS x")
    report = evaluate(df, [Rule("x", "NOT_NULL")], threshold=0.85)
    assert report.passed is ok and report.results[0].pass_rate == 1 - nulls / 100
    assert evaluate(df, [Rule("x", "NOT_NULL")], threshold=(100 - nulls) / 100).passed


def test_report_sums():
    r = QualityReport("d", (RuleResult("a", "NOT_NULL", 90, 10, 0.95), RuleResult("b", "RANGE", 100, 0, 0.95), RuleResult("c", "UNIQUE", 0, 0, 0.95)), AS_OF)
    assert not r.passed and r.rows_rejected == 10 and [x.field for x in r.failing] == ["a"]
    assert r.overall_pass_rate == pytest.approx((0.9 + 1 + 1) / 3) and r.results[2].failure_rate == 0


def test_rule_documents():
    q = load_rules("quality:\n  dataset: orders\n  threshold: 0.9\n  rules:\n    - {field: a, checks: [NOT_NULL, {type: RANGE, min: 1}]}\n    - {field: b, checks: UNIQUE}")
    assert q.dataset == "orders" and [(r.field, r.type) for r in q.rules] == [("a", "NOT_NULL"), ("a", "RANGE"), ("b", "UNIQUE")] and q.rules[1].params == {"min": 1}
    for bad in ([{"checks": ["NOT_NULL"]}], [{"field": "a", "checks": ["NOTHING"]}], [{"field": "a", "checks": [{}]}]):
        with pytest.raises(DefinitionError):
            parse_rules(bad)


def test_page_escapes_values():
    page = html.render(QualityReport("<d>", (RuleResult("<script>", "REGEX", 1, 1, 0.95),), AS_OF))
    assert "<script>" not in page and "&lt;script&gt;" in page and "50.00%" in page
    assert html.file_name(QualityReport("d", (), AS_OF)) == "quality-d-20250601T120000.html"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(allow_nan=False, width=32), st.sampled_from([0.0, 10.0, -0.0])), max_size=30))
def test_range_against_plain_python(spark, values):
    want = sum(v is not None and not 0 <= v <= 10 for v in values)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = evaluate(df, [Rule("x", "RANGE", {"min": 0, "max": 10})]).results[0]
    assert r.failed == want and r.total == len(values)
