"""Quality rules compiled to aggregates: all simple rules of a dataset in one pass.

A rule's predicate says when a value fails. NOT_NULL, RANGE, REGEX and FRESHNESS become
conditional counts of a single ``agg``; UNIQUE, REFERENTIAL and DISTRIBUTION need their own
aggregate. A field that the dataset lacks counts as null in every row.

Nulls pass every rule but NOT_NULL. NaN passes RANGE. An empty dataset passes everything.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.errors import DefinitionError
from tidegate.functions.text import is_blank, matches_whole, pattern_is_valid, to_instant, to_number
from tidegate.plans.model import load_yaml

#: The rules that documents can name.
RULE_TYPES = ("NOT_NULL", "RANGE", "UNIQUE", "REGEX", "FRESHNESS", "REFERENTIAL", "DISTRIBUTION")


@dataclass(frozen=True)
class Rule:
    field: str
    type: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class RuleResult:
    field: str
    rule: str
    passed: int
    failed: int
    threshold: float
    detail: str = ""

    @property
    def total(self) -> int:
        return self.passed + self.failed

    @property
    def pass_rate(self) -> float:
        return self.passed / self.total if self.total else 1.0

    @property
    def failure_rate(self) -> float:
        return self.failed / self.total if self.total else 0.0

    @property
    def meets_threshold(self) -> bool:
        return self.pass_rate >= self.threshold


@dataclass(frozen=True)
class QualityReport:
    dataset: str
    results: tuple[RuleResult, ...]
    at: datetime

    @property
    def passed(self) -> bool:
        return all(r.meets_threshold for r in self.results)

    @property
    def overall_pass_rate(self) -> float:
        return sum(r.pass_rate for r in self.results) / len(self.results) if self.results else 1.0

    @property
    def failing(self) -> list[RuleResult]:
        return [r for r in self.results if not r.meets_threshold]

    @property
    def rows_rejected(self) -> int:
        """Failures of failing rules; a row that fails several rules counts several times."""
        return sum(r.failed for r in self.failing)


def parse_rules(raw: list[dict] | tuple[dict, ...]) -> list[Rule]:
    """Rules from ``field`` and ``checks``; a check is a name or a map with ``type`` and parameters."""
    out = []
    for entry in raw:
        if "field" not in entry:
            raise DefinitionError(f"a quality rule has no field: {entry}")
        checks = entry.get("checks") or []
        for check in [checks] if isinstance(checks, (str, dict)) else checks:
            params = {"type": check} if isinstance(check, str) else dict(check)
            kind = str(params.pop("type", "")).upper()
            if kind not in RULE_TYPES:
                raise DefinitionError(f"unknown quality rule {kind or '(none)'} for field {entry['field']}")
            out.append(Rule(str(entry["field"]), kind, params))
    return out


@dataclass(frozen=True)
class DatasetQuality:
    """A rule document: dataset, threshold and rules."""

    dataset: str
    threshold: float
    rules: tuple[Rule, ...]


def load_rules(text: str) -> DatasetQuality:
    """A stand-alone YAML document: ``quality: {dataset, threshold, rules}`` or the same without the root key."""
    raw = load_yaml(text) or {}
    body = raw.get("quality", raw)
    return DatasetQuality(str(body.get("dataset", "unknown")), float(body.get("threshold", 0.95)), tuple(parse_rules(body.get("rules") or [])))


def _column(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    found = next((f for f in df.schema.fields if f.name == name), None)
    if found is None:
        return F.lit(None).cast("string"), T.StringType()
    return F.col(f"`{name}`"), found.dataType


def fails(df: DataFrame, rule: Rule, as_of: datetime | None = None) -> Column:
    """When a row fails a rule that looks at single values; never null."""
    c, kind = _column(df, rule.field)
    p = rule.params
    if rule.type == "NOT_NULL":
        bad = c.isNull() | is_blank(c) if isinstance(kind, T.StringType) else c.isNull()
    elif rule.type == "RANGE":
        v = to_number(c, kind)
        low, high = float(p.get("min", -math.inf)), float(p.get("max", math.inf))
        bad = c.isNotNull() & (v.isNull() | (~F.isnan(v) & ((v < low) | (v > high))))
    elif rule.type == "REGEX":
        ok = pattern_is_valid(df.sparkSession, p.get("pattern"))
        bad = c.isNotNull() & (~matches_whole(c.cast("string"), p["pattern"]) if ok else F.lit(True))
    elif rule.type == "FRESHNESS":
        hours = float(p.get("maxAgeHours", p.get("max_age_hours", 24)))
        now = F.lit(p.get("as_of", as_of or datetime.now(UTC))).cast("timestamp")
        at = to_instant(c, kind)
        bad = c.isNotNull() & (at.isNull() | (F.unix_micros(at) < F.unix_micros(now) - F.lit(int(hours * 3_600_000_000))))
    else:
        raise ValueError(f"{rule.type} looks at more than single values")
    return F.coalesce(bad, F.lit(False))


SINGLE = {"NOT_NULL", "RANGE", "REGEX", "FRESHNESS"}


def failure_counts(df: DataFrame, rules: list[Rule], as_of: datetime | None = None) -> DataFrame:
    """One row: ``total`` and one count ``f<i>`` per rule (rules on single values only)."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(fails(df, r, as_of)).alias(f"f{i}") for i, r in enumerate(rules)])


def repeated_values(df: DataFrame, name: str) -> DataFrame:
    """One row: how many rows hold a non-null value that occurs more than once."""
    c, _ = _column(df, name)
    counts = df.select(c.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("failed"))


def orphans(df: DataFrame, name: str, reference: DataFrame, key: str) -> DataFrame:
    """One row: how many non-null values do not occur in the reference."""
    c, _ = _column(df, name)
    values = df.select(c.alias("v")).filter("v is not null")
    return values.join(reference.select(F.col(f"`{key}`").alias("v")).distinct(), "v", "left_anti").agg(F.count(F.lit(1)).alias("failed"))


def stability_index(df: DataFrame, name: str, expected: dict[str, float], bounds: list[float] | None = None) -> DataFrame:
    """One row: the population stability index ``psi`` of a column against expected shares.

    With ``bounds`` the classes are the stretches of a numeric column between them, numbered from 0;
    without, they are the values. Classes of neither side and nulls are left out; empty shares count as 1e-4.
    """
    c, kind = _column(df, name)
    if bounds is not None:
        v = to_number(c, kind)
        key = F.when(v.isNotNull(), sum((F.when(v >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("string"))
    else:
        key = c.cast("string")
    counts = df.select(key.alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = df.sparkSession.createDataFrame([(k, float(x)) for k, x in expected.items()], "k string, e double")
    both = counts.join(F.broadcast(wanted), "k", "full").join(F.broadcast(total))
    least = lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(1e-4))
    a, e = least(F.col("n") / F.col("total")), least(F.col("e"))
    return both.agg(F.coalesce(F.sum((a - e) * F.log(a / e)), F.lit(0.0)).alias("psi"))


def evaluate(
    df: DataFrame, rules: list[Rule], dataset: str = "dataset", threshold: float = 0.95, as_of: datetime | None = None, reference: Callable[[str], DataFrame] | None = None,
) -> QualityReport:
    """The report of all rules. ``reference`` finds a table by name for REFERENTIAL rules.

    Reads the data once for all rules on single values, and once per rule of the other kinds.
    """
    at = as_of or datetime.now(UTC)
    single = [r for r in rules if r.type in SINGLE]
    row = failure_counts(df, single, at).first()
    total, simple = row["total"], iter([row[f"f{i}"] for i in range(len(single))])
    results = []
    for r in rules:
        detail = ""
        if r.type in SINGLE:
            failed = next(simple)
        elif r.type == "UNIQUE":
            failed = repeated_values(df, r.field).first()["failed"]
        elif r.type == "REFERENTIAL":
            if reference is None:
                raise DefinitionError(f"REFERENTIAL rule of {r.field}: no reference tables are known")
            failed = orphans(df, r.field, reference(r.params["dataset"]), r.params.get("key", r.field)).first()["failed"]
        else:
            psi = stability_index(df, r.field, r.params.get("expected", {}), r.params.get("bounds")).first()["psi"]
            failed = total if psi > float(r.params.get("max_psi", 0.2)) else 0
            detail = f"psi {psi:.4f}"
        results.append(RuleResult(r.field, r.type, total - failed, failed, threshold, detail))
    return QualityReport(dataset, tuple(results), at)


def violations(df: DataFrame, rules: list[Rule], keys: list[str], as_of: datetime | None = None) -> DataFrame:
    """Rows that fail a rule on single values: keys, field, rule, value, reason."""
    told = [
        F.when(fails(df, r, as_of), F.struct(F.lit(r.field).alias("field"), F.lit(r.type).alias("rule"), _column(df, r.field)[0].cast("string").alias("value"), F.lit(reason(r)).alias("reason")))
        for r in rules if r.type in SINGLE
    ]
    found = df.select(*keys, F.filter(F.array(*told), lambda v: v.isNotNull()).alias("v"))
    return found.select(*keys, F.inline("v"))


def reason(rule: Rule) -> str:
    p = rule.params
    return {
        "NOT_NULL": "null or blank",
        "RANGE": f"not a number from {p.get('min', '-inf')} to {p.get('max', 'inf')}",
        "REGEX": f"does not match {p.get('pattern')}",
        "FRESHNESS": f"older than {p.get('maxAgeHours', p.get('max_age_hours', 24))} hours or no time",
    }.get(rule.type, rule.type)
