"""The transforms that pipeline documents can name, each from inputs and settings to a frame."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.errors import DefinitionError
from tidegate.operators.dedup import exactly_once
from tidegate.operators.drift import schema_changes, unified_records
from tidegate.operators.hierarchy import hierarchy
from tidegate.operators.intervals import merge_intervals
from tidegate.operators.joins import asof_join, lookup_join, range_join, relational_join
from tidegate.operators.ranges import range_aggregate
from tidegate.operators.origins import origins_of
from tidegate.operators.rolling import rolling_totals
from tidegate.operators.upsert import last_per_key, upsert
from tidegate.sources.base import Config
from tidegate.streaming.windows import once, sessions, tumbling


@dataclass
class Inputs:
    """The datasets of an execution, and those that the step depends on in order."""

    spark: SparkSession
    all: dict[str, DataFrame]
    direct: list[str]
    params: dict = field(default_factory=dict)

    def named(self, name: str) -> DataFrame:
        if name not in self.all:
            raise DefinitionError(f"there is no dataset '{name}'; there are: {', '.join(sorted(self.all)) or 'none'}")
        return self.all[name]

    def one(self, config: Config) -> tuple[str, DataFrame]:
        """The dataset named ``input``, else the only one that the step depends on."""
        name = config.text("input")
        if name is None:
            if len(self.direct) != 1:
                raise DefinitionError(f"name the input: the step depends on {len(self.direct)} datasets")
            name = self.direct[0]
        return name, self.named(name)


@dataclass
class Output:
    """The result, and where its fields come from: kind, inputs and for renamed ones the origins.

    ``origins`` are names of the only input, ``sources`` (dataset, name) pairs of any.
    """

    df: DataFrame
    kind: str
    inputs: list[str]
    origins: dict[str, list[str]] | None = None
    sources: dict[str, list[tuple[str, str]]] | None = None


Transform = Callable[[Inputs, Config], Output]


def _names(df: DataFrame, expression: str) -> list[str]:
    """Columns of ``df`` that a SQL expression mentions, by Spark's own parser."""
    as_java = df.sparkSession.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    by = {c.lower(): c for c in df.columns}
    found, stack = set(), [df.sparkSession._jsparkSession.sessionState().sqlParser().parseExpression(expression)]
    while stack:
        e = stack.pop()
        if e.getClass().getSimpleName() == "UnresolvedAttribute":
            found.add(by.get(as_java(e.nameParts())[0].lower()))
        stack.extend(as_java(e.children()))
    return [c for c in df.columns if c in found]


def filter_(inputs: Inputs, config: Config) -> Output:
    """``condition``: SQL; rows for which it is null are dropped."""
    name, df = inputs.one(config)
    return Output(df.filter(F.expr(config.need("condition"))), "FILTER", [name])


def join(inputs: Inputs, config: Config) -> Output:
    """``left``, ``right``, ``on`` or ``left_on`` and ``right_on``, ``type``; ``lookup`` (default for INNER and LEFT) never multiplies rows.

    With ``condition``, SQL over ``l.name`` and ``r.name``, any comparison joins; CROSS pairs everything and needs neither.
    """
    left, right = config.need("left"), config.need("right")
    left_on, right_on = config.names("left_on") or config.names("on"), config.names("right_on") or config.names("on")
    kind, conflict, condition = config.text("type", "INNER").upper(), config.text("on_conflict", "coalesce"), config.text("condition")
    if len(left_on) != len(right_on) or not (left_on or condition or kind == "CROSS"):
        raise DefinitionError("a join needs 'on', or as many 'left_on' as 'right_on', or a 'condition'")
    a, b = inputs.named(left), inputs.named(right)
    if condition or kind == "CROSS":
        return Output(relational_join(a, b, left_on, right_on, kind, conflict, condition), "JOIN", [left, right])
    if config.flag("lookup", kind in ("INNER", "LEFT")):
        return Output(lookup_join(a, b, left_on, right_on, kind, config.names("order_by"), config.flag("right_unique", False), conflict), "JOIN", [left, right])
    return Output(relational_join(a, b, left_on, right_on, kind, conflict), "JOIN", [left, right])


def select(inputs: Inputs, config: Config) -> Output:
    """``columns``: names, a map from old to new names, or maps of a new name and an expression (``{total: "a + b"}``)."""
    name, df = inputs.one(config)
    raw = config.get("columns") or {}
    pairs: list[tuple[str, str]] = []
    if isinstance(raw, dict):
        pairs = [(f"`{old}`", str(new)) for old, new in raw.items()]
    else:
        for c in raw if isinstance(raw, list) else config.names("columns"):
            pairs += [(str(e), str(n)) for n, e in c.items()] if isinstance(c, dict) else [(f"`{c}`", str(c))]
    return Output(df.select(*[F.expr(e).alias(n) for e, n in pairs]), "SELECT", [name], {n: _names(df, e) for e, n in pairs})


def derive(inputs: Inputs, config: Config) -> Output:
    """``columns``: new or replaced columns by expression, beside all others."""
    name, df = inputs.one(config)
    new = {str(k): str(v) for k, v in (config.get("columns") or {}).items()}
    origins = {c: [c] for c in df.columns} | {k: _names(df, v) for k, v in new.items()}
    return Output(df.withColumns({k: F.expr(v) for k, v in new.items()}), "SELECT", [name], origins)


def aggregate(inputs: Inputs, config: Config) -> Output:
    """``group_by``, ``aggregates`` (name to expression) and ``mode``: GROUP, ROLLUP or CUBE; ``having``."""
    name, df = inputs.one(config)
    keys, aggs = config.names("group_by"), {str(k): str(v) for k, v in (config.get("aggregates") or {}).items()}
    if not aggs:
        raise DefinitionError("an aggregate needs 'aggregates'")
    mode = config.text("mode", "GROUP").upper()
    grouped = {"GROUP": df.groupBy, "ROLLUP": df.rollup, "CUBE": df.cube}.get(mode)
    if grouped is None:
        raise DefinitionError(f"unknown aggregate mode {mode}")
    out = grouped(*keys).agg(*[F.expr(e).alias(n) for n, e in aggs.items()])
    if having := config.text("having"):
        out = out.filter(F.expr(having))
    return Output(out, "AGGREGATE", [name], {k: [k] for k in keys} | {n: _names(df, e) for n, e in aggs.items()})


def _order(names: list[str]) -> list[Column]:
    """Columns to sort by; ``name desc`` sorts downwards. Nulls come last either way."""
    out = []
    for n in names:
        column, _, direction = n.partition(" ")
        out.append(F.col(column).desc_nulls_last() if direction.strip().lower() == "desc" else F.col(column).asc_nulls_last())
    return out


def window(inputs: Inputs, config: Config) -> Output:
    """``partition_by``, ``order_by``, ``columns`` (name to expression) and ``rows: [from, to]`` (null: unbounded)."""
    name, df = inputs.one(config)
    spec = Window.partitionBy(*config.names("partition_by")).orderBy(*_order(config.names("order_by")))
    if (rows := config.get("rows")) is not None:
        lo, hi = rows
        spec = spec.rowsBetween(Window.unboundedPreceding if lo is None else int(lo), Window.unboundedFollowing if hi is None else int(hi))
    new = {str(k): str(v) for k, v in (config.get("columns") or {}).items()}
    origins = {c: [c] for c in df.columns} | {k: _names(df, v) for k, v in new.items()}
    return Output(df.withColumns({k: F.expr(v).over(spec) for k, v in new.items()}), "CUSTOM", [name], origins)


def sort(inputs: Inputs, config: Config) -> Output:
    """``order_by`` and, for the first rows only, ``limit``."""
    name, df = inputs.one(config)
    out = df.orderBy(*_order(config.names("order_by")))
    n = config.whole("limit", -1)
    return Output(out if n < 0 else out.limit(n), "FILTER", [name])


def limit(inputs: Inputs, config: Config) -> Output:
    name, df = inputs.one(config)
    return Output(df.limit(config.whole("limit", 0)), "FILTER", [name])


def distinct(inputs: Inputs, config: Config) -> Output:
    """Distinct rows, or with ``key`` the last row of each key by ``order_by``."""
    name, df = inputs.one(config)
    keys = config.names("key")
    return Output(last_per_key(df, keys, config.names("order_by")) if keys else df.distinct(), "FILTER", [name])


def _set(op: str) -> Transform:
    def run(inputs: Inputs, config: Config) -> Output:
        names = config.names("inputs") or inputs.direct
        if len(names) < 2:
            raise DefinitionError(f"{op} needs two inputs or more")
        out = inputs.named(names[0])
        for n in names[1:]:
            other = inputs.named(n)
            every = config.flag("all", False)
            if op == "union":
                out = out.unionByName(other, allowMissingColumns=config.flag("allow_missing", False))
            elif op == "intersect":
                out = out.intersectAll(other) if every else out.intersect(other)
            else:
                out = out.exceptAll(other) if every else out.subtract(other)
        if op == "union" and not config.flag("all", True):
            out = out.distinct()
        return Output(out, "CUSTOM", names)

    return run


_VIEWS = threading.Lock()


def sql(inputs: Inputs, config: Config) -> Output:
    """``query`` over the datasets by name, with named parameters.

    The datasets are views only while Spark resolves the query, one query at a time, so executions that run together
    do not see each other's; views of the session under the same names are put back.
    """
    args = {**inputs.params, **(config.get("params") or {})}
    catalog = inputs.spark.catalog
    with _VIEWS:
        before = {n: inputs.spark.table(n) for n in inputs.all if any(t.isTemporary and t.name == n for t in catalog.listTables(pattern=n))}
        try:
            for name, df in inputs.all.items():
                df.createOrReplaceTempView(name)
            out = inputs.spark.sql(config.need("query"), args=args)
        finally:
            for name in inputs.all:
                catalog.dropTempView(name)
            for name, df in before.items():
                df.createOrReplaceTempView(name)
    sources = origins_of(out, inputs.all)
    used = sorted({d for pairs in sources.values() for d, _ in pairs}) if sources else config.names("inputs") or inputs.direct
    return Output(out, "CUSTOM", used, sources=sources)


def asof(inputs: Inputs, config: Config) -> Output:
    """``left``, ``right``, ``by``, ``left_time``, ``right_time``."""
    left, right = config.need("left"), config.need("right")
    return Output(asof_join(inputs.named(left), inputs.named(right), config.names("by"), config.need("left_time"), config.need("right_time"), config.text("prefix", "right_")), "JOIN", [left, right])


def merge(inputs: Inputs, config: Config) -> Output:
    """``existing``, ``incoming``, ``key``, ``order_by``: an upsert of frames."""
    a, b = config.need("existing"), config.need("incoming")
    return Output(upsert(inputs.named(a), inputs.named(b), config.names("key"), config.names("order_by")), "CUSTOM", [a, b])


def passthrough(inputs: Inputs, config: Config) -> Output:
    name, df = inputs.one(config)
    return Output(df, "FILTER", [name])


def _aggregates(config: Config) -> list[Column]:
    aggs = {str(k): str(v) for k, v in (config.get("aggregates") or {}).items()}
    if not aggs:
        raise DefinitionError("'aggregates' is missing")
    return [F.expr(e).alias(n) for n, e in aggs.items()]


def _one(build: Callable[[DataFrame, Config, Inputs], DataFrame], kind: str = "CUSTOM") -> Transform:
    """A transform of one input."""

    def run(inputs: Inputs, config: Config) -> Output:
        name, df = inputs.one(config)
        return Output(build(df, config, inputs), kind, [name])

    return run


def _micros(df: DataFrame, name: str) -> Column:
    """A time column in epoch microseconds; whole numbers stay as they are."""
    kind = dict(df.dtypes)[name]
    return F.col(name) if kind in ("bigint", "int") else F.unix_micros(F.col(name).cast("timestamp"))


def _intervals(df: DataFrame, config: Config, _: Inputs) -> DataFrame:
    """``key``, ``start``, ``end``: periods and gaps, in epoch microseconds."""
    key, start, end = config.need("key"), config.need("start"), config.need("end")
    rows = df.select(F.col(key), _micros(df, start).alias("__tg_a"), _micros(df, end).alias("__tg_b"))
    return merge_intervals(rows, key, "__tg_a", "__tg_b")


def _exactly_once(df: DataFrame, config: Config, _: Inputs) -> DataFrame:
    """``key``, ``order_by`` and ``bucket``, an expression for the whole number of the time bucket."""
    return exactly_once(df, config.names("key"), F.expr(config.text("bucket", "0")), config.names("order_by"), config.text("copies", "copies"))


def _rolling(df: DataFrame, config: Config, _: Inputs) -> DataFrame:
    """``entity``, ``day``, ``measures``, ``windows``."""
    return rolling_totals(df, config.need("entity"), config.need("day"), config.names("measures"), [int(w) for w in config.names("windows")])


def _drift(inputs: Inputs, config: Config) -> Output:
    """``nodes``, ``executions``."""
    a, b = config.need("nodes"), config.need("executions")
    return Output(schema_changes(inputs.named(a), inputs.named(b)), "CUSTOM", [a, b])


def _unify(inputs: Inputs, config: Config) -> Output:
    """``records``, ``nodes``, ``executions`` and ``defaults`` (dataset to field to value)."""
    names = [config.need(k) for k in ("records", "nodes", "executions")]
    return Output(unified_records(*map(inputs.named, names), config.get("defaults")), "CUSTOM", names)


def _tree(inputs: Inputs, config: Config) -> Output:
    """``nodes`` with ``id`` and ``label`` (an expression), ``links`` with ``parent`` and ``child``; ``paths``."""
    a, b = config.need("nodes"), config.need("links")
    nodes = inputs.named(a).select(F.col(config.text("id", "id")).alias("id"), F.expr(config.text("label", "cast(id AS string)")).alias("label"))
    links = inputs.named(b).select(F.col(config.text("parent", "parent")).alias("parent"), F.col(config.text("child", "child")).alias("child"))
    return Output(hierarchy(nodes, links, config.flag("paths", True), config.text("separator", " > ")), "CUSTOM", [a, b])


def _range(inputs: Inputs, config: Config) -> Output:
    """``left`` with ``point``, ``right`` with ``low`` and ``high``; ``width`` of the smallest buckets."""
    a, b = config.need("left"), config.need("right")
    return Output(range_join(inputs.named(a), inputs.named(b), config.need("point"), config.need("low"), config.need("high"), float(config.text("width", "1"))), "JOIN", [a, b])


def _range_aggregate(inputs: Inputs, config: Config) -> Output:
    """``left`` with ``point`` and ``value``, ``right`` with ``low`` and ``high``."""
    a, b = config.need("left"), config.need("right")
    return Output(range_aggregate(inputs.named(a), inputs.named(b), *map(config.need, ("point", "low", "high", "value"))), "AGGREGATE", [a, b])


def _tumble(df: DataFrame, config: Config, _: Inputs) -> DataFrame:
    """``time``, ``size``, ``slide``, ``by``, ``aggregates``, ``watermark``: tumbling, or with ``slide`` sliding windows."""
    return tumbling(df, config.need("time"), config.need("size"), config.names("by"), _aggregates(config), config.text("slide"), config.text("watermark"))


def _sessions(df: DataFrame, config: Config, _: Inputs) -> DataFrame:
    """``time``, ``gap``, ``by``, ``aggregates``, ``watermark``."""
    return sessions(df, config.need("time"), config.need("gap"), config.names("by"), _aggregates(config), config.text("watermark"))


def _within(df: DataFrame, config: Config, _: Inputs) -> DataFrame:
    """``key``, ``time``, ``watermark``: one copy of each identifier, on a stream within the watermark."""
    if not df.isStreaming:
        return df.dropDuplicates(config.names("key"))
    return once(df, config.names("key"), config.need("time"), config.need("watermark"))


TRANSFORMS: dict[str, Transform] = {
    "filter": filter_, "join": join, "select": select, "derive": derive, "aggregate": aggregate, "window": window, "sort": sort, "limit": limit, "distinct": distinct,
    "union": _set("union"), "intersect": _set("intersect"), "except": _set("except"), "sql": sql, "asof_join": asof, "upsert": merge, "passthrough": passthrough,
    "range_join": _range, "range_aggregate": _range_aggregate, "tumbling": _one(_tumble, "AGGREGATE"), "sessions": _one(_sessions, "AGGREGATE"), "once": _one(_within, "FILTER"),
    "merge_intervals": _one(_intervals), "exactly_once": _one(_exactly_once, "FILTER"), "rolling_totals": _one(_rolling, "AGGREGATE"),
    "schema_changes": _drift, "unified_records": _unify, "hierarchy": _tree,
}


def register(name: str, f: Callable[[Inputs, Config], DataFrame]) -> None:
    """Add a transform of one's own, from inputs and settings to a frame."""
    TRANSFORMS[name.lower()] = lambda inputs, config: Output(f(inputs, config), "CUSTOM", list(inputs.direct))


def register_function(spark: SparkSession, name: str, f, returns: str | None = None) -> None:
    """Add a function for expressions and queries: a UDF, a grouped aggregate (both preferably Pandas UDFs), or a UDTF class."""
    if isinstance(f, type):
        spark.udtf.register(name, F.udtf(f, returnType=returns))
    elif hasattr(f, "evalType") and not isinstance(f, type):
        (spark.udtf if hasattr(f, "_name") and f.__class__.__name__ == "UserDefinedTableFunction" else spark.udf).register(name, f)
    else:
        spark.udf.register(name, f, returns)


def load_plugins(modules: list[str]) -> None:
    """Import modules that add transforms with ``register`` as they are imported."""
    import importlib

    for m in modules:
        importlib.import_module(m)


def apply(name: str, inputs: Inputs, config: Config) -> Output:
    found = TRANSFORMS.get(name.lower())
    if found is None:
        raise DefinitionError(f"unknown transform '{name}'; there are: {', '.join(sorted(TRANSFORMS))}")
    return found(inputs, config)
