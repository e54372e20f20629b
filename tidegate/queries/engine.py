"""Queries over the engine's own operators, and the SQL they are checked against."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.engine.api import Engine
from tidegate.engine.config import EngineConfig
from tidegate.lineage.graph import reachable, source_nodes
from tidegate.operators import transforms
from tidegate.operators.joins import asof_join, lookup_join, range_join, relational_join
from tidegate.operators.upsert import upsert
from tidegate.quality.rules import Rule, failure_counts, orphans, repeated_values, stability_index, violations
from tidegate.session import table
from tidegate.sources import Config
from tidegate.sources.tables import kafka_message, kafka_rows
from tidegate.streaming.windows import sessions, tumbling

AS_OF = datetime(1998, 1, 1)


def _apply(name: str, spark: SparkSession, inputs: dict[str, DataFrame], **config) -> DataFrame:
    return transforms.apply(name, transforms.Inputs(spark, inputs, list(inputs)), Config(config)).df


DEMO = """
pipeline:
  id: open-purchases
  steps:
    - {{id: purchases-in, type: SOURCE, connector: parquet, config: {{path: "{dir}/orders.parquet"}}, output: purchases}}
    - {{id: buyers-in, type: SOURCE, connector: parquet, config: {{path: "{dir}/customer.parquet", columns: [c_custkey, c_name, c_nationkey, c_mktsegment]}}, output: buyers}}
    - id: add-buyers
      type: TRANSFORM
      depends_on: [purchases-in, buyers-in]
      transform: join
      config: {{left: purchases, right: buyers, left_on: o_custkey, right_on: c_custkey, type: INNER, right_unique: true}}
      output: purchases_by_buyer
    - id: still-open
      type: TRANSFORM
      depends_on: [add-buyers]
      transform: filter
      config: {{condition: "o_orderstatus != 'F' AND o_totalprice > 0"}}
      output: open_purchases
"""


def demo_orders_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline document run by the engine up to a lazy frame."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    engine = Engine(spark, config=EngineConfig(checkpoint="none", max_retries=0))
    engine.register(DEMO.format(dir=sf_dir))
    info = engine.execute("open-purchases")
    if info.error:
        raise RuntimeError(info.error)
    return engine.frame(info.execution_id, "open_purchases")


def source_parquet_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("select", spark, {"c": table(spark, sf_dir, "customer")}, columns=["c_custkey", {"name": "upper(c_name)"}, "c_acctbal"])


def filter_sql_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("filter", spark, {"o": table(spark, sf_dir, "orders")}, condition="o_orderstatus != 'F' AND o_totalprice > 1000")


def _holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_custkey % 10, 0)").alias("k"), F.expr("nullif(o_orderstatus, 'P')").alias("status"), "o_totalprice")


def filter_null_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("filter", spark, {"o": _holes(spark, sf_dir)}, condition="status != 'F' OR k > 5")


def _building(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_nationkey")


def join_inner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _building(spark, sf_dir), ["o_custkey"], ["c_custkey"], right_unique=True)


def join_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _building(spark, sf_dir), ["o_custkey"], ["c_custkey"], "LEFT", right_unique=True)


_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def join_lookup_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", *_ORDER)
    return lookup_join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), lines, ["p_partkey"], ["l_partkey"], order_by=_ORDER)


def join_overlap_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END").alias("s"))
    right = table(spark, sf_dir, "orders").filter("o_totalprice > 20000").select("o_orderkey", F.lower("o_orderpriority").alias("s"), "o_totalprice")
    return lookup_join(left, right, ["o_orderkey"], kind="LEFT", right_unique=True)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_acctbal")
    spend = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return rich, spend


def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_join(*_sides(spark, sf_dir), ["k"], kind="RIGHT")


def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_join(*_sides(spark, sf_dir), ["k"], kind="FULL")


def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_join(*_sides(spark, sf_dir), ["k"], kind="SEMI")


def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational_join(*_sides(spark, sf_dir), ["k"], kind="ANTI")


def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))
    b = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("returns"))
    return relational_join(a, b, ["l_partkey", "l_suppkey"], ["p", "s"])


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last view before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    buys, views = events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen"))
    return asof_join(buys, views, ["user_id"], "ts", "seen").select("event_id", "user_id", "ts", "right_seen")


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the price band they fall in; bands are made of the parts' prices."""
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 10).alias("low"), (F.col("s_acctbal") * 10 + 200).alias("high"))
    return range_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "low", "high", 500.0).select("o_orderkey", "s_suppkey")


# Quality: each rule on its own, and all in one pass.

QUALITY_RULES = [
    Rule("k", "NOT_NULL"), Rule("status", "NOT_NULL"), Rule("o_totalprice", "RANGE", {"min": 2000, "max": 400000}),
    Rule("status", "REGEX", {"pattern": "[FO]"}), Rule("o_orderdate", "FRESHNESS", {"maxAgeHours": 24 * 365}),
]


def _quality_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("nullif(o_custkey % 10, 0)").alias("k"), F.expr("CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END").alias("status"), "o_totalprice", "o_orderdate")


def _one_rule(i: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return failure_counts(_quality_input(spark, sf_dir), [QUALITY_RULES[i]], AS_OF).select("total", F.col("f0").alias("failed"))

    return run


def quality_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one aggregate, laid out as one row per rule."""
    counts = failure_counts(_quality_input(spark, sf_dir), QUALITY_RULES, AS_OF)
    rows = F.array(*[F.struct(F.lit(r.field).alias("field"), F.lit(r.type).alias("rule"), F.col(f"f{i}").alias("failed")) for i, r in enumerate(QUALITY_RULES)])
    long = counts.select("total", F.inline(rows))
    rate = (F.col("total") - F.col("failed")) / F.col("total")
    return long.select("field", "rule", (F.col("total") - F.col("failed")).alias("passed"), "failed", F.round(rate, 6).alias("pass_rate"), (rate >= 0.95).alias("meets_threshold"))


def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return violations(_quality_input(spark, sf_dir), QUALITY_RULES, ["o_orderkey"], AS_OF).select("o_orderkey", "field", "rule", "reason")


def quality_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_values(table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k")), "k")


def quality_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(table(spark, sf_dir, "orders"), "o_custkey", _building(spark, sf_dir), "c_custkey")


def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stability_index(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": 0.5, "O": 0.4, "P": 0.1}).select(F.round("psi", 8).alias("psi"))


# Projection, aggregates, windows, sets.


def select_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("select", spark, {"n": table(spark, sf_dir, "nation")}, columns={"n_nationkey": "id", "n_name": "nation"})


def select_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on text, times, numbers and conditions."""
    columns = ["o_orderkey", {"year": "year(o_orderdate)"}, {"month": "date_format(o_orderdate, 'yyyy-MM')"}, {"price": "o_totalprice * 1.1"}, {"size": "CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END"}, {"priority": "split(o_orderpriority, '-')[0]"}, {"letters": "length(regexp_replace(o_orderpriority, '[^A-Z]', ''))"}]
    return _apply("select", spark, {"o": table(spark, sf_dir, "orders")}, columns=columns)


def derive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount")
    return _apply("derive", spark, {"l": lines}, columns={"net": "l_extendedprice * (1 - l_discount)", "cheap": "l_extendedprice < 10000"})


def _lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"l": table(spark, sf_dir, "lineitem")}


_SUMS = {"n": "count(*)", "quantity": "round(sum(l_quantity), 2)", "cents": "sum(CAST(round(l_extendedprice * 100) AS BIGINT))"}


def aggregate_groupby(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = _SUMS | {"parts": "count(distinct l_partkey)", "discount": "round(avg(l_discount), 6)", "first_ship": "min(l_shipdate)"}
    return _apply("aggregate", spark, _lines(spark, sf_dir), group_by=["l_returnflag", "l_linestatus"], aggregates=aggs)


def aggregate_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("aggregate", spark, _lines(spark, sf_dir), group_by=["l_suppkey"], aggregates=_SUMS, having="quantity > 15000 OR n % 2 = 0")


def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("aggregate", spark, _lines(spark, sf_dir), group_by=["l_returnflag", "l_linestatus"], aggregates=_SUMS | {"level": "grouping_id()"}, mode="ROLLUP")


def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("aggregate", spark, _lines(spark, sf_dir), group_by=["l_returnflag", "l_linestatus"], aggregates=_SUMS | {"level": "grouping_id()"}, mode="CUBE")


def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("sql", spark, _lines(spark, sf_dir), query="SELECT l_returnflag, l_suppkey, count(*) AS n FROM l GROUP BY GROUPING SETS ((l_returnflag), (l_suppkey), ())")


def window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"place": "rank()", "dense": "dense_rank()", "quarter": "ntile(4)", "before": "lag(o_orderkey)", "after": "lead(o_orderkey)"}
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return _apply("window", spark, {"o": orders}, partition_by=["o_custkey"], order_by=["o_totalprice desc", "o_orderkey"], columns=columns)


def window_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return _apply("window", spark, {"o": orders}, partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"], columns={"running": "sum(cents)", "seen": "count(*)"}, rows=[None, 0])


def window_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return _apply("window", spark, {"o": orders}, partition_by=["o_custkey"], order_by=["o_orderdate", "o_orderkey"], columns={"nearby": "sum(cents)", "most": "max(cents)"}, rows=[-2, 2])


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("sort", spark, {"o": table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")}, order_by=["o_totalprice desc", "o_orderkey"], limit=100)


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("distinct", spark, {"l": table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")})


def distinct_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("distinct", spark, {"l": table(spark, sf_dir, "lineitem").select("l_partkey", *_ORDER)}, key=["l_partkey"], order_by=_ORDER)


def _parts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    return {"a": lines.filter("l_returnflag = 'A' AND l_quantity > 30").select("l_partkey"), "b": lines.filter("l_linestatus = 'O' AND l_quantity < 10").select("l_partkey")}


def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("union", spark, _parts(spark, sf_dir))


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("union", spark, _parts(spark, sf_dir), all=False)


def intersect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("intersect", spark, _parts(spark, sf_dir))


def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("intersect", spark, _parts(spark, sf_dir), all=True)


def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("except", spark, _parts(spark, sf_dir))


def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("except", spark, _parts(spark, sf_dir), all=True)


def sql_named_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _apply("sql", spark, {"orders": table(spark, sf_dir, "orders")}, query="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice >= :least", params={"status": "O", "least": 100000})


def sql_cte_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = "WITH spend AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_orderkey, n FROM orders JOIN spend USING (o_custkey) WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)"
    return _apply("sql", spark, {"orders": table(spark, sf_dir, "orders"), "customer": table(spark, sf_dir, "customer")}, query=query)


def sql_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive table expression joined with a table: customers by powers of two."""
    query = "WITH RECURSIVE steps(n, k) AS (SELECT 0, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, k * 2 FROM steps WHERE n < 12) SELECT n, k, c_name FROM steps JOIN customer ON c_custkey = k"
    return _apply("sql", spark, {"customer": table(spark, sf_dir, "customer")}, query=query)


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = orders.filter("o_orderstatus != 'P'")
    new = orders.filter("o_totalprice > 250000").select("o_orderkey", F.lit("U").alias("o_orderstatus"), "o_totalprice")
    return upsert(old, new, ["o_orderkey"])


def kafka_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as messages: key and the values read back from the JSON."""
    events = table(spark, sf_dir, "events").select("event_id", F.expr("nullif(user_id % 50, 0)").alias("user"), "event_type")
    sent = kafka_message(events, "user")
    return sent.select("key", F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("value", "$.event_type").alias("event_type"))


def kafka_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a topic as rows with the delivery's columns; broken values are dropped."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    value = F.when(F.col("event_id") % 20 == 0, F.lit('{"event_id": ')).otherwise(F.to_json(F.struct("event_id", "user_id", "event_type")))
    raw = events.select(value.alias("value"), (F.col("event_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.timestamp_millis(F.col("event_id") * 1000).alias("timestamp"))
    return kafka_rows(raw, "event_id bigint, user_id bigint, event_type string, __tg_bad string")


def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.json_object_keys("props").alias("keys")).select("event_id", "k", F.size("keys").cast("bigint").alias("n_keys"))


# Lineage over the recorded tables.


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineage_edges").select("source_node_id", "target_node_id")


def _nodes_of(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "lineage_nodes").filter(f"lower(trim(dataset_name)) LIKE '%{kind}'").select(F.col("id").alias("node_id"))


def lineage_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields that the raw fields of any dataset lead to."""
    return reachable(_edges(spark, sf_dir), _nodes_of(spark, sf_dir, "raw")).select("node_id")


def lineage_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields that the marts of any dataset come from."""
    return reachable(_edges(spark, sf_dir), _nodes_of(spark, sf_dir, "mart"), downstream=False).select("node_id")


def lineage_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_nodes(table(spark, sf_dir, "lineage_nodes").select(F.col("id").alias("node_id")).distinct(), _edges(spark, sf_dir))


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], [F.count(F.lit(1)).alias("n")])


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", ["event_type"], [F.count(F.lit(1)).alias("n")], slide="2 hours")


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], [F.count(F.lit(1)).alias("n")])


_FUNCTIONS = [
    demo_orders_enriched, source_parquet_project, filter_sql_condition, filter_null_condition, join_inner_lookup, join_left_lookup, join_lookup_last_wins, join_overlap_coalesce,
    join_right, join_full, join_semi, join_anti, join_multi_key, join_asof, join_range, quality_report_summary, quality_violations, quality_unique, quality_referential, quality_distribution,
    select_rename, select_expressions, derive_columns, aggregate_groupby, aggregate_having, agg_rollup, agg_cube, agg_grouping_sets, window_rank, window_running, window_frame, topk, distinct_rows, distinct_by_key,
    union_all, union_distinct, intersect_distinct, intersect_all, except_distinct, except_all, sql_named_params, sql_cte_subquery, sql_recursive, upsert_merge, kafka_payload, kafka_parse, json_props_extract,
    lineage_downstream, lineage_upstream, lineage_sources, events_tumbling, events_sliding, events_session,
]
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {"quality_not_null": _one_rule(1), "quality_range": _one_rule(2), "quality_regex": _one_rule(3), "quality_freshness": _one_rule(4)}

_Q = """q AS (SELECT o_orderkey, nullif(o_custkey % 10, 0) AS k, CASE WHEN o_orderkey % 7 = 0 THEN ' ' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS status, o_totalprice, o_orderdate FROM orders),
x AS (SELECT o_orderkey, k IS NULL AS f0, status IS NULL OR trim(status) = '' AS f1, o_totalprice < 2000 OR o_totalprice > 400000 AS f2, coalesce(NOT regexp_full_match(status, '[FO]'), false) AS f3, coalesce(o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 8760 HOUR, false) AS f4 FROM q)"""
_FIELDS = ["('k', 'NOT_NULL', f0)", "('status', 'NOT_NULL', f1)", "('o_totalprice', 'RANGE', f2)", "('status', 'REGEX', f3)", "('o_orderdate', 'FRESHNESS', f4)"]
_V = f"v AS (SELECT o_orderkey, t.field, t.rule, t.bad FROM x, LATERAL (VALUES {', '.join(_FIELDS)}) AS t(field, rule, bad))"
_C = "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')"
_S = "r AS (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_acctbal > 0), s AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey)"
_A, _B = "(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 30)", "(SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity < 10)"
_N = "count(*) AS n, round(sum(l_quantity), 2) AS quantity, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY " + ", ".join(f"{c} DESC" for c in _ORDER) + ") AS rn FROM lineitem) WHERE rn = 1)"
_O = ", ".join(_ORDER)
_W = "SELECT o_orderkey, o_custkey, o_orderdate, round(o_totalprice * 100)::BIGINT AS cents FROM orders"


def _reach(name: str, a: str, b: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT {a} AS a, {b} AS b FROM lineage_edges), s AS (SELECT DISTINCT id FROM lineage_nodes WHERE lower(trim(dataset_name)) LIKE '%{name}'),
        t(n) AS (SELECT b FROM e JOIN s ON e.a = s.id UNION SELECT e.b FROM e JOIN t ON e.a = t.n) SELECT n AS node_id FROM t WHERE n NOT IN (SELECT id FROM s)"""


ORACLE = {
    "demo_orders_enriched": "SELECT orders.*, c_custkey, c_name, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_totalprice > 0",
    "source_parquet_project": "SELECT c_custkey, upper(c_name) AS name, c_acctbal FROM customer",
    "filter_sql_condition": "SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 1000",
    "filter_null_condition": "SELECT * FROM (SELECT o_orderkey, nullif(o_custkey % 10, 0) AS k, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders) WHERE status <> 'F' OR k > 5",
    "join_inner_lookup": f"SELECT o_orderkey, o_custkey, c_custkey, c_name, c_nationkey FROM orders JOIN {_C} c ON o_custkey = c_custkey",
    "join_left_lookup": f"SELECT o_orderkey, o_custkey, c_custkey, c_name, c_nationkey FROM orders LEFT JOIN {_C} c ON o_custkey = c_custkey",
    "join_lookup_last_wins": f"SELECT p_partkey, p_name, l_partkey, {_O} FROM part JOIN {_LAST} l ON p_partkey = l_partkey",
    "join_overlap_coalesce": "SELECT a.o_orderkey, coalesce(CASE WHEN a.o_orderkey % 3 = 0 THEN NULL ELSE a.o_orderstatus END, lower(b.o_orderpriority)) AS s, b.o_totalprice FROM orders a LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 20000) b ON a.o_orderkey = b.o_orderkey",
    "join_right": f"WITH {_S} SELECT s.k, c_acctbal, n FROM r RIGHT JOIN s ON r.k = s.k",
    "join_full": f"WITH {_S} SELECT coalesce(r.k, s.k) AS k, c_acctbal, n FROM r FULL JOIN s ON r.k = s.k",
    "join_semi": f"WITH {_S} SELECT * FROM r WHERE k IN (SELECT k FROM s)",
    "join_anti": f"WITH {_S} SELECT * FROM r WHERE k NOT IN (SELECT k FROM s)",
    "join_multi_key": "SELECT a.*, b.p, b.s, returns FROM (SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS returns FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) b ON l_partkey = p AND l_suppkey = s",
    "join_asof": "SELECT event_id, b.user_id, ts, seen AS right_seen FROM (SELECT * FROM events WHERE event_type = 'purchase') b ASOF LEFT JOIN (SELECT user_id, ts AS seen FROM events WHERE event_type = 'view') v ON b.user_id = v.user_id AND b.ts >= v.seen",
    "join_range": "SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice BETWEEN s_acctbal * 10 AND s_acctbal * 10 + 200",
    "quality_not_null": f"WITH {_Q} SELECT count(*) AS total, count(CASE WHEN f1 THEN 1 END) AS failed FROM x",
    "quality_range": f"WITH {_Q} SELECT count(*) AS total, count(CASE WHEN f2 THEN 1 END) AS failed FROM x",
    "quality_regex": f"WITH {_Q} SELECT count(*) AS total, count(CASE WHEN f3 THEN 1 END) AS failed FROM x",
    "quality_freshness": f"WITH {_Q} SELECT count(*) AS total, count(CASE WHEN f4 THEN 1 END) AS failed FROM x",
    "quality_report_summary": f"WITH {_Q}, {_V}, c AS (SELECT field, rule, count(*) AS total, count(CASE WHEN bad THEN 1 END) AS failed FROM v GROUP BY field, rule) SELECT field, rule, total - failed AS passed, failed, round((total - failed) / total::DOUBLE, 6) AS pass_rate, (total - failed) / total::DOUBLE >= 0.95 AS meets_threshold FROM c",
    "quality_violations": f"WITH {_Q}, {_V} SELECT o_orderkey, field, rule, CASE rule WHEN 'NOT_NULL' THEN 'null or blank' WHEN 'RANGE' THEN 'not a number from 2000 to 400000' WHEN 'REGEX' THEN 'does not match [FO]' ELSE 'older than 8760 hours or no time' END AS reason FROM v WHERE bad",
    "quality_unique": "SELECT coalesce(sum(n), 0)::BIGINT AS failed FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "quality_referential": f"SELECT count(*) AS failed FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM {_C})",
    "quality_distribution": "SELECT round(sum((a - e) * ln(a / e)), 8) AS psi FROM (SELECT count(*) / (SELECT count(*) FROM orders)::DOUBLE AS a, CASE o_orderstatus WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.4 WHEN 'P' THEN 0.1 ELSE 0.0001 END::DOUBLE AS e FROM orders GROUP BY o_orderstatus)",
    "select_rename": "SELECT n_nationkey AS id, n_name AS nation FROM nation",
    "select_expressions": "SELECT o_orderkey, year(o_orderdate)::INT AS year, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice * 1.1 AS price, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size, split_part(o_orderpriority, '-', 1) AS priority, length(regexp_replace(o_orderpriority, '[^A-Z]', '', 'g'))::INT AS letters FROM orders",
    "derive_columns": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net, l_extendedprice < 10000 AS cheap FROM lineitem",
    "aggregate_groupby": f"SELECT l_returnflag, l_linestatus, {_N}, count(DISTINCT l_partkey) AS parts, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1, 2",
    "aggregate_having": f"SELECT l_suppkey, {_N} FROM lineitem GROUP BY 1 HAVING round(sum(l_quantity), 2) > 15000 OR count(*) % 2 = 0",
    "agg_rollup": f"SELECT l_returnflag, l_linestatus, {_N}, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": f"SELECT l_returnflag, l_linestatus, {_N}, grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT l_returnflag, l_suppkey, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_suppkey), ())",
    "window_rank": "SELECT o_orderkey, o_custkey, o_totalprice, (rank() OVER w)::INT AS place, (dense_rank() OVER w)::INT AS dense, (ntile(4) OVER w)::INT AS quarter, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
    "window_running": f"SELECT *, (sum(cents) OVER w)::BIGINT AS running, count(*) OVER w AS seen FROM ({_W}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)",
    "window_frame": f"SELECT *, (sum(cents) OVER w)::BIGINT AS nearby, max(cents) OVER w AS most FROM ({_W}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "distinct_rows": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "distinct_by_key": f"SELECT l_partkey, {_O} FROM {_LAST}",
    "union_all": f"SELECT * FROM {_A} UNION ALL SELECT * FROM {_B}",
    "union_distinct": f"SELECT * FROM {_A} UNION SELECT * FROM {_B}",
    "intersect_distinct": f"SELECT * FROM {_A} INTERSECT SELECT * FROM {_B}",
    "intersect_all": f"SELECT * FROM {_A} INTERSECT ALL SELECT * FROM {_B}",
    "except_distinct": f"SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}",
    "except_all": f"SELECT * FROM {_A} EXCEPT ALL SELECT * FROM {_B}",
    "sql_named_params": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000",
    "sql_cte_subquery": "WITH spend AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_orderkey, n FROM orders JOIN spend USING (o_custkey) WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders) AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)",
    "sql_recursive": "WITH RECURSIVE steps(n, k) AS (SELECT 0, 1::BIGINT UNION ALL SELECT n + 1, k * 2 FROM steps WHERE n < 12) SELECT n, k, c_name FROM steps JOIN customer ON c_custkey = k",
    "upsert_merge": "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 250000 OR o_orderstatus <> 'P'",
    "kafka_payload": "SELECT coalesce(nullif(user_id % 50, 0)::VARCHAR, 'null') AS key, event_id, event_type FROM events",
    "kafka_parse": "SELECT event_id, user_id, event_type, event_id AS _kafka_offset, (event_id % 4)::INT AS _kafka_partition, event_id * 1000 AS _kafka_timestamp FROM events WHERE event_id % 20 <> 0",
    "json_props_extract": "SELECT event_id, props->>'$.k' AS k, len(json_keys(props))::BIGINT AS n_keys FROM events",
    "lineage_downstream": _reach("raw", "source_node_id", "target_node_id"),
    "lineage_upstream": _reach("mart", "target_node_id", "source_node_id"),
    "lineage_sources": "SELECT DISTINCT id AS node_id FROM lineage_nodes WHERE id NOT IN (SELECT target_node_id FROM lineage_edges WHERE target_node_id IS NOT NULL)",
    "events_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL",
    "events_sliding": "SELECT s AS window_start, s + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS s FROM events) GROUP BY ALL",
    "events_session": """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, s.n""",
}
