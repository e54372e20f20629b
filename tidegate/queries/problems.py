"""The pN_ queries of the general problems and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.dedup import exactly_once
from tidegate.operators.dedup_store import DedupStore
from tidegate.operators.drift import schema_changes, unified_records
from tidegate.operators.hierarchy import hierarchy
from tidegate.operators.intervals import merge_intervals
from tidegate.operators.rolling import rolling_totals
from tidegate.session import shared_dir, table

STATES = ["CREATED", "VALIDATED", "RUNNING", "COMPLETED", "FAILED", "RESUMING"]
WINDOWS = [1, 7, 30]


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "step_executions").select("execution_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("a"), F.unix_micros(F.col("finished_at").cast("timestamp")).alias("b"))
    return merge_intervals(steps, "execution_id", "a", "b")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running periods and idle gaps of each execution."""
    return _intervals(spark, sf_dir)


def p1_busy_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per execution: periods, gaps, microseconds running and idle."""
    gap = F.col("kind") == "gap"
    length = F.col("end_us") - F.col("start_us")
    return _intervals(spark, sf_dir).groupBy("execution_id").agg(
        F.count_if(~gap).alias("periods"), F.count_if(gap).alias("gaps"),
        F.sum(F.when(~gap, length)).alias("busy_us"), F.coalesce(F.sum(F.when(gap, length)), F.lit(0)).alias("idle_us"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every schema change of every dataset from one run to the next."""
    return schema_changes(table(spark, sf_dir, "lineage_nodes"), table(spark, sf_dir, "pipeline_executions")).select("dataset_name", "execution_id", "change", "field_before", "field_after")


def p3_unified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records brought to the last schema of their dataset, by chained migrations."""
    return unified_records(table(spark, sf_dir, "raw_records"), table(spark, sf_dir, "lineage_nodes"), table(spark, sf_dir, "pipeline_executions"))


def p3_record_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each dataset are whole, broken or without a run."""
    return p3_unified_records(spark, sf_dir).groupBy("dataset_name", "status").agg(F.count(F.lit(1)).alias("n"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactly_once(table(spark, sf_dir, "kafka_orders"), ["topic", "_kafka_partition", "_kafka_offset"], F.unix_date(F.col("polled_at").cast("date")), ["polled_at", "batch_id"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers that came more than once."""
    return _messages(spark, sf_dir).filter("copies > 1").select("topic", "_kafka_partition", "_kafka_offset")


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one row per identifier: the first delivery, and how often it came."""
    return _messages(spark, sf_dir).select("topic", "_kafka_partition", "_kafka_offset", "polled_at", "copies")


BATCHES = 4


def p4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages kept when the polls come in as batches, one after another, through a store; the second batch comes twice."""
    orders = table(spark, sf_dir, "kafka_orders")
    first, last = orders.agg(F.min(F.unix_micros(F.col("polled_at").cast("timestamp"))), F.max(F.unix_micros(F.col("polled_at").cast("timestamp")))).first()
    first, last = first or 0, last or 0
    at = F.coalesce(F.floor((F.unix_micros(F.col("polled_at").cast("timestamp")) - first) * BATCHES / (last - first + 1)), F.lit(0))
    store = DedupStore(spark, f"{shared_dir(spark)}/tidegate-store-{uuid.uuid4().hex}", ["topic", "_kafka_partition", "_kafka_offset"])
    kept = []
    for n in (0, 1, 1, *range(2, BATCHES)):
        fresh = store.ingest(orders.filter(at == n), str(n), F.unix_date(F.col("polled_at").cast("date")), ["polled_at", "batch_id"])
        kept = [*kept[:n], fresh]  # a batch that comes again takes its own place
    return reduce(DataFrame.unionByName, kept).select("topic", "_kafka_partition", "_kafka_offset", "polled_at")


def _hierarchy(spark: SparkSession, sf_dir: str, paths: bool) -> DataFrame:
    nodes = table(spark, sf_dir, "lineage_nodes").select("id", F.concat_ws(".", "dataset_name", "field_name").alias("label"))
    return hierarchy(nodes, table(spark, sf_dir, "lineage_edges").select(F.col("source_node_id").alias("parent"), F.col("target_node_id").alias("child")), paths)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, depth and status of each node that has a parent."""
    return _hierarchy(spark, sf_dir, False).filter("parent_id is not null").select("node_id", "root_id", "depth", "status")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its path, depth, root and the interval that its descendants' numbers fill."""
    return _hierarchy(spark, sf_dir, True).select("node_id", "root_id", "depth", "status", "path", "n_descendants", "tree_no", "descendants_from", "descendants_to")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its path, depth, root and number of descendants."""
    return _hierarchy(spark, sf_dir, True).select("node_id", "root_id", "depth", "status", "path", "n_descendants")


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs (once each, in their furthest state) and the rows their steps rejected, by start day."""
    state = F.upper(F.trim("state"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ["CREATED", "VALIDATED", "RUNNING", "RESUMING", "FAILED", "COMPLETED"])), state), F.lit(0))
    runs = (
        table(spark, sf_dir, "pipeline_executions").filter(F.col("started_at").isNotNull())
        .groupBy("id").agg(F.max("pipeline_id").alias("pipeline_id"), F.min("started_at").alias("started_at"), F.max(rank).alias("rank"))
    )
    rejected = (
        table(spark, sf_dir, "step_executions")
        .groupBy("id", "execution_id").agg(F.max("rows_rejected").alias("rows_rejected"))
        .groupBy("execution_id").agg(F.sum("rows_rejected").alias("rows_rejected"))
    )
    names = ["CREATED", "VALIDATED", "RUNNING", "RESUMING", "FAILED", "COMPLETED"]
    return runs.join(rejected, runs["id"] == rejected["execution_id"], "left").select(
        "pipeline_id", F.col("started_at").cast("date").alias("day"), F.lit(1).cast("bigint").alias("runs"),
        *[(F.col("rank") == i + 1).cast("bigint").alias(f"runs_{n.lower()}") for i, n in enumerate(names)],
        F.coalesce("rows_rejected", F.lit(0)).alias("rows_rejected"),
    )


MEASURES = ["runs", *(f"runs_{n.lower()}" for n in STATES), "rows_rejected"]


def p6_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, runs by state and rejected rows of the trailing 7 and 30 days, for every day of a pipeline."""
    out = rolling_totals(_activity(spark, sf_dir), "pipeline_id", "day", MEASURES, [7, 30])
    return out.select("pipeline_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days", *MEASURES, F.round("runs_per_day", 6).alias("runs_per_day"), F.round("rows_rejected_per_day", 3).alias("rows_rejected_per_day"))


def p6_rolling_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every total of p6_rolling_totals as an average per day of its period."""
    out = rolling_totals(_activity(spark, sf_dir), "pipeline_id", "day", MEASURES, [7, 30])
    return out.select("pipeline_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days", *[F.round(f"{m}_per_day", 3 if m == "rows_rejected" else 6).alias(f"{m}_per_day") for m in MEASURES])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a pipeline's life without any run in the trailing 1, 7 or 30 days."""
    runs = table(spark, sf_dir, "pipeline_executions").filter(F.col("started_at").isNotNull()).select("pipeline_id", F.col("started_at").cast("date").alias("day"), F.lit(1).alias("runs"))
    return rolling_totals(runs, "pipeline_id", "day", ["runs"], WINDOWS).filter("runs = 0").select("pipeline_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_days")


QUERIES = {f.__name__: f for f in (p1_found, p1_busy_share, p3_found, p3_unified_records, p3_record_status, p4_found, p4_messages, p4_batches, p5_found, p5_hierarchy, p5_paths, p6_found, p6_rolling_totals, p6_rolling_averages)}

_ISLANDS = """
i AS (SELECT DISTINCT execution_id, epoch_us(started_at) a, epoch_us(finished_at) b FROM step_executions WHERE finished_at > started_at),
m AS (SELECT *, max(b) OVER (PARTITION BY execution_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY execution_id ORDER BY a, b) AS n FROM m),
p AS (SELECT execution_id, n, min(a) AS start_us, max(b) AS end_us FROM g GROUP BY execution_id, n),
f AS (SELECT execution_id, 'period' AS kind, start_us, end_us FROM p
      UNION ALL SELECT * FROM (SELECT execution_id, 'gap', lag(end_us) OVER (PARTITION BY execution_id ORDER BY n) AS start_us, start_us AS end_us FROM p) WHERE start_us IS NOT NULL)
"""

_RUNS = """
r AS (SELECT id, max(pipeline_id) AS pipeline_id, min(started_at) AS started_at,
      max(CASE upper(trim(state)) WHEN 'CREATED' THEN 1 WHEN 'VALIDATED' THEN 2 WHEN 'RUNNING' THEN 3 WHEN 'RESUMING' THEN 4 WHEN 'FAILED' THEN 5 WHEN 'COMPLETED' THEN 6 ELSE 0 END) AS k
      FROM pipeline_executions WHERE started_at IS NOT NULL GROUP BY id),
s AS (SELECT execution_id, sum(rr)::BIGINT AS rr FROM (SELECT id, execution_id, max(rows_rejected) AS rr FROM step_executions GROUP BY id, execution_id) GROUP BY execution_id),
d AS (SELECT pipeline_id, started_at::DATE AS day, k, coalesce(rr, 0) AS rr FROM r LEFT JOIN s ON r.id = s.execution_id),
c AS (SELECT pipeline_id, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY pipeline_id),
w AS (SELECT unnest([7, 30])::BIGINT AS window_days)
"""

_SUMS = ", ".join(f"count(CASE WHEN d.k = {k} THEN 1 END) AS runs_{n}" for n, k in (("created", 1), ("validated", 2), ("running", 3), ("completed", 6), ("failed", 5), ("resuming", 4)))

_MEANS = ", ".join(f"round(count(CASE WHEN d.k = {k} THEN 1 END) / window_days::DOUBLE, 6) AS runs_{n}_per_day" for n, k in (("created", 1), ("validated", 2), ("running", 3), ("completed", 6), ("failed", 5), ("resuming", 4)))

_LINKS = """ids AS (SELECT DISTINCT id FROM lineage_nodes),
        l AS (SELECT target_node_id AS c, min(source_node_id) AS p FROM lineage_edges WHERE source_node_id IN (SELECT id FROM ids) AND target_node_id IN (SELECT id FROM ids) GROUP BY 1),
        t(n, r, d) AS (SELECT c, p, 1::BIGINT FROM l WHERE p NOT IN (SELECT c FROM l) UNION ALL SELECT l.c, t.r, t.d + 1 FROM l JOIN t ON l.p = t.n),
        u AS (SELECT * FROM l WHERE c NOT IN (SELECT n FROM t)),
        w(v, a) AS (SELECT c, p FROM u UNION SELECT w.v, u.p FROM w JOIN u ON w.a = u.c),
        y AS (SELECT v, min(a) AS r FROM w WHERE v IN (SELECT v FROM w WHERE v = a) GROUP BY v),
        b(n, r, d) AS (SELECT v, r, 0::BIGINT FROM y UNION ALL SELECT u.c, b.r, b.d + 1 FROM u JOIN b ON u.p = b.n WHERE u.c NOT IN (SELECT v FROM y))"""

ORACLE = {
    "p1_found": f"WITH {_ISLANDS} SELECT * FROM f",
    "p1_busy_share": f"""WITH {_ISLANDS} SELECT execution_id, count(CASE WHEN kind = 'period' THEN 1 END) AS periods, count(CASE WHEN kind = 'gap' THEN 1 END) AS gaps,
        sum(CASE WHEN kind = 'period' THEN end_us - start_us END)::BIGINT AS busy_us, coalesce(sum(CASE WHEN kind = 'gap' THEN end_us - start_us END), 0)::BIGINT AS idle_us FROM f GROUP BY execution_id""",
    "p3_found": """WITH st AS (SELECT id, min(started_at) AS s FROM pipeline_executions WHERE started_at IS NOT NULL GROUP BY id),
        f AS (SELECT lower(trim(dataset_name)) AS d, execution_id AS e, lower(trim(field_name)) AS n, min(id) AS i, max(lower(trim(data_type))) AS t FROM lineage_nodes GROUP BY 1, 2, 3),
        g AS (SELECT f.*, s, row_number() OVER (PARTITION BY d, e ORDER BY i) AS place, last_value(t IGNORE NULLS) OVER (PARTITION BY d, n ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM f JOIN st ON e = st.id),
        x AS (SELECT d, e, lag(e) OVER (PARTITION BY d ORDER BY s, e) AS before FROM (SELECT DISTINCT d, e, s FROM g)),
        o AS (SELECT x.d, x.e, g.n, g.place, g.k FROM x JOIN g ON g.d = x.d AND g.e = x.before),
        w AS (SELECT x.d, x.e, g.n, g.place, g.k FROM x JOIN g ON g.d = x.d AND g.e = x.e WHERE before IS NOT NULL),
        gone AS (SELECT * FROM o ANTI JOIN w USING (d, e, n)), come AS (SELECT * FROM w ANTI JOIN o USING (d, e, n)),
        r AS (SELECT d, e, gone.n AS a, come.n AS b FROM gone JOIN come USING (d, e, place, k))
        SELECT d AS dataset_name, e AS execution_id, 'renamed' AS change, a AS field_before, b AS field_after FROM r
        UNION ALL SELECT d, e, 'removed', n, '' FROM gone WHERE (d, e, n) NOT IN (SELECT (d, e, a) FROM r)
        UNION ALL SELECT d, e, 'added', '', n FROM come WHERE (d, e, n) NOT IN (SELECT (d, e, b) FROM r)
        UNION ALL SELECT d, e, 'type_changed', n, n FROM o JOIN w USING (d, e, n) WHERE o.k <> w.k""",
    "p3_record_status": """WITH st AS (SELECT DISTINCT id FROM pipeline_executions WHERE started_at IS NOT NULL)
        SELECT lower(trim(dataset_name)) AS dataset_name, CASE WHEN payload IS NULL OR NOT json_valid(payload) OR json_type(CASE WHEN json_valid(payload) THEN payload END) <> 'OBJECT' THEN 'broken'
        WHEN execution_id NOT IN (SELECT id FROM st) OR execution_id IS NULL THEN 'no_run' ELSE 'whole' END AS status, count(*) AS n FROM raw_records GROUP BY 1, 2""",
    "p5_found": f"""WITH RECURSIVE {_LINKS}
        SELECT n AS node_id, r AS root_id, d AS depth, 'tree' AS status FROM t
        UNION ALL SELECT n, r, d, CASE WHEN d = 0 THEN 'cycle' ELSE 'below_cycle' END FROM b""",
    "p5_paths": f"""WITH RECURSIVE {_LINKS},
        f AS (SELECT * FROM l WHERE c NOT IN (SELECT v FROM y)),
        m AS (SELECT id, min(concat_ws('.', dataset_name, field_name)) AS label FROM lineage_nodes GROUP BY id),
        g(n, top, d, path) AS (SELECT id, id, 0::BIGINT, label FROM m WHERE id NOT IN (SELECT c FROM f) UNION ALL SELECT f.c, g.top, g.d + 1, g.path || ' > ' || m.label FROM f JOIN g ON f.p = g.n JOIN m ON m.id = f.c),
        a(n, up) AS (SELECT c, p FROM f UNION ALL SELECT a.n, f.p FROM a JOIN f ON a.up = f.c),
        z AS (SELECT up, count(*) AS n FROM a GROUP BY up)
        SELECT g.n AS node_id, coalesce(y.r, g.top) AS root_id, g.d AS depth, CASE WHEN y.v IS NULL THEN 'tree' WHEN g.d = 0 THEN 'cycle' ELSE 'below_cycle' END AS status, path, coalesce(z.n, 0) AS n_descendants
        FROM g LEFT JOIN y ON y.v = g.top LEFT JOIN z ON z.up = g.n""",
    "p4_found": "SELECT topic, _kafka_partition, _kafka_offset FROM kafka_orders GROUP BY ALL HAVING count(*) > 1",
    "p4_messages": "SELECT topic, _kafka_partition, _kafka_offset, min(polled_at) AS polled_at, count(*) AS copies FROM kafka_orders GROUP BY topic, _kafka_partition, _kafka_offset",
    "p4_batches": "SELECT topic, _kafka_partition, _kafka_offset, min(polled_at) AS polled_at FROM kafka_orders GROUP BY topic, _kafka_partition, _kafka_offset",
    "p6_found": """WITH d AS (SELECT DISTINCT pipeline_id, started_at::DATE AS day FROM pipeline_executions WHERE started_at IS NOT NULL),
        c AS (SELECT pipeline_id, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY pipeline_id),
        w AS (SELECT unnest([1, 7, 30])::BIGINT AS window_days)
        SELECT pipeline_id, strftime(day, '%Y-%m-%d') AS day, window_days FROM c, w
        WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.pipeline_id = c.pipeline_id AND d.day <= c.day AND d.day > c.day - window_days::INT)""",
    "p6_rolling_totals": f"""WITH {_RUNS} SELECT c.pipeline_id, strftime(c.day, '%Y-%m-%d') AS day, window_days, count(d.day) AS runs, {_SUMS},
        coalesce(sum(d.rr), 0)::BIGINT AS rows_rejected, round(count(d.day) / window_days::DOUBLE, 6) AS runs_per_day, round(coalesce(sum(d.rr), 0) / window_days::DOUBLE, 3) AS rows_rejected_per_day
        FROM c CROSS JOIN w LEFT JOIN d ON d.pipeline_id = c.pipeline_id AND d.day <= c.day AND d.day > c.day - window_days::INT GROUP BY c.pipeline_id, c.day, window_days""",
    "p6_rolling_averages": f"""WITH {_RUNS} SELECT c.pipeline_id, strftime(c.day, '%Y-%m-%d') AS day, window_days, round(count(d.day) / window_days::DOUBLE, 6) AS runs_per_day, {_MEANS},
        round(coalesce(sum(d.rr), 0) / window_days::DOUBLE, 3) AS rows_rejected_per_day
        FROM c CROSS JOIN w LEFT JOIN d ON d.pipeline_id = c.pipeline_id AND d.day <= c.day AND d.day > c.day - window_days::INT GROUP BY c.pipeline_id, c.day, window_days""",
}
