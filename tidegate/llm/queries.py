"""The pN_ queries of the llm problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.llm import languages, leakage, mixture, percentiles
from tidegate.session import table

#: Guaranteed relative error of the percentile queries, and the points they report.
ERROR, POINTS = 0.01, [0.5, 0.9, 0.95, 0.99]


MEASURES = ("latency_ms", "rows_written")
#: Stands for the day of rows that never began.
NO_DAY = -(2**31)


def _sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of latency_ms and rows_written by step and day, over all rows as delivered.

    Days and measures are numbers until the end, which makes the rows that are shuffled short.
    """
    steps = table(spark, sf_dir, "step_executions").select("step_id", F.coalesce(F.unix_date(F.col("started_at").cast("date")), F.lit(NO_DAY)).alias("day"), *MEASURES)
    both = F.explode(F.array(*[F.struct(F.lit(i).cast("tinyint").alias("measure"), F.col(m).alias("value")) for i, m in enumerate(MEASURES)]))
    long = steps.select("step_id", "day", both.alias("m")).select("step_id", "day", "m.measure", "m.value")
    return percentiles.sketch(long, ["step_id", "day", "measure"], "value", ERROR)


def _named(df: DataFrame, no_day: str | None = None) -> DataFrame:
    """Days and measures as text, percentiles rounded. A null day stays null."""
    columns = {"measure": F.element_at(F.array(*map(F.lit, MEASURES)), F.col("measure").cast("int") + 1)}
    if "day" in df.columns:
        columns["day"] = F.when(F.col("day") == NO_DAY, F.lit(no_day)).otherwise(F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd"))
    return df.withColumns(columns | {c: F.round(c, 2) for c in df.columns if c[0] == "p" and c[1:].isdigit()})


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by step and day, and over all days (null day) from the merged sketches of the days."""
    days = _sketches(spark, sf_dir)
    whole = percentiles.merge(days, ["step_id", "measure"]).select("step_id", F.lit(None).cast("int").alias("day"), "measure", "sign", "index", "n")
    # The day of steps that never began has a name, so that it stays apart from the sum.
    return _named(percentiles.percentiles(days.unionByName(whole), ["step_id", "day", "measure"], POINTS, ERROR), "none")


def p2_step_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by step, merged from the sketches of the days."""
    days = _sketches(spark, sf_dir)
    return _named(percentiles.percentiles(percentiles.merge(days, ["step_id", "measure"]), ["step_id", "measure"], POINTS, ERROR))


def p2_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by step and day."""
    return _named(percentiles.percentiles(_sketches(spark, sf_dir), ["step_id", "day", "measure"], POINTS, ERROR))


def p2_daily_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form itself: counts by step, day, measure and bucket."""
    return _named(_sketches(spark, sf_dir))


#: The rank file of a public byte-level tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Tokens of an output shard.
SHARD_TOKENS = 1 << 18


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), TOKENIZER, shard_tokens=SHARD_TOKENS)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of a chosen record, in the order of its output shard."""
    return _mixture(spark, sf_dir)[0]


def p8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen records and how often each is used."""
    return _mixture(spark, sf_dir)[0].groupBy("doc_id", "source", "tokens").agg(F.count(F.lit(1)).alias("repeats"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mixture(spark, sf_dir)[1]


def p8_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target source: its documents, whether each use is one and within the cap, and whether its tokens are its share to within two records."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    mixture_, report = _mixture(spark, sf_dir)
    uses = mixture_.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("repeat_no").alias("last"), F.max("tokens").alias("tokens"))
    uses = uses.groupBy("source").agg(F.max("n").alias("most"), F.min(F.col("n") == F.col("last")).alias("single"), F.max("tokens").alias("largest"))
    total = Window.partitionBy()  # a row per source
    checked = report.join(uses, "source", "left").withColumn("room", 2 * F.max("largest").over(total)).withColumn("off", F.abs(F.col("tokens") - F.col("scaled_share") * F.sum("tokens").over(total)))
    there = documents.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return targets.select("source").join(there, "source", "left").join(checked, "source", "left").select(
        "source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_cap"),
        F.coalesce("single", F.lit(True)).alias("single"), F.coalesce(F.col("off") <= F.col("room"), F.lit(True)).alias("near"),
    )


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = languages.trained(*languages.training_pairs(documents, [table(spark, sf_dir, "lang_samples")]))
    return languages.passages(documents, net)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the documents whose label is missing or wrong or that hold several languages."""
    return languages.language_cases(_passages(spark, sf_dir))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage with its language and confidence, beside the document's own."""
    return _passages(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 successive words, or all words, of an evaluation item."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbatim and re-parameterised leaks with the share of the item that occurs."""
    return leakage.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_step_percentiles, p2_daily_percentiles, p2_daily_sketches, p7_found, p7_leak_report, p8_mixture, p8_records, p8_shares, p8_sound, p9_found, p9_passages)}

_G = (1 + ERROR) / (1 - ERROR)
_BUCKETS = f"""
v AS (SELECT step_id, strftime(started_at, '%Y-%m-%d') AS day, unnest(['latency_ms', 'rows_written']) AS measure, unnest([latency_ms, rows_written])::DOUBLE AS value FROM step_executions),
b AS (SELECT step_id, day, measure, sign(value)::INT AS sign, CASE WHEN value = 0 THEN 0 ELSE ceil(ln(abs(value)) / ln({_G!r}))::INT END AS index FROM v WHERE value IS NOT NULL)
"""


def _percentile_sql(groups: str, day: str = "day") -> str:
    picks = ", ".join(f"round(max(CASE WHEN upto > floor({p} * (total - 1)) AND upto - n <= floor({p} * (total - 1)) THEN middle END), 2) AS p{p * 100:g}" for p in POINTS)
    return f"""WITH {_BUCKETS}, d AS (SELECT step_id, {day}, measure, sign, index FROM b), s AS (SELECT {groups}, sign, index, count(*) AS n FROM d GROUP BY {groups}, sign, index),
        c AS (SELECT {groups}, n, sign * pow({_G!r}, index) * {2 / (_G + 1)!r} AS middle, sum(n) OVER (PARTITION BY {groups} ORDER BY sign, sign * index) AS upto, sum(n) OVER (PARTITION BY {groups}) AS total FROM s)
        SELECT {groups}, max(total)::BIGINT AS n, {picks} FROM c GROUP BY {groups}"""


ORACLE = {
    "p2_percentiles": f"""{_percentile_sql("step_id, day, measure", "coalesce(day, 'none') AS day")} UNION ALL BY NAME SELECT *, NULL::VARCHAR AS day FROM ({_percentile_sql("step_id, measure")})""",
    "p8_sound": "SELECT t.source, count(d.doc_id) AS documents, true AS within_cap, true AS single, true AS near FROM mix_targets t LEFT JOIN documents d USING (source) GROUP BY t.source",
    "p2_step_percentiles": _percentile_sql("step_id, measure"),
    "p2_daily_percentiles": _percentile_sql("step_id, day, measure"),
    "p2_daily_sketches": f"WITH {_BUCKETS} SELECT step_id, day, measure, sign, index, count(*) AS n FROM b GROUP BY ALL",
}
