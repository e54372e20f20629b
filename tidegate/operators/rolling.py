"""Totals and averages over trailing periods of days, for every day of an entity's life.

Per entity and day the measures are summed, days without rows are filled in with the last
prefix sum, and the total of a trailing period is the difference of two prefix sums: the one of
the day and the one of the day just before the period.

Defined results:
* null days and null measures add nothing; a null entity is an entity like any other;
* the days go from the entity's first to its last day with a row, both included;
* a period that begins before the first day counts what there is; averages are per day of the
  period, so they divide by its full length;
* an empty table gives an empty result; repeated rows must be removed before (see ``exactly_once``
  or an aggregate), since every row counts.

All rows of an entity and day are added up before the shuffle. What follows sees one row per
entity and day, so a group is never longer than the entity's life in days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_prefix_sums(df: DataFrame, entity: str, day: str, measures: list[str]) -> DataFrame:
    """(entity, day, one prefix sum per measure, measure_before: the day's own sum), without missing days."""
    daily = df.filter(F.col(day).isNotNull()).groupBy(entity, day).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    w = Window.partitionBy(entity).orderBy(day)
    prefix = daily.select(entity, day, *[F.sum(m).over(w).alias(m) for m in measures], F.lead(day).over(w).alias("__tg_next"))
    last = F.coalesce(F.date_sub("__tg_next", 1), F.col(day))
    return prefix.select(entity, F.explode(F.sequence(F.col(day), last)).alias(day), *measures)


def rolling_totals(df: DataFrame, entity: str, day: str, measures: list[str], windows: list[int]) -> DataFrame:
    """(entity, day, window_days, <measure>, <measure>_per_day): trailing totals and averages in long form."""
    w = Window.partitionBy(entity).orderBy(day)
    prefix = daily_prefix_sums(df, entity, day, measures)
    # The days are complete, so the prefix sum n days back is n rows back.
    before = {(m, n): F.coalesce(F.lag(m, n).over(w), F.lit(0)) for m in measures for n in windows}
    spread = prefix.select(
        entity, day,
        F.array(*[F.struct(F.lit(n).cast("bigint").alias("window_days"), *[(F.col(m) - before[m, n]).alias(m) for m in measures]) for n in windows]).alias("__tg_w"),
    )
    return spread.select(entity, day, F.inline("__tg_w")).select("*", *[(F.col(m) / F.col("window_days")).alias(f"{m}_per_day") for m in measures])
