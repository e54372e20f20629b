"""Percentiles with bounded relative error from counts in logarithmic buckets.

A value v falls in bucket sign(v) * ceil(log(|v|) / log(g)) with g = (1 + e) / (1 - e); zero has
a bucket of its own. All values of a bucket lie within the factor g, so its middle
2 g^i / (g + 1) is off by at most the relative error e. A sketch is a table of counts by bucket;
sketches of days, partitions or tables are put together by adding the counts.

Defined results:
* null values are not counted; NaN and infinities are not counted either (they have no bucket);
* values with |v| < ``smallest`` count as zero, so their error is absolute and below ``smallest``;
* a percentile p of n values is the value at rank floor(p * (n - 1)), counted from 0;
* a null group is a group; ties and repeated rows count as often as they occur; an empty table
  gives an empty sketch; other columns are ignored.

Counting is a map-side combined aggregate; a group has at most about 2 * log(largest / smallest)
/ log(g) buckets whatever its rows, so a hot group is no task's burden. All of it stays in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def growth(error: float) -> float:
    """The factor between bucket bounds for a relative error."""
    if not 0 < error < 1:
        raise ValueError("the relative error lies between 0 and 1")
    return (1 + error) / (1 - error)


def bucket_of(value: Column, error: float, smallest: float = 1e-9) -> Column:
    """(sign, index) of the bucket of a value; null for null, NaN and infinities."""
    v = value.cast("double")
    size = F.abs(v)
    sign = F.when(size < smallest, 0).otherwise(F.signum(v)).cast("int")
    index = F.when(size < smallest, 0).otherwise(F.ceil(F.log(size) / F.lit(math.log(growth(error))))).cast("int")
    usable = v.isNotNull() & ~F.isnan(v) & (size != float("inf"))
    return F.when(usable, F.struct(sign.alias("sign"), index.alias("index")))


def sketch(df: DataFrame, groups: list[str], value: str, error: float = 0.01, smallest: float = 1e-9) -> DataFrame:
    """(groups, sign, index, n): how many values of each group fall in each bucket."""
    rows = df.select(*groups, bucket_of(F.col(value), error, smallest).alias("__tg_b")).filter("__tg_b is not null")
    rows = rows.select(*groups, F.col("__tg_b.sign").alias("sign"), F.col("__tg_b.index").alias("index"))
    return rows.groupBy(*groups, "sign", "index").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of the same error put together over all columns but ``groups``."""
    return sketches.groupBy(*groups, "sign", "index").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: list[str], points: list[float], error: float = 0.01) -> DataFrame:
    """(groups, n, one column p<point> per point such as p50 or p99_9) from a merged sketch."""
    g = growth(error)
    order = F.col("sign") * F.col("index")
    w = Window.partitionBy(*groups).orderBy("sign", order)
    middle = F.col("sign") * F.pow(F.lit(g), F.col("index")) * F.lit(2 / (g + 1))
    placed = sketches.select(*groups, "n", middle.alias("middle"), F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(*groups)).alias("total"))
    picks = []
    for p in points:
        rank = F.floor(F.lit(p) * (F.col("total") - 1))
        picks.append(F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("middle"))).alias(f"p{p * 100:g}".replace(".", "_")))
    return placed.groupBy(*groups).agg(F.max("total").alias("n"), *picks)
