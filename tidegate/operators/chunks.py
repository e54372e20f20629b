"""Splitting hot keys of ordered data into bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.session import cut_and_count

#: Keys above this many rows are split along their order column into chunks of about so many.
TARGET_ROWS = 250_000
#: Bounds between those that are asked first.
STRIDE = 64
#: Tables of bounds with at most so many rows are broadcast; larger ones are joined.
BROADCAST_ROWS = 10_000


class Bounds:
    """Per hot key the bounds of its chunks. All bounds together are at most the rows over the target."""

    def __init__(self, rows: DataFrame, hot_keys: int):
        self.rows, self.hot_keys = rows, hot_keys

    def side(self) -> DataFrame:
        return F.broadcast(self.rows) if self.hot_keys <= BROADCAST_ROWS else self.rows


def hot_bounds(df: DataFrame, key: str, order: str, target: int = TARGET_ROWS) -> Bounds | None:
    """Per key with more than ``target`` rows the chunk bounds along ``order``; None if there is no such key.

    Bounds are approximate quantiles, so chunks hold about ``target`` rows, however many the key has. Rows of
    one and the same order stay together.
    """
    counts = df.groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > target)
    if counts.isEmpty():
        return None
    keys, hot = cut_and_count(counts, "n > 0")
    # All keys are measured on the finest grid that one needs; each takes as many of its points as it has chunks.
    grid = keys.agg(F.ceil(F.max("n") / target)).first()[0]
    marks = [i / grid for i in range(1, grid)]
    side = F.broadcast(keys) if hot <= BROADCAST_ROWS else keys
    points = df.join(side, F.col(key).eqNullSafe(F.col("hot_key"))).groupBy("hot_key").agg(F.percentile_approx(order, marks, max(2000, 10 * grid)).alias("points"), F.first("n").alias("n"))
    step = F.greatest(F.lit(1), F.floor(grid / F.ceil(F.col("n") / target))).cast("int")
    picked = F.filter("points", lambda p, i: (i + 1) % step == 0)
    sorted_ = points.select("hot_key", F.array_sort(F.array_distinct(picked)).alias("bounds"))
    rows, _ = cut_and_count(sorted_.select("hot_key", F.struct("bounds", F.filter("bounds", lambda _, i: i % STRIDE == STRIDE - 1).alias("coarse")).alias("bounds")), "true")
    return Bounds(rows, hot)


def with_bounds(df: DataFrame, key: str, bounds: Bounds | None, order_type: str = "bigint") -> DataFrame:
    """Attach ``bounds`` (null for keys that are not hot)."""
    if bounds is None:
        return df.withColumn("bounds", F.lit(None).cast(f"struct<bounds: array<{order_type}>, coarse: array<{order_type}>>"))
    return df.join(bounds.side(), F.col(key).eqNullSafe(F.col("hot_key")), "left").drop("hot_key")


def chunk_of(value: Column, bounds: Column) -> Column:
    """How many bounds are at or below ``value``; 0 without bounds. Every STRIDE-th is asked first, then those after it."""
    upto = lambda a: F.size(F.filter(a, lambda b: b <= value))
    passed = upto(bounds["coarse"]) * STRIDE
    return F.coalesce(passed + upto(F.slice(bounds["bounds"], passed + 1, F.lit(STRIDE))), F.lit(0))


def bound(bounds: Column, at: Column) -> Column:
    """The bound at a place, null beyond the last."""
    return F.get(bounds["bounds"], at)
