"""Joins: lookups that never multiply rows, and the relational kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate.operators.chunks import TARGET_ROWS, chunk_of, hot_bounds, with_bounds

KINDS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "SEMI": "left_semi", "LEFT_SEMI": "left_semi", "ANTI": "left_anti", "LEFT_ANTI": "left_anti", "CROSS": "cross"}


def _need(df: DataFrame, names: list[str], side: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"the {side} side has no column {', '.join(missing)}; it has {', '.join(df.columns)}")


class _Right:
    """The right side under names of its own, so that it may be the left side over again."""

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self.df = df.toDF(*[f"__tg_r{i}" for i in range(len(df.columns))])

    def __getitem__(self, name: str) -> Column:
        return self.df[f"__tg_r{self.columns.index(name)}"]


def _merged(left: DataFrame, right: _Right, left_on: list[str], right_on: list[str], on_conflict: str) -> list[Column]:
    """Left columns, then those of the right that are new; shared ones come from the left, nulls filled from the right."""
    out = []
    for c in left.columns:
        shared = c in right.columns and c not in right_on
        out.append(F.coalesce(left[c], right[c]).alias(c) if shared and on_conflict == "coalesce" else left[c])
    return out + [right[c].alias(c) for c in right.columns if c not in left.columns]


def lookup_join(
    left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str] | None = None, kind: str = "INNER",
    order_by: list[str] | None = None, right_unique: bool = False, on_conflict: str = "coalesce",
) -> DataFrame:
    """Each left row meets at most one right row.

    Of right rows with equal keys the one with the largest ``order_by`` counts; without ``order_by`` and
    ``right_unique`` that order is the whole row. Null keys match nothing. A column of both sides takes the
    left value, or the right one where that is null (``on_conflict``: ``coalesce`` or ``left``).
    """
    right_on = right_on or left_on
    kind = kind.upper()
    if kind not in ("INNER", "LEFT"):
        raise ValueError(f"a lookup join is INNER or LEFT, not {kind}")
    _need(left, left_on, "left")
    _need(right, right_on, "right")
    if not right_unique:
        rows = right.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in right_on))
        others = [c for c in right.columns if c not in right_on]
        if others:
            order = F.struct(*[f"`{c}`" for c in (order_by or others)])
            best = rows.groupBy(*right_on).agg(F.max_by(F.struct(*[f"`{c}`" for c in others]), order).alias("__tg_row"))
            right = best.select(*right_on, "__tg_row.*").select(*right.columns)
        else:
            right = rows.distinct()
    other = _Right(right)
    same = [left[a] == other[b] for a, b in zip(left_on, right_on)]
    return left.join(other.df, same, KINDS[kind]).select(*_merged(left, other, left_on, right_on, on_conflict))


def relational_join(
    left: DataFrame, right: DataFrame, left_on: list[str] | None = None, right_on: list[str] | None = None, kind: str = "INNER", on_conflict: str = "coalesce", condition: str | None = None,
) -> DataFrame:
    """A join of any kind: on equal keys, on a ``condition``, on both, or (CROSS) on nothing.

    For RIGHT and FULL the key columns hold whichever side's key is there. In a condition the columns go by ``l.name`` and
    ``r.name``; with nothing equal in it Spark compares all pairs.
    """
    left_on = left_on or []
    right_on = right_on or left_on
    how = KINDS.get(kind.upper())
    if how is None:
        raise ValueError(f"unknown join type {kind}; there are {', '.join(KINDS)}")
    if how == "cross" and (left_on or condition):
        raise ValueError("a CROSS join has no keys and no condition")
    if how != "cross" and not left_on and not condition:
        raise ValueError(f"a join of type {kind} needs keys or a condition")
    _need(left, left_on, "left")
    _need(right, right_on, "right")
    other = _Right(right)
    if how == "cross":
        return left.crossJoin(other.df).select(*_merged(left, other, [], [], on_conflict))
    same = [left[a] == other[b] for a, b in zip(left_on, right_on)]
    if condition:
        # Both sides as structs under the names l and r, so that the condition may name any column.
        wide = left.select("*", F.struct(*[left[c] for c in left.columns]).alias("l"))
        far = other.df.select("*", F.struct(*[F.col(f"__tg_r{i}").alias(c) for i, c in enumerate(right.columns)]).alias("r"))
        test = F.expr(condition)
        for a, b in zip(left_on, right_on):
            test = test & (F.col(f"l.`{a}`") == F.col(f"r.`{b}`"))
        joined = wide.join(far, test, how)
        if how in ("left_semi", "left_anti"):
            return joined.drop("l")
    else:
        joined = left.join(other.df, same, how)
        if how in ("left_semi", "left_anti"):
            return joined
    columns = _merged(left, other, left_on, right_on, on_conflict)
    if how in ("right", "full"):
        pairs = dict(zip(left_on, right_on))
        columns = [F.coalesce(left[c], other[c]).alias(c) if pairs.get(c) == c else col for c, col in zip([*left.columns, *[""] * len(columns)], columns)]
    return joined.select(*columns)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, prefix: str = "right_", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Each left row with the last right row of the same key that is not later; nulls where there is none.

    Both sides are brought into one ordered stream per key and the last right row is carried forward: one
    shuffle, no range join. Rows with a null time on the right are no candidates. A key with more than
    ``target_rows`` rows is cut into chunks of time; the last right row of each goes on to the chunks after it.
    """
    payload = [c for c in right.columns if c not in by]
    kind = right.select(F.struct(*payload)).schema[0].dataType
    left_kind = left.select(F.struct(*left.columns)).schema[0].dataType
    a = left.select(*by, F.col(left_time).alias("__tg_t"), F.lit(1).alias("__tg_side"), F.struct(*left.columns).alias("__tg_l"), F.lit(None).cast(kind).alias("__tg_r"))
    b = right.filter(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("__tg_t"), F.lit(0).alias("__tg_side"), F.lit(None).cast(left_kind).alias("__tg_l"), F.struct(*payload).alias("__tg_r"))
    rows = a.unionByName(b).withColumn("__tg_key", F.struct(*by))
    bounds = hot_bounds(rows, "__tg_key", "__tg_t", target_rows)
    keys = ["__tg_key"]
    if bounds is not None:
        rows = with_bounds(rows, "__tg_key", bounds).withColumn("__tg_chunk", chunk_of(F.col("__tg_t"), F.col("bounds"))).drop("bounds")
        keys = ["__tg_key", "__tg_chunk"]
    w = Window.partitionBy(*keys).orderBy("__tg_t", "__tg_side", "__tg_r").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.withColumn("__tg_last", F.last("__tg_r", ignorenulls=True).over(w)).filter("__tg_side = 1")
    if bounds is not None:
        # Every chunk with its last right row; chunks without one get null, as max_by leaves rows without an order out.
        chunks = rows.groupBy(*keys).agg(F.max_by("__tg_r", F.when(F.col("__tg_side") == 0, F.struct("__tg_t", "__tg_r"))).alias("__tg_end"))
        before = Window.partitionBy("__tg_key").orderBy("__tg_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = chunks.select(F.col("__tg_key").alias("__tg_key2"), F.col("__tg_chunk").alias("__tg_chunk2"), F.last("__tg_end", ignorenulls=True).over(before).alias("__tg_carried")).filter("__tg_carried is not null")
        met = F.col("__tg_key").eqNullSafe(F.col("__tg_key2")) & (F.col("__tg_chunk") == F.col("__tg_chunk2")) & F.col("__tg_t").isNotNull()
        last = last.join(carried, met, "left").withColumn("__tg_last", F.coalesce("__tg_last", "__tg_carried"))
    return last.select("__tg_l.*", *[F.col(f"__tg_last.{c}").alias(f"{prefix}{c}") for c in payload])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with low <= point <= high, found through buckets instead of comparing all pairs.

    Intervals up to ``width`` lie in buckets of that width, longer ones in buckets of twice, four times ... the width, so each
    lies in two buckets or three, however long it is; a point asks one bucket of each size that occurs.
    """
    length = F.col(high).cast("double") - F.col(low).cast("double")
    level = F.when(length <= width, 0).otherwise(F.ceil(F.log2(length / width))).cast("int")
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("__tg_level"))
    bucket = lambda c: F.floor(F.col(c) / size).cast("bigint")
    placed = right.filter(F.col(low) <= F.col(high)).withColumn("__tg_level", level)
    levels = [r[0] for r in placed.select("__tg_level").distinct().collect()]  # as many as doublings of the width occur
    placed = placed.withColumn("__tg_b", F.explode(F.sequence(bucket(low), bucket(high))))
    asked = left.withColumn("__tg_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__tg_b", bucket(point))
    return asked.join(placed, ["__tg_level", "__tg_b"]).filter(F.col(point).between(F.col(low), F.col(high))).drop("__tg_b", "__tg_level")
