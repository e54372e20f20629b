"""Counts and extremes of the points in each interval, without listing the pairs of points and intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.chunks import STRIDE, TARGET_ROWS, chunk_of
from tidegate.session import cut, cut_and_count


def _lowest(ranks: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The lowest rank in each [begin, end), which are not empty: the lower one of two overlapping runs of 2^k places."""
    runs = [ranks]
    for k in range(max(0, int((end - begin).max(initial=1)).bit_length() - 1)):
        runs.append(np.minimum(runs[-1][: -(1 << k)], runs[-1][1 << k :]))
    level = np.frexp((end - begin).astype("float64"))[1] - 1
    out = np.empty(len(begin), ranks.dtype)
    for k, run in enumerate(runs):
        at = level == k
        out[at] = np.minimum(run[begin[at]], run[end[at] - (1 << k)])
    return out


def _extreme(values: pa.ChunkedArray, begin: np.ndarray, end: np.ndarray, largest: bool) -> pa.Array:
    """The least or largest value in each [begin, end) that is not null; NaN is above all numbers, as in Spark."""
    values = values.combine_chunks()
    order = pc.sort_indices(values).to_numpy()  # numbers, NaN, nulls
    ranks = np.empty(len(order), "int64")
    ranks[order] = np.arange(len(order))
    if largest:
        ranks = -ranks
        ranks[values.is_null().to_numpy(zero_copy_only=False)] = len(order)
    found = _lowest(ranks, begin, end)
    if largest:
        found = np.where(found == len(order), len(order) - 1, -found)  # nulls have the last places
    return values.take(pa.array(order[found]))


def _in_chunk(points: pa.Table, pieces: pa.Table) -> pa.Table:
    """For each interval that has an end in this chunk its points in the chunk; and without an interval, all of them."""
    if not points.num_rows:
        return pa.table({c: pa.array([], t) for c, t in (("low", pieces["low"].type), ("high", pieces["high"].type), ("chunk", pieces["chunk"].type), ("n", pa.int64()), ("least", points["least"].type), ("most", points["most"].type))})
    points = points.take(pa.array(np.argsort(points["p"].to_numpy(), kind="stable")))
    at, upto = points["p"].to_numpy(), np.concatenate([[0], np.cumsum(points["n"].to_numpy())])
    begin, end = np.zeros(1, "int64"), np.full(1, len(at), "int64")
    low, high = pa.nulls(1, pieces["low"].type), pa.nulls(1, pieces["high"].type)
    if pieces.num_rows:
        a, b = np.searchsorted(at, pieces["low"].to_numpy(), "left"), np.searchsorted(at, pieces["high"].to_numpy(), "right")
        some = a < b
        begin, end = np.concatenate([begin, a[some]]), np.concatenate([end, b[some]])
        kept = pieces.filter(pa.array(some))
        low, high = (pa.concat_arrays([x, kept[c].combine_chunks()]) for x, c in ((low, "low"), (high, "high")))
    return pa.table({
        "low": low, "high": high, "chunk": pa.array(np.full(len(begin), points["chunk"][0].as_py()), points["chunk"].type), "n": pa.array(upto[end] - upto[begin], pa.int64()),
        "least": _extreme(points["least"], begin, end, False), "most": _extreme(points["most"], begin, end, True),
    })


def range_aggregate(left: DataFrame, right: DataFrame, point: str, low: str, high: str, value: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The rows of ``right`` that hold points (low <= point <= high), with ``n``, how many, and ``least`` and ``most``, their extreme ``value``.

    The points are cut into chunks of about ``target_rows`` different ones at quantiles. An interval looks its points up in
    the chunks of its two ends; the chunks between come from sums over 1, 2, 4 ... chunks. So the work grows with points and
    intervals, not with their pairs. Intervals that end in one and the same chunk are answered by one task.
    """
    own = left.filter(F.col(point).isNotNull()).groupBy(F.col(point).alias("p"))
    points, found = cut_and_count(own.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")), "true")
    grid, marks = -(-found // target_rows), []
    if grid > 1:
        marks = list(dict.fromkeys(points.agg(F.percentile_approx("p", [i / grid for i in range(1, grid)], max(2000, 10 * grid))).first()[0]))
    kind = points.schema["p"].dataType
    literal = lambda xs: F.array(*map(F.lit, xs)).cast(f"array<{kind.simpleString()}>")
    bounds = F.struct(literal(marks).alias("bounds"), literal(marks[STRIDE - 1 :: STRIDE]).alias("coarse"))
    spans = right.select(F.col(low).alias("low"), F.col(high).alias("high")).filter("low <= high").distinct()
    spans = spans.withColumn("a", chunk_of(F.col("low"), bounds)).withColumn("b", chunk_of(F.col("high"), bounds))
    pieces = spans.select("low", "high", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in [*pieces.dtypes, *points.drop("p").dtypes])
    placed = points.withColumn("chunk", chunk_of(F.col("p"), bounds))
    parts = cut(placed.groupBy("chunk").cogroup(pieces.groupBy("chunk")).applyInArrow(_in_chunk, kinds))
    total = [F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")]
    each = parts.filter("low is not null").select("low", "high", "n", "least", "most")
    if len(marks) > 1:
        levels = F.sequence(F.lit(0), F.lit(len(marks).bit_length()))
        nodes = parts.filter("low is null").withColumn("level", F.explode(levels)).withColumn("node", F.expr("shiftright(chunk, level)")).groupBy("level", "node").agg(*total)
        # The chunks a + 1 to b - 1 as nodes: on each level at most the first, if it is odd, and the last, if it is even.
        asked = spans.filter("b - a > 1").withColumn("level", F.explode(levels)).withColumn("l", F.expr("shiftright(a + shiftleft(1, level), level)")).withColumn("r", F.expr("shiftright(b, level)")).filter("l < r")
        asked = asked.withColumn("node", F.explode(F.expr("filter(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)), x -> x is not null)")))
        each = each.unionByName(asked.join(F.broadcast(nodes), ["level", "node"]).select("low", "high", "n", "least", "most"))
    sums = each.groupBy(F.col("low").alias("__tg_low"), F.col("high").alias("__tg_high")).agg(*total)
    return right.join(sums, (F.col(low) == F.col("__tg_low")) & (F.col(high) == F.col("__tg_high"))).drop("__tg_low", "__tg_high")
