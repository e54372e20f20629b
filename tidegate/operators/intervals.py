"""Merge overlapping intervals per entity into periods and list the gaps between them.

Each entity's intervals go into an ordered map of disjoint intervals that is kept as keyed
state while the rows stream through in key order. An insertion finds the intervals it meets by
binary search, replaces them by their union and so moves the gaps.

Defined results:
* null bounds, or an end not after its start: the row is no interval and is ignored;
* a null key is an entity like any other (as in GROUP BY);
* intervals that only touch are one period; repeated rows and ties change nothing;
* an empty table gives an empty result; further columns are ignored, whatever their names.

An entity with very many rows is cut into chunks of time. A chunk's outermost periods may go on
in its neighbours, so only those are brought together afterwards, at most two for each chunk.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate.operators.chunks import TARGET_ROWS, bound, chunk_of, hot_bounds, with_bounds
from tidegate.session import cut


class IntervalMap:
    """Disjoint intervals in order; intervals that touch are joined."""

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or ()), list(ends or ())

    def add(self, start: int, end: int) -> None:
        first = bisect_left(self.ends, start)
        after = bisect_right(self.starts, end)
        if first < after:
            start = min(start, self.starts[first])
            end = max(end, self.ends[after - 1])
        self.starts[first:after] = [start]
        self.ends[first:after] = [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


class _Rows:
    """Output rows gathered column by column."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.cols = schema, [[] for _ in schema]

    def add(self, *values) -> None:
        for col, v in zip(self.cols, values):
            col.append(v)

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.cols, self.schema)], schema=self.schema)
        self.cols = [[] for _ in self.schema]
        return batch


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, hot, chunk, start, end) sorted by key and chunk -> periods, gaps and chunk edges."""
    out, current, state = None, None, IntervalMap()

    def flush() -> None:
        if current is None:
            return
        key, hot, chunk = current
        periods, last = state.periods(), len(state.starts) - 1
        for i, (a, b) in enumerate(periods):
            edge = hot and i in (0, last)
            out.add(key, chunk, "only" if edge and last == 0 else "first" if edge and i == 0 else "last" if edge else "period", a, b)
        for a, b in state.gaps():
            out.add(key, chunk, "gap", a, b)

    for batch in batches:
        if out is None:
            out = _Rows(pa.schema([pa.field("key", batch.schema.field(0).type), ("chunk", pa.int32()), ("kind", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64())]))
        for key, hot, chunk, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, hot, chunk) != current:
                flush()
                current, state = (key, hot, chunk), IntervalMap()
            state.add(a, b)
        yield out.take()
    if out is not None:
        flush()
        yield out.take()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (key, chunk, kind, start, end) sorted by key, chunk, start -> periods, gaps across chunks."""
    out, current, state, chunk_before, end_before = None, object(), IntervalMap(), None, None

    def flush() -> None:
        if state.starts:
            for a, b in state.periods():
                out.add(current, "period", a, b)

    for batch in batches:
        if out is None:
            out = _Rows(pa.schema([pa.field("key", batch.schema.field(0).type), ("kind", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64())]))
        for key, chunk, _, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            if key != current:
                flush()
                current, state, chunk_before, end_before = key, IntervalMap(), None, None
            if chunk_before is not None and chunk != chunk_before and a > end_before:
                out.add(key, "gap", end_before, a)
            chunk_before, end_before = chunk, b
            state.add(a, b)
        yield out.take()
    if out is not None:
        flush()
        yield out.take()


def _premerge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join what overlaps within a batch before anything is shuffled."""
    for batch in batches:
        maps: dict = {}
        for key, a, b in zip(*(c.to_pylist() for c in batch.columns)):
            maps.setdefault(key, IntervalMap()).add(a, b)
        out = _Rows(batch.schema)
        for key, m in maps.items():
            for a, b in m.periods():
                out.add(key, a, b)
        yield out.take()


def merge_intervals(df: DataFrame, key: str, start_us: str, end_us: str, target_rows: int = TARGET_ROWS) -> DataFrame:
    """(key, kind, start_us, end_us): one row per period and per gap of each entity.

    ``start_us`` and ``end_us`` are bigint columns. Entities above ``target_rows`` rows are cut
    into chunks of time with about so many rows.
    """
    kind_of_key = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), F.col(start_us).cast("bigint").alias("a"), F.col(end_us).cast("bigint").alias("b")).filter("b > a")
    bounds = hot_bounds(rows, "key", "a", target_rows)
    marked = with_bounds(rows, "key", bounds)
    calm = marked.filter("bounds is null").select("key", F.lit(False).alias("hot"), F.lit(0).alias("chunk"), "a", "b")
    result = _merged(calm, kind_of_key).drop("chunk")
    if bounds is not None:
        joined = marked.filter("bounds is not null").select("key", "a", "b").mapInArrow(_premerge, f"key {kind_of_key}, a bigint, b bigint")
        piece = F.explode(F.sequence(chunk_of(F.col("a"), F.col("bounds")), chunk_of(F.col("b") - 1, F.col("bounds"))))
        low = F.when(F.col("chunk") > 0, bound(F.col("bounds"), F.col("chunk") - 1))
        hot = (
            with_bounds(joined, "key", bounds)
            .select("key", "a", "b", "bounds", piece.alias("chunk"))
            .select("key", F.lit(True).alias("hot"), "chunk", F.greatest("a", low).alias("a"), F.least("b", bound(F.col("bounds"), F.col("chunk"))).alias("b"))
        )
        merged = cut(_merged(hot, kind_of_key))
        edge = F.col("kind").isin("first", "last", "only")
        stitched = (
            merged.filter(edge)
            .repartition("key")
            .sortWithinPartitions("key", "chunk", "start_us")
            .mapInArrow(_stitch, f"key {kind_of_key}, kind string, start_us bigint, end_us bigint")
        )
        result = result.unionByName(merged.filter(~edge).drop("chunk")).unionByName(stitched)
    return result.select(F.col("key").alias(key), "kind", "start_us", "end_us")


def _merged(rows: DataFrame, kind_of_key: str) -> DataFrame:
    return (
        rows.repartition("key", "chunk")
        .sortWithinPartitions("key", "hot", "chunk", "a")
        .mapInArrow(_merge, f"key {kind_of_key}, chunk int, kind string, start_us bigint, end_us bigint")
    )
