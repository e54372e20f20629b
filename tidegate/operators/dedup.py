"""Exactly one copy of every message that was delivered at least once.

Rows are hash-partitioned by identifier. Within a partition they come in order of their time
bucket (the day of the poll, say). Every bucket has a Bloom filter: an identifier that no
filter knows is new for certain and is stored with its bucket. One that some filters know is a
possible repeat; it is compared exactly, column by column, with the stored identifiers of just
those buckets. So false positives cost time and never a row, and no exact set of all
identifiers is searched.

Defined results:
* nulls in identifier columns compare equal, as in GROUP BY;
* a null time goes to a bucket of its own, before all others;
* of several copies the one with the smallest order columns stays (nulls first); of copies that
  tie in these, either;
* an empty table gives an empty result; extra columns are carried along, and internal names
  start with ``__tg`` so they clash with none.

An identifier with very many copies is reduced to one row per input partition before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per identifier and hash functions: a false positive rate of about 1 %.
BITS, HASHES = 10, 4
#: Rows of one partition are handled in so many slices, one after another.
SLICES = 16
#: An identifier with so many copies in a batch is held back from then on and delivered once by each task, at most
#: HELD of them at a time. It bounds memory only: what is not held back is shuffled as it is.
HOT_COPIES, HELD = 2, 65_536

_H, _SLICE, _BUCKET, _N = "__tg_h", "__tg_slice", "__tg_bucket", "__tg_n"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BucketFilters:
    """One Bloom filter per time bucket, all of one size and stored bit by bit beside each other.

    A position holds one bit for every bucket, 64 to a word, so one probe asks all filters at once.
    """

    def __init__(self, buckets: int, largest: int, bits_each: int = BITS, hashes: int = HASHES):
        size = 64
        while size < largest * bits_each:
            size *= 2
        self.mask, self.hashes = np.uint64(size - 1), hashes
        self.words = np.zeros((-(-buckets // 64), size), np.uint64)

    def positions(self, h: np.ndarray) -> list[np.ndarray]:
        step = _mix(h) | np.uint64(1)
        return [((h + np.uint64(i) * step) & self.mask).astype(np.int64) for i in range(self.hashes)]

    def add(self, bucket: int, at: list[np.ndarray]) -> None:
        bit = np.uint64(1 << (bucket % 64))
        for p in at:
            self.words[bucket // 64, p] |= bit

    def has(self, at: list[np.ndarray]) -> list[np.ndarray]:
        """Per word of 64 buckets: for each hash the buckets whose filter knows it."""
        out = []
        for word in self.words:
            found = word[at[0]]
            for p in at[1:]:
                found &= word[p]
            out.append(found)
        return out


class BucketStore:
    """The stored identifiers of one time bucket, found by hash and compared exactly."""

    def __init__(self, h: np.ndarray, rows: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.h, self.rows = h[order], rows[order]

    def find(self, h: np.uint64, same) -> int:
        lo, hi = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        for r in self.rows[lo:hi]:
            if same(int(r)):
                return int(r)
        return -1


def _slice(table: pa.Table, id_cols: list[str]) -> pa.Table:
    """One slice of a partition, sorted by bucket and order -> its kept rows with counts."""
    h = _mix(table[_H].to_numpy().view(np.uint64))
    bucket = table[_BUCKET].to_numpy()
    counts = table[_N].to_numpy().copy()
    columns = [table[c].combine_chunks() for c in id_cols]
    keep = np.ones(table.num_rows, bool)
    home = np.arange(table.num_rows)
    stores: list[BucketStore] = []
    edges = np.flatnonzero(np.diff(bucket)) + 1
    spans = list(zip([0, *edges], [*edges, len(bucket)]))
    filters = BucketFilters(len(spans), max(hi - lo for lo, hi in spans))

    def same_as(row: int):
        mine = [c[row] for c in columns]
        return lambda other: all((c[other].as_py() == m.as_py()) for c, m in zip(columns, mine))

    for at_bucket, (lo, hi) in enumerate(spans):
        part = h[lo:hi]
        places = filters.positions(part)
        new = np.ones(hi - lo, bool)
        for w, hits in enumerate(filters.has(places)):
            for i in np.flatnonzero(hits):
                for bit in range(64):
                    if new[i] and int(hits[i]) >> bit & 1 and (found := stores[w * 64 + bit].find(part[i], same_as(lo + i))) >= 0:
                        new[i] = False
                        home[lo + i] = found
        # copies inside the bucket share a hash; those that do are compared with the first of them
        order = np.argsort(part, kind="stable")
        again = np.flatnonzero(part[order][1:] == part[order][:-1]) + 1
        firsts: dict[int, list[int]] = {}
        for k in again:
            i, before = int(order[k]), int(order[k - 1])
            group = firsts.setdefault(int(part[i]), [lo + before])
            if not new[i]:
                continue
            same = same_as(lo + i)
            found = next((r for r in group if same(r)), None)
            if found is None:
                group.append(lo + i)
            else:
                new[i] = False
                home[lo + i] = home[found]
        keep[lo:hi] = new
        at = np.flatnonzero(new)
        filters.add(at_bucket, [p[at] for p in places])
        stores.append(BucketStore(part[at], at + lo))
    total = np.zeros(table.num_rows, np.int64)
    np.add.at(total, home, counts)
    kept = table.filter(pa.array(keep))
    return kept.set_column(kept.schema.get_field_index(_N), _N, pa.array(total[keep]))


def _keep(id_cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                yield from _slice(pa.Table.from_batches(held), id_cols).combine_chunks().to_batches()
                held.clear()

        for batch in batches:
            at = batch.column(batch.schema.get_field_index(_SLICE)).to_numpy()
            edges = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(at)]):
                if hi > lo:
                    if at[lo] != current:
                        yield from done()
                        current = at[lo]
                    held.append(batch.slice(lo, hi - lo))
        yield from done()

    return run


def _shrink(id_cols: list[str], order_cols: list[str]):
    """Map side: hold identifiers that repeat very often, deliver each once with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # hash -> [identifier, order, row, copies]
        rank = lambda values: tuple((v is not None, v) for v in values)
        for batch in batches:
            h = batch.column(batch.schema.get_field_index(_H)).to_numpy()
            order = np.argsort(h, kind="stable")
            begins = np.concatenate([[0], np.flatnonzero(np.diff(h[order])) + 1])
            sizes = np.diff(np.append(begins, len(h)))
            hashes = h[order[begins]] if len(h) else h
            often = sizes >= HOT_COPIES
            if held:
                often |= np.isin(hashes, np.fromiter(held, np.int64, len(held)))
            rows = order[np.repeat(often, sizes)] if len(h) else order
            if not len(rows):
                yield batch
                continue
            some, stay = batch.take(pa.array(rows)), np.ones(len(h), bool)
            cells = lambda names: zip(*(some.column(some.schema.get_field_index(c)).to_pylist() for c in names)) if names else [()] * len(rows)  # noqa: E731, B023
            for k, (r, x, ident, place) in enumerate(zip(rows.tolist(), h[rows].tolist(), cells(id_cols), map(rank, cells(order_cols)))):
                mine = held.get(x)
                if mine is None:
                    if len(held) >= HELD:
                        continue
                    mine = held[x] = [ident, place, some.slice(k, 1), 0]  # of the repeats only, so that the batch itself can go
                if mine[0] == ident:
                    stay[r] = False
                    mine[3] += 1
                    if place < mine[1]:
                        mine[1:3] = [place, some.slice(k, 1)]
            yield batch.filter(pa.array(stay))
        if held:
            kept = pa.Table.from_batches([x[2] for x in held.values()]).combine_chunks()
            at = kept.schema.get_field_index(_N)
            yield from kept.set_column(at, kept.schema.field(at), pa.array([x[3] for x in held.values()], pa.int64())).combine_chunks().to_batches(10_000)

    return run


def exactly_once(df: DataFrame, id_cols: list[str], bucket: Column, order_cols: list[str], copies: str = "copies") -> DataFrame:
    """One row per identifier: the first copy with all its columns, and how many copies came.

    ``bucket`` is an integer column expression for the time bucket. ``copies`` must not be the
    name of a column of ``df``.
    """
    if copies.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {copies}")
    schema = df.select("*", F.lit(0).cast("bigint").alias(_H), F.lit(0).alias(_SLICE), F.lit(0).alias(_BUCKET), F.lit(0).cast("bigint").alias(_N)).schema
    marked = df.select(
        "*",
        F.xxhash64(*id_cols).alias(_H),
        F.lit(0).alias(_SLICE),
        F.coalesce(bucket.cast("int"), F.lit(-(2**31))).alias(_BUCKET),
        F.lit(1).cast("bigint").alias(_N),
    )
    order = [F.col(c).asc_nulls_first() for c in order_cols]
    return (
        marked.mapInArrow(_shrink(id_cols, order_cols), schema)
        .withColumn(_SLICE, F.pmod(F.shiftright(_H, 40), F.lit(SLICES)).cast("int"))
        .repartition(_H)
        .sortWithinPartitions(_SLICE, _BUCKET, *order)
        .mapInArrow(_keep(id_cols), schema)
        .withColumnRenamed(_N, copies)
        .drop(_H, _SLICE, _BUCKET)
    )
