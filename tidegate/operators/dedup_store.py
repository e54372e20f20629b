"""Exactly one copy of every message across batches that arrive one after another.

The store holds, for every batch, time bucket and part of the identifiers' hashes, the identifiers
themselves and a Bloom filter of them. A new batch is first reduced to one copy of each identifier
(``exactly_once``). Its identifiers then meet the filters of their part: those that no filter
knows are new for certain; the others are joined exactly with the stored identifiers of just the
buckets whose filters know them.

A batch taken in again under the same id gives the same rows and replaces what it stored, so a
step that failed half-way can be repeated. Filters are written before identifiers: a batch that
broke off between the two leaves filters without rows, which cost a look-up and lose nothing.

Defined results: as in ``exactly_once``; batch ids are any texts and compared as such; an empty batch gives
no rows and stores nothing that matters.

A task holds the new batch's identifiers of one part and one filter at a time, whatever the store holds. The
number of parts is fixed when the store begins: by ``parts``, or by the rows of the first batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate import fs
from tidegate.operators.dedup import BITS, HASHES, _mix, exactly_once
from tidegate.session import cut, cut_and_count, drop

#: Where no number of parts is given: at least so many, and one for so many rows of the first batch.
LEAST_PARTS, PART_ROWS = 32, 100_000

_H, _PART, _BUCKET, _BATCH, _HITS = "__tg_h", "__tg_part", "__tg_bucket", "__tg_batch", "__tg_hits"


def _places(h: np.ndarray, size: int) -> list[np.ndarray]:
    mixed = _mix(h.view(np.uint64))
    step = _mix(mixed) | np.uint64(1)
    return [((mixed + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def make_filter(h: np.ndarray) -> bytes:
    """The Bloom filter of some hashes, its size a power of two with BITS bits or more for each."""
    size = 64
    while size < len(h) * BITS:
        size *= 2
    bits = np.zeros(size, bool)
    for p in _places(h, size):
        bits[p] = True
    return np.packbits(bits).tobytes()


def in_filter(h: np.ndarray, kept: bytes) -> np.ndarray:
    packed = np.frombuffer(kept, np.uint8)
    found = np.ones(len(h), bool)
    for p in _places(h, len(packed) * 8):
        found &= packed[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1 > 0
    return found


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, part, bucket, bits) sorted by part, the batch's own hashes (without bits) first, then the filters -> (h, bucket) that a filter knows."""
    schema = pa.schema([(_H, pa.int64()), (_BUCKET, pa.int32())])
    part, own, fresh = None, np.empty(0, np.int64), []
    for batch in batches:
        parts = batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi == lo:
                continue
            if parts[lo] != part:
                part, own, fresh = parts[lo], np.empty(0, np.int64), []
            piece = batch.slice(lo, hi - lo)
            is_filter = piece.column(3).is_valid().to_numpy(zero_copy_only=False)
            n = int((~is_filter).sum())
            if n:
                fresh.append(piece.column(0).slice(0, n).to_numpy())
            for bucket, bits in zip(piece.column(2).slice(n).to_pylist(), piece.column(3).slice(n).to_pylist()):
                if fresh:
                    own, fresh = np.unique(np.concatenate([own, *fresh])), []
                known = own[in_filter(own, bits)]
                if len(known):
                    yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(np.full(len(known), bucket, np.int32))], schema=schema)


class DedupStore:
    """Identifiers seen so far, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, id_cols: list[str], parts: int | None = None):
        self.spark, self.path, self.ids, self.parts = spark, path.rstrip("/"), id_cols, parts

    def ingest(self, batch: DataFrame, batch_id: str, bucket: Column, order_cols: list[str]) -> DataFrame:
        """The rows of a batch whose identifiers were never seen before, one each, with the number of ``copies`` in the batch."""
        once = exactly_once(batch, self.ids, bucket, order_cols)
        hashed, rows = cut_and_count(once.select("*", F.xxhash64(*self.ids).alias(_H), F.coalesce(bucket.cast("int"), F.lit(-(2**31))).alias(_BUCKET)), "true")
        marked = hashed.withColumn(_PART, F.pmod(F.shiftright(_H, 20), F.lit(self._parts(rows))).cast("int"))
        fresh = cut(self._fresh(marked, batch_id))
        drop(hashed)
        self._store(fresh, batch_id)
        return fresh.drop(_H, _BUCKET, _PART)

    def _parts(self, rows: int) -> int:
        """The number of parts of the store, written when it begins."""
        at = f"{self.path}/parts"
        if not fs.exists(self.spark, at):
            fs.write_text(self.spark, at, str(self.parts or max(LEAST_PARTS, -(-rows // PART_ROWS))))
        return int(fs.read_text(self.spark, at))

    def _folder(self, what: str, batch_id: str) -> str:
        # The prefix and the quoting keep a folder's name from being read as a number, a date or a path.
        return f"{self.path}/{what}/{_BATCH}=b-{quote(batch_id, safe='')}"

    def _kept(self, what: str, batch_id: str, schema: str) -> DataFrame | None:
        """Filters or identifiers of all other batches."""
        at = f"{self.path}/{what}"
        mine = self._folder(what, batch_id).rpartition("/")[2]
        others = [n for n in fs.children(self.spark, at) if n.startswith(_BATCH) and n != mine]
        if not others:
            return None
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/{n}" for n in others])

    def _fresh(self, marked: DataFrame, batch_id: str) -> DataFrame:
        types = ", ".join(f"`{c}` {marked.schema[c].dataType.simpleString()}" for c in self.ids)
        filters = self._kept("filters", batch_id, f"{_BUCKET} int, {_PART} int, bits binary, {_BATCH} string")
        stored = self._kept("ids", batch_id, f"{types}, {_H} bigint, {_PART} int, {_BATCH} string, {_BUCKET} int")
        if filters is None or stored is None:
            return marked
        own = marked.select(_H, _PART, F.lit(None).cast("int").alias(_BUCKET), F.lit(None).cast("binary").alias("bits"))
        both = own.unionByName(filters.select(F.lit(0).cast("bigint").alias(_H), _PART, _BUCKET, "bits"))
        known = cut(both.repartition(_PART).sortWithinPartitions(_PART, F.col("bits").isNotNull()).mapInArrow(_screen, f"{_H} bigint, {_BUCKET} int").distinct())
        # Only the folders of buckets that some filter named are read: the join prunes partitions while it runs.
        looked = marked.drop(_BUCKET).join(known, _H)
        same = [looked[c].eqNullSafe(stored[c]) if c in self.ids else looked[c] == stored[c] for c in (_BUCKET, _PART, _H, *self.ids)]
        seen = looked.join(stored, same, "left_semi").select(*self.ids, _H).distinct()
        again = [marked[c].eqNullSafe(seen[c]) if c in self.ids else marked[c] == seen[c] for c in (_H, *self.ids)]
        return marked.join(seen, again, "left_anti")

    def _store(self, fresh: DataFrame, batch_id: str) -> None:
        def build(rows: pa.Table) -> pa.Table:
            return pa.table({_BUCKET: rows[_BUCKET][:1], _PART: rows[_PART][:1], "bits": pa.array([make_filter(rows[_H].to_numpy())], pa.binary())})

        filters = fresh.select(_BUCKET, _PART, _H).groupBy(_BUCKET, _PART).applyInArrow(build, f"{_BUCKET} int, {_PART} int, bits binary")
        filters.write.mode("overwrite").parquet(self._folder("filters", batch_id))
        rows = fresh.select(*self.ids, _H, _BUCKET, _PART).repartition(_BUCKET, _PART)
        rows.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._folder("ids", batch_id))
