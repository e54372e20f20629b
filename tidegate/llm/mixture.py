"""Mixing sources to target shares of the total size in tokens.

1. Every text is tokenized whole; a chunk between single spaces has the same tokens wherever it
   stands, so each different chunk is tokenized once per task.
2. A hash of the id permutes a source's records. In that order their tokens form a tape, which is
   used again and again up to the source's quota; the part up to the quota is cut into blocks of
   equal size in tokens. A record belongs to the block in which its middle lies.
3. The blocks of all sources are divided among the output shards by a splitting tree: every node
   gives each side its whole proportion of each source's blocks, and of those that do not divide
   a multivariate hypergeometric draw says which go left. Quotas are exact at every node.
4. Each shard takes its number of blocks from each permuted tape, blocks that no other shard has,
   and orders their records by a hash: a local shuffle of all its sources.

A shard's share of a source is off by a few of its ``BLOCKS`` and by a record at either end.

Defined results:
* a source without records, or whose records have no tokens, contributes nothing; the shares of the others are scaled up
  to sum to 1 and both shares are reported;
* the total is the largest that no source's cap forbids, unless one is given; a source that cannot
  fill its quota of a given total is used as often as its cap allows, and the report shows it;
* records with a null source or one without target are not used; a null or empty text has 0 tokens;
  a record without tokens is never used;
* several target rows of one source count as one (shares summed, largest cap); a null or negative
  share or cap counts as 0; repeated records are records;
* the same seed gives the same mixture; empty tables give an empty mixture.

The driver sees one row per target source, and holds one number per shard and target source.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegate.session import cut_and_count, spread

#: Blocks of all sources that make up a shard, and tokens of a shard where no number of shards is given.
BLOCKS, SHARD_TOKENS = 1_024, 1 << 26
#: With at most so many target sources their plan is broadcast.
BROADCAST_SOURCES = 10_000
#: Chunks whose token counts a task keeps, and how long a kept chunk may be.
KEPT_CHUNKS, LONG_CHUNK = 500_000, 64
#: Fixed value: the pattern that splits text before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SINGLE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def encoding(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of a rank file; built once per Python process."""
    import tiktoken
    from tiktoken import registry

    name = "tidegate-" + hashlib.sha1(ranks + pattern.encode()).hexdigest()
    if name not in registry.ENCODINGS:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return registry.ENCODINGS[name]


class TokenCounter:
    """Token counts of whole texts, chunk by chunk.

    A token never holds a space behind a character that is none, and white space before a single
    space and a character is split alike without what follows. So a text may be cut before each
    single space between two other characters.
    """

    def __init__(self, encode):
        self.encode = encode
        self.after_space: dict[str, int] = {}
        self.as_it_is: dict[str, int] = {}

    def _count(self, kept: dict[str, int], key: str, chunk: str) -> int:
        n = kept.get(key)
        if n is None:
            n = len(self.encode(chunk))
            if len(key) <= LONG_CHUNK:
                if len(kept) >= KEPT_CHUNKS:
                    kept.clear()
                kept[key] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text:
            return sum(self._count(self.as_it_is, c, c) for c in _SINGLE_SPACE.split(text))
        first, *rest = text.split(" ")
        try:
            return self._count(self.as_it_is, first, first) + sum(map(self.after_space.__getitem__, rest))
        except KeyError:
            return self._count(self.as_it_is, first, first) + sum(self._count(self.after_space, c, " " + c) for c in rest)


def token_counts(df: DataFrame, keys: list[str], text: str, tokenizer: str) -> DataFrame:
    """(keys, tokens): the tokens of each text under the rank file at ``tokenizer``."""
    with open(tokenizer, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, under 10 MB
    rows = df.select(*keys, F.col(text).alias("__tg_text"))
    schema = df.select(*keys, F.lit(0).cast("bigint").alias("tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(encoding(sent.value).encode_ordinary)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts = [counter.count(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*keys, "tokens"])

    return spread(rows).mapInArrow(run, schema)


@dataclass(frozen=True)
class Quota:
    """A source's tape and what is taken of it."""

    source: str
    target_share: float
    scaled_share: float
    max_repeats: int
    tape: int = 0  #: tokens of all its records
    quota: float = 0.0  #: tokens to be used
    blocks: int = 0


def split_quotas(quotas: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """How many blocks of each source go to each shard; columns sum to the quotas, rows differ by at most about one."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def descend(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left, right, all_ = mid - lo, hi - mid, hi - lo
        sure = have * left // all_
        open_ = have - sure - have * right // all_  # one block at most of each source
        take = int(have.sum()) * left // all_ - int(sure.sum())
        mine = sure + (rng.multivariate_hypergeometric(open_, take, method="marginals") if take else 0)
        descend(lo, mid, mine)
        descend(mid, hi, have - mine)

    descend(0, shards, np.asarray(quotas, np.int64))
    return out


def plan_mixture(tapes: dict[str, int], targets: list[tuple], shards: int | None, total_tokens: int | None, shard_tokens: int) -> tuple[list[Quota], int]:
    """Each target source's quota in tokens and blocks, and the number of shards. ``targets`` are (source, share, cap)."""
    wanted: dict[str, tuple[float, int]] = {}
    for source, share, cap in targets:
        old_share, old_cap = wanted.get(source, (0.0, 0))
        wanted[source] = (old_share + max(0.0, share or 0.0), max(old_cap, cap or 0))
    used = [s for s, (share, cap) in sorted(wanted.items()) if share > 0 and cap > 0 and tapes.get(s)]
    scale = sum(wanted[s][0] for s in used)
    if not used:
        return [Quota(s, share, 0.0, cap) for s, (share, cap) in sorted(wanted.items())], 1
    total = total_tokens if total_tokens is not None else min(wanted[s][1] * tapes[s] * scale / wanted[s][0] for s in used)
    quota = {s: float(min(total * wanted[s][0] / scale, wanted[s][1] * tapes[s])) for s in used}
    shards = shards or max(1, round(sum(quota.values()) / shard_tokens))
    size = sum(quota.values()) / (shards * BLOCKS)
    return [
        Quota(s, share, share / scale, cap, tapes[s], quota[s], max(1, round(quota[s] / size))) if s in quota else Quota(s, share, 0.0, cap)
        for s, (share, cap) in sorted(wanted.items())
    ], shards


def _tape(counted: DataFrame, records: int) -> DataFrame:
    """``counted`` with ``middle``: where on its source's tape the middle of a record lies.

    The tape is cut into ranges of the hash, about as many as the root of the number of records, so neither
    the ranges of a source nor the records of a range are many for one task.
    """
    bits = max(0, math.ceil(math.log2(max(1, records)) / 2))
    ranged = counted.withColumn("range", F.shiftright("u", 63 - bits))
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("n"))
    before = sums.select("source", "range", (F.sum("n").over(Window.partitionBy("source").orderBy("range")) - F.col("n")).alias("before"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("u", "record_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("upto", inside).join(before, ["source", "range"]).withColumn("middle", F.col("before") + F.col("upto") - F.col("tokens") / 2).drop("range", "upto", "before")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str, shards: int | None = None, total_tokens: int | None = None, seed: int = 1, shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """The mixture, and the report of shares.

    ``documents`` has doc_id, source, text; ``targets`` source, target_share, max_repeats, one row per source
    as a rule. There are ``shards`` shards, or as many as have about ``shard_tokens`` tokens.
    Mixture: doc_id, source, tokens, repeat_no (from 1), shard, sort_key, one row per use of a record.
    Report: source, target_share, scaled_share, max_repeats, available_tokens, records, uses, tokens, share.
    """
    spark: SparkSession = documents.sparkSession
    rng = np.random.default_rng(seed)
    counted = token_counts(documents.select("doc_id", "source", "text"), ["doc_id", "source"], "text", tokenizer).withColumnRenamed("doc_id", "record_id")
    counted, n = cut_and_count(counted.withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(0), "record_id"), 1)), "tokens > 0")
    there = counted.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    aimed = targets.filter("source is not null").select("source", "target_share", "max_repeats")
    tapes = {r["source"]: r["available_tokens"] for r in there.join(aimed.select("source").distinct(), "source", "left_semi").collect()}
    quotas, shards = plan_mixture(tapes, [tuple(r) for r in aimed.collect()], shards, total_tokens, shard_tokens)
    drawn = [q for q in quotas if q.blocks]
    plan = spark.createDataFrame([(q.source, q.tape, q.quota, q.quota / q.blocks) for q in drawn], "source string, tape bigint, quota double, block_tokens double")
    plan = F.broadcast(plan) if len(drawn) <= BROADCAST_SOURCES else plan
    placed = _tape(counted.filter("tokens > 0").join(plan, "source"), n)
    uses = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.ceil(F.col("quota") / F.col("tape")).cast("int"))))
    at = (F.col("repeat_no") - 1) * F.col("tape") + F.col("middle")
    uses = uses.withColumn("at", at).filter("at < quota").select("record_id", "source", "tokens", "repeat_no", F.floor(F.col("at") / F.col("block_tokens")).alias("block"))
    shares = split_quotas([q.blocks for q in drawn], shards, rng) if drawn else np.zeros((1, 0), np.int64)
    sent = spark.sparkContext.broadcast({q.source: np.cumsum(shares[:, i]) for i, q in enumerate(drawn)})  # a number per shard and source

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, blocks, out = batch.column(1).dictionary_encode(), batch.column(4).to_numpy(), np.zeros(batch.num_rows, np.int32)
            for code, source in enumerate(sources.dictionary.to_pylist()):
                mine = np.flatnonzero(sources.indices.to_numpy() == code)
                ends = sent.value[source]
                out[mine] = np.searchsorted(ends, np.minimum(blocks[mine], ends[-1] - 1), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], names=[*batch.schema.names[:4], "shard"])

    kind = dict(counted.dtypes)["record_id"]
    dealt = uses.mapInArrow(shard, f"record_id {kind}, source string, tokens bigint, repeat_no int, shard int")
    mixture = dealt.select(F.col("record_id").alias("doc_id"), "source", "tokens", "repeat_no", "shard", F.xxhash64(F.lit(seed), F.lit("order"), "record_id", "repeat_no").alias("sort_key"))
    aims = spark.createDataFrame([(q.source, q.target_share, q.scaled_share, q.max_repeats) for q in quotas], "source string, target_share double, scaled_share double, max_repeats int")
    used = mixture.groupBy("source").agg(F.count_distinct("doc_id").alias("records"), F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = (
        there.join(aims, there["source"].eqNullSafe(aims["source"]), "full")
        .select(F.coalesce(there["source"], aims["source"]).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("scaled_share", F.lit(0.0)).alias("scaled_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), zero("available_tokens"))
        .join(used, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))  # a row per source
        .select("source", "target_share", "scaled_share", "max_repeats", "available_tokens", zero("records"), zero("uses"), zero("tokens"), F.coalesce(F.round(F.col("tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("share"))
    )
    return mixture.repartition("shard").sortWithinPartitions("shard", "sort_key"), report
