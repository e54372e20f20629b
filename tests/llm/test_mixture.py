import random
from collections import Counter

import numpy as np
import pytest

from tidegate.llm.mixture import TokenCounter, encoding, mix, split_quotas, token_counts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DOCS, TARGETS = "doc_id bigint, source string, text string, tokens int, shard int", "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def encode():
    with open(TOKENIZER, "rb") as f:
        return encoding(f.read()).encode_ordinary


def test_counts_equal_whole_texts(encode):
    rng = random.Random(0)
    bits = [" ", "  ", "   ", "\n", "\t", " \n", "\r\n", "\xa0", "　", "a", "b1", "'s", "don't", "x.", "é", "中文", "12 3", "<|endoftext|>", "🙂"]
    counter = TokenCounter(encode)
    for _ in range(5_000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert counter.count(text) == len(encode(text))
    assert counter.count(None) == counter.count("") == 0


def test_long_text_without_spaces_is_counted_whole(spark, encode):
    text = "0123456789abcdef" * 3_000
    df = spark.createDataFrame([(1, text, "k"), (2, None, "k")], "doc_id bigint, text string, tokens_note string")
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df, ["doc_id"], "text", TOKENIZER).collect()} == {1: len(encode(text)), 2: 0}


def test_splitting_tree_keeps_quotas():
    rng = np.random.default_rng(1)
    for quotas in ([5, 0, 17], [0, 0], [1], [1000, 3, 400, 70]):
        for shards in (1, 2, 7, 32):
            got = split_quotas(quotas, shards, rng)
            assert got.sum(0).tolist() == quotas and (got >= 0).all()
            assert got.sum(1).max() - got.sum(1).min() <= int(np.ceil(np.log2(shards))) + 1


def docs(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [(i, s, " ".join(["word"] * rng.randrange(20, 60)), 0, 0) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_disjoint_blocks(spark):
    sizes = {"big": 2_000, "mid": 300, "small": 40, "other": 50, None: 20}
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 9), ("absent", 0.1, 5)], TARGETS)
    mixture_, report = mix(docs(spark, sizes), targets, TOKENIZER, shards=8)
    rows, shares = mixture_.collect(), {r["source"]: r for r in report.collect()}
    uses = Counter((r["doc_id"]) for r in rows)
    assert len({(r["doc_id"], r["repeat_no"]) for r in rows}) == len(rows)
    caps = {"big": 1, "mid": 2, "small": 9}
    for r in rows:
        assert uses[r["doc_id"]] <= caps[r["source"]]
    for s, want in (("big", 5 / 9), ("mid", 3 / 9), ("small", 1 / 9)):
        assert abs(shares[s]["share"] - want) < 0.004 and shares[s]["uses"] == sum(r["source"] == s for r in rows)
    assert shares["absent"]["tokens"] == shares["other"]["tokens"] == shares[None]["tokens"] == 0 and shares["other"]["available_tokens"] > 0
    assert {r["shard"] for r in rows} == set(range(8))
    again, _ = mix(docs(spark, sizes), targets, TOKENIZER, shards=8)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_given_total_that_a_cap_forbids(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], TARGETS)
    _, report = mix(docs(spark, {"a": 10, "b": 500}), targets, TOKENIZER, shards=2, total_tokens=10_000)
    got = {r["source"]: r for r in report.collect()}
    assert got["a"]["tokens"] == 2 * got["a"]["available_tokens"] and got["a"]["uses"] == 20
    assert abs(got["b"]["tokens"] - 5_000) < 60


def test_nulls_repeated_targets_and_records_without_tokens(spark):
    rows = [(1, "a", None, 0, 0), (2, "a", "x y z", 0, 0), (2, "a", "x y z", 0, 0), (3, "z", "", 0, 0)]
    targets = spark.createDataFrame([("a", 0.2, 1), ("a", 0.3, 2), ("z", 0.5, 1), (None, 0.5, 1), ("n", None, None)], TARGETS)
    mixture_, report = mix(spark.createDataFrame(rows, DOCS), targets, TOKENIZER, shards=3)
    got = {r["source"]: r for r in report.collect()}
    assert got["a"]["max_repeats"] == 2 and got["a"]["target_share"] == 0.5 and got["a"]["share"] == 1.0
    assert max(Counter((r["doc_id"], r["repeat_no"]) for r in mixture_.collect()).values()) <= 2


def test_empty(spark):
    a, b = spark.createDataFrame([], DOCS), spark.createDataFrame([], TARGETS)
    assert mix(a, b, TOKENIZER)[0].count() == mix(docs(spark, {"a": 3}), b, TOKENIZER)[0].count() == 0
    assert [r["share"] for r in mix(a, spark.createDataFrame([("a", 1.0, 1)], TARGETS), TOKENIZER)[1].collect()] == [0.0]


def test_every_shard_has_the_shares(spark):
    """Each shard is a mixture of all sources, of equal size and with the target shares to within 2 points."""
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 9)], TARGETS)
    mixture_, report = mix(docs(spark, {"big": 4_000, "mid": 900, "small": 150}), targets, TOKENIZER, shard_tokens=10_000)
    tokens: dict = {}
    for r in mixture_.collect():
        tokens.setdefault(r["shard"], Counter())[r["source"]] += r["tokens"]
    total = sum(r["tokens"] for r in report.collect())
    assert set(tokens) == set(range(round(total / 10_000))) and len(tokens) > 5
    for own in tokens.values():
        assert abs(sum(own.values()) / (total / len(tokens)) - 1) < 0.03
        for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
            assert abs(own[s] / sum(own.values()) - share) < 0.02


def test_a_use_lies_in_one_shard_and_in_order(spark):
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.4, 4)], TARGETS)
    mixture_, _ = mix(docs(spark, {"a": 400, "b": 90}), targets, TOKENIZER, shards=5)
    per = Counter((r["doc_id"], r["repeat_no"]) for r in mixture_.collect())
    assert set(per.values()) == {1}
    for part in mixture_.rdd.glom().collect():
        keys = [(r["shard"], r["sort_key"]) for r in part]
        assert keys == sorted(keys)
