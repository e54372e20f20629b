import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegate.operators import dedup
from tidegate.operators.dedup import exactly_once

SCHEMA = "topic string, part int, off bigint, day int, seq int, body string, bucket string"
IDS = ["topic", "part", "off"]


def run(df):
    return exactly_once(df, IDS, F.col("day"), ["day", "seq"])


def brute(rows):
    first, n = {}, Counter()
    for r in rows:
        n[r[:3]] += 1
        order = tuple((v is not None, v) for v in r[3:5])
        if r[:3] not in first or order < first[r[:3]][0]:
            first[r[:3]] = (order, r)
    return {(*v[1], n[k]) for k, v in first.items()}


def test_copies_across_days_and_with_nulls(spark):
    rows = [("a", 0, 1, 5, 1, "x", "b"), ("a", 0, 1, 3, 2, "y", None), ("a", 0, 1, None, 9, "late", ""), ("a", 1, 1, 5, 3, "x", "b"), (None, 0, 1, 5, 4, None, None), (None, 0, 1, 6, 5, None, None), ("a", 0, None, 5, 6, "x", ""), ("", 0, None, 5, 7, "x", "")]
    assert {tuple(r) for r in run(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_many_days_and_a_hot_identifier(spark):
    rng = random.Random(4)
    rows = [("hot", 0, 0, rng.randrange(90), i, "h", "") if rng.random() < 0.35 else (f"t{rng.randrange(3)}", rng.randrange(4), rng.randrange(400), rng.randrange(90), i, "é" * rng.randrange(5), "") for i in range(6_000)]
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_equal_hashes_of_different_identifiers_stay_apart(spark, monkeypatch):
    """With a hash that puts everything together, the exact comparison alone decides."""
    monkeypatch.setattr(dedup.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    rows = [("a", i % 5, i % 3, i % 4, i, "", "") for i in range(60)]
    assert {tuple(r) for r in run(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_screen_has_no_false_negatives():
    import numpy as np

    f = dedup.BucketFilters(70, 1000)
    h = dedup._mix(np.arange(1000, dtype=np.uint64))
    f.add(69, f.positions(h))
    assert all(int(x) >> 5 & 1 for x in f.has(f.positions(h))[1])
    other = dedup._mix(np.arange(10_000, 20_000, dtype=np.uint64))
    assert (f.has(f.positions(other))[1] != 0).mean() < 0.05


def test_name_of_the_count_must_be_free(spark):
    with pytest.raises(ValueError, match="copies"):
        run(spark.createDataFrame([], SCHEMA + ", Copies int"))
