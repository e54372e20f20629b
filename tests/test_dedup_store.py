import random

import numpy as np
from pyspark.sql import functions as F

from tidegate.operators.dedup_store import DedupStore, in_filter, make_filter

SCHEMA = "topic string, off bigint, day int, seq int, body string"


def ingest(store, df, name):
    return {tuple(r) for r in store.ingest(df, name, F.col("day"), ["day", "seq"]).select("topic", "off", "seq", "copies").collect()}


def test_batches_one_after_another(spark, tmp_path):
    store = DedupStore(spark, str(tmp_path / "s"), ["topic", "off"], parts=4)
    rng = random.Random(6)
    seen: set = set()
    batches = []
    for b in range(4):
        rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(150)]), rng.choice([b, b + 1, None]), i, "x") for i in range(200)]
        df = spark.createDataFrame(rows, SCHEMA)
        first: dict = {}
        for r in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r[2:4])):
            if r[:2] not in seen:
                first.setdefault(r[:2], [*r[:2], r[3], 0])
        for r in rows:
            if r[:2] in first:
                first[r[:2]][3] += 1
        want = {tuple(v) for v in first.values()}
        assert ingest(store, df, f"b{b}") == want
        seen |= set(first)
        batches.append((df, want))
    # the same batch again, as after a failure, gives the same rows
    assert ingest(store, *(batches[3][0], "b3")) == batches[3][1]
    assert ingest(store, batches[0][0], "b9") == set()
    assert ingest(store, batches[0][0].limit(0), "b10") == set()


def test_a_batch_repeated_under_any_id_gives_its_rows_again(spark, tmp_path):
    df = spark.createDataFrame([("a", i, None if i == 2 else 1, i, "x") for i in range(3)], SCHEMA)
    want = {("a", i, i, 1) for i in range(3)}
    for n, name in enumerate(["007", "7", "1e3", "2024-01-01", "a/b=c d", "", "null"]):
        store = DedupStore(spark, str(tmp_path / f"s{n}"), ["topic", "off"])
        assert ingest(store, df, name) == want
        assert ingest(store, df, name) == want
        assert ingest(store, df, name + "x") == set()


def test_filters():
    h = np.arange(5_000, dtype=np.int64) * 7_919
    kept = make_filter(h)
    assert in_filter(h, kept).all() and in_filter(h + 1, kept).mean() < 0.05
    assert not in_filter(h, make_filter(h[:0])).any()
