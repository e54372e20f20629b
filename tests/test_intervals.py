import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.operators.intervals import IntervalMap, merge_intervals

SCHEMA = "k string, a bigint, b bigint, chunk string, kind int"


def brute(rows):
    """Periods and gaps by sorting."""
    out, by = set(), {}
    for k, a, b, *_ in rows:
        if a is not None and b is not None and b > a:
            by.setdefault(k, []).append((a, b))
    for k, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(k, "period", a, b) for a, b in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12)), max_size=40))
def test_map_equals_sorting(spans):
    m = IntervalMap()
    for a, n in spans:
        m.add(a, a + n)
    want = brute([("k", a, a + n) for a, n in spans])
    assert {("k", "period", a, b) for a, b in m.periods()} | {("k", "gap", a, b) for a, b in m.gaps()} == want


CASES = [("x", 1, 5, "c", 1), ("x", 5, 7, "c", 1), ("x", 9, 10, None, 2), ("x", 2, 3, None, 2), ("y", None, 4, "", 0), ("y", 4, None, "", 0), ("y", 8, 8, "", 0), ("y", 9, 3, "", 0), (None, 1, 2, None, None), (None, 4, 6, None, None), ("x", 9, 10, None, 2)]


@pytest.mark.parametrize("target", [1_000, 1])
def test_nulls_touching_reversed_and_repeated(spark, target):
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(CASES, SCHEMA), "k", "a", "b", target).collect()}
    assert got == brute(CASES)


def test_empty(spark):
    assert merge_intervals(spark.createDataFrame([], SCHEMA), "k", "a", "b").count() == 0


@pytest.mark.parametrize("length", [3, 400])
def test_hot_entity_is_cut_into_chunks(spark, length):
    rng = random.Random(length)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", a := rng.randrange(20_000), a + rng.randrange(1, length), "", 0) for _ in range(5_000)]
    got = merge_intervals(spark.createDataFrame(rows, SCHEMA).repartition(4), "k", "a", "b", target_rows=500).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_all_intervals_start_together(spark):
    rows = [("hot", 5, 5 + i, "", 0) for i in range(1, 300)]
    got = {tuple(r) for r in merge_intervals(spark.createDataFrame(rows, SCHEMA), "k", "a", "b", target_rows=10).collect()}
    assert got == {("hot", "period", 5, 304)}


def test_stream_gives_the_same(spark, tmp_path):
    from tidegate.streaming.intervals import merge_stream

    rows = [r for r in CASES if r[0]] + [("z", 1, 2, "", 0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    last: dict = {}

    def keep(batch, _):
        seen: dict = {}
        for r in batch.collect():
            seen.setdefault(r["k"], set()).add(tuple(r))
        last.update(seen)

    q = merge_stream(stream, "k", "a", "b").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    assert set().union(*last.values()) == brute(rows)
