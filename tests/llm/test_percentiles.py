import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegate.llm.percentiles import growth, merge, percentiles, sketch

SCHEMA = "g string, day int, v double, n string"
POINTS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def check(got, values, error):
    for p in POINTS:
        exact = sorted(values)[math.floor(p * (len(values) - 1))]
        assert abs(got[f"p{p * 100:g}"] - exact) <= error * abs(exact) * (1 + 1e-9) + 1e-9


@pytest.mark.parametrize("error", [0.01, 0.1])
def test_error_bound_over_many_magnitudes_and_signs(spark, error):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.randrange(5), rng.choice([-1, 1, 1]) * 10 ** rng.uniform(-3, 12), "x") for _ in range(3_000)] + [("a", 1, 0.0, "x")] * 200
    days = sketch(spark.createDataFrame(rows, SCHEMA), ["g", "day"], "v", error)
    got = {r["g"]: r for r in percentiles(merge(days, ["g"]), ["g"], POINTS, error).collect()}
    for g in ("a", None):
        check(got[g], [r[2] for r in rows if r[0] == g], error)


def test_sketches_of_parts_add_up(spark):
    df = spark.range(1, 2_000).select(F.lit("a").alias("g"), (F.col("id") % 7).alias("day"), (F.col("id") * 1.5).alias("v"))
    whole = sketch(df, ["g"], "v").orderBy("index").collect()
    assert merge(sketch(df, ["g", "day"], "v"), ["g"]).orderBy("index").select(*whole[0].asDict()).collect() == whole


def test_nulls_nan_infinities_and_ties(spark):
    rows = [("a", 1, None, ""), ("a", 1, float("nan"), ""), ("a", 1, float("inf"), ""), ("a", 1, 5.0, ""), ("a", 1, 5.0, ""), ("b", 1, None, "")]
    got = percentiles(sketch(spark.createDataFrame(rows, SCHEMA), ["g"], "v"), ["g"], [0.5], 0.01).collect()
    assert [(r["g"], r["n"]) for r in got] == [("a", 2)] and abs(got[0]["p50"] - 5) <= 0.05


def test_empty(spark):
    assert percentiles(sketch(spark.createDataFrame([], SCHEMA), ["g"], "v"), ["g"], [0.5]).count() == 0


@settings(max_examples=300)
@given(st.floats(1e-6, 1e15), st.sampled_from([0.001, 0.01, 0.2]))
def test_bucket_middle_is_near_every_value(v, error):
    g = growth(error)
    i = math.ceil(math.log(v) / math.log(g))
    assert abs(2 * g**i / (g + 1) - v) <= error * v * (1 + 1e-6)


@pytest.mark.parametrize("error", [0, 1, -1])
def test_error_must_make_sense(error):
    with pytest.raises(ValueError):
        growth(error)
