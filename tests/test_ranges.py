import math
import random

import pytest

from tidegate.operators.joins import range_join
from tidegate.operators.ranges import range_aggregate


def tables(spark):
    rng = random.Random(5)
    points = [(float(rng.randint(-60, 60)) / 2, rng.choice([None, *range(500)]), i) for i in range(700)] + [(None, 1, -1), (math.nan, 2, -2), (math.inf, -9, -3)]
    ends = [(rng.uniform(-40, 40), rng.choice([0, 0.5, 3, 20, 90, -1])) for _ in range(120)]
    bands = [(i, a, a + d) for i, (a, d) in enumerate(ends)] + [(500, -1e9, math.nan), (501, None, 4.0), (502, 1.0, None), (503, -1e9, 1e9), (504, -1e9, 1e9), (505, -0.0, 0.0), (506, 100.0, 101.0)]
    return points, bands, spark.createDataFrame(points, "p double, v bigint, i int"), spark.createDataFrame(bands, "k int, low double, high double")


@pytest.mark.parametrize("target", [1_000_000, 60, 7, 1])
def test_totals_equal_those_of_all_pairs(spark, target):
    points, bands, left, right = tables(spark)
    key = lambda x: (math.isnan(x), 0 if math.isnan(x) else x)
    want = {}
    for k, a, b in bands:
        held = [v for p, v, _ in points if None not in (p, a, b) and key(a) <= key(p) <= key(b)]
        if held:
            some = [v for v in held if v is not None]
            want[k] = (len(held), min(some, default=None), max(some, default=None))
    got = {r["k"]: (r["n"], r["least"], r["most"]) for r in range_aggregate(left, right, "p", "low", "high", "v", target).collect()}
    assert got == want and 503 in got and 506 not in got


def test_no_points_and_no_bands(spark):
    _, _, left, right = tables(spark)
    assert range_aggregate(left.limit(0), right, "p", "low", "high", "v").count() == 0
    assert range_aggregate(left, right.limit(0), "p", "low", "high", "v").count() == 0


def test_wide_bands_are_joined(spark):
    """Pairs of bands from narrow ones to some that hold everything."""
    points, bands, left, right = tables(spark)
    finite = left.filter("p < 1e300")
    got = sorted((r["i"], r["k"]) for r in range_join(finite, right.filter("high < 1e300"), "p", "low", "high", 1.0).collect())
    assert got == sorted((i, k) for p, _, i in points for k, a, b in bands if None not in (p, a, b) and a <= p <= b and p < 1e300)
