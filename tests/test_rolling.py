import datetime as dt
import random

from pyspark.sql import functions as F

from tests.conftest import DATA
from tidegate.operators.rolling import rolling_totals
from tidegate.queries import problems

SCHEMA = "who string, day date, n bigint, window_days_note string"


def brute(rows, windows):
    out, by = set(), {}
    for who, day, n, _ in rows:
        if day is not None:
            by.setdefault(who, []).append((day, n or 0))
    for who, own in by.items():
        day, last = min(d for d, _ in own), max(d for d, _ in own)
        while day <= last:
            out |= {(who, day, w, sum(n for d, n in own if dt.timedelta(0) <= day - d < dt.timedelta(days=w))) for w in windows}
            day += dt.timedelta(days=1)
    return out


def test_against_summing_up(spark):
    rng = random.Random(3)
    first = dt.date(2025, 1, 1)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else first + dt.timedelta(days=rng.randrange(60)), None if rng.random() < 0.1 else rng.randrange(-5, 9), "") for _ in range(120)]
    rows += [("once", first, 4, "")] * 2
    got = rolling_totals(spark.createDataFrame(rows, SCHEMA), "who", "day", ["n"], [1, 7, 30]).select("who", "day", "window_days", "n").collect()
    assert {tuple(r) for r in got} == brute(rows, [1, 7, 30])
    assert len(got) == len(brute(rows, [1, 7, 30]))


def test_average_divides_by_the_whole_period(spark):
    df = spark.createDataFrame([("a", dt.date(2025, 1, 1), 7, "")], SCHEMA)
    assert rolling_totals(df, "who", "day", ["n"], [7]).first()["n_per_day"] == 1.0


def test_empty(spark):
    assert rolling_totals(spark.createDataFrame([], SCHEMA), "who", "day", ["n"], [7]).filter(F.lit(True)).count() == 0


def test_every_measure_has_its_average(spark):
    averages = problems.p6_rolling_averages(spark, str(DATA))
    assert {f"{m}_per_day" for m in problems.MEASURES} <= set(averages.columns)
