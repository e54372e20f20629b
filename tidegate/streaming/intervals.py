"""Interval merging on a stream: the ordered interval map of each entity is keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegate.operators.intervals import IntervalMap

STATE = "starts array<bigint>, ends array<bigint>"


def merge_stream(df: DataFrame, key: str, start_us: str, end_us: str) -> DataFrame:
    """(key, kind, start_us, end_us) in update mode: after each batch the periods and gaps of every entity it touched.

    ``key`` is text. Rows that are no intervals are ignored, as in ``merge_intervals``. An entity's state is its
    disjoint periods, which is what the result holds too.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = IntervalMap(*(state.get if state.exists else ((), ())))
        for pdf in batches:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
                held.add(a, b)
        state.update((held.starts, held.ends))
        rows = [(k[0], "period", a, b) for a, b in held.periods()] + [(k[0], "gap", a, b) for a, b in held.gaps()]
        yield pd.DataFrame(rows, columns=[key, "kind", "start_us", "end_us"])

    rows = df.select(F.col(key).alias("k"), F.col(start_us).cast("bigint").alias("a"), F.col(end_us).cast("bigint").alias("b")).filter("b > a")
    return rows.groupBy("k").applyInPandasWithState(update, f"{key} string, kind string, start_us bigint, end_us bigint", STATE, "update", GroupStateTimeout.NoTimeout)
