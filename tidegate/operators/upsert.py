"""Upserts without a table format: the incoming rows replace the stored rows of the same key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegate import fs


def last_per_key(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key: the one with the largest ``order_by``, or without it the largest row, so that the result is the same each time.
    Rows with a null key are dropped.

    An aggregate with map-side combine, so a key with very many rows is no burden.
    """
    rows = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    whole = F.struct(*[f"`{c}`" for c in df.columns])
    # Maps have no order; as text they have.
    plain = [F.col(f"`{c}`").cast("string") if "map<" in t or t == "variant" else F.col(f"`{c}`") for c, t in df.dtypes]
    picked = F.max_by(whole, F.struct(*[f"`{c}`" for c in order_by] if order_by else plain))
    return rows.groupBy(*[f"`{k}`" for k in keys]).agg(picked.alias("__tg_row")).select("__tg_row.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """The existing rows without those that come anew, and the last incoming row of each key."""
    fresh = last_per_key(incoming, keys, order_by or [])
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert_parquet(df: DataFrame, path: str, keys: list[str], order_by: list[str] | None = None) -> None:
    """Upsert into a Parquet folder: the result is written beside it and swapped in at once."""
    if not keys:
        raise ValueError("an upsert needs a key")
    spark = df.sparkSession
    result = upsert(spark.read.parquet(path), df, keys, order_by) if fs.exists(spark, path) else last_per_key(df, keys, order_by or [])
    beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    result.write.parquet(beside)
    fs.swap_in(spark, beside, path)
