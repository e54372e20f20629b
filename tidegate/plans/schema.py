"""Schemas of datasets and how they drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidegate.errors import SchemaDriftError

#: What happens when a schema has changed.
DRIFT_MODES = ("PERMISSIVE", "STRICT", "IGNORE")
#: The field types of pipeline documents and lineage.
FIELD_TYPES = ["STRING", "INTEGER", "LONG", "DOUBLE", "DECIMAL", "BOOLEAN", "DATE", "TIMESTAMP", "BYTES", "UNKNOWN", "STRUCT", "ARRAY", "MAP"]

_BY_SPARK = {
    T.StringType: "STRING", T.VarcharType: "STRING", T.CharType: "STRING", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER",
    T.LongType: "LONG", T.FloatType: "DOUBLE", T.DoubleType: "DOUBLE", T.DecimalType: "DECIMAL", T.BooleanType: "BOOLEAN", T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "BYTES", T.StructType: "STRUCT", T.ArrayType: "ARRAY", T.MapType: "MAP",
}


def field_type(t: T.DataType) -> str:
    return _BY_SPARK.get(type(t), "UNKNOWN")


def fields_of(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, field_type(f.dataType)) for f in schema.fields]


def drift(before: list[tuple[str, str]], after: list[tuple[str, str]]) -> list[str]:
    """New fields, then removed ones, then changes of type, in words; nullability does not count."""
    old, new = dict(before), dict(after)
    said = [f"new field: {n} ({t})" for n, t in after if n not in old]
    said += [f"removed field: {n}" for n, _ in before if n not in new]
    return said + [f"type changed: {n} from {old[n]} to {t}" for n, t in after if n in old and old[n] != t]


def check_drift(before: list[tuple[str, str]], df: DataFrame, mode: str = "PERMISSIVE") -> list[str]:
    """Drift of a frame against an earlier schema. PERMISSIVE reports it, STRICT raises, IGNORE is silent."""
    if mode not in DRIFT_MODES:
        raise ValueError(f"unknown drift mode {mode}")
    said = [] if mode == "IGNORE" else drift(before, fields_of(df.schema))
    if said and mode == "STRICT":
        raise SchemaDriftError("; ".join(said))
    return said
