"""Text functions whose edge cases matter: blanks, trims, full matches, numbers and instants."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_blank(c: Column) -> Column:
    r"""Only white space of any script (a no-break space is none), or nothing at all."""
    return c.rlike(r"^\p{javaWhitespace}*\z")


def trim_control(c: Column) -> Column:
    """Without leading and trailing characters up to and including the space."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def matches_whole(c: Column, pattern: str) -> Column:
    """The whole text matches; a trailing line break is part of the text."""
    return c.rlike(rf"\A(?:{pattern})\z")


def pattern_is_valid(spark: SparkSession, pattern: str | None) -> bool:
    """Whether the JVM accepts the regular expression."""
    if pattern is None or not pattern.strip():
        return False
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def to_number(c: Column, kind: T.DataType) -> Column:
    """A number as double, or null. Other types count by their text, so true and times are no numbers."""
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    text = c.cast("string")
    # The cast knows short forms of infinity that are not numbers elsewhere.
    return F.when(F.lower(F.trim(text)).rlike(r"^[+-]?inf$"), None).otherwise(text.try_cast("double"))


def to_instant(c: Column, kind: T.DataType) -> Column:
    """A time from a timestamp, epoch milliseconds (bigint) or ISO-8601 text with a zone; else null."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("timestamp")
    if isinstance(kind, T.LongType):
        return F.timestamp_millis(c)
    if isinstance(kind, T.StringType):
        iso = r"^[+-]?\d{4,}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}(:?\d{2})?)$"
        return F.when(c.rlike(iso), F.try_to_timestamp(c))
    return F.lit(None).cast("timestamp")
