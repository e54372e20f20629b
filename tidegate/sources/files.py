"""CSV, JSON and Parquet files."""

from __future__ import annotations

import json as jsonlib
import re
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate import fs
from tidegate.errors import ConnectorError
from tidegate.functions.text import trim_control
from tidegate.sources.base import BaseConnector, Config, Health, ReadContext, WriteResult, counted


class _Files(BaseConnector):
    def health(self, ctx: ReadContext, config: Config) -> Health:
        path = config.text("path")
        if not path or not path.strip():
            return Health(self.type, False, reason="the setting 'path' is missing")
        began = time.perf_counter()
        fs.exists(ctx.spark, path)
        return Health(self.type, True, (time.perf_counter() - began) * 1000)

    def _put(self, df: DataFrame, config: Config, write) -> WriteResult:
        began = time.perf_counter()
        n = counted(df, write)
        return WriteResult(n, 0, config.need("path"), (time.perf_counter() - began) * 1000)


class CsvConnector(_Files):
    """All columns are text. ``strict`` reads line by line: the delimiter is a regular expression, quotes mean
    nothing, blank lines are rows, short rows are filled with nulls and surplus cells dropped."""

    type = "csv"

    def read(self, ctx: ReadContext, config: Config) -> DataFrame:
        path, header = config.need("path"), config.flag("hasHeader", True)
        sep = config.text("delimiter", ",")
        if config.flag("strict", False):
            return self._strict(ctx, path, header, sep)
        names = self._names(ctx, path, header, sep)
        if not names:
            return ctx.spark.createDataFrame([], T.StructType([]))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        options = {"header": header, "sep": sep, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "enforceSchema": True}
        return ctx.spark.read.schema(schema).options(**options).csv(path)

    def _first(self, ctx: ReadContext, path: str) -> str | None:
        row = ctx.spark.read.text(path).limit(1).collect()
        return row[0]["value"] if row else None

    def _names(self, ctx: ReadContext, path: str, header: bool, sep: str) -> list[str]:
        if header:
            return [c.strip() for c in ctx.spark.read.options(header=True, sep=sep).csv(path).columns]
        return [f"col_{i}" for i in range(len(ctx.spark.read.options(sep=sep).csv(path).columns))]

    def _strict(self, ctx: ReadContext, path: str, header: bool, sep: str) -> DataFrame:
        first = self._first(ctx, path)
        if first is None:
            return ctx.spark.createDataFrame([], T.StructType([]))
        cells = re.split(sep, first)
        names = [c.strip() for c in cells] if header else [f"col_{i}" for i in range(len(cells))]
        lines = ctx.spark.read.text(path)
        if header:
            # Only each file's true first line is its header; a later line with the same text is a row.
            lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
            heads = lines.filter("block = 0").groupBy("file").agg(F.min("n").alias("n"))
            lines = lines.join(F.broadcast(heads), ["file", "n"], "left_anti")
        parts = F.split("value", sep, -1)
        return lines.select(*[trim_control(F.get(parts, i)).alias(n) for i, n in enumerate(names)])

    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult:
        """Modes OVERWRITE (CREATE is the same) and APPEND, which needs an existing target."""
        path, mode = config.need("path"), config.text("mode", "OVERWRITE").upper()
        if mode not in ("OVERWRITE", "CREATE", "APPEND"):
            raise ConnectorError(f"csv: unknown mode {mode}")
        if mode == "APPEND" and not fs.exists(ctx.spark, path):
            raise ConnectorError(f"csv: nothing to append to at {path}")
        header = config.flag("hasHeader", True) and (mode != "APPEND" or config.flag("directory", True))
        options = {"header": header, "sep": config.text("delimiter", ","), "emptyValue": "", "nullValue": ""}
        if config.flag("singleFile", False):
            return self._put(df.coalesce(1), config, lambda d: fs.write_single(ctx.spark, path, lambda to: d.write.options(**options).csv(to), append=mode == "APPEND"))
        return self._put(df, config, lambda d: d.write.mode("append" if mode == "APPEND" else "overwrite").options(**options).csv(path))


class JsonConnector(_Files):
    """``format`` ARRAY (a whole file is a list of objects) or LINES (one object per line; a bad line is an error)."""

    type = "json"

    def read(self, ctx: ReadContext, config: Config) -> DataFrame:
        path, lines = config.need("path"), config.text("format", "ARRAY").upper() == "LINES"
        reader = ctx.spark.read.option("mode", "FAILFAST")
        if schema := config.text("schema"):
            reader = reader.schema(schema)
        try:
            df = reader.json(path) if lines else reader.option("multiLine", True).json(path)
        except AnalysisException:
            raise
        except Exception as e:
            raise ConnectorError(f"{path} holds what is no JSON: {str(e).splitlines()[0]}") from e
        order = self._order(ctx, path, lines)
        return df.select(*[f"`{c}`" for c in order if c in df.columns], *[f"`{c}`" for c in df.columns if c not in order])

    def _order(self, ctx: ReadContext, path: str, lines: bool) -> list[str]:
        """Keys of the first object, in its order; the reader sorts names."""
        if lines:
            row = ctx.spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
            text = row[0]["value"] if row else "{}"
            return self._keys(text)
        row = ctx.spark.read.format("binaryFile").load(path).select("path").limit(1).collect()  # lists files, reads none
        for text in fs.heads(ctx.spark, row[0]["path"]) if row else ():
            if keys := self._keys(text.lstrip().removeprefix("[").lstrip()):
                return keys
        return []

    def _keys(self, text: str) -> list[str]:
        """The keys of the object that a text begins with; none if it is not whole yet."""
        try:
            first, _ = jsonlib.JSONDecoder().raw_decode(text)
            return list(first) if isinstance(first, dict) else []
        except ValueError:
            return []

    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult:
        """LINES in parallel. ARRAY is one document, so it is written by one task, row by row."""
        path, form = config.need("path"), config.text("format", "ARRAY").upper()
        if form == "LINES":
            return self._put(df, config, lambda d: d.write.mode("overwrite").option("ignoreNullFields", False).json(path))
        options = {"ignoreNullFields": "false"} | ({"pretty": "true"} if config.flag("pretty", False) else {})

        def brackets(batches):
            import pyarrow as pa

            began = False
            for batch in batches:
                rows = batch.column(0).to_pylist()
                if rows:
                    yield pa.RecordBatch.from_pydict({"value": [("," if began or i else "[") + "\n" + r for i, r in enumerate(rows)]})
                    began = True
            yield pa.RecordBatch.from_pydict({"value": ["]" if began else "[]"]})

        def put(d: DataFrame) -> None:
            text = d.select(F.to_json(F.struct(*[f"`{c}`" for c in d.columns]), options).alias("value"))
            text.coalesce(1).mapInArrow(brackets, "value string").write.mode("overwrite").text(path)

        return self._put(df, config, put)


class ParquetConnector(_Files):
    type = "parquet"

    def read(self, ctx: ReadContext, config: Config) -> DataFrame:
        df = ctx.spark.read.option("mergeSchema", config.flag("mergeSchema", False)).parquet(config.need("path"))
        columns = config.names("columns")
        return df.select(*columns) if columns else df

    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult:
        """Modes OVERWRITE, APPEND and UPSERT (with ``key``: see ``operators.upsert``)."""
        path, mode = config.need("path"), config.text("mode", "OVERWRITE").upper()
        by = config.names("partitionBy")
        if mode == "UPSERT":
            from tidegate.operators.upsert import upsert_parquet

            return self._put(df, config, lambda d: upsert_parquet(d, path, config.names("key"), config.names("orderBy")))
        if mode not in ("OVERWRITE", "APPEND", "INSERT"):
            raise ConnectorError(f"parquet: unknown mode {mode}")
        return self._put(df, config, lambda d: d.write.mode("overwrite" if mode == "OVERWRITE" else "append").partitionBy(*by).parquet(path))
