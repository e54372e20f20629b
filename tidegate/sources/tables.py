"""SQL over registered tables, JDBC databases and Kafka topics."""

from __future__ import annotations

import logging
import re
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegate import fs
from tidegate.errors import ConnectorError
from tidegate.session import drop_dir, one_process, passing_dir
from tidegate.sources.base import BaseConnector, Config, Health, ReadContext, WriteResult, counted

log = logging.getLogger("tidegate")

#: Databases that live within the process that opens them, so that no two processes may share one.
EMBEDDED = re.compile(r"jdbc:(derby:(?!//)|h2:(?!tcp:|ssl:)|hsqldb:(mem|file|res):|sqlite:|duckdb:)", re.IGNORECASE)
#: Rows that the driver holds at once between an embedded database and the cluster; as many are one transaction.
PASSED_ROWS = 50_000


class SqlConnector(BaseConnector):
    """A query with named parameters, or a table with columns, over the session's tables and views."""

    type = "sql"

    def read(self, ctx: ReadContext, config: Config) -> DataFrame:
        if query := config.text("query"):
            return ctx.spark.sql(query, args={**ctx.params, **(config.get("params") or {})})
        df = ctx.spark.table(config.need("table"))
        columns = config.names("columns")
        return df.select(*columns) if columns else df

    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult:
        mode = {"INSERT": "append", "TRUNCATE_INSERT": "overwrite"}.get(config.text("mode", "INSERT").upper())
        if mode is None:
            raise ConnectorError(f"sql: unknown mode {config.text('mode')}")
        name = config.need("table")
        return WriteResult(counted(df, lambda d: d.write.mode(mode).saveAsTable(name)), 0, name)


def bind(query: str, params: dict) -> str:
    """The query with ``:name`` replaced by literals; names inside quotes, after ``::`` and longer names stay."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool) or isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    def put(m: re.Match) -> str:
        name = m.group("name")
        if name is None:
            return m.group(0)
        if name not in params:
            raise ConnectorError(f"the query has no value for :{name}")
        return literal(params[name])

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|::|:(?P<name>[A-Za-z_]\w*)", put, query)


class JdbcConnector(BaseConnector):
    """Reads a query or a table (in parallel with partitionColumn, lowerBound, upperBound, numPartitions);
    writes with INSERT, TRUNCATE_INSERT or UPSERT on ``key``.

    On a cluster an embedded database is the driver's: executors would each open one of their own. Its rows pass
    through the driver, some at a time; what is read is stored in the shared folder when ``read`` is called.
    """

    def __init__(self, kind: str = "jdbc", defaults: dict | None = None):
        self.type, self.defaults = kind, defaults or {}

    def _options(self, config: Config) -> dict[str, str]:
        merged = Config(self.defaults | config)
        found = {"url": merged.need("url")}
        for k in ("driver", "user", "password", "fetchsize", "partitionColumn", "lowerBound", "upperBound", "numPartitions", "batchsize", "isolationLevel"):
            if merged.get(k) is not None:
                found[k] = str(merged[k])
        return found

    def read(self, ctx: ReadContext, config: Config) -> DataFrame:
        options = self._options(config)
        if query := config.text("query"):
            return self._load(ctx, options | {"query": bind(query, {**ctx.params, **(config.get("params") or {})})})
        return self._load(ctx, options | {"dbtable": config.need("table")}, config.names("columns"))

    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult:
        began, name, mode = time.perf_counter(), config.need("table"), config.text("mode", "INSERT").upper()
        options = self._options(config) | {"dbtable": name}

        def put(d: DataFrame) -> None:
            if mode == "INSERT":
                self._save(ctx, d, "append", options)
            elif mode == "TRUNCATE_INSERT":
                self._save(ctx, d, "overwrite", options | {"truncate": "true"})
            elif mode == "UPSERT":
                self._upsert(ctx, d, config, options)
            else:
                raise ConnectorError(f"{self.type}: unknown mode {mode}")

        return WriteResult(counted(df, put), 0, name, (time.perf_counter() - began) * 1000)

    def _upsert(self, ctx: ReadContext, df: DataFrame, config: Config, options: dict[str, str]) -> None:
        """Load a side table in parallel, then let the database replace the rows of equal key in one transaction."""
        keys = config.names("key")
        if not keys:
            raise ConnectorError(f"{self.type}: UPSERT needs a key")
        from tidegate.operators.upsert import last_per_key

        target = options["dbtable"]
        side = f"{target}_in_{uuid.uuid4().hex[:12]}"  # executions that run together have one each
        columns = ", ".join(f'"{c}"' for c in df.columns)
        same = " AND ".join(f'{side}."{k}" = {target}."{k}"' for k in keys)
        try:
            self._save(ctx, last_per_key(df, keys, config.names("orderBy")), "error", options | {"dbtable": side})
            try:  # without it some databases read the whole side table for each row of the target
                self.run(ctx, options, [f"CREATE INDEX {side}_key ON {side} (" + ", ".join(f'"{k}"' for k in keys) + ")"])
            except Exception as e:  # of types that have no index
                log.debug("side table %s: %s", side, e)
            self.run(ctx, options, [f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {side} WHERE {same})", f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {side}"])
        finally:
            try:
                self.run(ctx, options, [f"DROP TABLE {side}"])
            except Exception as e:  # it may never have come to be
                log.debug("side table %s: %s", side, e)

    @staticmethod
    def _apart(ctx: ReadContext, options: dict[str, str]) -> bool:
        """Whether the executors cannot see the database that the driver sees."""
        return bool(EMBEDDED.match(options["url"])) and not one_process(ctx.spark)

    def _load(self, ctx: ReadContext, options: dict[str, str], columns: list[str] | None = None) -> DataFrame:
        df = ctx.spark.read.format("jdbc").options(**options).load()
        df = df.select(*columns) if columns else df
        return self._fetch(ctx, df, options) if self._apart(ctx, options) else df

    def _fetch(self, ctx: ReadContext, df: DataFrame, options: dict[str, str]) -> DataFrame:
        """The rows of ``df`` read on one connection of the driver, as Parquet in the shared folder."""
        jvm, session, schema = ctx.spark.sparkContext._jvm, ctx.spark._jsparkSession, df._jdf.schema()
        settings, dialect = self._settings(ctx, options)
        path, list_of = passing_dir(ctx.spark), jvm.scala.collection.JavaConverters.seqAsJavaList
        store = lambda rows: DataFrame(session.createDataFrame(rows, schema), ctx.spark).coalesce(1).write.mode("append").parquet(path)
        connection = self._connection(ctx, options)
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            statement.setFetchSize(int(options.get("fetchsize", 0)))
            names = ", ".join(dialect.quoteIdentifier(c) for c in df.columns)
            found = statement.executeQuery(f"SELECT {names} FROM {settings.tableOrQuery()}")
            rows = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils.resultSetToRows(found, schema, dialect).grouped(PASSED_ROWS)
            store(jvm.java.util.ArrayList())  # so that there is a table even without rows
            while rows.hasNext():
                store(list_of(rows.next()))
            connection.commit()
        finally:
            connection.close()
        return ctx.spark.read.schema(df.schema).parquet(path)

    def _save(self, ctx: ReadContext, df: DataFrame, mode: str, options: dict[str, str]) -> None:
        """Append to the table, or make it anew (``error``, ``overwrite``)."""
        if not self._apart(ctx, options):
            df.write.format("jdbc").mode(mode).options(**options).save()
            return
        jvm, session = ctx.spark.sparkContext._jvm, ctx.spark._jsparkSession
        utils, schema = jvm.org.apache.spark.sql.execution.datasources.jdbc.JdbcUtils, df._jdf.schema()
        path = passing_dir(ctx.spark)
        df.write.option("compression", "lz4").option("maxRecordsPerFile", PASSED_ROWS).parquet(path)  # all rows are there before the first is inserted
        # Without rows and partitions Spark makes or empties the table on the driver, and no more.
        DataFrame(session.createDataFrame(jvm.java.util.ArrayList(), schema), ctx.spark).write.format("jdbc").mode(mode).options(**options).save()
        settings, dialect = self._settings(ctx, options)
        connection = self._connection(ctx, options)
        try:
            there = utils.getSchemaOption(connection, settings)
        finally:
            connection.close()
        exact = ctx.spark.conf.get("spark.sql.caseSensitive") == "true"
        insert = utils.getInsertStatement(options["dbtable"], schema, there, exact, dialect)
        for part in fs.children(ctx.spark, path):
            if part.startswith("part-"):
                rows = ctx.spark.read.schema(df.schema).parquet(f"{path}/{part}")._jdf.collectAsList()
                passing = jvm.scala.collection.JavaConverters.asScalaIterator(rows.iterator())
                with self._as_task(ctx):
                    utils.savePartition(options["dbtable"], passing, schema, insert, settings.batchSize(), dialect, settings.isolationLevel(), settings)
        drop_dir(ctx.spark, path)

    @staticmethod
    @contextmanager
    def _as_task(ctx: ReadContext):
        """Spark's writer of a partition wants a task around it, which has its counters and the session's settings."""
        tasks = getattr(getattr(ctx.spark.sparkContext._jvm.org.apache.spark, "TaskContext$"), "MODULE$")
        task = tasks.empty()
        for k, v in ctx.spark.conf.getAll.items():
            if k.startswith("spark.sql."):
                task.getLocalProperties().setProperty(k, v)
        tasks.setTaskContext(task)
        try:
            yield
        finally:
            tasks.unset()

    @staticmethod
    def _settings(ctx: ReadContext, options: dict[str, str]) -> tuple:
        """Spark's own settings of a connection, and the dialect of its database."""
        jvm = ctx.spark.sparkContext._jvm
        found = jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(jvm.PythonUtils.toScalaMap(options))
        return found, jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"])

    def _connection(self, ctx: ReadContext, options: dict[str, str]):
        """A connection of the driver, with the settings that reading and writing have."""
        jvm = ctx.spark.sparkContext._jvm
        if options.get("driver"):
            jvm.org.apache.spark.util.Utils.classForName(options["driver"], True, False)
        props = jvm.java.util.Properties()
        for k in ("user", "password"):
            if options.get(k):
                props.setProperty(k, options[k])
        return jvm.java.sql.DriverManager.getConnection(options["url"], props)

    def run(self, ctx: ReadContext, options: dict[str, str], statements: list[str]) -> None:
        """Statements in one transaction."""
        connection = self._connection(ctx, options)
        try:
            connection.setAutoCommit(False)
            for s in statements:
                statement = connection.createStatement()
                statement.executeUpdate(s)
                statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def health(self, ctx: ReadContext, config: Config) -> Health:
        began = time.perf_counter()
        try:
            connection = self._connection(ctx, self._options(config))
            ok = connection.isValid(3)
            connection.close()
            return Health(self.type, ok, (time.perf_counter() - began) * 1000, "" if ok else "the connection is not valid")
        except Exception as e:
            return Health(self.type, False, reason=str(e).splitlines()[0])


def kafka_message(df: DataFrame, key: str | None) -> DataFrame:
    """(key, value): the key column as text (a null key is the text null) and the row as JSON."""
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")) if key else F.lit(None).cast("string")
    return df.select(k.alias("key"), F.to_json(F.struct(*[f"`{c}`" for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))


def kafka_rows(raw: DataFrame, schema: str) -> DataFrame:
    """Parsed JSON values with _kafka_offset, _kafka_partition and _kafka_timestamp; what does not parse is dropped."""
    parsed = raw.select(F.from_json(F.col("value").cast("string"), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__tg_bad"}).alias("r"), F.col("offset").alias("_kafka_offset"), F.col("partition").alias("_kafka_partition"), F.unix_millis(F.col("timestamp").cast("timestamp")).alias("_kafka_timestamp"))
    whole = parsed.filter(F.col("r").isNotNull() & F.col("r.__tg_bad").isNull())
    return whole.select("r.*", "_kafka_offset", "_kafka_partition", "_kafka_timestamp").drop("__tg_bad")


class KafkaConnector(BaseConnector):
    """A topic on brokers, or with ``path`` the same records as Parquet files (partition, offset, timestamp, key, value)."""

    type = "kafka"

    def _raw(self, ctx: ReadContext, config: Config) -> DataFrame:
        if path := config.text("path"):
            return ctx.spark.read.parquet(f"{path.rstrip('/')}/{config.need('topic')}")
        reader = ctx.spark.read.format("kafka").option("kafka.bootstrap.servers", config.need("bootstrapServers")).option("subscribe", config.need("topic"))
        group = f"{config.text('groupPrefix', 'tidegate')}-{ctx.execution_id}"
        try:
            return reader.option("startingOffsets", config.text("startingOffsets", "earliest")).option("kafka.group.id", group).load()
        except Exception as e:
            raise ConnectorError(f"kafka: the session has no Kafka package, or the brokers cannot be read: {e}") from e

    def read(self, ctx: ReadContext, config: Config) -> DataFrame:
        raw = self._raw(ctx, config)
        most = config.whole("maxRecords", 0)
        if most > 0:  # a bounded poll where one is asked for, the first of the lowest partitions; otherwise all
            raw = raw.orderBy("partition", "offset").limit(most)
        schema = config.text("schema") or self._schema(raw)
        return kafka_rows(raw, f"{schema}, __tg_bad string")

    def _schema(self, raw: DataFrame) -> str:
        first = raw.select(F.col("value").cast("string").alias("v")).filter("try_parse_json(v) is not null").limit(1).collect()
        if not first:
            return "value string"
        sample = F.lit(first[0]["v"])
        found = raw.sparkSession.range(1).select(F.from_json(sample, F.schema_of_json(sample)).alias("r")).select("r.*").schema
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found)

    def write(self, ctx: ReadContext, df: DataFrame, config: Config) -> WriteResult:
        began, topic = time.perf_counter(), config.need("topic")
        key = config.text("partitionBy")

        def put(d: DataFrame) -> None:
            messages = kafka_message(d, key)
            if path := config.text("path"):
                at = f"{path.rstrip('/')}/{topic}"
                self._append(ctx, messages, at, config.whole("partitions", 4))
            else:
                messages.write.format("kafka").option("kafka.bootstrap.servers", config.need("bootstrapServers")).option("kafka.acks", "all").option("topic", topic).save()

        return WriteResult(counted(df, put), 0, topic, (time.perf_counter() - began) * 1000)

    def _append(self, ctx: ReadContext, messages: DataFrame, at: str, partitions: int) -> None:
        begin: Column = F.lit(0).cast("bigint")
        placed = messages.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
        number = F.row_number().over(Window.partitionBy("partition").orderBy("key", "value")).cast("bigint") - 1
        if fs.exists(ctx.spark, at):
            ends = ctx.spark.read.parquet(at).groupBy("partition").agg((F.max("offset") + 1).alias("begin"))
            placed = placed.join(F.broadcast(ends), "partition", "left")  # a row per partition
            begin = F.coalesce("begin", F.lit(0).cast("bigint"))
        placed.select("partition", (number + begin).alias("offset"), F.current_timestamp().alias("timestamp"), "key", "value").write.mode("append").parquet(at)

    def health(self, ctx: ReadContext, config: Config) -> Health:
        if not config.text("topic"):
            return Health(self.type, False, reason="the setting 'topic' is missing")
        began = time.perf_counter()
        try:
            self._raw(ctx, config).limit(0).count()
            return Health(self.type, True, (time.perf_counter() - began) * 1000)
        except Exception as e:
            return Health(self.type, False, reason=str(e).splitlines()[0])
