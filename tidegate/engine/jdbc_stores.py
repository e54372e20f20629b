"""Checkpoints and lineage in a relational database, for those who keep their runs there."""

from __future__ import annotations

from dataclasses import astuple, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.engine.checkpoints import StepCheckpoint
from tidegate.lineage.graph import Edge, Field, LineageGraph, Node, to_frames
from tidegate.sources.base import Config, ReadContext
from tidegate.sources.tables import JdbcConnector


class _Database:
    def __init__(self, spark: SparkSession, options: dict[str, str]):
        """``options``: url, and driver, user and password where they are needed."""
        self.spark, self.connector = spark, JdbcConnector()
        self.options = self.connector._options(Config(options))

    def run(self, statements: list[tuple[str, tuple]]) -> None:
        """Statements with values, in one transaction."""
        connection = self.connector._connection(ReadContext(self.spark), self.options)
        try:
            connection.setAutoCommit(False)
            for sql, values in statements:
                prepared = connection.prepareStatement(sql)
                for i, v in enumerate(values, 1):
                    prepared.setString(i, None if v is None else str(v))
                prepared.executeUpdate()
                prepared.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def rows(self, sql: str, values: tuple, columns: int) -> list[tuple]:
        connection = self.connector._connection(ReadContext(self.spark), self.options)
        try:
            prepared = connection.prepareStatement(sql)
            for i, v in enumerate(values, 1):
                prepared.setString(i, v)
            result, out = prepared.executeQuery(), []
            while result.next():
                out.append(tuple(result.getString(i) for i in range(1, columns + 1)))
            return out
        finally:
            connection.close()

    def has(self, table: str) -> bool:
        connection = self.connector._connection(ReadContext(self.spark), self.options)
        try:
            names = connection.getMetaData().getTables(None, None, None, None)
            while names.next():
                if names.getString("TABLE_NAME").lower() == table.lower():
                    return True
            return False
        finally:
            connection.close()

    def frame(self, df: DataFrame, table: str) -> None:
        df.write.format("jdbc").mode("append").options(**self.options, dbtable=table).save()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options, dbtable=table).load()


_COLUMNS = [f.name for f in fields(StepCheckpoint)]


class JdbcCheckpoints:
    """One row per execution and step; saving twice replaces. The table is made if it is not there."""

    def __init__(self, spark: SparkSession, options: dict[str, str], table: str = "step_checkpoints"):
        self.db, self.table = _Database(spark, options), table
        if not self.db.has(table):
            kinds = {"schema_json": "VARCHAR(32000)", "location": "VARCHAR(2000)", "rows": "VARCHAR(30)"}
            columns = ", ".join(f"{self._column(c)} {kinds.get(c, 'VARCHAR(255)')}{' NOT NULL' if c in ('execution_id', 'step_id') else ''}" for c in _COLUMNS)
            self.db.run([(f"CREATE TABLE {table} ({columns}, PRIMARY KEY (execution_id, step_id))", ())])

    @staticmethod
    def _column(name: str) -> str:
        return {"rows": "row_count", "output": "output_name"}.get(name, name)  # words that databases keep for themselves

    def save(self, checkpoint: StepCheckpoint) -> None:
        names = ", ".join(map(self._column, _COLUMNS))
        self.db.run([
            (f"DELETE FROM {self.table} WHERE execution_id = ? AND step_id = ?", (checkpoint.execution_id, checkpoint.step_id)),
            (f"INSERT INTO {self.table} ({names}) VALUES ({', '.join('?' * len(_COLUMNS))})", astuple(checkpoint)),
        ])

    def _select(self, where: str, values: tuple) -> list[StepCheckpoint]:
        names = ", ".join(map(self._column, _COLUMNS))
        found = [dict(zip(_COLUMNS, r)) for r in self.db.rows(f"SELECT {names} FROM {self.table} WHERE {where} ORDER BY completed_at, step_id", values, len(_COLUMNS))]
        return [StepCheckpoint(**{**r, "rows": None if r["rows"] is None else int(r["rows"])}) for r in found]

    def find(self, execution_id: str, step_id: str) -> StepCheckpoint | None:
        found = self._select("execution_id = ? AND step_id = ?", (execution_id, step_id))
        return found[0] if found else None

    def exists(self, execution_id: str, step_id: str) -> bool:
        return self.find(execution_id, step_id) is not None

    def find_all(self, execution_id: str) -> list[StepCheckpoint]:
        return self._select("execution_id = ?", (execution_id,))

    def delete_all(self, execution_id: str) -> None:
        self.db.run([(f"DELETE FROM {self.table} WHERE execution_id = ?", (execution_id,))])


class JdbcLineageStore:
    """Graphs of executions in two tables; saving an execution again replaces it."""

    def __init__(self, spark: SparkSession, options: dict[str, str], nodes: str = "lineage_nodes", edges: str = "lineage_edges"):
        self.db, self.tables = _Database(spark, options), (nodes, edges)
        kinds = {"execution_id": "VARCHAR(64)", "node_id": "BIGINT", "source_node_id": "BIGINT", "target_node_id": "BIGINT"}
        for table, columns in zip(self.tables, (("execution_id", "node_id", "dataset_name", "field_name", "data_type", "step_id"), ("execution_id", "source_node_id", "target_node_id", "transformation_type", "step_id"))):
            if not self.db.has(table):
                self.db.run([(f"CREATE TABLE {table} (" + ", ".join(f'"{c}" {kinds.get(c, "VARCHAR(1000)")}' for c in columns) + ")", ())])

    def save(self, execution: str, graph: LineageGraph) -> None:
        self.db.run([(f'DELETE FROM {t} WHERE "execution_id" = ?', (execution,)) for t in self.tables])
        for table, df in zip(self.tables, to_frames(self.db.spark, execution, graph)):
            self.db.frame(df.coalesce(1), table)

    def load(self, execution: str) -> LineageGraph:
        nodes, edges = (self.db.read(t).filter(F.col("execution_id") == execution) for t in self.tables)
        graph, keys = LineageGraph(), {}
        for r in nodes.orderBy("node_id").collect():
            key: Field = (r["dataset_name"], r["field_name"])
            keys[r["node_id"]] = key
            graph.add_node(Node(*key, r["data_type"], r["step_id"]))
        for r in edges.collect():
            graph.add_edge(Edge(keys[r["source_node_id"]], keys[r["target_node_id"]], r["transformation_type"], r["step_id"]))
        return graph
