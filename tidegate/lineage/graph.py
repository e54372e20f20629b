"""Field-level lineage: what each step reads and writes, and what depends on what."""

from __future__ import annotations

import threading
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.errors import TidegateError
from tidegate.session import cut, cut_and_count, drop, read_cuts

#: How a field came from another.
KINDS = ("SOURCE", "JOIN", "FILTER", "AGGREGATE", "SELECT", "SINK", "CUSTOM")

Field = tuple[str, str]


@dataclass(frozen=True)
class Node:
    dataset: str
    field: str
    type: str
    step: str


@dataclass(frozen=True)
class Edge:
    source: Field
    target: Field
    kind: str
    step: str


class LineageGraph:
    """Nodes by dataset and field (the first to come stays) and edges; repeated edges are allowed."""

    def __init__(self):
        self.nodes: dict[Field, Node] = {}
        self.edges: list[Edge] = []
        self._down: dict[Field, list[Field]] = {}
        self._up: dict[Field, list[Field]] = {}
        self._lock = threading.Lock()

    def add_node(self, node: Node) -> None:
        with self._lock:
            self.nodes.setdefault((node.dataset, node.field), node)

    def add_edge(self, edge: Edge) -> None:
        with self._lock:
            self.edges.append(edge)
            self._down.setdefault(edge.source, []).append(edge.target)
            self._up.setdefault(edge.target, []).append(edge.source)

    def _walk(self, start: Field, links: dict[Field, list[Field]]) -> list[Node]:
        seen, queue, out = {start}, deque([start]), []
        while queue:
            for nxt in links.get(queue.popleft(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    queue.append(nxt)
                    if nxt in self.nodes:
                        out.append(self.nodes[nxt])
        return out

    def downstream(self, dataset: str, field: str) -> list[Node]:
        """What depends on a field, nearest first, without the field itself."""
        return self._walk((dataset, field), self._down)

    def upstream(self, dataset: str, field: str) -> list[Node]:
        """What a field depends on, nearest first, without the field itself."""
        return self._walk((dataset, field), self._up)

    def sources(self) -> list[Node]:
        return [n for k, n in self.nodes.items() if k not in self._up]


class LineageRecorder:
    """Writes what steps do into a graph. Fields are (name, type) pairs."""

    def __init__(self, graph: LineageGraph | None = None):
        self.graph = graph or LineageGraph()

    def _nodes(self, dataset: str, fields: list[tuple[str, str]], step: str) -> None:
        for name, kind in fields:
            self.graph.add_node(Node(dataset, name, kind, step))

    def source(self, dataset: str, fields: list[tuple[str, str]], step: str) -> None:
        self._nodes(dataset, fields, step)

    def same_names(self, kind: str, inputs: dict[str, list[tuple[str, str]]], dataset: str, fields: list[tuple[str, str]], step: str) -> None:
        """Each output field comes from the field of that name in every input that has it."""
        self._nodes(dataset, fields, step)
        for name, _ in fields:
            for source, theirs in inputs.items():
                if any(n == name for n, _ in theirs):
                    self.graph.add_edge(Edge((source, name), (dataset, name), kind, step))

    def mapped(self, kind: str, source: str, dataset: str, fields: list[tuple[str, str]], origins: dict[str, list[str]], step: str) -> None:
        """Each output field comes from the input fields that ``origins`` names, as far as they are known."""
        self._nodes(dataset, fields, step)
        for name, _ in fields:
            for old in origins.get(name, ()):
                if (source, old) in self.graph.nodes:
                    self.graph.add_edge(Edge((source, old), (dataset, name), kind, step))


    def traced(self, kind: str, dataset: str, fields: list[tuple[str, str]], sources: dict[str, list[tuple[str, str]]], step: str) -> None:
        """Each output field comes from the (dataset, field) pairs that ``sources`` names, as far as they are known."""
        self._nodes(dataset, fields, step)
        for name, _ in fields:
            for old in sources.get(name, ()):
                if old in self.graph.nodes:
                    self.graph.add_edge(Edge(old, (dataset, name), kind, step))


NODES = "execution_id string, node_id bigint, dataset_name string, field_name string, data_type string, step_id string"
EDGES = "execution_id string, source_node_id bigint, target_node_id bigint, transformation_type string, step_id string"


def to_frames(spark: SparkSession, execution: str, graph: LineageGraph) -> tuple[DataFrame, DataFrame]:
    """A graph as two tables; edges whose ends are no nodes are left out."""
    ids = {k: i for i, k in enumerate(graph.nodes, 1)}
    nodes = [(execution, ids[k], n.dataset, n.field, n.type, n.step) for k, n in graph.nodes.items()]
    edges = [(execution, ids[e.source], ids[e.target], e.kind, e.step) for e in graph.edges if e.source in ids and e.target in ids]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


class LineageStore:
    """Graphs of executions as Parquet under one folder, a partition for each execution."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, execution: str, graph: LineageGraph) -> None:
        for name, df in zip(("nodes", "edges"), to_frames(self.spark, execution, graph)):
            df.drop("execution_id").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/execution_id={execution}")

    def load(self, execution: str) -> LineageGraph:
        graph = LineageGraph()
        read = lambda name: self.spark.read.parquet(f"{self.path}/{name}/execution_id={execution}")
        keys: dict[int, Field] = {}
        for r in read("nodes").orderBy("node_id").collect():
            keys[r["node_id"]] = (r["dataset_name"], r["field_name"])
            graph.add_node(Node(r["dataset_name"], r["field_name"], r["data_type"], r["step_id"]))
        for r in read("edges").collect():
            graph.add_edge(Edge(keys[r["source_node_id"]], keys[r["target_node_id"]], r["transformation_type"], r["step_id"]))
        return graph


def reachable(edges: DataFrame, starts: DataFrame, downstream: bool = True, most: int | None = None) -> DataFrame:
    """(node_id, distance): all nodes that the ``starts`` (node_id) lead to, or come from, without themselves.

    ``edges`` has source_node_id and target_node_id. A node is visited once, so cycles end; rounds are
    joins, and each round writes the nodes that are new in it to the shared folder. For very deep graphs see ``hierarchy``.
    It ends when a round finds no fresh node; nodes beyond ``most`` links, if that is given, are an error.
    """
    a, b = ("source_node_id", "target_node_id") if downstream else ("target_node_id", "source_node_id")
    links = cut(edges.select(F.col(a).alias("node_id"), F.col(b).alias("next")).filter("node_id is not null and next is not null").distinct())
    parts, found = [cut(starts.select("node_id").distinct().withColumn("distance", F.lit(0)))], 1
    while found:
        fresh = parts[-1].join(links, "node_id").select(F.col("next").alias("node_id")).distinct().join(read_cuts(parts), "node_id", "left_anti")
        new, found = cut_and_count(fresh.withColumn("distance", F.lit(len(parts))), "true")
        parts.append(new)
        if found and most is not None and len(parts) - 1 > most:
            for p in parts:
                drop(p)
            raise TidegateError(f"there are nodes more than {most} links away")
    drop(links)
    return read_cuts(parts).filter("distance > 0")


def source_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("target_node_id").alias("node_id")), "node_id", "left_anti")
