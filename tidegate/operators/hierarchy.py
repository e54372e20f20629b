"""Parent-child links of unknown depth -> path, depth, root and descendants of every node.

1. Pointer doubling over the nodes that have children: in round k a node knows its ancestor 2^k
   levels up. A node whose pointer ends knows its root. Only nodes still pointing somewhere are
   joined and written in a round, so rounds get smaller.
2. Nodes whose pointer never ends lead to a cycle. With the pointer they carry the smallest id
   on the way; once a round changes none of them, every node of a cycle carries the cycle's
   smallest id, and the pointers' targets are just the cycle nodes. Their links are cut, so they
   become roots.
3. Heavy-path decomposition: each node's child with the largest subtree continues its chain,
   every other child begins one. A path crosses at most log2(n) chains.
4. Depth, path and pre-order number are then sums and concatenations over chains: a node's
   place in its chain, and for each chain what its head's parent contributes. A node's
   descendants are the numbers ``descendants_from .. descendants_to`` of its tree ``tree_no``.

Trees of at most ``target_rows`` nodes are gathered, many to a task, and 3 and 4 are done in numpy
there. Larger trees are never gathered: for them sizes, chains and sums are joins and aggregates over
(node, pointer) rows, and chains are cut into pieces of ``PIECE`` nodes. Both ways give the same rows.

Defined results:
* a link counts if both ends are nodes; repeated links count once; of several parents of a child
  the smallest counts; rows with a null id or a null end are ignored;
* repeated node rows count once, with the smallest label; a null label is an empty step in paths;
* ``status`` is ``cycle`` (on a cycle; root is its smallest id, depth 0), ``below_cycle`` (depth
  counts from the nearest cycle node, the root is the same) or ``tree``; nodes without links are trees;
* descendants of a cycle node are those that hang below it once the cycle is cut;
* children are numbered with the largest subtree first, then by id;
* an empty table gives an empty result; extra columns are ignored.

Nothing is gathered on the driver. Every round's rows are written to the shared folder, so lost
executors cost one round; what a call has written is dropped when its result needs it no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegate.session import cut, cut_and_count, drop, read_cuts

#: Trees of more nodes are worked on in parts, by joins.
TARGET_ROWS = 100_000
#: Nodes of a chain whose labels one task strings together.
PIECE = 64
#: Rows of small trees that a task takes at a time (about).
BATCH = 50_000

POINTS, ENDS = "j is not null", "j is null"


def _hop(t: DataFrame, up: DataFrame, take: list[str]) -> DataFrame:
    """Rows of ``t`` that point somewhere, with ``take`` columns of the row they point to as ``up_*``."""
    return t.filter(POINTS).join(up.select(F.col("v").alias("j"), *[F.col(c).alias(f"up_{c}") for c in take]), "j")


class _Rounds:
    """Rows (v, j, ...) of pointer doubling: those that have ended, by the round they ended in, and those that go on."""

    def __init__(self, t: DataFrame):
        self.parts: list[DataFrame] = []
        self._write(t)

    def _write(self, t: DataFrame) -> None:
        self.now, self.pointing = cut_and_count(t.withColumn("k", F.lit(len(self.parts))), POINTS)
        self.parts.append(self.now)

    def everyone(self) -> DataFrame:
        """All rows as they are now: the last round's, and those that ended before. One scan, whatever the number of rounds."""
        return read_cuts(self.parts).filter(f"{ENDS} or k = {len(self.parts) - 1}").drop("k")

    def step(self, take: list[str], columns: list) -> int:
        """One doubling; how many rows ended in it."""
        before = self.pointing
        self._write(_hop(self.now, self.everyone(), take).select("v", *columns))
        return before - self.pointing

    def drop(self) -> None:
        for part in self.parts:
            drop(part)


def _smallest_on_cycles(t: DataFrame) -> DataFrame:
    """(v, j, root, parent) of rows (v, j, low, parent) that all lead to cycles; ``low`` is the smallest id on the way to ``j``, ``j`` not included.

    In a round the smallest id met from ``j`` on becomes known. Windows of twice the length change it for some
    node unless each lies wholly on a cycle and covers it; and then all pointers end on cycles.
    """
    at, changed = t.withColumn("root", F.lit(None).cast("bigint")), 1
    while changed:
        moved = _hop(at, at, ["j", "low"]).select(
            "v", F.col("up_j").alias("j"), F.least("low", "up_low").alias("low"), F.col("up_low").alias("root"), "parent", (~F.col("root").eqNullSafe(F.col("up_low"))).alias("changed")
        )
        before = at
        at, changed = cut_and_count(moved, "changed")
        drop(before)
    return at.select("v", "j", "root", "parent")


# Small trees, in numpy.


def _reach(j: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointer doubling: the last node upwards from each, and the sum of ``sums`` on the way, the last node's left out."""
    top = np.where(j < 0, np.arange(len(j)), j)
    total = np.where(j < 0, 0, sums)
    while (j >= 0).any():
        on = np.flatnonzero(j >= 0)
        up = j[on]
        total[on] += total[up]
        top[on] = top[up]
        j = j.copy()
        j[on] = j[up]
    return top, total


def _label(v: np.ndarray, parent: np.ndarray) -> dict[str, np.ndarray]:
    """Heavy-path labels of a forest of whole trees: ``v`` in ascending order within trees, ``parent`` the index of the parent or -1."""
    n = len(v)
    ones = np.ones(n, np.int64)
    size, j = ones.copy(), parent
    while (j >= 0).any():
        on = np.flatnonzero(j >= 0)
        more = np.zeros(n, np.int64)
        np.add.at(more, j[on], size[on])
        size = size + more
        j = np.where(j >= 0, j[np.maximum(j, 0)], -1)
    has = np.flatnonzero(parent >= 0)
    order = has[np.lexsort((v[has], -size[has], parent[has]))]
    first = np.ones(len(order), bool)
    first[1:] = parent[order[1:]] != parent[order[:-1]]
    light = np.ones(n, bool)
    light[order[first]] = False
    # The siblings before a node: the heavy one, then the others by id.
    line = has[np.lexsort((v[has], light[has], parent[has]))]
    offset = np.zeros(n, np.int64)
    if len(line):
        before = np.cumsum(size[line]) - size[line]
        head = np.ones(len(line), bool)
        head[1:] = parent[line[1:]] != parent[line[:-1]]
        offset[line] = before - before[np.flatnonzero(head)][np.cumsum(head) - 1]
    head, place = _reach(np.where(light, -1, parent), ones)
    # Chains: what their head's parent contributes.
    above = parent[head]
    rise = np.where(above >= 0, place[np.maximum(above, 0)] + 1, 0)
    is_head = head == np.arange(n)
    up = np.where(is_head & (parent >= 0), head[np.maximum(parent, 0)], -1)
    top, depth = _reach(up, np.where(is_head, rise, 0))
    _, number = _reach(up, np.where(is_head, rise + offset, 0))
    return {"depth": depth[head] + place, "number": number[head] + place, "size": size, "top": top[head], "head": head, "place": place}


_LABELLED = "node_id bigint, parent_id bigint, root_id bigint, looped boolean, depth bigint, n_descendants bigint, tree_no bigint, number bigint"


def _paths(found: dict[str, np.ndarray], parent: np.ndarray, labels: list[str | None], separator: str) -> list[str]:
    """Each node's path: the path of its chain's head, and the chain's segment up to the node."""
    out = [""] * len(parent)
    for i in np.lexsort((found["place"], found["head"], found["depth"] - found["place"])).tolist():
        own = labels[i] or ""
        out[i] = own if parent[i] < 0 else out[parent[i]] + separator + own
    return out


def _trees(paths: bool, separator: str):
    """Rows (root, looped, v, j, parent[, label]) sorted by root and v, whole trees -> labelled rows."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in _LABELLED.split(", ")]

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        v = t["v"].to_numpy()
        j = t["j"].fill_null(-1).to_numpy()
        has = t["j"].is_valid().to_numpy(zero_copy_only=False)
        order = np.argsort(v, kind="stable")
        parent = np.where(has, order[np.minimum(np.searchsorted(v[order], j), len(v) - 1)], -1)
        found = _label(v, parent)
        columns = [t["v"].combine_chunks(), t["parent"].combine_chunks(), t["root"].combine_chunks(), t["looped"].combine_chunks()]
        columns += [pa.array(x, pa.int64()) for x in (found["depth"], found["size"] - 1, v[found["top"]], found["number"])]
        if paths:
            columns.append(pa.array(_paths(found, parent, t["label"].to_pylist(), separator), pa.string()))
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=pa.schema(list(zip([*names, "path"], [*kinds, pa.string()]))[: len(columns)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            roots = batch.column(0).to_numpy()
            if held and rows >= BATCH:  # what ends here are whole trees
                upto = int(np.argmax(roots != last)) if (roots != last).any() else len(roots)
                held.append(batch.slice(0, upto))
                if upto < len(roots):
                    yield done(held)
                    held, rows = [], 0
                batch = batch.slice(upto)
            if batch.num_rows:
                held.append(batch)
            rows += batch.num_rows
            last = roots[-1]
        if held:
            yield done(held)

    return run


# Large trees, by joins.


def _follow(t: DataFrame, sums: list[str], texts: list[str]) -> DataFrame:
    """Pointer doubling over (v, j, top, ...): ``sums`` are added up and ``texts`` joined, upwards to the end.

    ``top`` becomes the last node reached; a row without pointer is its own top.
    """
    rounds = _Rounds(t)
    columns = [F.col("up_j").alias("j"), F.col("up_top").alias("top"), *[(F.col(c) + F.col(f"up_{c}")).alias(c) for c in sums], *[F.concat(f"up_{c}", c).alias(c) for c in texts]]
    while rounds.pointing:
        rounds.step(["j", "top", *sums, *texts], columns)
    return rounds.everyone()


def _sizes(links: DataFrame) -> DataFrame:
    """(v, s) from (v, j), a forest: the sizes of subtrees."""
    t, active = cut_and_count(links.select("v", "j", F.lit(1).cast("bigint").alias("s")), POINTS)
    while active:
        below = t.filter(POINTS).groupBy(F.col("j").alias("v")).agg(F.sum("s").alias("more"))
        moved = _hop(t, t, ["j"]).select("v", F.col("up_j").alias("j"), "s").unionByName(t.filter(ENDS))
        before = t
        t, active = cut_and_count(moved.join(below, "v", "left").select("v", "j", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")), POINTS)
        drop(before)
    return t.select("v", "s")


def _siblings(child: DataFrame) -> DataFrame:
    """(v, parent, light, offset) of rows (v, parent, light, s): the sizes of the siblings before each, the heavy one first, then by id.

    Rows are cut into ranges of (parent, light, v), so a node with very many children is spread over several tasks.
    """
    placed = cut(child.repartitionByRange("parent", "light", "v").withColumn("part", F.spark_partition_id()))
    offset = placed.withColumn("offset", F.sum("s").over(Window.partitionBy("parent", "part").orderBy("light", "v")) - F.col("s"))
    parts = placed.groupBy("parent", "part").agg(F.sum("s").alias("s"))
    skip = parts.withColumn("skip", F.sum("s").over(Window.partitionBy("parent").orderBy("part")) - F.col("s")).filter("skip > 0").drop("s")
    return offset.join(skip, ["parent", "part"], "left").select("v", "parent", "light", (F.col("offset") + F.coalesce("skip", F.lit(0))).alias("offset"))


def _large_trees(rows: DataFrame, paths: bool, separator: str) -> DataFrame:
    """The rows that ``_trees`` gives, for trees of any size."""
    rows = cut(rows)
    t = rows.select("v", "j").join(_sizes(rows), "v")
    child = t.filter(POINTS).withColumnRenamed("j", "parent")
    best = child.groupBy("parent").agg(F.max(F.struct("s", (-F.col("v")).alias("neg"))).alias("b")).select("parent", (-F.col("b.neg")).alias("heavy"))
    child = child.join(best, "parent").select("v", "s", "parent", (F.col("v") != F.col("heavy")).cast("int").alias("light"))
    t = cut(t.select("v", "s").join(_siblings(child), "v", "left"))
    goes_on = F.col("light") == 0
    in_chain = _follow(t.select("v", F.when(goes_on, F.col("parent")).alias("j"), F.when(goes_on, F.col("parent")).otherwise(F.col("v")).alias("top"), F.when(goes_on, 1).otherwise(0).cast("bigint").alias("pos")), ["pos"], [])
    placed = t.join(in_chain.select("v", F.col("top").alias("chain"), "pos"), "v").withColumn("piece", F.floor(F.col("pos") / PIECE))
    begins = placed.filter(F.col("pos") % PIECE == 0).select("chain", "piece", F.col("v").alias("head"))
    placed = placed.join(begins, ["chain", "piece"]).withColumn("pos", F.col("pos") % PIECE)
    if paths:
        labels = rows.select("v", "label")
        so_far = Window.partitionBy("head").orderBy("pos")
        placed = placed.join(labels, "v").withColumn("segment", F.concat(F.array_join(F.collect_list(F.coalesce("label", F.lit(""))).over(so_far), separator), F.lit(separator)))
    placed = cut(placed.drop("chain", "piece", "label"))

    # One row per piece of a chain: where its head hangs, and what that adds to depth, number and path.
    texts = ["prefix"] if paths else []
    at = placed.select(F.col("v").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("up_pos"), *([F.col("segment").alias("up_segment")] if paths else []))
    heads = placed.filter("v = head").select("v", "parent", "offset")
    # Heads without a parent would all meet in one task of an outer join.
    heads = heads.filter("parent is not null").join(at, "parent").unionByName(heads.filter("parent is null"), allowMissingColumns=True)
    rise = F.coalesce(F.col("up_pos") + 1, F.lit(0))
    pieces = _follow(
        heads.select(
            "v", F.col("up").alias("j"), F.coalesce("up", "v").alias("top"), rise.alias("depth"), (rise + F.coalesce("offset", F.lit(0))).alias("number"),
            *([F.coalesce("up_segment", F.lit("")).alias("prefix")] if paths else []),
        ),
        ["depth", "number"], texts,
    )
    out = placed.join(pieces.select(F.col("v").alias("head"), "top", F.col("depth").alias("head_depth"), F.col("number").alias("head_number"), *texts), "head")
    out = out.join(rows.select("v", F.col("parent").alias("parent_id"), "root", "looped"), "v")
    return out.select(
        F.col("v").alias("node_id"), "parent_id", F.col("root").alias("root_id"), "looped", (F.col("head_depth") + F.col("pos")).alias("depth"),
        (F.col("s") - 1).alias("n_descendants"), F.col("top").alias("tree_no"), (F.col("head_number") + F.col("pos")).alias("number"),
        *([F.concat("prefix", F.expr(f"left(segment, length(segment) - {len(separator)})")).alias("path")] if paths else []),
    )


def hierarchy(nodes: DataFrame, links: DataFrame, paths: bool = True, separator: str = " > ", target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per node of ``nodes`` (id, label) under ``links`` (parent, child).

    node_id, parent_id, status, root_id, depth, n_descendants, tree_no, number, descendants_from,
    descendants_to and, with ``paths``, path (labels from the root, or the nearest cycle node, down).
    """
    label = ["label"] if paths else []
    named = nodes.filter("id is not null")
    ids = named.groupBy(F.col("id").alias("v")).agg(F.min("label").alias("label")) if paths else named.select(F.col("id").alias("v")).distinct()
    sound = (
        links.filter("parent is not null and child is not null").select("parent", F.col("child").alias("v"))
        .join(named.select(F.col("id").alias("parent")), "parent", "left_semi").groupBy("v").agg(F.min("parent").alias("j"))
    )
    sound = cut(sound)
    inner = sound.select(F.col("j").alias("v")).distinct().withColumn("inner", F.lit(True))
    forest = cut(ids.join(sound, "v", "left").join(inner, "v", "left"))
    drop(sound)

    # The root of every node that has children, or the smallest id of the cycle it leads to.
    rounds = _Rounds(forest.filter("inner").select("v", "j", F.coalesce("j", "v").alias("top"), F.col("v").alias("low"), F.col("j").alias("parent")))
    while rounds.pointing:
        if not rounds.step(["j", "top", "low"], [F.col("up_j").alias("j"), F.col("up_top").alias("top"), F.least("low", "up_low").alias("low"), F.col("parent")]):
            break  # no node ended in this round, so none of the others ever will
    ended = rounds.everyone().filter(ENDS).select("v", F.col("top").alias("root"), F.lit(False).alias("looped"), "parent")
    on_cycle = None
    if rounds.pointing:
        looping = _smallest_on_cycles(rounds.now.filter(POINTS).select("v", "j", "low", "parent"))
        ended = ended.unionByName(looping.select("v", "root", F.lit(True).alias("looped"), "parent"))
        on_cycle = looping.select(F.col("j").alias("v")).distinct().withColumn("on_cycle", F.lit(True))
    found = cut(ended)

    # Every node with its root: its own, or its parent's if it has no children. Cycles are cut.
    single = forest.filter(f"inner is null and {ENDS}")
    of_parent = forest.filter(f"inner is null and {POINTS}").select("v", F.col("j").alias("parent"), *label).join(found.select(F.col("v").alias("parent"), "root", "looped"), "parent")
    rooted = (found.join(forest.select("v", "label"), "v") if paths else found).unionByName(of_parent).withColumn("j", F.col("parent"))
    if on_cycle is not None:
        rooted = rooted.join(on_cycle, "v", "left").withColumn("j", F.when(F.col("on_cycle").isNull(), F.col("j"))).drop("on_cycle")
    rooted = cut(rooted.select("root", "looped", "v", "j", "parent", *label))
    rounds.drop()
    drop(found)
    large, some = cut_and_count(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > target_rows), "n > 0")
    small = rooted.join(large, "root", "left_anti") if some else rooted
    out = small.repartition("root").sortWithinPartitions("root", "v").mapInArrow(_trees(paths, separator), _LABELLED + (", path string" if paths else ""))
    if some:
        out = out.unionByName(_large_trees(rooted.join(large, "root", "left_semi"), paths, separator))
    zero = F.lit(0).cast("bigint")
    alone = single.select(
        F.col("v").alias("node_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("v").alias("root_id"), F.lit(False).alias("looped"), zero.alias("depth"),
        zero.alias("n_descendants"), F.col("v").alias("tree_no"), zero.alias("number"), *([F.coalesce("label", F.lit("")).alias("path")] if paths else []),
    )
    return out.unionByName(alone).select(
        "node_id", "parent_id", F.when(~F.col("looped"), "tree").when(F.col("depth") == 0, "cycle").otherwise("below_cycle").alias("status"), "root_id", "depth", "n_descendants",
        "tree_no", "number", (F.col("number") + 1).alias("descendants_from"), (F.col("number") + F.col("n_descendants")).alias("descendants_to"), *(["path"] if paths else []),
    )
