import random

import pytest

from tidegate.operators import hierarchy as module
from tidegate.operators.hierarchy import hierarchy

NODES, LINKS = "id bigint, label string, path string, s int", "parent bigint, child bigint, depth int"


def check(spark, ids, links, paths=True):
    """Against walks up and down in plain Python: small trees gathered, and all trees by joins."""
    rows = [_check(spark, ids, links, paths, target) for target in (1_000, 0)]
    assert rows[0] == rows[1]


def _check(spark, ids, links, paths, target_rows):
    label = {i: f"n{i}" for i in ids}
    nodes = spark.createDataFrame([(i, label[i], "?", 1) for i in ids] + [(i, label[i], "?", 1) for i in list(ids)[:3]], NODES)
    got = {r["node_id"]: r for r in hierarchy(nodes, spark.createDataFrame([(p, c, 0) for p, c in links], LINKS), paths, target_rows=target_rows).collect()}
    parent: dict = {}
    for p, c in links:
        if p in label and c in label:
            parent[c] = min(p, parent.get(c, p))
    assert set(got) == set(ids)
    loops: dict = {}
    for v in ids:
        seen, x = [], v
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x in seen and x == v:
            loops[v] = min(seen[seen.index(x) :])
    below = {v: 0 for v in ids}
    for v in ids:
        way, x = [v], v
        while x in parent and x not in loops:
            x = parent[x]
            way.append(x)
            below[x] += 1
        r = got[v]
        assert r["depth"] == len(way) - 1 and r["root_id"] == loops.get(x, x)
        assert r["status"] == ("cycle" if v in loops else "below_cycle" if x in loops else "tree")
        assert r["parent_id"] == parent.get(v)
        if paths:
            assert r["path"] == " > ".join(label[w] for w in reversed(way))
        for w in way[1:]:
            assert got[w]["tree_no"] == r["tree_no"] and got[w]["descendants_from"] <= r["number"] <= got[w]["descendants_to"]
    assert all(got[v]["n_descendants"] == below[v] == got[v]["descendants_to"] - got[v]["descendants_from"] + 1 for v in ids)
    assert len({(r["tree_no"], r["number"]) for r in got.values()}) == len(got)
    return got


def test_trees_cycles_tails_and_broken_links(spark):
    links = [(1, 2), (1, 3), (3, 4), (1, 2), (10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (20, 20), (20, 21), (99, 5), (5, 98), (30, 31), (31, 30), (7, 6)]
    check(spark, [1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14, 20, 21, 30, 31], links)


def test_deep_chain_and_wide_node(spark, monkeypatch):
    monkeypatch.setattr(module, "PIECE", 8)
    check(spark, range(160), [(i, i + 1) for i in range(90)] + [(3, i) for i in range(91, 160)])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    check(spark, range(80), [(rng.randrange(80), c) for c in range(80) if rng.random() < 0.9], paths=seed == 1)


def test_trees_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(module, "BATCH", 20)
    check(spark, range(200), [(i - 1, i) for i in range(200) if i % 7] + [(i - 7, i) for i in range(7, 200, 14)])


def test_several_parents_null_ends_and_null_labels(spark):
    nodes = spark.createDataFrame([(1, "a", "", 0), (2, None, "", 0), (3, "c", "", 0), (None, "x", "", 0)], NODES)
    links = spark.createDataFrame([(3, 2, 0), (1, 2, 0), (None, 3, 0), (1, None, 0)], LINKS)
    got = {r["node_id"]: (r["root_id"], r["path"]) for r in hierarchy(nodes, links).collect()}
    assert got == {1: (1, "a"), 2: (1, "a > "), 3: (3, "c")}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], NODES), spark.createDataFrame([], LINKS)).count() == 0
    assert hierarchy(spark.createDataFrame([(1, "a", "", 0)], NODES), spark.createDataFrame([], LINKS)).first()["path"] == "a"
