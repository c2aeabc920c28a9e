"""Leiden communities: connected, no worse than greedy moves on the full matrix, the same
through tasks and through joins."""

import numpy as np
import pytest

from tesselon.operators import communities as C


def planted(seed, n, blocks, inside=0.5, outside=0.05):
    r = np.random.default_rng(seed)
    g = r.integers(0, blocks, n)
    m = np.triu((r.random((n, n)) < np.where(g[:, None] == g[None, :], inside, outside)) * r.random((n, n)), 1)
    return g, m + m.T


def quality(m, label):
    k, label = m.sum(axis=1), np.asarray(label)
    same = label[:, None] == label[None, :]
    return ((m - np.outer(k, k) / m.sum()) * same).sum() / m.sum()


def pieces(m, label):
    """Connected pieces of all labels, by plain search."""
    left, n = set(range(len(m))), 0
    while left:
        stack = [left.pop()]
        n += 1
        while stack:
            i = stack.pop()
            for j in [j for j in left if m[i, j] > 0 and label[j] == label[i]]:
                left.remove(j)
                stack.append(j)
    return n


def greedy(a):
    """Communities by moves and aggregation on the full matrix, without refinement."""
    label = np.arange(len(a))
    while True:
        k, m2, part, moved = a.sum(axis=1), a.sum(), np.arange(len(a)), True
        while moved:
            moved = False
            for i in range(len(a)):
                gain = np.bincount(part, weights=a[i], minlength=len(a))
                gain[part[i]] -= a[i, i]
                mass = np.bincount(part, weights=k, minlength=len(a))
                mass[part[i]] -= k[i]
                score = gain - k[i] * mass / m2
                best = int(np.argmax(score))
                if score[best] > score[part[i]] + 1e-12:
                    part[i], moved = best, True
        names, part = np.unique(part, return_inverse=True)
        label = part[label]
        if len(names) == len(a):
            return label
        small = np.zeros((len(names), len(names)))
        np.add.at(small, (part[:, None], part[None, :]), a)
        a = small


def rows(graph, m, directed=True):
    """Edges of either direction, some in two halves."""
    i, j = np.nonzero(np.triu(m))
    return [(graph, int(b if directed and (a + b) % 2 else a), int(a if directed and (a + b) % 2 else b), float(m[a, b])) for a, b in zip(i, j, strict=True)]


@pytest.mark.parametrize("seed", range(25))
def test_kernel_is_connected_and_no_worse_than_greedy(seed):
    _, m = planted(seed, 10 + 3 * seed, 2 + seed // 4)
    m = m[m.sum(axis=0) > 0][:, m.sum(axis=0) > 0]
    i, j = np.nonzero(np.triu(m))
    label = C.leiden(i.tolist(), j.tolist(), m[i, j].tolist(), len(m))
    assert pieces(m, label) == len(set(label))
    assert quality(m, label) >= quality(m, greedy(m)) - 1e-9
    assert C.Lists(i.tolist(), j.tolist(), m[i, j].tolist(), len(m)).quality(label) == pytest.approx(quality(m, label))


def test_pairs_within_a_node_count_twice():
    g = C.Lists([0, 0, 1], [0, 1, 1], [2.0, 1.0, 3.0], 2)
    m = np.array([[4.0, 1.0], [1.0, 6.0]])
    assert g.strength == m.sum(axis=1).tolist()
    assert g.quality([0, 1]) == pytest.approx(quality(m, [0, 1])) and g.quality([0, 0]) == pytest.approx(0)


@pytest.fixture(scope="module")
def graphs(spark):
    held = {name: planted(seed, n, blocks, 0.4, 0.03)[1] for name, seed, n, blocks in (("one", 1, 120, 5), ("two", 2, 60, 3), ("small", 3, 9, 2))}
    return held, spark.createDataFrame([x for k, m in held.items() for x in rows(k, m)], "g string, src long, dst long, w double")


@pytest.mark.parametrize("task_edges", [10**6, 400])
def test_tasks_and_joins_give_connected_communities(spark, graphs, monkeypatch, task_edges):
    held, edges = graphs
    for name in ("COLOURS", "SWEEPS", "REFINES"):  # few rounds
        monkeypatch.setattr(C, name, 2)
    got = C.communities(edges, ["g"], task_edges=task_edges).toPandas()
    for name, m in held.items():
        mine = got[got["g"] == name].set_index("node")["community"].to_dict()
        nodes = [i for i in range(len(m)) if m[i].any()]
        assert sorted(mine) == nodes
        label = [mine.get(i, -1 - i) for i in range(len(m))]
        assert pieces(m, label) == len(set(label))
        assert all(c == min(i for i in mine if mine[i] == c) for c in mine.values())  # named by the smallest node
        floor = quality(m, greedy(m)) if task_edges > 10**5 else 0.8 * quality(m, greedy(m))
        assert quality(m, label) >= floor - 1e-9


def test_a_level_keeps_weight_and_raises_modularity(spark, graphs, monkeypatch):
    held, _ = graphs
    for name in ("COLOURS", "SWEEPS", "REFINES"):
        monkeypatch.setattr(C, name, 2)
    one = spark.createDataFrame([("one", int(a), int(b), float(held["one"][a, b])) for a, b in zip(*np.nonzero(np.triu(held["one"])), strict=True)], "g string, a long, b long, w double")
    start = C._both(one, ["g"]).selectExpr("g", "node", "node AS label").distinct()
    smaller, parts = C.shrunk_by_joins(one, start, ["g"])
    assert smaller.agg({"w": "sum"}).first()[0] == pytest.approx(np.triu(held["one"]).sum())
    p = parts.toPandas().set_index("node")
    at = [i for i in range(120) if i in p.index]
    m = held["one"][at][:, at]
    assert pieces(m, p.loc[at, "part"].tolist()) == p["part"].nunique() < len(at)
    assert (p.groupby("part")["label"].nunique() == 1).all()
    assert quality(m, p.loc[at, "label"]) > 0.2 and quality(m, p.loc[at, "part"]) > quality(m, at)


def test_nodes_without_edges(spark):
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 1, 1.0), ("a", 5, 5, 3.0), ("b", 1, 2, 0.0)], "g string, src long, dst long, w double")
    nodes = spark.createDataFrame([("a", i) for i in (1, 2, 5, 9)] + [("b", 1), ("b", 2), ("c", 4)], "g string, node long")
    got = {(r["g"], r["node"]): r["community"] for r in C.communities(edges, ["g"], nodes).collect()}
    assert got == {("a", 1): 1, ("a", 2): 1, ("a", 5): 5, ("a", 9): 9, ("b", 1): -1, ("b", 2): -1, ("c", 4): -1}
    assert sorted(tuple(r) for r in C.communities(edges.where("g = 'a'").drop("g"), []).collect()) == [(1, 1), (2, 1)]
    assert C.communities(edges.where("false"), ["g"]).collect() == []
    with pytest.raises(ValueError, match="nulls"):
        C.communities(spark.createDataFrame([(None, 1, 2, 1.0)], "g string, src long, dst long, w double"), ["g"])
