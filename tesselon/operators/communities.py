"""Leiden communities of weighted graphs by modularity, on sparse neighbour lists.

A level of the method moves nodes between communities while that raises modularity, refines
each community into connected parts, and makes each part a node of a smaller graph, in which
moves start from the communities found. Graphs of up to TASK_EDGES pairs are worked on by one
task each. Larger ones shrink by levels made of joins and sums over all of them at once - the
nodes of one colour move in a round, by the state before it - until they are that small.

Every community is connected: parts grow along edges to members that stay, and what a task
returns is split into its components.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.operators.relational import checkpointed, require_no_null

#: Pairs of nodes that a task takes; node orders that it tries.
TASK_EDGES, ORDERS = 50_000, 5
#: Rounds by joins: colours of a sweep, sweeps, rounds of refinement.
COLOURS, SWEEPS, REFINES = 3, 6, 4
#: Sweeps end where no graph's modularity rises by this.
RISE = 1e-3
#: A level that leaves more than this share of nodes isn't followed by another.
SHRINK = 0.9


class Lists:
    """Neighbour lists of an undirected graph; a pair within a node counts twice in its
    strength."""

    def __init__(self, a, b, w, n: int):
        self.near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        self.strength, self.inner = [0.0] * n, [0.0] * n
        for i, j, x in zip(a, b, w, strict=True):
            self.strength[i] += x
            self.strength[j] += x
            if i == j:
                self.inner[i] += x
            else:
                self.near[i].append((j, x))
                self.near[j].append((i, x))
        self.total = sum(self.strength)

    def __len__(self):
        return len(self.near)

    def links(self, i: int, label: list[int]) -> dict[int, float]:
        out: dict[int, float] = defaultdict(float)
        for j, x in self.near[i]:
            out[label[j]] += x
        return out

    def quality(self, label: list[int]) -> float:
        inside, mass = 0.0, defaultdict(float)
        for i, c in enumerate(label):
            mass[c] += self.strength[i]
            inside += 2 * self.inner[i] + sum(x for j, x in self.near[i] if label[j] == c)
        return inside / self.total - sum((m / self.total) ** 2 for m in mass.values())


def moved(g: Lists, label: list[int], order) -> list[int]:
    """Labels after moves, one node at a time, while one raises modularity."""
    mass = defaultdict(float)
    for i, c in enumerate(label):
        mass[c] += g.strength[i]
    free = max(label, default=0) + 1
    queue, waits = deque(order), [True] * len(g)
    while queue:
        i = queue.popleft()
        waits[i] = False
        own, k = label[i], g.strength[i]
        mass[own] -= k
        links = g.links(i, label)
        best, most = own, links.get(own, 0.0) - k * mass[own] / g.total
        for c, x in links.items():
            gain = x - k * mass[c] / g.total
            if gain > most + 1e-12:
                best, most = c, gain
        if most < -1e-12:
            best, free = free, free + 1
        mass[best] += k
        if best != own:
            label[i] = best
            for j, _ in g.near[i]:
                if label[j] != best and not waits[j]:
                    waits[j] = True
                    queue.append(j)
    return label


def refined(g: Lists, label: list[int], order) -> list[int]:
    """Connected parts of each community: single nodes that join a part of their community
    with which they share edges, where that raises modularity."""
    part, mass, size = list(range(len(g))), list(g.strength), [1] * len(g)
    for i in order:
        if size[part[i]] > 1:
            continue
        links: dict[int, float] = defaultdict(float)
        for j, x in g.near[i]:
            if label[j] == label[i]:
                links[part[j]] += x
        best, most = -1, 0.0
        for p, x in links.items():
            gain = x - g.strength[i] * mass[p] / g.total
            if gain > most + 1e-12:
                best, most = p, gain
        if best >= 0:
            mass[best] += g.strength[i]
            size[best] += 1
            size[i] -= 1
            part[i] = best
    return part


def split(g: Lists, label: list[int]) -> list[int]:
    """Labels with each connected piece of a community on its own."""
    out = [-1] * len(g)
    for s in range(len(g)):
        if out[s] < 0:
            out[s], stack = s, [s]
            while stack:
                i = stack.pop()
                for j, _ in g.near[i]:
                    if out[j] < 0 and label[j] == label[i]:
                        out[j] = s
                        stack.append(j)
    return out


def leiden(a, b, w, n: int, start: list[int] | None = None, orders: int = ORDERS) -> list[int]:
    """Labels of nodes 0 .. n - 1 of the graph of pairs (a, b) of weight w: the best of some
    node orders, each run until modularity rises no more."""
    whole = Lists(a, b, w, n)
    if whole.total <= 0:
        return list(range(n))
    best, most = None, -np.inf
    for seed in range(orders):
        r = np.random.default_rng(seed)
        label, before = list(start) if start is not None else list(range(n)), -np.inf
        while (now := whole.quality(label)) > before + 1e-12:
            before, g, at = now, whole, list(range(n))  # at: the node of g that holds each node
            while True:
                order = (lambda m: r.permutation(m).tolist() if seed else list(range(m)))(len(g))
                label = moved(g, label, order)
                part = refined(g, label, order)
                names, code = np.unique(part, return_inverse=True)
                if len(names) == len(g):
                    label = [label[i] for i in at]
                    break
                sums: dict[tuple[int, int], float] = defaultdict(float)
                for i in range(len(g)):
                    sums[code[i], code[i]] += g.inner[i]
                    for j, x in g.near[i]:
                        if i < j:
                            sums[min(code[i], code[j]), max(code[i], code[j])] += x
                label = [label[p] for p in names]
                at = [int(code[i]) for i in at]
                g = Lists([p for p, _ in sums], [q for _, q in sums], sums.values(), len(names))
            label = np.unique(split(whole, label), return_inverse=True)[1].tolist()
        if (q := whole.quality(label)) > most + 1e-12:
            best, most = label, q
    return best


def _in_tasks(graphs: DataFrame, by: list[str]) -> DataFrame:
    """by, node, label of graphs (by, a, b, w, start_a, start_b), one task each."""
    schema = ", ".join([*[f"`{c}` {graphs.schema[c].dataType.simpleString()}" for c in by], "node long, label long"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate([g["a"], g["b"]]), return_inverse=True)
        first = np.zeros(len(names), np.int64)
        first[code] = np.concatenate([g["start_a"], g["start_b"]])
        start = np.unique(first, return_inverse=True)[1].tolist()
        label = leiden(code[: len(g)].tolist(), code[len(g) :].tolist(), g["w"].tolist(), len(names), start)
        return pd.DataFrame({**{c: [g[c].iloc[0]] * len(names) for c in by}, "node": names, "label": names[label]})

    return graphs.groupBy(*by).applyInPandas(run, schema)


def _both(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, node, other, w: each pair of different nodes from both ends."""
    apart = pairs.where("a <> b")
    return apart.select(*by, F.col("a").alias("node"), F.col("b").alias("other"), "w").unionAll(apart.select(*by, F.col("b"), F.col("a"), "w"))


def _best(links: DataFrame, mass: DataFrame, by: list[str], own: str, target: str) -> DataFrame:
    """links (by, node, k, own, target, w, total) with the mass and size of each target, and
    gain: what node's modularity share would be there."""
    there = links.join(mass.withColumnRenamed("group", target), [*by, target])
    here = F.when(F.col(own) == F.col(target), F.col("k")).otherwise(0.0)
    return there.withColumn("gain", F.col("w") - F.col("k") * (F.col("mass") - here) / F.col("total"))


def _mass(state: DataFrame, by: list[str], name: str) -> DataFrame:
    return state.groupBy(*by, F.col(name).alias("group")).agg(F.sum("k").alias("mass"), F.count("*").alias("size"))


def moved_by_joins(arcs: DataFrame, state: DataFrame, by: list[str], sweep: int) -> DataFrame:
    """state (by, node, k, inner, total, label) after one sweep: the nodes of one colour after
    the other move to the label of the highest gain among their neighbours'. A node that is
    alone only joins another that is alone if that has the smaller label, so that no two
    swap."""
    for colour in range(COLOURS):
        turn = F.pmod(F.xxhash64("node", F.lit(sweep)), F.lit(COLOURS)) == colour
        mine = state.where(turn).select(*by, "node", "k", "total", "label")
        near = arcs.where(turn).join(state.select(*by, F.col("node").alias("other"), F.col("label").alias("to")), [*by, "other"])
        links = near.groupBy(*by, "node", "to").agg(F.sum("w").alias("w")).join(mine, [*by, "node"])
        mass = _mass(state, by, "label")
        stay = mine.join(mass.withColumnsRenamed({"group": "label", "mass": "own_mass", "size": "own_size"}), [*by, "label"]).select(*by, "node", (-F.col("k") * (F.col("own_mass") - F.col("k")) / F.col("total")).alias("alone"), "own_size")
        each = _best(links, mass, by, "label", "to").join(stay, [*by, "node"])
        same = F.col("to") == F.col("label")
        swap = (F.col("own_size") == 1) & (F.col("size") == 1) & (F.col("to") > F.col("label"))
        pick = each.groupBy(*by, "node").agg(
            F.max(F.when(~same & ~swap, F.struct("gain", (-F.col("to")).alias("to")))).alias("best"), F.coalesce(F.max(F.when(same, F.col("gain"))), F.max("alone")).alias("here")
        )
        goes = pick.where(F.col("best.gain") > F.col("here") + 1e-12).select(*by, "node", (-F.col("best.to")).alias("new"))
        state = checkpointed(state.join(goes, [*by, "node"], "left").withColumn("label", F.coalesce("new", "label")).drop("new"))
    return state


def qualities(arcs: DataFrame, state: DataFrame, by: list[str], name: str = "label") -> DataFrame:
    """by, q: modularity of each graph's labels."""
    ends = arcs.join(state.select(*by, "node", F.col(name).alias("x")), [*by, "node"]).join(state.select(*by, F.col("node").alias("other"), F.col(name).alias("y")), [*by, "other"])
    inside = ends.where("x = y").groupBy(*by).agg(F.sum("w").alias("inside"))
    spread = state.groupBy(*by, name).agg(F.sum("k").alias("m"), F.first("total").alias("total"), F.sum("inner").alias("inner"))
    sums = spread.groupBy(*by).agg(F.sum(F.pow(F.col("m") / F.col("total"), 2)).alias("squares"), F.max("total").alias("total"), F.sum("inner").alias("inner"))
    return sums.join(inside, by, "left").select(*by, ((F.coalesce("inside", F.lit(0.0)) + 2 * F.col("inner")) / F.col("total") - F.col("squares")).alias("q"))


def refined_by_joins(arcs: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """state with part: connected parts of each community. In a round half of the nodes that
    are alone, chosen by a hash, join the part of their community with the highest positive
    gain, among parts that no member leaves in that round."""
    state = state.withColumn("part", F.col("node")).withColumn("size", F.lit(1).cast("long"))
    for i in range(REFINES):
        goes_out = (F.col("size") == 1) & (F.pmod(F.xxhash64("node", F.lit(-1 - i)), F.lit(2)) == 0)
        mine = state.where(goes_out).select(*by, "node", "k", "total", "label", F.col("part").alias("own"))
        stays = state.where(~goes_out).select(*by, F.col("node").alias("other"), F.col("label").alias("their"), F.col("part").alias("to"))
        links = arcs.join(mine, [*by, "node"]).join(stays, [*by, "other"]).where("label = their").groupBy(*by, "node", "k", "total", "own", "to").agg(F.sum("w").alias("w"))
        gains = _best(links, _mass(state, by, "part"), by, "own", "to").where("gain > 1e-12")
        goes = gains.groupBy(*by, "node").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("best")).select(*by, "node", (-F.col("best.to")).alias("new"))
        now = state.join(goes, [*by, "node"], "left").withColumn("part", F.coalesce("new", "part")).drop("new", "size")
        state = checkpointed(now.join(now.groupBy(*by, "part").agg(F.count("*").alias("size")), [*by, "part"]))
    return state.drop("size")


def shrunk_by_joins(pairs: DataFrame, start: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """One level for graphs of any size: (pairs between parts, (by, node, part, label)).
    pairs: by, a <= b, w, each once; start: by, node, label. Of the sweeps each graph keeps
    the labels of its highest modularity."""
    arcs = checkpointed(_both(pairs, by))
    ends = arcs.select(*by, "node", "w", F.lit(0.0).alias("inner")).unionAll(pairs.where("a = b").select(*by, "a", 2 * F.col("w"), F.col("w")))
    k = ends.groupBy(*by, "node").agg(F.sum("w").alias("k"), F.sum("inner").alias("inner"))
    totals = k.groupBy(*by).agg(F.sum("k").alias("total"))
    state = checkpointed(k.join(totals, by).join(start, [*by, "node"]))
    best = checkpointed(state.join(qualities(arcs, state, by), by))
    for sweep in range(SWEEPS):
        state = moved_by_joins(arcs, state, by, sweep)
        now = state.join(qualities(arcs, state, by), by).select(*by, "node", F.col("label").alias("new"), F.col("q").alias("now"))
        both = checkpointed(best.join(now, [*by, "node"]).withColumn("up", F.col("now") > F.col("q") + RISE))
        best = both.withColumns({"label": F.when(F.col("now") > F.col("q"), F.col("new")).otherwise(F.col("label")), "q": F.greatest("q", "now")}).drop("new", "now", "up")
        if both.where("up").isEmpty():
            break
    parts = refined_by_joins(arcs, checkpointed(best.drop("q")), by)
    name = lambda end: parts.select(*by, F.col("node").alias(end), F.col("part").alias(f"p{end}"))
    merged = pairs.join(name("a"), [*by, "a"]).join(name("b"), [*by, "b"])
    smaller = merged.groupBy(*by, F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).agg(F.sum("w").alias("w"))
    return checkpointed(smaller), parts.select(*by, "node", "part", "label")


def communities(edges: DataFrame, by: list[str], nodes: DataFrame | None = None, task_edges: int = TASK_EDGES) -> DataFrame:
    """by, node, community: Leiden communities of each graph's symmetrised edges (H7, H8),
    named by their smallest node. edges: by, src, dst, w, long node ids without nulls and
    weights of 0 or more; edges within a node don't count. nodes (by, node) that have no edge
    are communities of their own, and have -1 if their graph has no edge at all."""
    if not by:
        one = lambda df: None if df is None else df.withColumn("__graph", F.lit(0))
        return communities(one(edges), ["__graph"], one(nodes), task_edges).drop("__graph")
    e = require_no_null(edges, [*by, "src", "dst"]).where("src <> dst AND w > 0")
    pairs = checkpointed(e.groupBy(*by, F.least("src", "dst").cast("long").alias("a"), F.greatest("src", "dst").cast("long").alias("b")).agg(F.sum("w").cast("double").alias("w")))
    names = _both(pairs, by).select(*by, "node").distinct()
    held = names.select("*", F.col("node").alias("part"), F.col("node").alias("label"))
    n, large = held.count(), _large(pairs, by, task_edges)
    while not large.isEmpty():
        start = held.join(large, by, "left_semi").select(*by, F.col("part").alias("node"), "label").distinct()
        smaller, parts = shrunk_by_joins(pairs.join(large, by, "left_semi"), start, by)
        up = parts.select(*by, F.col("node").alias("part"), F.col("part").alias("up"), F.col("label").alias("new"))
        risen = held.join(up, [*by, "part"]).select(*by, "node", F.col("up").alias("part"), F.col("new").alias("label"))
        held = checkpointed(risen.unionByName(held.join(large, by, "left_anti")))
        pairs = checkpointed(smaller.unionByName(pairs.join(large, by, "left_anti")))
        before, n = n, held.select(*by, "part").distinct().count()
        large = _large(pairs, by, task_edges)
        if n > SHRINK * before:
            break
    # graphs that are still large shrink no more: their connected parts stand
    stands = held.join(large, by, "left_semi").select(*by, "node", F.col("part").alias("label"))
    held = held.join(large, by, "left_anti")
    first = held.select(*by, "part", "label").distinct()
    at = lambda end: first.select(*by, F.col("part").alias(end), F.col("label").alias(f"start_{end}"))
    found = _in_tasks(pairs.join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"]), by)
    out = held.join(found.select(*by, F.col("node").alias("part"), F.col("label").alias("found")), [*by, "part"]).select(*by, "node", F.col("found").alias("label"))
    out = checkpointed(out.unionByName(stands))
    smallest = out.groupBy(*by, "label").agg(F.min("node").alias("community"))
    out = out.join(smallest, [*by, "label"]).select(*by, "node", "community")
    if nodes is None:
        return out
    lone = nodes.select(*by, F.col("node").cast("long").alias("node")).distinct().join(names, [*by, "node"], "left_anti")
    marked = lone.join(names.select(*by).distinct().withColumn("__there", F.lit(1)), by, "left")
    return out.unionByName(marked.select(*by, "node", F.when(F.col("__there").isNull(), F.lit(-1)).otherwise(F.col("node")).cast("long").alias("community")))


def _large(pairs: DataFrame, by: list[str], task_edges: int) -> DataFrame:
    """by of the graphs of more pairs than a task takes."""
    return checkpointed(pairs.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > task_edges).drop("n"))
