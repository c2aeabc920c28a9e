"""Directed weighted graphs: rank-1 scores, region measures, nulls, communities."""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import divide, divide_positive
from tesselon.operators.communities import communities
from tesselon.operators.units import kmeans_units

#: Edges of a graph, pairs of nodes of a null model, and segments of paths that one task
#: takes; a segment takes some 340 bytes of a worker.
TASK_ARCS, TASK_PAIRS, TASK_SEGMENTS = 2_000_000, 4_000_000, 1_000_000


def unit_adjacency(edges: DataFrame, cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """src_unit, dst_unit, w: cell edges (src, dst) counted between units of different
    regions (G7, J7, J9, A14). cells: cell, unit, region."""
    from tesselon.operators.relational import with_endpoints

    e = with_endpoints(edges, cells.select("cell", "unit", "region"), "cell", "src", "dst")
    return e.where("src_unit <> dst_unit AND src_region <> dst_region").groupBy(*by, "src_unit", "dst_unit").agg(F.count("*").cast("double").alias("w"))


def rank1(a: np.ndarray, max_iter: int = 300, tol: float = 1e-9, on_zero: str = "nan") -> tuple[np.ndarray, np.ndarray, int, float]:
    """Alternating iteration to the leading singular vectors of a non-negative matrix:
    (out, in, iterations, last change). on_zero, for a zero norm: nan, skip (keep
    the vector unscaled) or stop (keep the last vectors)."""
    n = len(a)
    out = np.full(n, 1 / np.sqrt(max(n, 1)))
    into = out.copy()
    change, step = np.inf, 0
    for step in range(1, max_iter + 1):
        new_out = a @ into
        size = np.linalg.norm(new_out)
        if size <= 1e-12:
            if on_zero == "nan":
                return np.full(n, np.nan), np.full(n, np.nan), step, np.nan
            if on_zero == "stop":
                break
        else:
            new_out = new_out / size
        new_in = a.T @ new_out
        size = np.linalg.norm(new_in)
        if size <= 1e-12:
            if on_zero == "nan":
                return np.full(n, np.nan), np.full(n, np.nan), step, np.nan
            if on_zero == "stop":
                break
        else:
            new_in = new_in / size
        change = max(np.abs(new_out - out).max(), np.abs(new_in - into).max())
        out, into = new_out, new_in
        if change < tol:
            break
    return out, into, step, float(change)


class Arcs:
    """A sparse matrix of weights, for products with vectors."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int):
        self.src, self.dst, self.w, self.n = src, dst, w, n

    def __len__(self):
        return self.n

    @property
    def T(self):  # noqa: N802
        return Arcs(self.dst, self.src, self.w, self.n)

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.src, self.w * v[self.dst], self.n)


def rank1_by_group(edges: DataFrame, by: list[str], max_iter: int = 300, tol: float = 1e-9, on_zero: str = "nan", task_edges: int = TASK_ARCS) -> DataFrame:
    """by, node, c_out, c_in, dca, iterations of many graphs (G1-G4, G6): graphs of at most
    task_edges edges by one task each, on their edges; larger ones together by joins. Edges:
    by, src, dst, w, weights of 0 or more."""
    from tesselon.operators.relational import checkpointed

    kind = edges.schema["src"].dataType.simpleString()
    schema = ", ".join([*[f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by], f"node {kind}, c_out double, c_in double, dca double, iterations int"])
    large = checkpointed(edges.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > task_edges).drop("n"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate([g["src"].to_numpy(), g["dst"].to_numpy()]), return_inverse=True)
        a = Arcs(code[: len(g)], code[len(g) :], g["w"].to_numpy(float), len(names))
        out, into, step, _ = rank1(a, max_iter, tol, on_zero)
        return pd.DataFrame({**{c: [g[c].iloc[0]] * len(names) for c in by}, "node": names, "c_out": out, "c_in": into, "dca": out - into, "iterations": step})

    if large.isEmpty():
        return edges.groupBy(*by).applyInPandas(run, schema)
    small = edges.join(large, by, "left_anti").groupBy(*by).applyInPandas(run, schema)
    return small.unionByName(rank1_by_joins(edges.join(large, by, "left_semi"), by, max_iter, tol, on_zero))


def rank1_by_joins(edges: DataFrame, by: list[str], max_iter: int = 300, tol: float = 1e-9, on_zero: str = "nan", every: int = 5) -> DataFrame:
    """As rank1_by_group, for graphs of any size: one set of joins and sums multiplies all of
    them. Vectors are scaled, compared and checkpointed every few rounds; a graph none of
    whose values moved by tol since the last time drops out, with its edges. Where a graph's
    first product is zero (no weight at all), on_zero decides at once."""
    from tesselon.operators.relational import checkpointed

    e = checkpointed(edges.groupBy(*by, "src", "dst").agg(F.sum("w").alias("w")))
    nodes = e.select(*by, F.col("src").alias("node")).unionAll(e.select(*by, F.col("dst").alias("node"))).distinct()
    size = F.sqrt(F.sum(F.col("c") * F.col("c")))

    def half(vector: DataFrame, end: str, to: str) -> DataFrame:
        return e.join(vector.withColumnRenamed("node", end), [*by, end]).groupBy(*by, F.col(to).alias("node")).agg(F.sum(F.col("w") * F.col("c")).alias("c"))

    start = nodes.join(nodes.groupBy(*by).agg((1 / F.sqrt(F.count("*"))).alias("c")), by)
    state = checkpointed(start.select(*by, "node", F.col("c").alias("c_out"), F.col("c").alias("c_in")))
    live = half(state.select(*by, "node", F.col("c_in").alias("c")), "dst", "src").groupBy(*by).agg(size.alias("s")).where("s > 1e-12").drop("s")
    live = checkpointed(live)
    fixed = {"nan": F.lit(None).cast("double"), "skip": F.lit(0.0), "stop": F.col("c_out")}[on_zero]
    done = [state.join(live, by, "left_anti").select(*by, "node", fixed.alias("c_out"), fixed.alias("c_in"), F.lit(2 if on_zero == "skip" else 1).alias("iterations"))]
    state, steps = state.join(live, by, "left_semi"), 0
    while not state.isEmpty():
        take = min(every, max_iter - steps)
        into, out = state.select(*by, "node", F.col("c_in").alias("c")), None
        for _ in range(take):
            out = half(into, "dst", "src")
            into = half(out, "src", "dst")
        steps += take
        new = state.select(*by, "node", F.col("c_out").alias("o"), F.col("c_in").alias("i"))
        for name, vector in (("c_out", out), ("c_in", into)):
            v = checkpointed(vector)
            scaled = v.join(v.groupBy(*by).agg(size.alias("s")), by).select(*by, "node", (F.col("c") / F.col("s")).alias(name))
            new = new.join(scaled, [*by, "node"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
        new = checkpointed(new)
        still = new.groupBy(*by).agg(F.max(F.greatest(F.abs(F.col("c_out") - F.col("o")), F.abs(F.col("c_in") - F.col("i")))).alias("change"))
        still = checkpointed(still.where((F.col("change") >= tol) & F.lit(steps < max_iter)).drop("change"))
        done.append(new.join(still, by, "left_anti").select(*by, "node", "c_out", "c_in", F.lit(steps).alias("iterations")))
        state = checkpointed(new.join(still, by, "left_semi").select(*by, "node", "c_out", "c_in"))
        e = checkpointed(e.join(still, by, "left_semi"))
    return reduce(DataFrame.unionAll, done).select(*by, "node", "c_out", "c_in", (F.col("c_out") - F.col("c_in")).alias("dca"), "iterations")


def rank1_distributed(edges: DataFrame, max_iter: int = 300, tol: float = 1e-9, every: int = 4) -> DataFrame:
    """node, c_out, c_in, dca of one graph of any size by joins and sums, until no value
    moves by tol between two checks or max_iter rounds are done (G1, G5). Vectors are
    scaled to length 1, compared and checkpointed every few rounds, so neither values nor
    lineage grow; one row a check comes to the driver."""
    from tesselon.operators.relational import checkpointed

    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    e = checkpointed(edges.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def half(vector: DataFrame, end: str, to: str) -> DataFrame:
        return e.join(vector.withColumnRenamed("node", end), end).groupBy(F.col(to).alias("node")).agg(F.sum(F.col("w") * F.col("c")).alias("c"))

    def unit(vector: DataFrame) -> DataFrame:
        v = checkpointed(vector)
        size = v.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("s"))
        return v.crossJoin(F.broadcast(size)).select("node", divide("c", "s").alias("c"))  # size is one row

    def change(new: DataFrame, old: DataFrame) -> float:
        both = new.join(old.withColumnRenamed("c", "__old"), "node", "full_outer")
        return both.agg(F.max(F.abs(zero(F.col("c")) - zero(F.col("__old"))))).first()[0] or 0.0

    into = checkpointed(nodes.withColumn("c", F.lit(1.0)))
    out = before = None
    for i in range(1, max_iter + 1):
        out = half(into, "dst", "src")
        if i % every and i < max_iter:
            into = half(out, "src", "dst")
            continue
        out = unit(out)
        into = unit(half(out, "src", "dst"))
        if before and max(change(out, before[0]), change(into, before[1])) < tol:
            break
        before = out, into
    both = nodes.join(out.withColumnRenamed("c", "c_out"), "node", "left").join(into.withColumnRenamed("c", "c_in"), "node", "left")
    return both.select("node", zero(F.col("c_out")).alias("c_out"), zero(F.col("c_in")).alias("c_in"), (zero(F.col("c_out")) - zero(F.col("c_in"))).alias("dca"))


def region_structure(adj: DataFrame, dca: DataFrame, regions: DataFrame) -> DataFrame:
    """region, dca_post, dca_pre, hard_oo, log_out_in, n_edges (H1, H2, H6). adj: src,
    dst, w, src_region, dst_region; dca: node, dca. Every region of regions has a row."""
    e = adj.join(dca.select(F.col("node").alias("src"), F.col("dca").alias("dca_src")), "src").join(dca.select(F.col("node").alias("dst"), F.col("dca").alias("dca_dst")), "dst")
    positive = F.when((F.col("dca_src") > 0) & (F.col("dca_dst") > 0), F.col("w")).otherwise(0.0)
    post = e.groupBy(F.col("src_region").alias("region")).agg(
        divide_positive(F.sum(F.col("w") * F.col("dca_dst")), F.sum("w")).alias("dca_post"), divide_positive(F.sum(positive), F.sum("w")).alias("hard_oo"), F.sum("w").alias("out"), F.count("*").alias("n_edges")
    )
    pre = e.groupBy(F.col("dst_region").alias("region")).agg(divide_positive(F.sum(F.col("w") * F.col("dca_src")), F.sum("w")).alias("dca_pre"), F.sum("w").alias("into"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        regions.select("region").distinct().join(post, "region", "left").join(pre, "region", "left")
        .select("region", "dca_post", "dca_pre", "hard_oo", F.log((zero("out") + 1) / (zero("into") + 1)).alias("log_out_in"), zero("n_edges").cast("long").alias("n_edges"))
    )


def oo_measures(e: DataFrame, threshold: Column | float, by: list[str]) -> DataFrame:
    """Weighted shares of edges whose ends are above a threshold: oo, source, target,
    conditional, and oo less the product (H12)."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    w = F.col("w")
    part = lambda c: divide_positive(F.sum(F.when(c, w).otherwise(0.0)), F.sum(w))
    s, d = F.col("dca_src") > t, F.col("dca_dst") > t
    out = e.groupBy(*by).agg(part(s & d).alias("oo"), part(s).alias("source_positive"), part(d).alias("target_positive"))
    return out.withColumn("conditional", divide_positive("oo", "source_positive")).withColumn("oo_minus_independence", F.col("oo") - F.col("source_positive") * F.col("target_positive"))


def oo_excluding(e: DataFrame, band: Column | float, by: list[str]) -> DataFrame:
    """Hard OO without edges that have an end within the band around 0, and the
    retained share of weight (H13)."""
    b = band if isinstance(band, Column) else F.lit(band)
    w = F.col("w")
    kept = F.when((F.abs("dca_src") > b) & (F.abs("dca_dst") > b), w).otherwise(0.0)
    hit = F.when((F.col("dca_src") > 0) & (F.col("dca_dst") > 0), kept).otherwise(0.0)
    return e.groupBy(*by).agg(divide_positive(F.sum(hit), F.sum(kept)).alias("oo"), divide_positive(F.sum(kept), F.sum(w)).alias("retained"))


def oo_soft(e: DataFrame, temperature: Column | float, by: list[str]) -> DataFrame:
    """Weighted mean product of the ends' logistic scores."""
    from tesselon.functions.scalars import clip

    t = temperature if isinstance(temperature, Column) else F.lit(temperature)
    s = lambda c: 1 / (1 + F.exp(-clip(F.col(c) / t, -40, 40)))
    return e.groupBy(*by).agg(divide_positive(F.sum(F.col("w") * s("dca_src") * s("dca_dst")), F.sum("w")).alias("soft_oo"))


def oo_by_count(e: DataFrame, by: list[str]) -> DataFrame:
    """Share of edges with both ends above 0; pairs with a missing end count below
    (H3)."""
    return e.groupBy(*by).agg((F.count_if((F.col("dca_src") > 0) & (F.col("dca_dst") > 0)) / F.count("*")).alias("oo"))


def oo_by_distinct_targets(e: DataFrame, by: list[str]) -> DataFrame:
    """Edges with both ends above 0 over distinct targets; edges with a missing end
    don't take part (H5)."""
    ok = e.where("dca_src IS NOT NULL AND dca_dst IS NOT NULL")
    return ok.groupBy(*by).agg(divide(F.count_if((F.col("dca_src") > 0) & (F.col("dca_dst") > 0)), F.countDistinct("dst")).alias("oo"))


def reciprocity(region_edges: DataFrame) -> DataFrame:
    """region, reciprocity: sum over partners of min(w, w back) / out strength.
    region_edges: src, dst, w summed, without loops."""
    back = region_edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("w_back"))
    e = region_edges.join(back, ["src", "dst"], "left")
    return e.groupBy(F.col("src").alias("region")).agg(divide_positive(F.sum(F.least("w", F.coalesce("w_back", F.lit(0.0)))), F.sum("w")).alias("reciprocity"))


def cycle_participation(edges: DataFrame, region: str = "src_region") -> DataFrame:
    """region, cycles: share of weight on edges i -> j with a path j -> k -> i (H11,
    J19)."""
    step = edges.select("src", "dst").distinct()
    path = step.select(F.col("src").alias("j"), F.col("dst").alias("k")).join(step.select(F.col("src").alias("k"), F.col("dst").alias("i")), "k").select(F.col("i").alias("src"), F.col("j").alias("dst")).distinct()
    e = edges.join(path.withColumn("closed", F.lit(1)), ["src", "dst"], "left")
    return e.groupBy(F.col(region).alias("region")).agg(divide_positive(F.sum(F.when(F.col("closed") == 1, F.col("w")).otherwise(0.0)), F.sum("w")).alias("cycles"))


def output_participation(edges: DataFrame, community: str = "dst_community") -> DataFrame:
    """region, participation: strength-weighted mean of 1 - sum_c (s_ic / s_i)^2 (H9).
    edges: src, src_region, w and the target's community."""
    by = edges.groupBy("src", "src_region", community).agg(F.sum("w").alias("s"))
    unit = by.groupBy("src", "src_region").agg(F.sum("s").alias("total"), F.sum(F.col("s") * F.col("s")).alias("squares"))
    p = 1 - F.try_divide(F.col("squares"), F.col("total") * F.col("total"))
    return unit.groupBy(F.col("src_region").alias("region")).agg(divide_positive(F.sum(F.col("total") * p), F.sum("total")).alias("participation"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """q of a labelled undirected graph, weights of both directions added. edges: src,
    dst, w; labels: node, community."""
    e = edges.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    ends = e.select("a", "b", "w").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    by = ends.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree"))
    total = by.agg(F.sum("degree").alias("m2"))
    return by.crossJoin(F.broadcast(total)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("degree") / F.col("m2"), 2)).alias("q"))  # total is one row


def modularity_within(edges: DataFrame, region: str, nodes: DataFrame | None = None) -> DataFrame:
    """region, n_communities, q of the communities detected inside each region's own
    graph (H8). edges: region, src, dst, w, both ends in the region. With nodes (region,
    node) those without an edge count as communities; a region without edges has 0 and a
    missing q."""
    labels = communities(edges, [region], nodes)
    e = edges.where("src <> dst AND w > 0").join(labels.select(region, F.col("node").alias("src"), F.col("community").alias("a")), [region, "src"])
    e = e.join(labels.select(region, F.col("node").alias("dst"), F.col("community").alias("b")), [region, "dst"])
    ends = e.select(region, "a", "b", "w").unionAll(e.select(region, F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    part = ends.groupBy(region, "a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("degree"))
    sums = part.groupBy(region).agg(F.sum("degree").alias("m2"), F.sum("inside").alias("inside"), F.sum(F.col("degree") * F.col("degree")).alias("squares"))
    found = labels.groupBy(region).agg(F.countDistinct(F.when(F.col("community") >= 0, F.col("community"))).alias("n_communities"))
    return found.join(sums, region, "left").select(region, "n_communities", (divide("inside", "m2") - divide("squares", F.col("m2") * F.col("m2"))).alias("q"))


def block_overwrite(members: DataFrame) -> DataFrame:
    """src, dst edges after blocks were written in order: each block clears all edges
    among its members and then sets source -> target, without loops (K6). members:
    block (ordered), cell, is_source, is_target. A pair's last common block decides: only
    pairs that some block sets are formed, and the last block of both cells, the largest
    that their two lists of blocks share, must not be later than the last that sets them."""
    a = members.where("is_source").select("block", F.col("cell").alias("src"))
    b = members.where("is_target").select("block", F.col("cell").alias("dst"))
    edges = a.join(b, "block").where("src <> dst").groupBy("src", "dst").agg(F.max("block").alias("block"))
    blocks = members.groupBy("cell").agg(F.collect_set("block").alias("blocks"))
    later = lambda end: blocks.select(F.col("cell").alias(end), F.col("blocks").alias(f"{end}_blocks"))
    both = edges.join(later("src"), "src").join(later("dst"), "dst")
    after = lambda end: F.filter(f"{end}_blocks", lambda x: x > F.col("block"))
    return both.where(~F.arrays_overlap(after("src"), after("dst"))).select("src", "dst")


def support(pairs: DataFrame, block: str, src: str, dst: str) -> DataFrame:
    """src, dst, n_blocks: distinct blocks behind each pair."""
    return pairs.select(block, src, dst).distinct().groupBy(src, dst).agg(F.count("*").alias("n_blocks"))


def maximum_entropy_null(edges: DataFrame, nodes: DataFrame, by: list[str], iterations: int = 100, seed: int = 20260722, pair_totals: bool = False, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """by, src, dst, w, margin_error: random weights over all pairs of nodes of different
    regions, scaled to the nodes' row and column sums, with the largest margin error
    relative to a sum (or 1) (K12). With pair_totals only region pairs that have edges take
    part, and their totals are kept too. Nodes without outgoing (incoming) weight have
    none. edges: by, src, dst, w; nodes: node, region. Graphs with at most task_pairs pairs
    of sources and targets are fitted by a task each, others by joins."""
    from tesselon.operators.relational import checkpointed, with_endpoints

    e = with_endpoints(edges.groupBy(*by, "src", "dst").agg(F.sum("w").cast("double").alias("w")), nodes.select("node", "region"), "node", "src", "dst")
    sizes = e.groupBy(*by).agg((F.countDistinct("src") * F.countDistinct("dst")).alias("n"))
    large = checkpointed(sizes.where(F.col("n") > task_pairs).drop("n"))
    schema = ", ".join([*[f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by], "src long, dst long, w double, margin_error double"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate([g["src"], g["dst"]]), return_inverse=True)
        i, j, n = code[: len(g)], code[len(g) :], len(names)
        kinds, kind = np.unique(np.concatenate([g["src_region"], g["dst_region"]]), return_inverse=True)
        region = np.zeros(n, int)
        region[code] = kind
        w = g["w"].to_numpy(float)
        key = int(pd.util.hash_pandas_object(g[by].iloc[:1], index=False).iloc[0]) if by else 0
        pair = region[:, None] * len(kinds) + region
        totals = np.bincount(pair[i, j], w, len(kinds) ** 2)
        allowed = region[:, None] != region
        if pair_totals:
            allowed &= totals[pair] > 0
        row, column = np.bincount(i, w, n), np.bincount(j, w, n)
        x = np.random.default_rng([seed, key]).exponential(size=(n, n)) * allowed * (row > 0)[:, None] * (column > 0)
        fit = lambda goal, now: np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
        for _ in range(iterations):
            x *= fit(row, x.sum(axis=1))[:, None]
            x *= fit(column, x.sum(axis=0))[None, :]
            if pair_totals:
                x *= fit(totals, np.bincount(pair.ravel(), weights=x.ravel(), minlength=len(totals)))[pair]
        error = max(np.max(np.abs(now - goal) / np.maximum(goal, 1)) for now, goal in ((x.sum(axis=1), row), (x.sum(axis=0), column)))
        a, z = np.nonzero(x)
        return pd.DataFrame({**{c: [g[c].iloc[0]] * len(a) for c in by}, "src": names[a], "dst": names[z], "w": x[a, z], "margin_error": error})

    if large.isEmpty():
        return e.groupBy(*by).applyInPandas(run, schema)
    small = e.join(large, by, "left_anti").groupBy(*by).applyInPandas(run, schema)
    return small.unionByName(null_by_joins(e.join(large, by, "left_semi"), by, iterations, seed, pair_totals))


def null_by_joins(e: DataFrame, by: list[str], iterations: int, seed: int, pair_totals: bool, blocks: int = 64) -> DataFrame:
    """maximum_entropy_null for graphs of any size. e: by, src, dst, w, src_region,
    dst_region, each pair once. Only the factors of rows, columns and region pairs are kept: a
    pair's weight is its exponential variate, drawn from a hash of graph and pair whenever it
    is needed, times its factors. Rows (columns) are dealt to blocks, and the other side's
    factors copied to each, so a sum stays within its block."""
    from tesselon.operators.relational import checkpointed

    def side(node: str, region: str) -> DataFrame:
        return checkpointed(e.groupBy(*by, F.col(node).alias("node"), F.col(region).alias("region")).agg(F.sum("w").alias("goal")).where("goal > 0").withColumn("factor", F.lit(1.0)))

    rows, columns = side("src", "src_region"), side("dst", "dst_region")
    pairs = e.groupBy(*by, F.col("src_region").alias("ra"), F.col("dst_region").alias("rb")).agg(F.sum("w").alias("total")).where("total > 0")
    pairs = checkpointed(pairs.withColumn("p", F.lit(1.0)))
    block = F.pmod(F.xxhash64("node"), F.lit(blocks)).alias("block")
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *by, "a", "b"), 11) + 0.5) / float(1 << 53)

    def weights(fixed: DataFrame, copied: DataFrame, names: tuple[str, str]) -> DataFrame:
        """by, block, a, b, ra, rb, x of all pairs; names says which of a (rows) and b
        (columns) fixed and copied are."""
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
        at = lambda d, n, part: d.select(*by, F.col("node").alias(n), F.col("region").alias(f"r{n}"), F.col("factor").alias(f"f{n}"), part)
        f, c = at(fixed, names[0], block), at(copied, names[1], each)
        both = f.join(c, [*by, "block"]).where("ra <> rb")
        if pair_totals:
            both = both.join(pairs.drop("total"), [*by, "ra", "rb"])
        return both.withColumn("x", -F.log(unit) * F.col("fa") * F.col("fb") * (F.col("p") if pair_totals else F.lit(1.0)))

    def fitted(mine: DataFrame, other: DataFrame, names: tuple[str, str]) -> DataFrame:
        sums = weights(mine, other, names).groupBy(*by, "block", names[0]).agg(F.sum("x").alias("now")).withColumnRenamed(names[0], "node")
        both = mine.join(sums.drop("block"), [*by, "node"], "left")
        return checkpointed(both.select(*by, "node", "region", "goal", F.when(F.col("now") > 0, F.col("factor") * F.col("goal") / F.col("now")).otherwise(0.0).alias("factor")))

    for _ in range(iterations):
        rows = fitted(rows, columns, ("a", "b"))
        columns = fitted(columns, rows, ("b", "a"))
        if pair_totals:
            now = weights(rows, columns, ("a", "b")).groupBy(*by, "ra", "rb").agg(F.sum("x").alias("now"))
            pairs = checkpointed(pairs.join(now, [*by, "ra", "rb"], "left").withColumn("p", F.when(F.col("now") > 0, F.col("p") * F.col("total") / F.col("now")).otherwise(0.0)).drop("now"))
    x = weights(rows, columns, ("a", "b"))
    far = None
    for goals, n in ((rows, "a"), (columns, "b")):
        sums = x.groupBy(*by, F.col(n).alias("node")).agg(F.sum("x").alias("now"))
        error = goals.join(sums, [*by, "node"], "left").select(*by, (F.abs(F.coalesce("now", F.lit(0.0)) - F.col("goal")) / F.greatest("goal", F.lit(1.0))).alias("error"))
        far = error if far is None else far.unionAll(error)
    errors = checkpointed(far.groupBy(*by).agg(F.max("error").alias("margin_error")))
    return x.where("x > 0").join(errors, by).select(*by, F.col("a").alias("src"), F.col("b").alias("dst"), F.col("x").alias("w"), "margin_error")


def distances(a: np.ndarray, b: np.ndarray, w: np.ndarray, sources: np.ndarray, n: int) -> np.ndarray:
    """The path length from sources to each of n nodes over undirected segments. Arcs are
    arrays sorted by node, a node is pushed only when it gets nearer, and lists of Python
    objects hold no more than the open nodes."""
    node = np.concatenate([a, b]).astype(np.int32)
    order = np.argsort(node, kind="stable").astype(np.int32)
    start = np.searchsorted(node[order], np.arange(n + 1))
    to, length = np.concatenate([b, a]).astype(np.int32)[order], np.concatenate([w, w])[order]
    best = np.full(n, np.inf)
    best[sources] = 0.0
    heap = [(0.0, x) for x in np.unique(sources).tolist()]
    while heap:
        d, x = heapq.heappop(heap)
        if d > best[x]:
            continue
        i, z = start[x], start[x + 1]
        for y, v in zip(to[i:z].tolist(), length[i:z].tolist(), strict=True):
            if d + v < best[y]:
                best[y] = d + v
                heapq.heappush(heap, (d + v, y))
    return best


def shortest_paths(segments: DataFrame, sources: DataFrame, by: list[str], task_edges: int = TASK_SEGMENTS) -> DataFrame:
    """by, node, distance from the block's sources over undirected segments (a, b, w) with
    weights of 0 or more; that of unreachable nodes is infinite (K3). sources: by, node.
    Blocks of at most task_edges segments take a task each, larger ones go by joins."""
    from tesselon.operators.relational import checkpointed

    large = checkpointed(segments.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > task_edges).drop("n"))
    if not large.isEmpty():
        far = paths_by_joins(segments.join(large, by, "left_semi"), sources.join(large, by, "left_semi"), by)
        near = shortest_paths(segments.join(large, by, "left_anti"), sources.join(large, by, "left_anti"), by, 1 << 62)
        return near.unionByName(far)
    schema = ", ".join([*[f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in by], "node long, distance double"])

    def run(g: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        nodes, code = np.unique(np.concatenate([g["a"].to_numpy(np.int64), g["b"].to_numpy(np.int64), s["node"].to_numpy(np.int64)]), return_inverse=True)
        n = len(g)
        best = distances(code[:n], code[n : 2 * n], g["w"].to_numpy(float), code[2 * n :], len(nodes))
        first = g if len(g) else s
        return pd.DataFrame({**{c: np.repeat(first[c].iloc[:1].to_numpy(), len(nodes)) for c in by}, "node": nodes, "distance": best})

    return segments.groupBy(*by).cogroup(sources.groupBy(*by)).applyInPandas(run, schema)


def paths_by_joins(segments: DataFrame, sources: DataFrame, by: list[str], delta: float | None = None) -> DataFrame:
    """shortest_paths for blocks of any size, all of them together. Each round extends the
    open nodes - those that got nearer since they were extended - within delta of the nearest
    open one of their block, so that few are extended twice; rounds end when none is open.
    delta: four mean weights if not given."""
    from tesselon.operators.relational import checkpointed

    a, b = segments.select(*by, F.col("a").alias("node"), F.col("b").alias("other"), "w"), segments.select(*by, F.col("b"), F.col("a"), "w")
    arcs = checkpointed(a.unionAll(b).groupBy(*by, "node", "other").agg(F.min("w").cast("double").alias("w")))
    if delta is None:
        delta = max(4 * (arcs.agg(F.avg("w")).first()[0] or 1.0), 1e-9)
    state = checkpointed(sources.select(*by, "node").distinct().withColumns({"d": F.lit(0.0), "open": F.lit(True)}))
    while not (pending := state.where("open")).isEmpty():
        bound = pending.groupBy(*by).agg((F.min("d") + delta).alias("bound"))
        now = checkpointed(pending.join(bound, by).where("d <= bound").select(*by, "node", "d"))
        step = now.join(arcs, [*by, "node"]).groupBy(*by, F.col("other").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("s"))
        both = state.join(step, [*by, "node"], "full_outer").join(now.select(*by, "node", F.lit(1).alias("went")), [*by, "node"], "left")
        nearer = F.col("s").isNotNull() & (F.col("d").isNull() | (F.col("s") < F.col("d")))
        state = checkpointed(both.select(*by, "node", F.least("d", "s").alias("d"), (nearer | F.coalesce("open", F.lit(False)) & F.col("went").isNull()).alias("open")))
    nodes = arcs.select(*by, "node").unionAll(sources.select(*by, "node")).distinct()
    return nodes.join(state, [*by, "node"], "left").select(*by, "node", F.coalesce("d", F.lit(float("inf"))).alias("distance"))


def split_two_means(df: DataFrame, by: list[str], value: str, ties: list[str]) -> DataFrame:
    """low_group: whether a value lies in the lower part of the exact one-dimensional
    2-means split of its block (K4): the cut of the sorted values with the least sum of
    squares within. One value, or equal values: the lower half; missing: upper."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), *ties)
    whole, upto = Window.partitionBy(*by), w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value)
    d = df.withColumn("__i", F.row_number().over(w)).withColumns({"__n": F.count(x).over(whole), "__s": F.sum(x).over(upto), "__t": F.sum(x).over(whole)})
    left, right = F.col("__s"), F.col("__t") - F.col("__s")
    between = F.when(F.col("__i") < F.col("__n"), left * left / F.col("__i") + F.try_divide(right * right, F.col("__n") - F.col("__i")))
    scored = d.withColumn("__b", F.round(between, 9))
    cut = F.min_by("__i", F.when(F.col("__b").isNotNull(), F.struct(-F.col("__b"), F.col("__i")))).over(whole)
    flat = F.min(x).over(whole) == F.max(x).over(whole)
    half = F.ceil(F.col("__n") / 2)
    low = F.when(x.isNull(), False).when(F.col("__n") <= 1, True).when(flat, F.col("__i") <= half).otherwise(F.col("__i") <= cut)
    return scored.withColumn("low_group", low).drop("__i", "__n", "__s", "__t", "__b")


def transform_points(points: DataFrame, matrix: list[list[float]], swap: bool = True) -> DataFrame:
    """x, y, z by an affine 3 x 4 matrix, after swapping x and y (K1)."""
    x, y, z = (F.col(c) for c in (("y", "x", "z") if swap else ("x", "y", "z")))
    return points.withColumns({c: x * m[0] + y * m[1] + z * m[2] + m[3] for c, m in zip("xyz", matrix, strict=True)})


def calibrated_strength(ends: DataFrame, sizes: DataFrame, by: list[str] = ()) -> DataFrame:
    """by, region, strength: mean over partner regions of log1p of symmetrised block
    counts over the product of region sizes (K8, J13). ends: by, block, region, n_source,
    n_target; sizes: region, n."""
    s = ends.select(*by, "block", F.col("region").alias("r"), "n_source")
    t = ends.select(*by, "block", F.col("region").alias("t"), "n_target")
    counts = s.join(t, [*by, "block"]).groupBy(*by, "r", "t").agg(F.sum(F.col("n_source") * F.col("n_target")).cast("double").alias("c"))
    back = counts.select(*by, F.col("r").alias("t"), F.col("t").alias("r"), F.col("c").alias("back"))
    both = counts.join(back, [*by, "r", "t"], "full_outer").where("r <> t")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = sizes.select(F.col("region").alias("r"), F.col("n").alias("nr")), sizes.select(F.col("region").alias("t"), F.col("n").alias("nt"))
    scaled = both.join(n[0], "r").join(n[1], "t").select(*by, "r", F.log1p(divide(zero("c") + zero("back"), F.col("nr") * F.col("nt"))).alias("v"))
    partners = sizes.agg((F.count("*") - 1).alias("m"))
    return scaled.groupBy(*by, F.col("r").alias("region")).agg(F.sum("v").alias("s")).crossJoin(F.broadcast(partners)).select(*by, "region", divide("s", "m").alias("strength"))  # partners is one row
