"""Composed structural tables and reconstruction controls."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import divide, divide_positive, side_suffix, without_leading_zeros
from tesselon.operators import graph as G
from tesselon.operators import relational as R
from tesselon.operators import stats as ST


def named_network(edges: DataFrame, classes: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """node, post_dca, pre_dca, oo, out_degree, in_degree, out_strength, in_strength of a
    network of named cells (H16). edges: source, target, type, weight (text or number,
    missing counts 1); classes: node. Names lose zero padding; only classified cells,
    positive weights and edges between different cells take part."""
    kept = edges.where(F.col("type").isin(kinds)) if kinds else edges
    w = F.coalesce(F.expr("try_cast(weight as double)"), F.lit(1.0))
    e = kept.select(without_leading_zeros("source").alias("a"), without_leading_zeros("target").alias("b"), w.alias("w")).where("w > 0 AND a <> b")
    names = classes.select(without_leading_zeros("node").alias("node")).distinct()
    known = lambda end: names.select(F.col("node").alias(end))
    adj = e.join(known("a"), "a").join(known("b"), "b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w"))
    dca = G.rank1_by_group(adj.withColumn("g", F.lit(0)), ["g"], 1000, 1e-10, "skip").select("node", "dca")
    at = lambda c: dca.select(F.col("node").alias(c), F.col("dca").alias(f"dca_{c}"))
    x = adj.join(at("src"), "src").join(at("dst"), "dst")
    post = x.groupBy(F.col("src").alias("node")).agg(divide_positive(F.sum(F.col("w") * F.col("dca_dst")), F.sum("w")).alias("post_dca"), F.avg(((F.col("dca_src") > 0) & (F.col("dca_dst") > 0)).cast("double")).alias("oo"))
    pre = x.groupBy(F.col("dst").alias("node")).agg(divide_positive(F.sum(F.col("w") * F.col("dca_src")), F.sum("w")).alias("pre_dca"))
    out = names.join(post, "node", "left").join(pre, "node", "left").join(R.degrees(adj, "src", "dst", "w"), "node", "left")
    return out.na.fill(0, ["out_degree", "in_degree", "out_strength", "in_strength"])


def cell_map(counts_a: DataFrame, counts_b: DataFrame, least: float = 0.30) -> DataFrame:
    """cell, region, confidence: the region with most localised counts (of both ends) of
    each cell, first by name if equal, where it holds least of them (H17). Inputs: cell,
    region, n."""
    both = R.outer_zero_filled(counts_a.withColumnRenamed("n", "na"), counts_b.withColumnRenamed("n", "nb"), ["cell", "region"]).select("cell", "region", (F.col("na") + F.col("nb")).alias("n"))
    share = both.withColumn("confidence", divide("n", F.sum("n").over(Window.partitionBy("cell"))))
    return R.best_row(share, ["cell"], "n", ["region"]).where(F.col("confidence") >= least).select("cell", "region", "confidence")


def mapped_network(connections: DataFrame, cells: DataFrame, least_weight: int = 5, times: str | None = None) -> DataFrame:
    """region, post_dca, pre_dca, oo, n_cells of a network whose cells lie in regions with
    a side suffix (H18): rows under least_weight are dropped before weights of a pair are
    summed; rank-1 scores inside each region; pooled means by region without its side.
    times: a column that says how many equal rows a row stands for."""
    from tesselon.operators.relational import checkpointed

    w = F.col("w") * F.col(times) if times else F.col("w")
    kept = connections.where(F.col("w") >= least_weight).groupBy("src", "dst").agg(F.sum(w).cast("double").alias("w")).where("src <> dst")
    m = cells.select(F.col("cell").alias("node"), "region")
    e = kept.join(m.select(F.col("node").alias("src"), F.col("region").alias("src_region")), "src").join(m.select(F.col("node").alias("dst"), F.col("region").alias("dst_region")), "dst")
    e = checkpointed(e)
    inside = e.where("src_region = dst_region").select(F.col("src_region").alias("region"), "src", "dst", "w")
    dca = G.rank1_by_group(inside, ["region"], 300, 1e-9, "stop").select("node", "dca")
    at = lambda c: dca.select(F.col("node").alias(c), F.col("dca").alias(f"dca_{c}"))
    x = e.join(at("src"), "src").join(at("dst"), "dst")
    bare = lambda c: side_suffix(c)[0].alias("region")
    post = x.groupBy(bare("src_region")).agg(divide_positive(F.sum(F.col("w") * F.col("dca_dst")), F.sum("w")).alias("post_dca"), divide(F.count_if((F.col("dca_src") > 0) & (F.col("dca_dst") > 0)), F.countDistinct("dst")).alias("oo"))
    pre = x.groupBy(bare("dst_region")).agg(divide_positive(F.sum(F.col("w") * F.col("dca_src")), F.sum("w")).alias("pre_dca"))
    n = cells.groupBy(bare("region")).agg(F.count("*").alias("n_cells"))
    return n.join(post, "region", "left").join(pre, "region", "left")


def covering_draws(members: dict[int, set], fraction: float, draws: int, seed: int, tries: int = 100_000) -> list[tuple[int, int]]:
    """(draw, block) of random block subsets that together cover every region; subsets
    that don't are drawn again (K14). members: block -> regions that it reaches."""
    blocks = np.array(sorted(members))
    everything = set().union(*members.values())
    size = max(1, round(fraction * len(blocks)))
    r = np.random.default_rng(seed)
    out = []
    for d in range(draws):
        for _ in range(tries):
            pick = r.choice(blocks, size, replace=False)
            if set().union(*(members[int(b)] for b in pick)) == everything:
                break
        else:
            raise R.CheckFailed(f"no covering subset of {size} blocks in {tries} tries")
        out += [(d, int(b)) for b in sorted(pick)]
    return out


def reproducibility(subsets: DataFrame, full: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, n_draws, mean, low, high, share_positive of the correlation over regions
    between subset measures (by, draw, region, value) and full ones (region and the keys
    they share) (K15, ST27)."""
    keys = [c for c in full.columns if c != value]
    r = ST.pearson(subsets.join(full.withColumnRenamed(value, "__full"), keys), value, "__full", [*by, "draw"])
    return ST.interval(r, "r", by).join(r.groupBy(*by).agg(F.count("r").alias("n_draws")), by)


def search_settings(baseline: list[float], spread: list[float], coarse: int, seed: int) -> list[list[float]]:
    """The baseline and coarse uniform draws around it (K9)."""
    r = np.random.default_rng(seed)
    return [list(map(float, baseline))] + [[float(b + s * u) for b, s, u in zip(baseline, spread, r.uniform(-1, 1, len(baseline)), strict=True)] for _ in range(coarse)]


def calibrate(spark: SparkSession, measure: Callable[[DataFrame], DataFrame], target: DataFrame, baseline: list[float], spread: list[float], coarse: int = 24, refine: int = 16, shrink: float = 0.25, seed: int = 0) -> DataFrame:
    """setting, stage, parameters, rho of a two-stage random search that maximises the
    Spearman correlation of measure(settings) (setting, region, strength) with target
    (region, value); settings (setting, p array<double>) hold a whole stage, so that
    each stage is one plan (K9). Equal correlations: the earlier setting is the best."""

    def scored(settings: list[list[float]], stage: str, first: int) -> list[tuple]:
        table = spark.createDataFrame([(first + i, p) for i, p in enumerate(settings)], "setting int, p array<double>")
        got = {r["setting"]: r["r"] for r in ST.spearman(measure(table).join(target, "region"), "strength", "value", ["setting"]).collect()}  # one row a setting
        return [(first + i, stage, p, got.get(first + i)) for i, p in enumerate(settings)]

    rows = scored(search_settings(baseline, spread, coarse, seed), "coarse", 0)
    best = max(rows, key=lambda r: (-2.0 if r[3] is None else r[3], -r[0]))
    if refine:
        rows += scored(search_settings(best[2], [shrink * s for s in spread], refine, seed + 1)[1:], "refine", len(rows))
    return spark.createDataFrame(rows, "setting int, stage string, parameters array<double>, rho double")


def shuffled_folds(n: int, k: int = 5, seed: int = 0) -> list[int]:
    """The fold of each of n rows when their order is shuffled by numpy's legacy generator
    and cut into k nearly equal parts (ST23)."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    fold = np.empty(n, int)
    for f, part in enumerate(np.array_split(order, k)):
        fold[part] = f
    return fold.tolist()
