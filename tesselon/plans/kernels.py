"""Queries on the simulator."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import sequence as S
from tesselon.operators import simulator as M
from tesselon.plans.catalogue import query


#: The published sweep: settings, runs and steps, and those of the potentials.
EPSILONS, RUNS, STEPS = [i / 20 for i in range(21)], 30, 6000
DENSE_EPSILONS, DENSE_RUNS, DENSE_STEPS = [0.0, 0.5, 1.0], 50, 60_000


@query("layer_sweep")
def layer_sweep(spark, sf):
    """Layer correlation, variability and spectrum over the sweep."""
    return M.sweep(spark, EPSILONS, RUNS, STEPS)


@query("layer_sweep_means")
def layer_sweep_means(spark, sf):
    """Mean over runs, by asymmetry and layer."""
    m = M.mean_sem(M.sweep(spark, EPSILONS, RUNS, STEPS), ["epsilon", "layer"], "fcv")
    return m.groupBy("epsilon").pivot("layer", [1, 2, 3, 4]).agg(F.first("mean"))


def _states(spark):
    return M.layer_states(spark, DENSE_EPSILONS, DENSE_RUNS, DENSE_STEPS)


@query("layer_energy_wells")
def layer_energy_wells(spark, sf):
    """Width of the potential well of each layer's dynamic-correlation state."""
    return S.well_width(M.potential(_states(spark), ["epsilon", "layer"], "state", 100), ["epsilon", "layer"], "x", "u", 1.0)


@query("layer_potential_curves")
def layer_potential_curves(spark, sf):
    """Every run's potential on a grid of 180 points, first and last layer."""
    return M.potential_curves(_states(spark).where("layer IN (1, 4)"), ["epsilon", "layer"], "run", "state")


@query("layer_state_summary")
def layer_state_summary(spark, sf):
    """Mean, deviation, trimmed spread and variability of every run's states."""
    t = _states(spark).where("layer IN (1, 4)")
    keys = ["epsilon", "run", "layer"]
    m = t.groupBy(*keys).agg(F.avg("state").alias("mean"), F.stddev_samp("state").alias("sd"), F.stddev_pop("state").alias("fcv"))
    return m.join(S.trimmed_spread(t, keys, "state"), keys)


@query("correlation_summary")
def correlation_summary(spark, sf):
    """ST4 ST5 ST6 T16: r with bootstrap interval and permutation p, 10,000 numpy draws each."""
    from tesselon.operators.stats import correlation_summary as summary
    from tesselon.plans.base import nation_table

    return summary(nation_table(spark, sf), "k", "x", "y", 10_000, 20260730)


@query("calibration_search")
def calibration_search(spark, sf):
    """K9 K1 K8 J14 ST2: random search of an affine map that aligns regional strength."""
    from tesselon.operators import graph as G
    from tesselon.operators import spatial as P
    from tesselon.operators.structure import calibrate
    from tesselon.plans.base import points

    p = points(spark, sf).withColumn("region", F.col("block"))
    sizes = p.groupBy("region").agg(F.count("*").alias("n"))
    target = p.groupBy("region").agg(F.avg("x").alias("value"))

    moved = p.select("block", F.col("y").alias("x"), F.col("x").alias("y"), "z")  # x and y are swapped before the map

    def strength(settings):
        of = {r["setting"]: r["p"] for r in settings.collect()}  # 25 settings at most
        maps = {k: [[scale, 0.0, 0.0, shift], [0.0, scale, 0.0, shift], [0.0, 0.0, scale, shift]] for k, (scale, shift) in of.items()}
        n = P.near_counts(moved, p, "block", "region", 0.02, maps).select(F.col("map").alias("setting"), F.col("a").alias("block"), F.col("b").alias("region"), F.col("n").alias("n_source"))
        return G.calibrated_strength(n.withColumn("n_target", F.col("n_source")), sizes, ["setting"])

    return calibrate(spark, strength, target, [1.0, 0.0], [0.3, 0.05])


@query("subsample_reproducibility")
def subsample_reproducibility(spark, sf):
    """K13 K14 K15 ST27: region strengths from covering block subsets against all."""
    from tesselon.operators.structure import covering_draws, reproducibility
    from tesselon.plans.base import cell_edges

    e = cell_edges(spark, sf).select((F.col("block") % 40).alias("block"), F.col("src").alias("region"))
    members = {r["block"]: set(r["r"]) for r in e.groupBy("block").agg(F.collect_set("region").alias("r")).collect()}  # forty blocks
    rows = [(f, d, b) for f in [k / 10 for k in range(1, 10)] for d, b in covering_draws(members, f, 200, 20260727)]  # as many as the reference's
    picks = spark.createDataFrame(rows, "fraction double, draw int, block long")
    counts = e.groupBy("block", "region").agg(F.count("*").cast("double").alias("n"))
    full = counts.groupBy("region").agg(F.sum("n").alias("value"))
    parts = counts.join(picks, "block").groupBy("fraction", "draw", "region").agg(F.sum("n").alias("value"))
    return reproducibility(parts, full, ["fraction"])


@query("named_network")
def named_network(spark, sf):
    """Structural table of a network of named cells."""
    from tesselon.operators.structure import named_network as table_
    from tesselon.plans.base import cell_edges

    name = lambda c: F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 3, "0"))
    e = cell_edges(spark, sf).groupBy("src", "dst").agg(F.count("*").cast("string").alias("weight"))
    edges = e.select(name("src").alias("source"), name("dst").alias("target"), F.lit("chemical").alias("type"), "weight")
    classes = spark.range(25).select(name("id").alias("node"))
    return table_(edges, classes, ["chemical"])


@query("mapped_network")
def mapped_network(spark, sf):
    """Regions of cells by localised counts, then pooled measures."""
    from tesselon.operators.relational import checkpointed
    from tesselon.operators.structure import cell_map
    from tesselon.operators.structure import mapped_network as table_
    from tesselon.plans.base import TASK_ITEMS
    from tesselon.sources.tables import table

    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // TASK_ITEMS))
    items = li.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 60).alias("src"), F.col("l_linenumber").alias("w")).repartition(tasks, "k")
    ends = o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 60).alias("dst"), F.col("o_orderpriority").alias("p")).repartition(tasks, "k")
    e = checkpointed(items.join(ends, "k").groupBy("src", "dst", "p", "w").agg(F.count("*").alias("n")))  # joined once; 60 x 60 cells
    side = F.when(F.col("cell") % 2 == 0, "_L").otherwise("_R")
    counts = lambda c: e.groupBy(F.col(c).alias("cell"), "p").agg(F.sum("n").alias("n")).select("cell", F.concat("p", side).alias("region"), "n")
    cells = checkpointed(cell_map(counts("src"), counts("dst"), 0.15))
    return table_(e, cells, 2, "n")


@query("cv_residual_shuffled")
def cv_residual_shuffled(spark, sf):
    """ST23: out-of-fold predictions with folds shuffled by numpy."""
    from tesselon.operators.stats import cv_residuals
    from tesselon.operators.structure import shuffled_folds
    from tesselon.plans.base import nation_table

    folds = spark.createDataFrame([(i, f) for i, f in enumerate(shuffled_folds(25))], "k long, fold int")
    return cv_residuals(nation_table(spark, sf).join(folds, "k"), "k", "x", "y", "fold")
