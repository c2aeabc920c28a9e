"""Windowed correlation, its variability and strength, and transfer entropy.

Input is one row for each unit of a recording with its values as an array. Pairs of
units are joined by recording and window; each pair-window is one product of two short
arrays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import clip, divide
from tesselon.operators.sequence import dot, sliding, unit_vector


def window_correlation(units: DataFrame, width: int, step: int, recording: str = "recording", unit: str = "unit") -> DataFrame:
    """recording, win, u < v, r of every pair and window (F4); r is null where a side
    is constant."""
    w = sliding(units, [recording, unit], width, step).withColumn("z", unit_vector(F.col("window"))).select(recording, unit, "win", "z")
    a, b = w.withColumnsRenamed({unit: "u", "z": "za"}), w.withColumnsRenamed({unit: "v", "z": "zb"})
    return a.join(b, [recording, "win"]).where("u < v").select(recording, "win", "u", "v", clip(dot(F.col("za"), F.col("zb")), -1, 1).alias("r"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """u, v in either order."""
    rest = [c for c in pairs.columns if c not in ("u", "v")]
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), *rest))


def variability(pairs: DataFrame, recording: str = "recording", missing_as_zero: bool = False, least: int = 3) -> DataFrame:
    """recording, unit, fcv: the mean over partners of the deviation of r over
    windows (F5; F8 with missing_as_zero); null under least windows."""
    r = F.coalesce("r", F.lit(0.0)) if missing_as_zero else F.col("r")
    by_pair = pairs.groupBy(recording, "u", "v").agg(F.stddev_pop(r).alias("sd"), F.count("*").alias("n"))
    return both_ways(by_pair).groupBy(recording, F.col("u").alias("unit")).agg(F.when(F.min("n") >= least, F.avg("sd")).alias("fcv"))


def strength(pairs: DataFrame, recording: str = "recording") -> DataFrame:
    """recording, unit, fcs: the mean over windows of the mean r with partners."""
    return both_ways(pairs).groupBy(recording, "u", "win").agg(F.avg("r").alias("m")).groupBy(recording, F.col("u").alias("unit")).agg(F.avg("m").alias("fcs"))


def profile_distance(pairs: DataFrame, recording: str = "recording") -> DataFrame:
    """recording, unit, distance: mean over windows of 1 - corr(profile in the
    window, mean profile) over partners (F7)."""
    every = both_ways(pairs)
    mean = every.groupBy(recording, "u", "v").agg(F.avg("r").alias("m"))
    by_window = every.join(mean, [recording, "u", "v"]).groupBy(recording, "u", "win").agg(F.covar_pop("r", "m").alias("c"), (F.stddev_pop("r") * F.stddev_pop("m")).alias("s"), F.count("r").alias("n"))
    d = 1 - clip(F.when(F.col("s") * F.col("n") > 1e-12, divide("c", "s")), -1, 1)
    return by_window.groupBy(recording, F.col("u").alias("unit")).agg(F.avg(d).alias("distance"))


def quantile_bins(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """state: how many distinct quartile edges are at most the value; -1 for a
    constant series (Q1)."""
    edges = long.groupBy(*keys).agg(F.array_distinct(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))).alias("edges"), (F.min(value) == F.max(value)).alias("flat"))
    return long.join(edges, keys).withColumn("state", F.when(F.col("flat"), -1).otherwise(F.size(F.filter("edges", lambda e: e <= F.col(value)))).cast("long")).drop("edges", "flat")


def transfer_entropy(states: DataFrame, recording: str = "recording", unit: str = "unit", lag: int = 1, least: int = 10) -> DataFrame:
    """recording, source, target, te in bits:
    H(y', y) - H(y) - H(y', y, x) + H(y, x) over valid triples, of pairs with more than
    least of them (Q2). Target-only entropies are computed once for each target."""
    from tesselon.operators.relational import entropy_bits
    from tesselon.operators.sequence import lead_triples

    own = lead_triples(states.where("state >= 0"), [recording, unit], "state", lag)
    y = own.select(recording, F.col(unit).alias("target"), "frame", F.col("now").alias("y"), F.col("next").alias("y1"))
    x = own.select(recording, F.col(unit).alias("source"), "frame", F.col("now").alias("x"))
    target = entropy_bits(y, [recording, "target"], ["y1", "y"], "hyy").join(entropy_bits(y, [recording, "target"], ["y"], "hy"), [recording, "target"])
    # counts of (y', y, x) are the finest; those of (y, x) are their sums
    fine = y.join(x, [recording, "frame"]).where("source <> target").groupBy(recording, "source", "target", "y1", "y", "x").agg(F.count("*").alias("n"))
    h3 = fine.groupBy(recording, "source", "target").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s3"))
    h2 = fine.groupBy(recording, "source", "target", "y", "x").agg(F.sum("n").alias("n")).groupBy(recording, "source", "target").agg(F.sum(F.col("n") * F.log2("n")).alias("s2"))
    both = h3.join(h2, [recording, "source", "target"]).join(target, [recording, "target"]).where(F.col("total") > least)
    return both.select(recording, "source", "target", (F.col("hyy") - F.col("hy") + (F.col("s3") - F.col("s2")) / F.col("total")).alias("te"))


def te_matrix(values: np.ndarray, lag: int = 1, least: int = 10) -> np.ndarray:
    """te[source, target] in bits of all pairs of rows of values, quartile states (Q1, Q2):
    all joint counts come from one product of indicator matrices. NaN for constant rows,
    on the diagonal, and for too few frames."""
    n, frames = values.shape
    m = frames - lag
    out = np.full((n, n), np.nan)
    if m <= least:
        return out
    ok = np.flatnonzero(values.min(axis=1) < values.max(axis=1))
    states = np.stack([np.searchsorted(np.unique(np.quantile(v, (0.25, 0.5, 0.75))), v, side="right") for v in values[ok]]) if len(ok) else np.zeros((0, frames), int)
    hot = (states[:, :, None] == np.arange(4)).astype(np.float64)
    now, after = hot[:, :m], hot[:, lag:]
    both = (after[:, :, :, None] * now[:, :, None, :]).reshape(len(ok), m, 16)
    counts = np.tensordot(both, now, axes=(1, 1)).transpose(0, 2, 1, 3).reshape(len(ok), len(ok), 4, 4, 4)  # target, source, y', y, x

    def h(c: np.ndarray, axes: tuple) -> np.ndarray:
        return -np.sum(np.where(c > 0, c / m * np.log2(np.where(c > 0, c, 1) / m), 0.0), axis=axes)

    target = h(both.sum(axis=1), (1,)) - h(now.sum(axis=1), (1,))
    te = target[:, None] - h(counts, (2, 3, 4)) + h(counts.sum(axis=2), (2, 3))
    np.fill_diagonal(te, np.nan)
    out[np.ix_(ok, ok)] = te.T
    return out


def transfer_entropy_arrays(units: DataFrame, by: list[str], unit: str = "unit") -> DataFrame:
    """by, source, target, te of units with their values as arrays, one task for each
    group: for many draws of recordings that fit a task (Q7)."""
    import pandas as pd

    schema = ", ".join([*[f"`{c}` {units.schema[c].dataType.simpleString()}" for c in by], "source long, target long, te double"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        te = te_matrix(np.stack(g["values"].to_numpy()).astype(float))
        i, j = np.nonzero(~np.isnan(te))
        names = g[unit].to_numpy()
        return pd.DataFrame({**{c: [g[c].iloc[0]] * len(i) for c in by}, "source": names[i], "target": names[j], "te": te[i, j]})

    return units.groupBy(*by).applyInPandas(run, schema)


def net_transfer(te: DataFrame, recording: str = "recording") -> DataFrame:
    """recording, source, target, net: te(i, j) - te(j, i)."""
    back = te.select(recording, F.col("source").alias("target"), F.col("target").alias("source"), F.col("te").alias("te_back"))
    return te.join(back, [recording, "source", "target"]).select(recording, "source", "target", (F.col("te") - F.col("te_back")).alias("net"))


def drive(net: DataFrame, recording: str = "recording") -> DataFrame:
    """recording, unit, drive: mean net transfer to the others."""
    return net.groupBy(recording, F.col("source").alias("unit")).agg(F.avg("net").alias("drive"))


def benjamini_hochberg(df: DataFrame, p: str, by: list[str], name: str = "q") -> DataFrame:
    """Adjusted p: the running minimum, from the largest, of p m / rank, at most 1
    (ST15)."""
    w = Window.partitionBy(*by or [F.lit(0)])
    up = w.orderBy(p)
    ranked = df.withColumn("__i", F.rank().over(up) + F.count("*").over(Window.partitionBy(*by, p)) - 1).withColumn("__m", F.count(p).over(w))
    down = w.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__i")).over(down))).drop("__i", "__m")


def holm(df: DataFrame, p: str, by: list[str], ties: list[str], name: str = "p_holm") -> DataFrame:
    """Adjusted p: the running maximum of (m - i + 1) p, at most 1 (ST14)."""
    w = Window.partitionBy(*by or [F.lit(0)])
    order = w.orderBy(p, *ties)
    step = df.withColumn("__s", (F.count(p).over(w) - F.row_number().over(order) + 1) * F.col(p))
    return step.withColumn(name, F.least(F.lit(1.0), F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def mean_correlation(units: DataFrame, width: int, step: int, recording: str = "recording") -> DataFrame:
    """recording, u, v, r: mean over windows of the clipped correlation of window
    z scores, constant sides as 0 (Q4)."""
    return window_correlation(units, width, step, recording).groupBy(recording, "u", "v").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("r"))


def neighbour_drive(net: DataFrame, fc: DataFrame, n_frames: Column | int, q: float, recording: str = "recording") -> DataFrame:
    """recording, unit, drive over partners whose mean correlation is significant by
    the Fisher z test after BH over both triangles (Q5, Q6)."""
    from tesselon.functions.scalars import fisher_z
    from tesselon.functions.special import normal_two_sided

    z = fisher_z("r") * F.sqrt(F.lit(n_frames) - 3)
    p = both_ways(fc).withColumn("p", normal_two_sided(z))
    near = benjamini_hochberg(p, "p", [recording]).where(F.col("q") <= q).select(recording, F.col("u").alias("source"), F.col("v").alias("target"))
    return net.join(near, [recording, "source", "target"]).groupBy(recording, F.col("source").alias("unit")).agg(F.avg("net").alias("drive"), F.count("*").alias("n_neighbours"))


def surrogate_offsets(recordings: list[tuple[str, int, int]], draws: int, least: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(recording, draw, unit, offset) of independent circular shifts (Q7)."""
    out = []
    for i, (name, units, frames) in enumerate(recordings):
        r = np.random.default_rng([seed, i])
        shift = r.integers(least, frames - least + 1, size=(draws, units))
        out += [(name, d, u, int(shift[d, u])) for d in range(draws) for u in range(units)]
    return out
