"""Correlation, rank tests, resampling, corrections and models.

Statistics are aggregations; tails of distributions are pandas UDFs over the few
resulting rows. Resampling joins rows with a table of drawn indices, so any draw rule
(numpy's generators, a hash) gives the same plan.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import clip, corr, divide, fisher_z
from tesselon.functions.special import chi2_p, normal_two_sided, r_p, t_p
from tesselon.operators.sequence import avg_rank

#: Rows of a group whose permutations tasks draw in blocks.
TASK_ROWS = 1_000_000


def pearson(df: DataFrame, x: str, y: str, by: list[str], least: int = 4) -> DataFrame:
    """by, n, r of complete pairs; r is null under least pairs (ST1)."""
    n = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    got = df.groupBy(*by).agg(n.alias("n"), corr(x, y).alias("r")) if by else df.agg(n.alias("n"), corr(x, y).alias("r"))
    return got.withColumn("r", F.when(F.col("n") >= least, F.col("r")))


def with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", r_p("r", "n"))


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 4) -> DataFrame:
    """by, n, r of average ranks over complete pairs (ST2)."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = avg_rank(avg_rank(both, x, by, "__rx"), y, by, "__ry")
    return pearson(ranked, "__rx", "__ry", by, least)


def correlation_grid(df: DataFrame, left: list[str], right: list[str], key: list[str], by: list[str] = (), least: int = 4) -> DataFrame:
    """by, x, y, n, r of each left measure with each right one (ST3): one long join and
    one aggregation."""
    from tesselon.operators.relational import long

    a = long(df, [*by, *key], left, "x", "a")
    b = long(df, [*by, *key], right, "y", "b")
    return pearson(a.join(b, [*by, *key]), "a", "b", [*by, "x", "y"], least)


def group_residual(df: DataFrame, value: str, group: list[str], name: str) -> DataFrame:
    """Residual on group dummies: the difference from the group mean (ST9)."""
    return df.withColumn(name, F.col(value) - F.avg(value).over(Window.partitionBy(*group)))


def partial_correlation(df: DataFrame, x: str, y: str, covariate: str, by: list[str]) -> DataFrame:
    """by, n, r of x and y given one covariate, from the three correlations; equal to
    that of least-squares residuals (ST8)."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(covariate).isNotNull())
    aggs = [F.count("*").alias("n"), corr(x, y).alias("xy"), corr(x, covariate).alias("xc"), corr(y, covariate).alias("yc")]
    got = ok.groupBy(*by).agg(*aggs) if by else ok.agg(*aggs)
    return got.withColumn("r", divide(F.col("xy") - F.col("xc") * F.col("yc"), F.sqrt((1 - F.pow("xc", 2)) * (1 - F.pow("yc", 2))))).drop("xy", "xc", "yc")


def partial_correlation_many(df: DataFrame, x: str, y: str, covariates: list[str], by: list[str]) -> DataFrame:
    """As partial_correlation with any number of covariates: least-squares residuals in
    one task a group, with the p of n - k - 2 degrees of freedom (ST8, ST11)."""
    from tesselon.functions.special import r_two_sided

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by], "n long, r double, p double"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna(subset=[x, y, *covariates])
        r = np.nan
        if len(g) > len(covariates) + 2:
            m = np.column_stack([np.ones(len(g)), g[covariates].to_numpy(float)])
            rest = [v - m @ np.linalg.lstsq(m, v, rcond=None)[0] for v in (g[x].to_numpy(float), g[y].to_numpy(float))]
            size = np.sqrt((rest[0] @ rest[0]) * (rest[1] @ rest[1]))
            r = rest[0] @ rest[1] / size if size > 0 else np.nan
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in by}, "n": [len(g)], "r": [r], "p": r_two_sided([r], [len(g)], len(covariates))}) if len(g) else pd.DataFrame(columns=[*by, "n", "r", "p"])

    return df.groupBy(*by).applyInPandas(run, schema)


def numpy_draws(n: int, draws: int, seed: int, replace: bool = True) -> np.ndarray:
    """draws x n indices as numpy's default generator gives them."""
    r = np.random.default_rng(seed)
    return r.integers(0, n, size=(draws, n)) if replace else np.stack([r.permutation(n) for _ in range(draws)])


def hash_draws(spark, n: int, draws: int, salt: int = 0) -> DataFrame:
    """draw, pos, idx by an integer hash that SQL can repeat."""
    d = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pos"))
    mixed = F.pmod((F.col("pos") * 1000003 + F.col("draw") * 7919 + salt) * 48271, F.lit(2147483647))
    return d.withColumn("idx", F.pmod(F.pmod(mixed * 69621, F.lit(2147483647)), F.lit(n)))


def bootstrap_r(rows: DataFrame, draws: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """by, draw, r of resampled rows (ST4). rows have idx from 0 within by."""
    return draws.join(rows, "idx").groupBy(*by, "draw").agg(corr(x, y).alias("r")).where("r IS NOT NULL")


def permutation_r(rows: DataFrame, draws: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """by, draw, r of x with permuted y; draws: draw, pos, idx, a permutation each
    (ST5, ST10)."""
    a = rows.select(*by, F.col("idx").alias("pos"), x)
    b = rows.select(*by, "idx", y)
    return draws.join(a, "pos").join(b, [*by, "idx"]).groupBy(*by, "draw").agg(corr(x, y).alias("r"))


def permutation_blocks(rows: DataFrame, key: str, x: str, y: str, draws: int, number: Callable, by: list[str] = (), strata: list[str] = (), block: int = 500, task_rows: int = TASK_ROWS) -> DataFrame:
    """by, draw, r of y with x permuted within strata (ST5, ST10). In each draw the rows of a
    stratum are put in the order of number(key, draw) and then of key, and the i-th of them
    gives its x to the i-th row by key; number is arithmetic that columns and numpy arrays
    both have, from 0 to 2**31, so a draw is the same wherever it is made. A task takes a
    block of draws of one group and returns one row. Groups of more than task_rows rows are
    ordered by windows instead, a window for each draw. Rows with a null in key, x or y take
    no part; r is null where x or y doesn't vary. Keys are whole numbers, different within
    a group; by and strata may not be null."""
    from tesselon.operators.relational import checkpointed, with_keys

    t = with_keys(rows, [*by, *strata]).where(F.col(key).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    t = t.select(*by, *strata, F.lit(0).alias("one"), F.col(key).cast("long").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    own = ["one", *by]
    large = checkpointed(t.groupBy(*own).agg(F.count("*").alias("n")).where(F.col("n") > task_rows).drop("n"))
    s = F.xxhash64(*strata) if strata else F.lit(0).cast("long")
    groups = t.join(large, own, "left_anti").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct(s.alias("s"), "k", "x", "y"))).alias("t"))
    blocks = groups.select(*by, *[F.col(f"t.{c}").alias(c) for c in "skxy"], F.explode(F.sequence(F.lit(0), F.lit(-(-draws // block) - 1))).alias("b")).repartition(*by, "b")

    def run(batches):
        for g in batches:
            out = []
            for s, k, a, c, b in zip(g["s"], g["k"], g["x"], g["y"], g["b"], strict=True):
                k, a, c = np.asarray(k, np.int64), np.asarray(a, float), np.asarray(c, float)
                run_of = np.concatenate([[0], np.cumsum(np.diff(np.asarray(s, np.int64)) != 0)]).astype(np.int64)
                r = []
                for lo in range(b * block, min((b + 1) * block, draws), step := max(1, (1 << 21) // len(k))):
                    d = np.arange(lo, min(lo + step, (b + 1) * block, draws), dtype=np.int64)
                    order = np.argsort(run_of * (1 << 32) + number(k[None], d[:, None]), axis=1, kind="stable")
                    p, q = a[order] - a.mean(), c - c.mean()
                    size = np.sqrt((p * p).sum(axis=1) * (q * q).sum())
                    flat = np.ptp(a) == 0 or np.ptp(c) == 0
                    r += [None] * len(d) if flat else (p @ q / size).tolist()
                out.append(r)
            yield pd.DataFrame({**{c: g[c] for c in by}, "b": g["b"], "r": out})

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by], "b int, r array<double>"])
    done = blocks.mapInPandas(run, schema).select(*by, "b", F.posexplode("r").alias("i", "r"))
    done = done.select(*by, (F.col("b").cast("long") * block + F.col("i")).alias("draw"), "r")
    if large.isEmpty():
        return done
    far = t.join(large, own, "left_semi")
    each = far.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    put = each.withColumn("i", F.row_number().over(Window.partitionBy(*own, "draw", *strata).orderBy(number(F.col("k"), F.col("draw")), "k"))).drop("k", "y")
    at = far.withColumn("i", F.row_number().over(Window.partitionBy(*own, *strata).orderBy("k"))).select(*own, *strata, "i", "y")
    return done.unionByName(put.join(at, [*own, *strata, "i"]).groupBy(*own, "draw").agg(corr("x", "y").alias("r")).drop("one"))


def interval(draws: DataFrame, value: str, by: list[str], level: float = 0.95) -> DataFrame:
    """Percentile interval, mean, sd and the share above 0 of drawn values (A5, ST27)."""
    a = (1 - level) / 2
    return draws.groupBy(*by).agg(
        F.percentile(value, F.lit(a)).alias("low"), F.percentile(value, F.lit(1 - a)).alias("high"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive")
    )


def empirical_p(null: DataFrame, observed: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(1 + count beyond the observed) / (N + 1): two-sided, upper, and two-sided about
    the null's mean (ST6, ST7). observed: by, obs. Values are compared at 12 decimals, so
    a draw that equals the observation counts whatever the order of its sums."""
    mean = (null.groupBy(*by) if by else null).agg(F.avg(value).alias("__m"))
    n = null.join(observed.join(mean, by), by) if by else null.crossJoin(F.broadcast(observed.crossJoin(mean)))  # one row
    beyond = lambda a, b: (1 + F.count_if(F.round(a, 12) >= F.round(b, 12))) / (F.count(value) + 1)
    return n.groupBy(*by, "obs").agg(
        beyond(F.abs(value), F.abs("obs")).alias("p_two_sided"), beyond(F.col(value), F.col("obs")).alias("p_upper"), beyond(F.abs(F.col(value) - F.col("__m")), F.abs(F.col("obs") - F.col("__m"))).alias("p_centred")
    )


def fisher_summary(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, r, z, var = 1 / (n - 3), low, high of each group (ST12)."""
    g = pearson(df, x, y, by).where("r IS NOT NULL AND n > 3")
    z, half = F.atanh("r"), 1.959963984540054 * F.sqrt(1 / (F.col("n") - 3))
    return g.withColumns({"z": z, "var": 1 / (F.col("n") - 3), "low": F.tanh(z - half), "high": F.tanh(z + half)})


def random_effects(df: DataFrame, effect: str = "z", variance: str = "var") -> DataFrame:
    """DerSimonian-Laird: k, q, tau2, i2, estimate, se (ST13)."""
    w = 1 / F.col(variance)
    one = df.agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * F.col(effect)).alias("wx"), F.sum(w * w).alias("w2"), F.sum(w * F.col(effect) * F.col(effect)).alias("wxx"))
    q = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    tau = F.greatest(F.lit(0.0), divide(q - (F.col("k") - 1), F.col("w") - F.col("w2") / F.col("w")))
    first = one.select("k", q.alias("q"), tau.alias("tau2"), F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("k") - 1)) / q)).otherwise(0.0).alias("i2"))
    v = 1 / (F.col(variance) + F.col("tau2"))
    return df.crossJoin(F.broadcast(first)).groupBy("k", "q", "tau2", "i2").agg((F.sum(v * F.col(effect)) / F.sum(v)).alias("estimate"), F.sqrt(1 / F.sum(v)).alias("se"))  # first is one row


def with_random_effects_p(df: DataFrame) -> DataFrame:
    return df.withColumns({"p": normal_two_sided(F.col("estimate") / F.col("se")), "q_p": chi2_p("q", F.col("k") - 1)})


def kruskal(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """by, k, n, h with tie correction (ST17)."""
    r = avg_rank(df.where(F.col(group).isNotNull()), value, list(by), "rk")
    g = r.groupBy(*by, group).agg(F.count("*").alias("ni"), F.sum("rk").alias("s")).groupBy(*by).agg(F.count("*").alias("k"), F.sum("ni").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("ni")).alias("ss"))
    t = r.groupBy(*by, value).agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    both = g.join(t, list(by)) if by else g.crossJoin(F.broadcast(t))  # each is one row
    n = F.col("n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)
    return both.select(*by, "k", "n", divide(h, 1 - F.col("ties") / (n * n * n - n)).alias("h"))


def with_kruskal_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", chi2_p("h", F.col("k") - 1))


def _slice_of_pairs(g: pd.DataFrame) -> pd.DataFrame:
    """slice, a, b, u, x of one slice of values: for its groups, u is how many pairs of a
    value of a and a smaller one of b lie in it, equal ones counted half, and x the sum of
    squared counts of a times counts of b at equal values."""
    names, code = np.unique(g["g"].to_numpy(), return_inverse=True)
    order = np.argsort(g["v"].to_numpy(), kind="stable")
    v, code, c = g["v"].to_numpy()[order], code[order], g["c"].to_numpy(float)[order]
    edges = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]]))
    below, u, x = np.zeros(len(names)), np.zeros((len(names),) * 2), np.zeros((len(names),) * 2)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        k, n = code[i:j], c[i:j]
        u[k] += n[:, None] * below
        u[np.ix_(k, k)] += np.outer(n, n) / 2
        x[np.ix_(k, k)] += np.outer(n * n, n)
        below[k] += n
    m = len(names)
    return pd.DataFrame({"slice": int(g["slice"].iloc[0]), "a": np.repeat(names, m), "b": np.tile(names, m), "u": u.ravel(), "x": x.ravel()})


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """a < b, na, nb, u (of a), z with tie and continuity correction, ties (sum of t^3 -
    t), for all pairs of groups (ST16). Rows are counted by group and value once and dealt to
    slices of values; within a slice all pairs are counted in one pass over it, between
    slices by the groups' sizes in them."""
    from tesselon.operators.relational import checkpointed

    v = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    c = checkpointed(v.repartitionByRange("v").withColumn("slice", F.spark_partition_id()))
    kind = c.schema["g"].dataType.simpleString()
    within = c.groupBy("slice").applyInPandas(_slice_of_pairs, f"slice int, a {kind}, b {kind}, u double, x double")
    sizes = c.groupBy("slice", "g").agg(F.sum("c").alias("n"))
    sums = c.groupBy("g").agg(F.sum("c").alias("n"), F.sum(F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c")).alias("own"))
    names = sums.select("g")
    # every slice with every group: as many rows as slices times groups
    every = sizes.select("slice").distinct().crossJoin(F.broadcast(names) if names.count() <= 100_000 else names).join(sizes, ["slice", "g"], "left")
    before = every.select("slice", F.col("g").alias("b"), F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    between = sizes.join(before, "slice").select("slice", F.col("g").alias("a"), "b", (F.col("n") * F.col("before")).cast("double").alias("u"), F.lit(0.0).alias("x"))
    both = within.unionByName(between).groupBy("a", "b").agg(F.sum("u").alias("u"), F.sum("x").alias("x"))
    back = both.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("x").alias("y"))
    of = lambda end: sums.select(F.col("g").alias(end), F.col("n").alias(f"n{end}"), F.col("own").alias(f"own_{end}"))
    g = both.where("a < b").join(back, ["a", "b"]).join(of("a"), "a").join(of("b"), "b")
    g = g.withColumn("ties", F.col("own_a") + F.col("own_b") + 3 * (F.col("x") + F.col("y")))
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    gap = F.col("u") - na * nb / 2
    return g.select("a", "b", "na", "nb", "u", divide(F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), sd).alias("z"), "ties")


def wilcoxon(df: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    """by, n, w_plus, w_minus of paired differences, zeros dropped, with ties (sum of t^3 -
    t) and the number of zeros (ST18). Groups without other differences have no row."""
    d = df.withColumn("__d", F.col(x) - F.col(y))
    zeros = d.groupBy(*by).agg(F.count_if(F.col("__d") == 0).alias("zeros"))
    d = d.where("__d <> 0").withColumn("__a", F.abs("__d"))
    r = avg_rank(d, "__a", list(by), "__r")
    part = lambda c: F.sum(F.when(c, F.col("__r")).otherwise(0.0))
    w = r.groupBy(*by).agg(F.count("*").alias("n"), part(F.col("__d") > 0).alias("w_plus"), part(F.col("__d") < 0).alias("w_minus"))
    t = r.groupBy(*by, "__a").agg(F.count("*").cast("double").alias("t")).groupBy(*by).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("ties"))
    return w.join(t, list(by)).join(zeros, list(by)) if by else w.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(zeros))  # one row each


def one_sample_t(df: DataFrame, value: str, by: list[str], mean: float = 0.0) -> DataFrame:
    """by, n, mean, t (ST19)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), divide(F.avg(value) - mean, F.stddev_samp(value) / F.sqrt(F.count(value))).alias("t"))


def with_t_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", t_p("t", F.col("n") - 1))


def line(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, slope, intercept of complete pairs (ST21)."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = divide(F.covar_pop(x, y), F.var_pop(x))
    return ok.groupBy(*by).agg(slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"))


def bootstrap_difference(a: DataFrame, b: DataFrame, draws_a: DataFrame, draws_b: DataFrame, value: str) -> DataFrame:
    """low, high, p = 2 min(tail shares) of resampled differences of means (ST20)."""
    m = lambda rows, draws, c: draws.join(rows, "idx").groupBy("draw").agg(F.avg(value).alias(c))
    d = m(a, draws_a, "ma").join(m(b, draws_b, "mb"), "draw").withColumn("d", F.col("ma") - F.col("mb"))
    below, above = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p"))


def cv_residuals(df: DataFrame, key: str, x: str, y: str, fold: str) -> DataFrame:
    """key, predicted, residual: out-of-fold prediction of y by a line on x fitted
    without the row's fold (ST23). The sums without a fold are totals less its own."""
    sums = [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy")]
    own = df.groupBy(fold).agg(*sums)
    w = Window.partitionBy(F.lit(0))
    rest = own.select(fold, *[(F.sum(c).over(w) - F.col(c)).cast("double").alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    fit = rest.select(fold, slope.alias("b"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("a"))
    p = F.col("a") + F.col("b") * F.col(x)
    return df.join(F.broadcast(fit), fold).select(key, p.alias("predicted"), (F.col(y) - p).alias("residual"))  # one row a fold


def ward(df: DataFrame, by: list[str], key: str, measures: list[str], k: int = 3) -> DataFrame:
    """by, key, cluster, leaf: Ward linkage of a small table cut at k clusters, and each
    row's place in the tree's leaf order (ST22, O5)."""
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*by, key]], "cluster int, leaf int"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key).reset_index(drop=True)
        x = g[measures].to_numpy(float)
        n = len(x)
        d = ((x[:, None] - x) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        size, members = np.ones(n), {i: [i] for i in range(n)}
        label = np.arange(n)
        alive = list(range(n))
        while len(alive) > 1:
            if len(alive) == min(k, n):
                label = _labels(members, alive, n)
            sub = d[np.ix_(alive, alive)]
            i, j = (alive[t] for t in sorted(np.unravel_index(np.argmin(sub), sub.shape)))
            for m in alive:
                if m not in (i, j):
                    d[i, m] = d[m, i] = ((size[i] + size[m]) * d[i, m] + (size[j] + size[m]) * d[j, m] - size[m] * d[i, j]) / (size[i] + size[j] + size[m])
            size[i] += size[j]
            members[i] = members[i] + members.pop(j)
            alive.remove(j)
        if k == 1 or n == 1:
            label = np.zeros(n, int)
        leaf = np.empty(n, int)
        leaf[members[alive[0]]] = np.arange(n)
        return pd.DataFrame({**{c: g[c] for c in [*by, key]}, "cluster": label, "leaf": leaf})

    def _labels(members, alive, n):
        out = np.empty(n, int)
        for c, a in enumerate(sorted(alive, key=lambda a: min(members[a]))):
            out[members[a]] = c
        return out

    return df.groupBy(*by).applyInPandas(run, schema)


def grid_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, least, most, median, n_positive over the settings of a grid (ST26)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.median(value).alias("median"), F.count_if(F.col(value) > 0).alias("n_positive"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, mean, sd, sem, median (ST31, A6)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"), F.median(value).alias("median"))


def division_statistics(df: DataFrame, value: str, recording: str, group: str) -> DataFrame:
    """a, b, u, z, p, p_holm of all group pairs after z scoring within recordings
    (ST29)."""
    from tesselon.operators.connectivity import holm
    from tesselon.operators.sequence import zscore

    z = zscore(df, value, [recording], 0, "zero", "__z")
    return holm(with_mann_whitney_p(mann_whitney(z, "__z", group)), "p", [], ["a", "b"])


def subsample_draws(subjects: list, regions: list, draws: int, share: float, seed: int) -> list[tuple]:
    """(draw, what, dropped) rows: one subject and floor(share) of the regions dropped in
    each draw, as numpy's default generator chooses (ST24)."""
    r = np.random.default_rng(seed)
    out = []
    for d in range(draws):
        out.append((d, "subject", str(subjects[r.integers(len(subjects))])))
        out += [(d, "region", str(regions[i])) for i in r.choice(len(regions), size=int(len(regions) * share), replace=False)]
    return out


_MOMENTS = ("n", "x", "y", "xx", "yy", "xy")


def _moments(x: Column, y: Column, name: str) -> list[Column]:
    """The summands of a correlation for one point; 0 where a side is missing."""
    each = (F.lit(1.0), x, y, x * x, y * y, x * y)
    return [F.when(x.isNotNull() & y.isNotNull(), c).otherwise(0.0).alias(f"{name}_{m}") for m, c in zip(_MOMENTS, each, strict=True)]


def _correlated(sums: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """keys, n, r from summed moments; r is null under least points or where a side
    doesn't vary."""
    n, x, y, xx, yy, xy = (F.col(m) for m in _MOMENTS)
    vx, vy = n * xx - x * x, n * yy - y * y
    varies = (n > least - 0.5) & (vx > 1e-12 * n * xx) & (vy > 1e-12 * n * yy)
    return sums.select(*keys, F.round(n).cast("long").alias("n"), F.when(varies, clip((n * xy - x * y) / F.sqrt(vx * vy), -1, 1)).alias("r"))


def _region_moments(df: DataFrame, subject: str, region: str, x: str, y: str) -> tuple[DataFrame, DataFrame]:
    """(region with the moments all_* of its means; subject, region with these and the
    moments less_* of the region's means without the subject), about a common centre. Only
    regions that a subject has rows in appear with it: the others don't change without it."""
    sums = lambda d, *by: d.groupBy(*by).agg(*[f(c).alias(f"{k}{v}") for v, c in (("x", "x"), ("y", "y")) for k, f in (("s", F.sum), ("c", F.count))])
    own = sums(df.select(F.col(subject).cast("string").alias("subject"), F.col(region).cast("string").alias("region"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), "subject", "region")
    total = own.groupBy("region").agg(*[F.sum(c).alias(f"t_{c}") for c in ("sx", "cx", "sy", "cy")])
    centre = total.agg(F.avg(divide("t_sx", "t_cx")).alias("mx"), F.avg(divide("t_sy", "t_cy")).alias("my"))
    total = total.crossJoin(F.broadcast(centre))  # one row
    mean = lambda v, less: divide(F.col(f"t_s{v}") - (F.coalesce(f"s{v}", F.lit(0.0)) if less else 0.0), F.col(f"t_c{v}") - (F.col(f"c{v}") if less else 0)) - F.col(f"m{v}")
    whole = total.select("*", *_moments(mean("x", False), mean("y", False), "all"))
    pair = own.join(whole, "region").select("subject", "region", *[f"all_{m}" for m in _MOMENTS], *_moments(mean("x", True), mean("y", True), "less"))
    return whole.select("region", *[f"all_{m}" for m in _MOMENTS]), pair


def _by_subject(whole: DataFrame, pair: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the summed moments of all regions, one row; those without each subject)."""
    every = whole.agg(*[F.coalesce(F.sum(f"all_{m}"), F.lit(0.0)).alias(m) for m in _MOMENTS])
    change = pair.groupBy("subject").agg(*[F.sum(F.col(f"less_{m}") - F.col(f"all_{m}")).alias(f"d_{m}") for m in _MOMENTS])
    return every, change.crossJoin(F.broadcast(every)).select("subject", *[(F.col(m) + F.col(f"d_{m}")).alias(m) for m in _MOMENTS])  # every is one row


def two_way_subsample(df: DataFrame, draws: DataFrame, subject: str, region: str, x: str, y: str) -> DataFrame:
    """draw, n, r of region means over the remaining subjects and regions (ST24). draws:
    draw, what, dropped (text); one subject at most in a draw. Sums are added and taken away:
    those of all regions without the subject, less those of the dropped regions without it,
    so a draw costs a row for each region that it drops, whatever the table's size."""
    from tesselon.operators.relational import require_unique

    whole, pair = _region_moments(df, subject, region, x, y)
    every, without = _by_subject(whole, pair)
    gone = require_unique(draws.where("what = 'subject'").select("draw", F.col("dropped").alias("subject")), ["draw"])
    named = draws.select("draw").distinct().join(gone, "draw", "left")
    start = named.join(without, "subject", "left").crossJoin(F.broadcast(every.select(*[F.col(m).alias(f"e_{m}") for m in _MOMENTS])))  # one row
    start = start.select("draw", *[F.coalesce(m, f"e_{m}").alias(m) for m in _MOMENTS])
    out = draws.where("what = 'region'").select("draw", F.col("dropped").alias("region")).distinct().join(named, "draw").join(whole, "region")
    out = out.join(pair.select("subject", "region", F.lit(1).alias("there"), *[f"less_{m}" for m in _MOMENTS]), ["subject", "region"], "left")
    less = out.groupBy("draw").agg(*[F.sum(F.when(F.col("there") == 1, F.col(f"less_{m}")).otherwise(F.col(f"all_{m}"))).alias(f"o_{m}") for m in _MOMENTS])
    left = start.join(less, "draw", "left").select("draw", *[(F.col(m) - F.coalesce(f"o_{m}", F.lit(0.0))).alias(m) for m in _MOMENTS])
    return _correlated(left.where("n > 0.5"), ["draw"])


def leave_one_out(df: DataFrame, subject: str, region: str, x: str, y: str) -> DataFrame:
    """omitted ('none' for nobody), n, r of region means (Q9), by taking each subject's own
    rows away from the sums of all."""
    every, without = _by_subject(*_region_moments(df, subject, region, x, y))
    sums = without.withColumnRenamed("subject", "omitted").unionByName(every.select(F.lit("none").alias("omitted"), *_MOMENTS))
    return _correlated(sums.where("n > 0.5"), ["omitted"])


def z_p(z: Column) -> Column:
    return normal_two_sided(z)


def fisher_p(r: str, n: Column) -> Column:
    """Two-sided p of atanh(r) sqrt(n - 3)."""
    return normal_two_sided(fisher_z(r) * F.sqrt(n - 3))


def correlation_summary(df: DataFrame, key: str, x: str, y: str, draws: int, seed: int) -> DataFrame:
    """n, r, p, low, high, p_permutation of one small table (of regions): Pearson r with
    its bootstrap interval and two-sided permutation p, both drawn by one numpy generator
    (ST5, ST6). The table meets in one task; draws are made a thousand at a time."""
    from tesselon.functions.special import r_two_sided

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna().sort_values("k")
        a, b, n = g["x"].to_numpy(float), g["y"].to_numpy(float), len(g)
        generator = np.random.default_rng(seed)

        def corr_rows(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
            size = np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
            return np.divide((p * q).sum(axis=1), size, out=np.full(len(p), np.nan), where=size > 1e-12)

        r = float(corr_rows(a[None], b[None])[0]) if n > 3 else np.nan
        sizes = [min(1000, draws - i) for i in range(0, draws, 1000)]
        index = [generator.integers(0, n, size=(m, n)) for m in sizes] if n else []
        boot = np.concatenate([corr_rows(a[i], b[i]) for i in index]) if n else np.zeros(0)
        null = np.concatenate([corr_rows(np.broadcast_to(a, (m, n)), b[np.stack([generator.permutation(n) for _ in range(m)])]) for m in sizes]) if n else np.zeros(0)
        low, high = np.quantile(boot[~np.isnan(boot)], (0.025, 0.975)) if (~np.isnan(boot)).any() else (np.nan, np.nan)
        p = (1 + np.count_nonzero(np.round(np.abs(null), 12) >= round(abs(r), 12))) / (draws + 1)
        return pd.DataFrame({"n": [n], "r": [r], "p": r_two_sided([r], [n]), "low": [low], "high": [high], "p_permutation": [p]})

    table = df.select(F.lit(0).alias("one"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return table.groupBy("one").applyInPandas(lambda g: run(g.drop(columns="one")), "n long, r double, p double, low double, high double, p_permutation double")


def with_mann_whitney_p(df: DataFrame) -> DataFrame:
    """mann_whitney's rows with their two-sided p: exact where there are no ties and one
    group has 8 values at most, else normal (ST16)."""
    exact = F.pandas_udf(lambda u, na, nb: pd.Series([exact_mann_whitney_p(*v) for v in zip(u, na, nb, strict=True)], dtype=float), "double")
    small = (F.col("ties") == 0) & (F.least("na", "nb") <= 8)
    few = F.when(small, F.col("na")).otherwise(F.lit(0)), F.when(small, F.col("nb")).otherwise(F.lit(0))
    return df.withColumn("p", F.when(small, exact("u", *few)).otherwise(normal_two_sided("z")))


def with_wilcoxon_p(df: DataFrame) -> DataFrame:
    """wilcoxon's rows with their two-sided p: exact for 50 pairs at most without ties or
    zero differences, else normal with tie correction (ST18)."""
    exact = F.pandas_udf(lambda w, n: pd.Series([exact_wilcoxon_p(*v) for v in zip(w, n, strict=True)], dtype=float), "double")
    small = (F.col("n") <= 50) & (F.col("ties") == 0) & (F.col("zeros") == 0)
    n = F.col("n").cast("double")
    z = divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return df.withColumn("p", F.when(small, exact(F.when(small, F.col("w_plus")).otherwise(0.0), F.when(small, F.col("n")).otherwise(F.lit(0)))).otherwise(normal_two_sided(z)))


def exact_mann_whitney_p(u: float, na: int, nb: int) -> float:
    """Two-sided exact p of U without ties, from the counts of rank arrangements."""
    ways = np.zeros(na * nb + 1)
    ways[0] = 1
    for i in range(1, na + 1):  # Gaussian binomial coefficients
        top = np.zeros_like(ways)
        top[:] = ways
        shift = nb + i
        if shift < len(ways):
            top[shift:] -= ways[:-shift]
        for k in range(i, len(top)):
            top[k] += top[k - i]
        ways = top
    total = ways.sum()
    high = max(u, na * nb - u)
    return float(min(1.0, 2 * ways[int(np.ceil(high)) :].sum() / total))


def exact_wilcoxon_p(w: float, n: int) -> float:
    """Two-sided exact p of a signed rank sum without ties or zeros."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for i in range(1, n + 1):
        ways[i:] = ways[i:] + ways[:-i].copy()
    high = max(w, n * (n + 1) / 2 - w)
    return float(min(1.0, 2 * ways[int(np.ceil(high)) :].sum() / ways.sum()))
