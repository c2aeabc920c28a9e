"""Spatial units: k-means of the points of each region, in a task or over slices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.operators.relational import checkpointed, with_keys

#: Points of a region that one task takes; points of a slice of a larger one.
TASK_POINTS, SLICE_POINTS = 200_000, 20_000
#: Distances that a task holds at a time.
DISTANCES = 1 << 22


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, squared distance) of each point's nearest centre, the first of equals."""
    shift = centres.mean(axis=0)
    c, at = centres - shift, np.zeros(len(x), int)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), step := max(1, DISTANCES // len(c))):
        at[i : i + step] = (half - (x[i : i + step] - shift) @ c.T).argmin(axis=1)
    return at, ((x - centres[at]) ** 2).sum(axis=1)


def seeded(x: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres among weighted points, each drawn in proportion to weight times its squared
    distance from those before (fewer if there are fewer different points)."""
    r = np.random.default_rng(seed)
    centre = [x[r.choice(len(x), p=weight / weight.sum())]]
    d = ((x - centre[0]) ** 2).sum(axis=1)
    while len(centre) < k and (mass := d * weight).sum() > 0:
        centre.append(x[r.choice(len(x), p=mass / mass.sum())])
        d = np.minimum(d, ((x - centre[-1]) ** 2).sum(axis=1))
    return np.stack(centre)


def moved(x: np.ndarray, weight: np.ndarray, centre: np.ndarray, most: int) -> np.ndarray:
    """Centres after at most so many rounds of weighted means; an empty one stays."""
    for _ in range(most):
        at, _ = nearest(x, centre)
        n = np.bincount(at, weights=weight, minlength=len(centre))
        sums = np.stack([np.bincount(at, weights=weight * v, minlength=len(centre)) for v in x.T], axis=1)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1e-300)[:, None], centre)
        if np.allclose(new, centre):
            break
        centre = new
    return centre


def _count_of_units(n: Column, size: int) -> Column:
    rest = n % size
    return F.greatest(F.floor(n / size) - F.when((n > size) & (rest > 0) & (rest < size / 4), 1).otherwise(0), F.lit(1))


def kmeans_units(points: DataFrame, by: list[str], vector: str, size: int, seed: int = 42, task_points: int = TASK_POINTS) -> DataFrame:
    """by, id, unit, inertia: k-means units of a region's points, k = floor(n / size)
    less one where n > size and the rest is under a quarter of size (K2). Regions of at most
    task_points points take a task each, larger ones go together over slices. Points without
    a vector take no part; by and id may not be null."""
    p = with_keys(points, [*by, "id"]).where(F.col(vector).isNotNull()).select(*by, F.col("id").cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    sizes = checkpointed(p.groupBy(*by).agg(F.count("*").alias("n")).withColumn("k", _count_of_units(F.col("n"), size)))
    large = sizes.where(F.col("n") > task_points)
    if not large.isEmpty():
        far = units_by_slices(p.join(large, by), by, seed, slice_points=SLICE_POINTS)
        return units_by_task(p.join(sizes.where(F.col("n") <= task_points), by), by, seed).unionByName(far)
    return units_by_task(p.join(sizes, by), by, seed)


def _schema(points: DataFrame, by: list[str], rest: str) -> str:
    return ", ".join([*[f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by], rest])


def units_by_task(points: DataFrame, by: list[str], seed: int) -> DataFrame:
    """kmeans_units of points (by, id, v, k), a task for each region."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        x, one = np.stack(g["v"].to_numpy()).astype(float), np.ones(len(g))
        label, d = nearest(x, moved(x, one, seeded(x, one, int(g["k"].iloc[0]), seed), 100))
        return pd.DataFrame({**{c: g[c].to_numpy() for c in by}, "id": g["id"].to_numpy(), "unit": label, "inertia": d.sum()})

    return points.groupBy(*by).applyInPandas(run, _schema(points, by, "id long, unit int, inertia double"))


def units_by_slices(points: DataFrame, by: list[str], seed: int, rounds: int = 5, most: int = 100, slice_points: int = SLICE_POINTS) -> DataFrame:
    """kmeans_units of points (by, id, v, n, k), whatever the size of a region. Points are
    dealt into slices by a hash of their id; a task meets one slice and its region's centres.
    Seeds are k-means||: in each round, and until a region has k of them, points become
    candidates by a hash in proportion to k / 2 times their share of the squared distances.
    Candidates, weighted by the points nearest to them, are brought down to k in a task for
    each region (some three times k, however many points there are). Then means are sums over
    slices, and regions whose centres rest drop out."""
    deal = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / slice_points))
    p = checkpointed(points.select(*by, deal.alias("slice"), "id", "v", "k"))
    key = [*by, "slice"]
    width = p.select(F.max(F.size("v"))).first()[0]
    slices = checkpointed(p.select(*key).distinct())

    def chance(r: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64("id", F.lit(r), F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)

    def meet(rows: DataFrame, centres: DataFrame, what: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], rest: str) -> DataFrame:
        """what(slice, centres in order of c_id) of every slice; centres: by, c_id, c."""

        def run(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("id")
            if g.empty:
                return pd.DataFrame()
            out = what(g, c.sort_values("c_id"))
            return out.assign(**{k: g[k].iloc[0] for k in key})

        there = slices.join(centres, by).select(*[F.col(c).alias(c) for c in (*key, "c_id", "c")])  # new columns, as rows may share theirs
        return rows.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(run, _schema(rows, key, rest))

    def stacked(x: pd.Series) -> np.ndarray:
        return np.stack(x.to_numpy()).astype(float)

    def nearer(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        d = nearest(stacked(g["v"]), stacked(c["c"]))[1] if len(c) else np.full(len(g), np.inf)
        return pd.DataFrame({"id": g["id"], "v": g["v"], "k": g["k"], "d": np.minimum(g["d"].to_numpy(), d)})

    def labelled(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        at, d = nearest(stacked(g["v"]), stacked(c["c"]))
        return pd.DataFrame({"id": g["id"].to_numpy(), "c_id": c["c_id"].to_numpy()[at], "d": d})

    def sums(g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        x = stacked(g["v"])
        at, _ = nearest(x, stacked(c["c"]))
        m = np.bincount(at, minlength=len(c))
        s = np.stack([np.bincount(at, weights=v, minlength=len(c)) for v in x.T], axis=1)
        some = np.flatnonzero(m)
        return pd.DataFrame({"c_id": c["c_id"].to_numpy()[some], "m": m[some], "s": list(s[some])})

    first = F.min_by(F.struct("id", "v"), F.struct(F.xxhash64("id", F.lit(-1), F.lit(seed)), "id")).alias("f")
    new = checkpointed(p.groupBy(*by).agg(first).select(*by, F.col("f.id").alias("c_id"), F.col("f.v").alias("c")))
    found, state, r = new, p.withColumn("d", F.lit(float("inf"))), 0
    while True:
        state = checkpointed(meet(state, new, nearer, "id long, v array<double>, k long, d double"))
        left = state.groupBy(*by).agg(F.sum("d").alias("left"), F.first("k").alias("k")).where("left > 0 AND k > 1")
        short = left.join(found.groupBy(*by).agg(F.count("*").alias("have")), by).where(F.lit(r < rounds) | (F.col("have") < F.col("k")))
        now = state.join(short.select(*by, "left"), by).where(chance(r) < F.col("k") / 2 * F.col("d") / F.col("left"))
        if r >= rounds and short.isEmpty():
            break
        new = checkpointed(now.select(*by, F.col("id").alias("c_id"), F.col("v").alias("c")))
        found, r = checkpointed(found.unionAll(new)), r + 1

    def chosen(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("c_id")
        x, w = stacked(g["c"]), g["weight"].to_numpy(float)
        c = moved(x, w, seeded(x, w, int(g["k"].iloc[0]), seed), 20)
        return pd.DataFrame({**{k: [g[k].iloc[0]] * len(c) for k in by}, "c_id": np.arange(len(c)), "c": list(c), "going": True})

    weight = meet(p, found, labelled, "id long, c_id long, d double").groupBy(*by, "c_id").agg(F.count("*").alias("weight"))
    ks = p.groupBy(*by).agg(F.first("k").alias("k"))
    seeds = found.join(weight, [*by, "c_id"]).join(ks, by).groupBy(*by)
    centres = checkpointed(seeds.applyInPandas(chosen, _schema(p, by, "c_id long, c array<double>, going boolean")))
    for _ in range(most):
        going = centres.where("going").drop("going")
        if going.isEmpty():
            break
        rows = p.join(going.select(*by).distinct(), by, "left_semi")
        means = meet(rows, going, sums, "c_id long, m long, s array<double>").groupBy(*by, "c_id").agg(F.array(*[F.sum(F.get("s", F.lit(i))) / F.sum("m") for i in range(width)]).alias("to"))
        step = going.join(means, [*by, "c_id"], "left").withColumn("to", F.coalesce("to", "c"))
        off = F.exists(F.arrays_zip("c", "to"), lambda z: F.abs(z["to"] - z["c"]) > 1e-8 + 1e-5 * F.abs(z["c"]))
        step = step.select(*by, "c_id", F.col("to").alias("c"), F.max(off).over(Window.partitionBy(*by)).alias("going"))
        centres = checkpointed(centres.where("NOT going").unionByName(step))
    final = checkpointed(meet(p, centres.drop("going"), labelled, "id long, c_id long, d double"))
    inertia = final.groupBy(*by).agg(F.sum("d").alias("inertia"))
    return final.join(inertia, by).select(*by, "id", F.col("c_id").cast("int").alias("unit"), "inertia")
