"""Queries that SQL can't express, against plain numpy on the smallest tables."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesselon.operators import graph as G
from tesselon.operators import sequence as S
from tesselon.operators import simulator as M
from tesselon.operators import stats as ST
from tesselon.plans import base, catalogue

SF = "/root/testdata/sf0.001"
Q = catalogue.queries()


@pytest.fixture(scope="module")
def nations(spark):
    return base.nation_table(spark, SF).toPandas().sort_values("k").reset_index(drop=True)


@pytest.fixture(scope="module")
def graph(spark):
    return base.nation_graph(spark, SF).toPandas()


def tail_of_t(t, df):
    """P(|T| > |t|) by the midpoint rule over the angle."""
    a = np.arctan2(math.sqrt(df), abs(t))
    x = (np.arange(200_000) + 0.5) / 200_000
    f = lambda z: np.sum(np.sin(z * x) ** (df - 1)) * z
    return f(a) / f(np.pi / 2)


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def normal(z):
    return math.erfc(abs(z) / math.sqrt(2))


def test_unit_vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.standard_normal(n).tolist()) for i, n in enumerate((1, 2, 7, 300))] + [(8, [3.0] * 9), (9, None)]
    df = spark.createDataFrame(rows, "i int, v array<double>").select("i", "v", S.unit_vector(F.col("v")).alias("u"))
    for x in df.collect():
        c = None if x["v"] is None else np.array(x["v"]) - np.mean(x["v"])
        if c is None or np.linalg.norm(c) < 1e-12:
            assert x["u"] is None
        else:
            assert np.allclose(x["u"], c / np.linalg.norm(c))


def test_neighbour_drive(spark):
    got = {(r["recording"], r["unit"]): (r["drive"], r["n_neighbours"]) for r in Q["neighbor_drive"](spark, SF).collect()}
    from tesselon.operators.connectivity import te_matrix

    want = {}
    for name, g in base.units(spark, SF, "count").toPandas().groupby("recording"):
        g = g.sort_values("unit")
        v, unit = np.stack(g["values"]).astype(float), g["unit"].to_numpy()
        net = te_matrix(v) - te_matrix(v).T
        n = v.shape[1]
        r = []
        for a in range(0, n - base.WIDTH + 1, base.STEP):
            with np.errstate(invalid="ignore", divide="ignore"):
                r.append(np.nan_to_num(np.clip(np.corrcoef(v[:, a : a + base.WIDTH]), -1, 1)))
        mean = np.mean(r, axis=0)
        off = ~np.eye(len(v), dtype=bool)
        p = np.array([normal(np.arctanh(np.clip(x, -0.999999, 0.999999)) * math.sqrt(n - 3)) for x in mean[off]])
        order = np.argsort(p)
        q = np.empty(len(p))
        q[order] = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        near = np.zeros_like(off)
        near[off] = q <= 0.2
        for i in range(len(v)):
            hit = near[i] & ~np.isnan(net[i])
            if hit.any():
                want[name, unit[i]] = (net[i][hit].mean(), hit.sum())
    assert set(got) == set(want)
    for k, (d, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(d, abs=1e-9)


def test_pearson_p(spark, nations):
    for x in Q["pearson_with_p"](spark, SF).collect():
        g = nations[nations["g"] == x["g"]]
        r = np.corrcoef(g["x"], g["y"])[0, 1]
        assert x["r"] == pytest.approx(r) and x["p"] == pytest.approx(tail_of_t(r * math.sqrt((len(g) - 2) / (1 - r * r)), len(g) - 2), rel=1e-4)


def test_partial_correlation_of_several(spark, nations):
    x = Q["partial_corr_many"](spark, SF).first()
    m = np.column_stack([np.ones(25), nations["z"], nations["g"] == 1]).astype(float)
    rest = [v - m @ np.linalg.pinv(m) @ v for v in (nations["x"].to_numpy(), nations["y"].to_numpy())]
    r = np.corrcoef(*rest)[0, 1]
    assert x["n"] == 25 and x["r"] == pytest.approx(r) and x["p"] == pytest.approx(tail_of_t(r * math.sqrt(21 / (1 - r * r)), 21), rel=1e-4)


def test_meta_p(spark):
    x = Q["meta_with_p"](spark, SF).first()
    assert x["p"] == pytest.approx(normal(x["estimate"] / x["se"]), rel=1e-9)
    d = x["k"] - 1
    t = np.linspace(0, x["q"], 400_001)
    density = (t[1:] + t[:-1]) / 2
    below = np.sum(density ** (d / 2 - 1) * np.exp(-density / 2)) * (t[1] - t[0]) / (2 ** (d / 2) * math.gamma(d / 2))
    assert x["q_p"] == pytest.approx(1 - below, abs=2e-3)


def test_division_statistics(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_totalprice", "o_orderstatus", "o_orderpriority").toPandas()
    mean, sd = (o.groupby("o_orderstatus")["o_totalprice"].transform(f) for f in ("mean", lambda v: v.std(ddof=0)))
    o["z"] = np.where(sd > 0, (o["o_totalprice"] - mean) / sd.where(sd > 0, 1), 0.0)
    got = {(r["a"], r["b"]): r for r in Q["division_statistics"](spark, SF).collect()}
    p = {}
    for a, b in itertools.combinations(sorted(o["o_orderpriority"].unique()), 2):
        x, y = (o.loc[o["o_orderpriority"] == k, "z"].to_numpy() for k in (a, b))
        u = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
        both = np.concatenate([x, y])
        n, t = len(both), np.unique(both, return_counts=True)[1].astype(float)
        s = math.sqrt(len(x) * len(y) / 12 * (n + 1 - (t**3 - t).sum() / (n * (n - 1))))
        p[a, b] = normal(max(abs(u - len(x) * len(y) / 2) - 0.5, 0) / s)
        assert got[a, b]["u"] == pytest.approx(u) and got[a, b]["p"] == pytest.approx(p[a, b], rel=1e-6)
    top = 0.0
    for i, k in enumerate(sorted(p, key=lambda k: (p[k], k))):
        top = max(top, min(1.0, (len(p) - i) * p[k]))
        assert got[k]["p_holm"] == pytest.approx(top, rel=1e-6)


def test_exact_tests_equal_enumeration(spark, nations):
    for x in Q["mann_whitney_p"](spark, SF).collect():
        a, b = (nations.loc[nations["g"] == x[k], "x"].to_numpy() for k in "ab")
        both = np.concatenate([a, b])
        r = ranks(both)
        centre = len(a) * len(b) / 2
        gap = abs(r[: len(a)].sum() - len(a) * (len(a) + 1) / 2 - centre)
        every = [abs(sum(c) - len(a) * (len(a) + 1) / 2 - centre) for c in itertools.combinations(r, len(a))]
        assert x["ties"] == 0 and x["p"] == pytest.approx(np.mean(np.array(every) >= gap - 1e-9))
    for x in Q["wilcoxon_p"](spark, SF).collect():
        g = nations[nations["g"] == x["g"]]
        d = (g["x"] - g["y"] / 30).to_numpy()
        r = ranks(np.abs(d))
        gap = abs(r[d > 0].sum() - r.sum() / 2)
        every = [abs(r[np.array(s, bool)].sum() - r.sum() / 2) for s in itertools.product((0, 1), repeat=len(r))]
        assert x["p"] == pytest.approx(np.mean(np.array(every) >= gap - 1e-9))


def test_correlation_summary(spark, nations):
    x = ST.correlation_summary(base.nation_table(spark, SF), "k", "x", "y", 1500, 7).first()
    r = np.random.default_rng(7)
    a, b = nations["x"].to_numpy(), nations["y"].to_numpy()
    boot = [np.corrcoef(a[i], b[i])[0, 1] for m in (1000, 500) for i in r.integers(0, 25, size=(m, 25))]
    null = [np.corrcoef(a, b[r.permutation(25)])[0, 1] for _ in range(1500)]
    obs = np.corrcoef(a, b)[0, 1]
    assert (x["n"], x["r"]) == (25, pytest.approx(obs)) and (x["low"], x["high"]) == (pytest.approx(np.quantile(boot, 0.025)), pytest.approx(np.quantile(boot, 0.975)))
    assert x["p_permutation"] == pytest.approx((1 + np.sum(np.round(np.abs(null), 12) >= round(abs(obs), 12))) / 1501)
    assert ST.correlation_summary(base.nation_table(spark, SF).limit(0), "k", "x", "y", 10, 7).count() == 0


def test_shuffled_folds(spark, nations):
    got = {r["k"]: r["predicted"] for r in Q["cv_residual_shuffled"](spark, SF).collect()}
    order = np.arange(25)
    np.random.RandomState(0).shuffle(order)
    for part in np.array_split(order, 5):
        rest = np.setdiff1d(np.arange(25), part)
        b, a = np.polyfit(nations["x"][rest], nations["y"][rest], 1)
        for k in part:
            assert got[k] == pytest.approx(a + b * nations["x"][k], rel=1e-6)


def test_ward_clusters(spark, nations):
    x = nations[["x", "y", "z"]].to_numpy()
    parts = [[i] for i in range(25)]
    spread = lambda p: ((x[p] - x[p].mean(axis=0)) ** 2).sum()
    while len(parts) > 3:
        i, j = min(itertools.combinations(range(len(parts)), 2), key=lambda c: spread(parts[c[0]] + parts[c[1]]) - spread(parts[c[0]]) - spread(parts[c[1]]))
        parts[i] = parts[i] + parts.pop(j)
    got = Q["ward_clusters"](spark, SF).toPandas()
    assert {frozenset(g["k"]) for _, g in got.groupby("cluster")} == {frozenset(p) for p in parts}
    assert sorted(got["leaf"]) == list(range(25)) and all(np.ptp(g["leaf"]) == len(g) - 1 for _, g in got.groupby("cluster"))


def q_of(graph, label):
    m2 = 2 * graph["w"].sum()
    ends = pd.concat([graph[["src", "w"]].rename(columns={"src": "n"}), graph[["dst", "w"]].rename(columns={"dst": "n"})])
    degree = ends.groupby(ends["n"].map(label))["w"].sum()
    inside = 2 * graph.loc[graph["src"].map(label).to_numpy() == graph["dst"].map(label).to_numpy(), "w"].sum()
    return inside / m2 - ((degree / m2) ** 2).sum()


def test_communities_and_their_modularity(spark, graph):
    label = {r["node"]: r["community"] for r in Q["communities"](spark, SF).collect()}
    x = Q["community_summary"](spark, SF).first()
    q = q_of(graph, label)
    assert x["n_communities"] == len(set(label.values())) and x["q"] == pytest.approx(q, abs=1e-6) and q > 0
    for n in label:  # no node is better off elsewhere
        for c in set(label.values()):
            assert q_of(graph, {**label, n: c}) <= q + 1e-9
    e = base.cell_edges(spark, SF).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w")).toPandas()
    region = {r["n_nationkey"]: r["n_regionkey"] for r in spark.read.parquet(f"{SF}/nation.parquet").collect()}
    e["a"], e["b"] = e["src"].map(region), e["dst"].map(region)
    inner = e[e["a"] == e["b"]].rename(columns={"a": "region"})
    labels = G.communities(spark.createDataFrame(inner[["region", "src", "dst", "w"]].astype({"region": "int64", "w": float})), ["region"]).toPandas()
    for x in Q["region_modularity"](spark, SF).collect():
        own = labels[labels["region"] == x["region"]].set_index("node")["community"].to_dict()
        assert x["n_communities"] == len(set(own.values())) and x["q"] == pytest.approx(q_of(inner[inner["region"] == x["region"]], own), abs=1e-6)


@pytest.mark.parametrize("name", ["maxent_null", "maxent_null_pairs"])
def test_null_keeps_margins(spark, graph, name):
    got = Q[name](spark, SF).where("draw < 3").toPandas()
    region = {**dict(zip(graph["src"], graph["src_region"], strict=True)), **dict(zip(graph["dst"], graph["dst_region"], strict=True))}
    a, b = (graph.groupby(c)["w"].sum() for c in ("src", "dst"))
    pairs = graph.groupby(["src_region", "dst_region"])["w"].sum()
    every = {(i, j) for i in a.index for j in b.index if region[i] != region[j] and (name == "maxent_null" or (region[i], region[j]) in pairs.index)}
    for _, g in got.groupby("draw"):
        assert set(zip(g["src"], g["dst"], strict=True)) == every
        assert np.allclose(g.groupby("dst")["w"].sum(), b, rtol=0.02) and np.allclose(g.groupby("src")["w"].sum(), a, rtol=0.02)
        if name != "maxent_null":
            assert np.allclose(g.groupby([g["src"].map(region), g["dst"].map(region)])["w"].sum(), pairs)
    assert got.groupby("draw")["w"].first().nunique() == 3


def test_tree_distances(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice").toPandas()
    weight = {(k % 10, k // 10): w for k, w in zip(o["o_orderkey"], o["o_totalprice"], strict=True) if k // 10 > 0}
    want = {}
    for block in range(10):
        known = {b for x, b in weight if x == block}
        for n in known | {b // 2 for b in known} | {0}:
            d, at = 0.0, n
            while at and d < math.inf:
                d, at = d + weight.get((block, at), math.inf), at // 2
            want[block, n] = d
    got = {(r["block"], r["node"]): r["distance"] for r in Q["dijkstra_skeleton"](spark, SF).collect()}
    roots = {k for k in want if k[0] in {x for x, _ in weight}}
    assert set(got) == roots and all(got[k] == pytest.approx(want[k]) for k in got)


def test_kmeans_units_are_nearest(spark):
    got = Q["kmeans_units"](spark, SF).toPandas()
    e = base.points(spark, SF).toPandas().set_index("id")[["x", "y", "z"]]
    for _, g in got.groupby("block"):
        x, label = e.loc[g["id"]].to_numpy(), g["unit"].to_numpy()
        centre = np.stack([x[label == k].mean(axis=0) for k in np.unique(label)])
        d = ((x[:, None] - centre) ** 2).sum(axis=2)
        own = d[np.arange(len(x)), np.searchsorted(np.unique(label), label)]
        assert np.all(own <= d.min(axis=1) + 1e-4) and g["inertia"].iloc[0] == pytest.approx(own.sum())


def test_sine_removed_is_orthogonal(spark):
    r = np.random.default_rng(2)
    t = 2 * np.pi * 0.1 * 0.5 * np.arange(60)
    x = r.standard_normal(60) + 3 * np.sin(t) - 2 * np.cos(t) + 5
    got = S.sine_removed(spark.createDataFrame([(0, x.tolist())], "k int, values array<double>"), ["k"], 0.1, 0.5).first()["values"]
    m = np.stack([np.sin(t), np.cos(t), np.ones(60)], axis=1)
    assert np.allclose(got, x - m @ np.linalg.pinv(m) @ x) and np.allclose(m.T @ np.array(got), 0, atol=1e-8)


def test_sweep_and_potentials_equal_numpy(spark):
    p = M.Layers()
    rows = M.sweep(spark, [0.0, 1.0], 2, 1500).toPandas()
    seeds = [int(c.generate_state(1)[0]) for c in np.random.SeedSequence(3526228248).spawn(4)]
    for i, (e, r) in enumerate(itertools.product((0.0, 1.0), range(2))):
        means = M.layer_means(p, M.simulate(p, e, [seeds[i]], 1500)[1])[0]
        c = np.stack([np.corrcoef(means[a : a + 600].T) for a in range(0, 901, 300)])
        for k in range(4):
            others = np.delete(c[:, k], k, axis=1)
            x = rows[(rows["epsilon"] == e) & (rows["run"] == r) & (rows["layer"] == k + 1)].iloc[0]
            assert x["fcv"] == pytest.approx(others.mean(axis=1).std()) and x["mean_fc"] == pytest.approx(others.mean())
    states = M.layer_states(spark, [0.0, 1.0], 3, 6000)
    pd_states = states.toPandas()
    curves = M.potential_curves(states, ["epsilon", "layer"], "run", "state", 30, 50).toPandas()
    kernel = np.exp(-0.5 * (np.arange(-3, 4) / 1.2) ** 2)
    kernel /= kernel.sum()
    assert len(curves) == 2 * 4 * 3 * 50
    for (e, layer), g in pd_states.groupby(["epsilon", "layer"]):
        lo, hi = np.percentile(g["state"], [0.1, 99.9])
        edges = np.linspace(lo - 0.25 * (hi - lo), hi + 0.25 * (hi - lo), 31)
        for run, v in g.groupby("run")["state"]:
            u = -np.log(np.maximum(np.convolve(np.histogram(v, edges, density=True)[0], kernel, "same"), 1e-9))
            x = np.linspace(edges[0], edges[-1], 50)
            want = np.interp(x, (edges[1:] + edges[:-1]) / 2, u, left=np.nan, right=np.nan)
            got = curves[(curves["epsilon"] == e) & (curves["layer"] == layer) & (curves["run"] == run)].sort_values("point")
            assert np.allclose(got["x"], x) and np.allclose(got["u"].to_numpy(float), want - np.nanmin(want), equal_nan=True, atol=1e-6)


def test_reproducibility_of_subsets(spark):
    from tesselon.operators.structure import covering_draws

    e = base.cell_edges(spark, SF).toPandas()
    counts = e.groupby([e["block"] % 40, "src"]).size().unstack(fill_value=0)
    members = {int(b): set(counts.columns[counts.loc[b] > 0]) for b in counts.index}
    full = counts.sum()
    got = {round(r["fraction"], 1): r for r in Q["subsample_reproducibility"](spark, SF).collect()}
    assert set(got) == {k / 10 for k in range(1, 10)}
    for f in (0.3, 0.8):
        picks = pd.DataFrame(covering_draws(members, f, 200, 20260727), columns=["draw", "block"])
        r = [np.corrcoef(counts.loc[g["block"]].sum(), full)[0, 1] for _, g in picks.groupby("draw")]
        assert got[f]["n_draws"] == 200 and got[f]["mean"] == pytest.approx(np.mean(r)) and got[f]["low"] == pytest.approx(np.quantile(r, 0.025))


def test_calibration_search_equals_plain_loops(spark):
    pts = base.points(spark, SF).toPandas()
    at, block = pts[["x", "y", "z"]].to_numpy(), pts["block"].to_numpy()
    names = np.unique(block)
    target = pts.groupby("block")["x"].mean()

    def strength(scale, shift):
        moved = at[:, [1, 0, 2]] * scale + shift
        near = ((moved[:, None] - at[None]) ** 2).sum(axis=2) < 0.02
        n = np.array([[near[np.ix_(block == b, block == r)].sum() for r in names] for b in names], float)
        counts = n.T @ n
        both = counts + counts.T
        sizes = np.array([(block == r).sum() for r in names])
        logs = np.log1p(both / np.outer(sizes, sizes))
        return (logs.sum(axis=1) - np.diag(logs)) / (len(names) - 1)

    rows = sorted(Q["calibration_search"](spark, SF).collect(), key=lambda r: r["setting"])
    assert [r["stage"] for r in rows] == ["coarse"] * 25 + ["refine"] * 16
    assert rows[0]["parameters"] == [1.0, 0.0]
    for r in rows:
        want = np.corrcoef(ranks(np.round(strength(*r["parameters"]), 12)), ranks(target.loc[names].to_numpy()))[0, 1]
        assert r["rho"] == pytest.approx(want, abs=1e-9)
    best = max(rows[:25], key=lambda r: (r["rho"], -r["setting"]))["parameters"]
    assert all(abs(r["parameters"][0] - best[0]) <= 0.075 and abs(r["parameters"][1] - best[1]) <= 0.0125 for r in rows[25:])
