"""Kernels against plain numpy and by their invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesselon.functions import scalars as X
from tesselon.functions import special
from tesselon.operators import connectivity as C
from tesselon.operators import graph as G
from tesselon.operators import relational as R
from tesselon.operators import sequence as S
from tesselon.operators import simulator as M
from tesselon.operators import spatial as P
from tesselon.operators import stats as ST


def test_special_values():
    assert special.norm_sf(1.959963984540054) == pytest.approx(0.025, abs=1e-12)
    assert float(special.norm_ppf(0.975)) == pytest.approx(1.959963984540054, abs=1e-9)
    assert special.t_two_sided([2.228138851964939], [10])[0] == pytest.approx(0.05, abs=1e-10)
    assert special.chi2_sf([3.841458820694124], [1])[0] == pytest.approx(0.05, abs=1e-10)
    assert math.isnan(special.r_two_sided([np.nan], [10])[0])
    assert special.r_two_sided([1.0], [10])[0] == 0


def test_fc_measures_of_random_traces(spark):
    x = np.random.default_rng(4).standard_normal((6, 120))
    units = spark.createDataFrame([("a", i, x[i].tolist()) for i in range(6)], "recording string, unit long, values array<double>")
    p = C.window_correlation(units, 20, 5)
    assert p.select("win").distinct().count() == 21
    got = {r["unit"]: r["fcv"] for r in C.variability(p).collect()}
    r = np.stack([np.corrcoef(x[:, a : a + 20]) for a in range(0, 101, 5)])
    want = r.std(axis=0)
    for i in range(6):
        assert got[i] == pytest.approx((want[i].sum() - want[i, i]) / 5, abs=1e-12)
    d = {r_["unit"]: r_["distance"] for r_ in C.profile_distance(p).collect()}
    mean = r.mean(axis=0)
    for i in range(6):
        o = [j for j in range(6) if j != i]
        assert d[i] == pytest.approx(np.mean([1 - np.corrcoef(w[i, o], mean[i, o])[0, 1] for w in r]), abs=1e-12)


def test_constant_series_have_no_correlation(spark):
    units = spark.createDataFrame([("a", 0, [1.0] * 30), ("a", 1, [float(i % 7) for i in range(30)])], "recording string, unit long, values array<double>")
    assert [r["r"] for r in C.window_correlation(units, 20, 5).collect()] == [None] * 3


def test_transfer_entropy_of_a_copied_series(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 4, 400)
    y = np.concatenate([[0], x[:-1]])
    rows = [("a", u, i, int(v)) for u, s in ((0, x), (1, y)) for i, v in enumerate(s)]
    te = {(t["source"], t["target"]): t["te"] for t in C.transfer_entropy(spark.createDataFrame(rows, "recording string, unit long, frame int, state long")).collect()}

    def h(*cols):
        n = np.unique(np.stack(cols), axis=1, return_counts=True)[1] / len(cols[0])
        return -(n * np.log2(n)).sum()

    want = h(y[1:], y[:-1]) - h(y[:-1]) - h(y[1:], y[:-1], x[:-1]) + h(y[:-1], x[:-1])
    assert te[0, 1] == pytest.approx(want, abs=1e-10)
    assert te[0, 1] > 1.5 > te[1, 0]


def test_transfer_entropy_forms_agree(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 9, (5, 60)).astype(float)
    x[3] = 1.0  # constant: takes no part
    units = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(x)], "recording string, unit long, values array<double>")
    key = lambda rows: {(t["source"], t["target"]): round(t["te"], 10) for t in rows}
    a = key(C.transfer_entropy_arrays(units, ["recording"]).collect())
    b = key(C.transfer_entropy(C.quantile_bins(S.rows(units, ["recording", "unit"]), ["recording", "unit"])).collect())
    assert a == b and len(a) == 12


def test_rank1_is_the_leading_singular_pair(spark):
    a = np.array([[0, 2, 1, 0], [0, 0, 3, 1], [1, 0, 0, 2], [0, 1, 1, 0]], float)
    u, _, v = np.linalg.svd(a)
    out, into, _, _ = G.rank1(a, 1000, 1e-12)
    assert np.allclose(out, np.abs(u[:, 0]), atol=1e-9) and np.allclose(into, np.abs(v[0]), atol=1e-9)
    cycle = G.rank1(np.roll(np.eye(3), 1, axis=1))
    assert np.linalg.norm(cycle[0]) == pytest.approx(1) and np.linalg.norm(cycle[1]) == pytest.approx(1)
    assert np.isnan(G.rank1(np.zeros((2, 2)))[0]).all()
    assert np.isfinite(G.rank1(np.zeros((2, 2)), on_zero="stop")[0]).all()
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(4) if a[i, j]], "src long, dst long, w double")
    got = {r["node"]: r for r in G.rank1_distributed(e, 40).collect()}
    assert [got[i]["c_out"] for i in range(4)] == pytest.approx(out.tolist(), abs=1e-6)
    assert [got[i]["c_in"] for i in range(4)] == pytest.approx(into.tolist(), abs=1e-6)
    assert G.rank1_distributed(e.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.booleans(), st.booleans()), min_size=1, max_size=14, unique_by=lambda x: x[:2]))
def test_block_overwrite_equals_the_loop(spark, members):
    edges = set()
    for b in sorted({m[0] for m in members}):
        cells = {m[1]: m for m in members if m[0] == b}
        edges -= {(u, v) for u in cells for v in cells}
        edges |= {(u, v) for u in cells for v in cells if u != v and cells[u][2] and cells[v][3]}
    got = G.block_overwrite(spark.createDataFrame(members, "block int, cell int, is_source boolean, is_target boolean"))
    assert {(r["src"], r["dst"]) for r in got.collect()} == edges


def test_two_means_split(spark):
    rows = [(0, i, v) for i, v in enumerate([1.0, 1.1, 0.9, 5.0, 5.2, None])] + [(1, 10, 3.0)] + [(2, 20 + i, 2.0) for i in range(4)]
    got = {r["id"]: r["low_group"] for r in G.split_two_means(spark.createDataFrame(rows, "b int, id int, v double"), ["b"], "v", ["id"]).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 10: True, 20: True, 21: True, 22: False, 23: False}


def test_graph_kernels(spark):
    seg = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 3, 2.0), (0, 1, 3, 9.0), (0, 7, 8, 1.0)], "block int, a long, b long, w double")
    src = spark.createDataFrame([(0, 1)], "block int, node long")
    assert {r["node"]: r["distance"] for r in G.shortest_paths(seg, src, ["block"]).collect()} == {1: 0, 2: 1, 3: 3, 7: math.inf, 8: math.inf}
    two = [(0, a, b, 1.0) for base in (0, 10) for a in range(base, base + 4) for b in range(base, base + 4) if a != b] + [(0, 0, 10, 0.1)]
    c = {r["node"]: r["community"] for r in G.communities(spark.createDataFrame(two, "g int, src long, dst long, w double"), ["g"]).collect()}
    assert len({c[i] for i in range(4)}) == 1 and len({c[i] for i in range(10, 14)}) == 1 and c[0] != c[10]
    nodes = spark.createDataFrame([(i, i) for i in range(4)], "node long, region int")
    n = G.maximum_entropy_null(spark.createDataFrame([(0, i, j, float(i + j + 1)) for i in range(4) for j in range(4) if i != j], "g int, src long, dst long, w double"), nodes, ["g"], 400).toPandas()
    assert n["margin_error"].max() < 1e-6
    k = G.kmeans_units(spark.createDataFrame([(0, i, [float(i // 50), 0.0]) for i in range(100)], "g int, id long, v array<double>"), ["g"], "v", 40).toPandas()
    assert k["unit"].nunique() == 2 and k["inertia"].iloc[0] == pytest.approx(0)


def test_jacobian_and_simulation(spark):
    j = M.jacobian(M.Layers(), 0.5)
    assert j.shape == (14, 14) and M.spectrum(j)[0] < 0
    assert M.spectrum(M.jacobian(M.Layers(), 0.0))[1] == pytest.approx(0, abs=1e-9)
    s = M.sweep(spark, [0.0, 0.5], 2, 1500).toPandas()
    assert len(s) == 16 and np.isfinite(s["fcv"]).all()


def test_highpass_keeps_fast_and_drops_slow():
    t = np.arange(400) / 2.0
    slow, fast = np.sin(2 * np.pi * 0.002 * t), np.sin(2 * np.pi * 0.3 * t)
    y = S.highpass_array(slow + fast, 0.03, 2.0)
    assert np.abs(y[50:-50] - fast[50:-50]).max() < 0.05
    assert np.allclose(S.highpass_array(np.ones(100), 0.03, 2.0), 0, atol=1e-9)
    assert np.allclose(S.highpass_array(fast, 0.0, 2.0), fast)


def test_sequences(spark):
    a = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0, 5.0])], "k int, values array<double>")
    assert a.select(S.boxcar("values", 3).alias("v")).first()["v"] == pytest.approx([1, 2, 3, 4, 3])
    assert S.rolled(a, F.lit(2)).first()["values"] == [4, 5, 1, 2, 3]
    assert [r["window"] for r in S.sliding(a, ["k"], 3, 2).orderBy("win").collect()] == [[1, 2, 3], [3, 4, 5]]
    assert S.sliding(a, ["k"], 9, 2).count() == 0
    long = spark.createDataFrame([(i, i) for i in range(30)], "frame int, v int")
    assert S.windows_of_frames(long, 20, 5, 30).groupBy("win").count().orderBy("win").collect() == [(0, 20), (1, 20), (2, 20)]
    flat = spark.createDataFrame([(0, 2.0), (0, 2.0), (0, None)], "g int, x double")
    assert [r["z"] for r in S.zscore(flat, "x", ["g"], 0, "zero", "z").orderBy(F.col("x").desc_nulls_last()).collect()] == [0, 0, None]
    assert [r["z"] for r in S.zscore(flat, "x", ["g"], 0, "null", "z").collect()] == [None] * 3
    with pytest.raises(Exception, match="constant"):
        S.zscore(flat, "x", ["g"], 0, "raise", "z").collect()


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("inf"), 2.0), (3.0, 0.0)], "a double, b double")
    c = df.select(X.clean("a").alias("a"), X.clean("b").alias("b"))
    assert [tuple(r) for r in c.collect()] == [(1.0, None), (None, 2.0), (3.0, 0.0)]
    assert [r[0] for r in c.select(X.divide("a", "b")).collect()] == [None, None, None]
    assert c.select(X.share(F.col("b") > 0)).first()[0] == pytest.approx(1 / 3)
    assert c.where(X.complete("a", "b")).count() == 1


def test_guards_and_joins(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0), (1, 5.0), (3, 1.0)], "k int, v double")
    with pytest.raises(R.CheckFailed):
        R.join_checked(a, b.withColumnRenamed("v", "w"), ["k"])
    with pytest.raises(R.CheckFailed):
        R.require_columns(a, ["k", "zz"])
    with pytest.raises(R.CheckFailed):
        R.require_rows(a, 3)
    assert R.compare(a, a, ["k"]).count() == 0
    nan = spark.createDataFrame([(1, float("nan"))], "k int, v double")
    assert R.compare(nan, nan, ["k"]).count() == 0
    assert {tuple(r) for r in R.upsert(a, spark.createDataFrame([(2, 9.0), (4, 1.0)], "k int, v double"), ["k"]).collect()} == {(1, 2.0), (2, 9.0), (4, 1.0)}


@pytest.mark.parametrize("block", [64, 100_000])
def test_near_counts_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(P, "LEFT_BLOCK", block)
    monkeypatch.setattr(P, "RIGHT_BLOCK", block)
    r = np.random.default_rng(5)
    at = np.concatenate([r.normal(0, 0.2, (400, 3)), np.repeat([[0.1, 0.0, 0.2]], 150, axis=0), r.integers(-4, 5, (150, 3)) / 8, [[30.0, 1.0, 2.0]]])  # copies, distances of just the radius, one far away
    of = r.integers(0, 4, len(at))
    rows = [(int(k), *map(float, p)) for k, p in zip(of, at, strict=True)]
    df = spark.createDataFrame([*rows, (None, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (1, 0.0, float("inf"), 0.0)], "of long, x double, y double, z double")
    maps = {0: [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]], 7: [[0.0, 0.8, 0.0, 0.05], [0.8, 0.0, 0.1, 0.0], [0.0, 0.0, 1.2, -0.3]]}
    got = {(x["map"], x["a"], x["b"]): x["n"] for x in P.near_counts(df, df, "of", "of", 0.0625, maps).collect()}
    want = {}
    for k, m in maps.items():
        x, y, z = at.T
        moved = np.column_stack([x * c[0] + y * c[1] + z * c[2] + c[3] for c in m])
        d = moved[:, None] - at[None]
        near = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] < 0.0625
        want |= {(k, a, b): n for a in range(4) for b in range(4) if (n := int(near[np.ix_(of == a, of == b)].sum()))}
    assert got == want


@pytest.mark.parametrize(("block", "by"), [(50, []), (100_000, []), (50, ["g"])])
def test_nearest_join_equals_all_pairs_in_blocks(spark, monkeypatch, block, by):
    monkeypatch.setattr(P, "LEFT_BLOCK", block)
    monkeypatch.setattr(P, "RIGHT_BLOCK", block)
    monkeypatch.setattr(P, "radius_join", None)  # no pairs
    r = np.random.default_rng(6)
    at = np.concatenate([r.normal(0, 0.2, (300, 3)), np.repeat([[0.1, 0.0, 0.2]], 120, axis=0), r.integers(-4, 5, (200, 3)) / 8, [[9.0, 9.0, 9.0]]])[r.permutation(621)]
    side, g = r.integers(0, 2, len(at)), r.integers(0, 2, len(at))
    df = spark.createDataFrame([(i, int(s), int(k), *map(float, p)) for i, (s, k, p) in enumerate(zip(side, g, at, strict=True))] + [(9999, 0, 0, None, 1.0, 1.0)], "id long, side int, g int, x double, y double, z double")
    got = {x["a_id"]: (x["b_id"], x["d2"]) for x in P.nearest_join(df.where("side = 0"), df.where("side = 1"), "id", "id", 0.0625, by).collect()}
    want = {}
    for i in np.flatnonzero(side == 0):
        d = at[i] - at
        d = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        d[(side == 0) | (bool(by) & (g != g[i]))] = np.inf
        if d.min() < 0.0625:
            want[int(i)] = (int(d.argmin()), float(d.min()))
    assert got == want


def test_radius_join_is_strict(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 2.0, 0.0, 0.0), (2, -1.5, 0.0, 0.5)], "id int, x double, y double, z double")
    assert {(r["a_id"], r["b_id"]) for r in P.radius_join(p, p, "id", "id", 4.0).where("a_id < b_id").collect()} == {(0, 2)}
    assert {(r["a_id"], r["b_id"]) for r in P.radius_join(p, p, "id", "id", 4.0, strict=False).where("a_id < b_id").collect()} == {(0, 1), (0, 2)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(0.001, 0.999), min_size=1, max_size=12))
def test_corrections(spark, p):
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    m, order = len(p), np.argsort(p, kind="stable")
    holm, bh = np.empty(m), np.empty(m)
    top = 0
    for i, at in enumerate(order):
        top = max(top, (m - i) * p[at])
        holm[at] = min(1, top)
    low = 1.0
    for i in range(m - 1, -1, -1):
        low = min(low, p[order[i]] * m / (i + 1))
        bh[order[i]] = low
    assert [r["p_holm"] for r in C.holm(df, "p", [], ["k"]).orderBy("k").collect()] == pytest.approx(holm.tolist())
    assert [r["q"] for r in C.benjamini_hochberg(df, "p", []).orderBy("k").collect()] == pytest.approx(bh.tolist())


def test_partial_correlation_forms_agree(spark):
    r = np.random.default_rng(0)
    c = r.standard_normal(40)
    rows = [(0, float(c[i] + a), float(c[i] - b), float(c[i])) for i, (a, b) in enumerate(r.standard_normal((40, 2)))]
    df = spark.createDataFrame(rows, "g int, x double, y double, c double")
    one = ST.partial_correlation(df, "x", "y", "c", ["g"]).first()["r"]
    many = ST.partial_correlation_many(df, "x", "y", ["c"], ["g"]).first()
    assert one == pytest.approx(many["r"], abs=1e-12) and 0 < many["p"] < 1


def test_ward_three_groups(spark):
    rows = [(0, i, float(i // 3 * 10 + i % 3), 0.0) for i in range(9)]
    got = ST.ward(spark.createDataFrame(rows, "g int, k int, x double, y double"), ["g"], "k", ["x", "y"], 3).toPandas().sort_values("k")
    assert got["cluster"].tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2] and sorted(got["leaf"]) == list(range(9))


def test_numpy_draws_are_reproducible():
    assert (ST.numpy_draws(10, 3, 0) == ST.numpy_draws(10, 3, 0)).all()
    d = ST.subsample_draws(["a", "b"], list(range(10)), 4, 0.2, 12)
    assert len(d) == 4 * 3 and d == ST.subsample_draws(["a", "b"], list(range(10)), 4, 0.2, 12)


def test_pandas_keyed_random_effects(spark):
    z = pd.DataFrame({"z": [0.1, 0.3, 0.5], "var": [0.01, 0.02, 0.01]})
    got = ST.with_random_effects_p(ST.random_effects(spark.createDataFrame(z))).first()
    w = 1 / z["var"]
    q = (w * (z["z"] - (w * z["z"]).sum() / w.sum()) ** 2).sum()
    assert got["q"] == pytest.approx(q) and 0 < got["p"] < 1 and 0 < got["q_p"] < 1


def test_exact_rank_tests_by_enumeration():
    from itertools import combinations, product

    na, nb = 4, 5
    us = [sum(c) + na - na * (na + 1) / 2 for c in combinations(range(na + nb), na)]
    for u in (0, 3, 10, 14):
        high = max(u, na * nb - u)
        assert ST.exact_mann_whitney_p(u, na, nb) == pytest.approx(min(1, 2 * np.mean([x >= high for x in us])))
    ws = [sum(i + 1 for i, s in enumerate(signs) if s) for signs in product([0, 1], repeat=6)]
    for w in (0, 5, 10):
        assert ST.exact_wilcoxon_p(w, 6) == pytest.approx(min(1, 2 * np.mean([x >= max(w, 21 - w) for x in ws])))


def test_structure_controls():
    from tesselon.operators import structure as Z

    folds = Z.shuffled_folds(42)
    assert sorted(np.bincount(folds)) == [8, 8, 8, 9, 9] and folds == Z.shuffled_folds(42)
    d = Z.covering_draws({1: {1}, 2: {2}, 3: {1, 2}}, 0.34, 5, 0)
    assert d == [(i, 3) for i in range(5)]
    with pytest.raises(R.CheckFailed):
        Z.covering_draws({1: {1}, 2: {2}}, 0.5, 1, 0, tries=5)
    s = Z.search_settings([1.0, 2.0], [0.1, 0.2], 4, 3)
    assert len(s) == 5 and s[0] == [1.0, 2.0] and all(abs(x[1] - 2) <= 0.2 for x in s)
