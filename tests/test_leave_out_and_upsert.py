"""Leave-out correlations, nearest vertices and upserts against plain code."""

from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from tesselon.operators import relational as R
from tesselon.operators import spatial as P
from tesselon.operators import stats as ST
from tesselon.sources import tables as T


@pytest.fixture(scope="module")
def measures(spark):
    """Regions and subjects with several, one or no rows, and missing values."""
    r = np.random.default_rng(6)
    rows = [(f"s{s}", f"r{g}", float(r.normal(1000, 5)), float(r.normal())) for s in range(5) for g in range(9) for _ in range(r.integers(0, 3))]
    rows = [(s, g, None if i % 11 == 0 else x, y) for i, (s, g, x, y) in enumerate(rows)] + [("s2", "only", 1000.0, 0.5)]
    return pd.DataFrame(rows, columns=["s", "g", "x", "y"]), spark.createDataFrame(rows, "s string, g string, x double, y double")


def expected(df, subject=None, regions=()):
    m = df[(df["s"] != subject) & ~df["g"].isin(regions)].groupby("g")[["x", "y"]].mean().dropna()
    return len(m), (np.corrcoef(m["x"], m["y"])[0, 1] if len(m) >= 4 else None)


def same(got, want):
    assert got["n"] == want[0] and (got["r"] is None if want[1] is None else got["r"] == pytest.approx(want[1], abs=1e-9))


def test_leave_one_out_equals_plain_code(measures):
    pdf, df = measures
    got = {r["omitted"]: r for r in ST.leave_one_out(df, "s", "g", "x", "y").collect()}
    assert set(got) == {"none", *pdf["s"]}
    for name, r in got.items():
        same(r, expected(pdf, name))


def test_two_way_subsampling_equals_plain_code(spark, measures):
    pdf, df = measures
    r = np.random.default_rng(1)
    drops = {d: (f"s{d % 6}" if d else None, [*r.choice(sorted(set(pdf["g"])), d % 7, replace=False)]) for d in range(30)}  # s5 has no rows
    rows = [(d, "subject", s) for d, (s, _) in drops.items() if s] + [(d, "region", str(g)) for d, (_, gs) in drops.items() for g in gs] + [(0, "region", "nowhere")]
    got = {x["draw"]: x for x in ST.two_way_subsample(df, spark.createDataFrame(rows, "draw int, what string, dropped string"), "s", "g", "x", "y").collect()}
    assert set(got) == set(drops)
    for d, x in got.items():
        same(x, expected(pdf, *drops[d]))
    with pytest.raises(R.CheckFailed):
        ST.two_way_subsample(df, spark.createDataFrame([(1, "subject", "a"), (1, "subject", "b")], "draw int, what string, dropped string"), "s", "g", "x", "y")


def test_nearest_vertices_equal_plain_code(spark):
    r = np.random.default_rng(3)
    v = [(b, i, *map(float, r.normal(0, 1, 3))) for b in (0, 1) for i in range(60)] + [(0, 900, 50.0, 0.0, 0.0), (0, 901, 50.0, 0.0, 0.0), (3, 1, 0.0, 0.0, 0.0)]
    p = [(b, i, *map(float, r.normal(0, 1, 3))) for b in (0, 1, 2) for i in range(40)] + [(0, 500, 49.0, 0.0, 0.0), (0, 501, -300.0, 4.0, 9.0), (0, 502, None, 0.0, 0.0), (1, 503, float("nan"), 0.0, 0.0)]
    got = {(x["block"], x["point"]): x for x in P.nearest_vertex(spark.createDataFrame(p, "block int, point int, x double, y double, z double"), spark.createDataFrame(v, "block int, vertex int, x double, y double, z double"), ["block"]).collect()}
    want = {}
    for b, i, x, y, z in p:
        near = sorted(((x - q[2]) ** 2 + (y - q[3]) ** 2 + (2 * z - 2 * q[4]) ** 2, q[1]) for q in v if q[0] == b and x is not None and x == x)
        if near:
            want[b, i] = near[0]
    assert set(got) == set(want)
    assert all(got[k]["vertex"] == w[1] and got[k]["d2"] == pytest.approx(w[0]) for k, w in want.items())
    empty = spark.createDataFrame([], "block int, vertex int, x double, y double, z double")
    assert P.nearest_vertex(spark.createDataFrame(p, "block int, point int, x double, y double, z double"), empty, ["block"]).collect() == []


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*")}


def test_upsert_replaces_only_touched_partitions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "p string, k int, v int")
    T.upsert_table(spark, path, rows(("a", 1, 1), ("a", 2, 2), ("b", 1, 3)), ["p", "k"], "p")
    before = files(path)
    T.upsert_table(spark, path, rows(("a", 2, 20), ("c", 9, 9)), ["p", "k"], "p")
    read = lambda: sorted((r["p"], r["k"], r["v"]) for r in spark.read.parquet(path).collect())
    want = [("a", 1, 1), ("a", 2, 20), ("b", 1, 3), ("c", 9, 9)]
    assert read() == want
    after = files(path)
    assert {k: t for k, t in before.items() if k.startswith("p=b")} == {k: t for k, t in after.items() if k.startswith("p=b")}
    # a run that fails leaves the table as it was
    with pytest.raises(Exception, match="a key is missing"):
        T.upsert_table(spark, path, rows(("a", None, 7), ("b", 1, 7)), ["p", "k"], "p")
    with pytest.raises(R.CheckFailed):
        T.upsert_table(spark, path, rows(("a", 1, 7), ("a", 1, 8)), ["p", "k"], "p")
    late = rows(("b", 1, 5), ("a", 1, 5)).selectExpr("p", "k", "v")
    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        m.setattr(R, "upsert", lambda old, new, keys: new.selectExpr("p", "k", "CASE WHEN p = 'b' THEN raise_error('lost') ELSE v END AS v"))
        T.upsert_table(spark, path, late, ["p", "k"], "p")
    assert read() == want and files(path) == after
    with pytest.raises(R.CheckFailed):
        T.upsert_table(spark, path, late, ["k"], "p")


def test_joins_refuse_missing_keys(spark):
    a = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, x double")
    b = spark.createDataFrame([(1, 5.0)], "k int, y double")
    nan = spark.createDataFrame([(float("nan"), 1.0)], "k double, x double")
    for run in (lambda: R.join_checked(a, b, ["k"]), lambda: R.outer_with_source(b, a, ["k"]), lambda: R.outer_zero_filled(a, b, ["k"]), lambda: R.with_keys(nan, ["k"])):
        with pytest.raises(Exception, match="a key is missing"):
            run().collect()
    assert R.join_checked(a.dropna(), b, ["k"]).collect() == [(1, 1.0, 5.0)]


def test_mann_whitney_over_slices_equals_plain_code(spark):
    r = np.random.default_rng(5)
    rows = [(f"g{g}", float(x)) for g, n in enumerate((30, 7, 50, 1)) for x in np.round(r.normal(g / 4, 1, n), 1)] + [("far", 99.0), ("far", 98.0), ("g0", None), (None, 1.0)]
    got = {(x["a"], x["b"]): x for x in ST.mann_whitney(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", "g").collect()}
    by = {}
    for g, v in rows:
        if g is not None and v is not None:
            by.setdefault(g, []).append(v)
    assert set(got) == {(a, b) for a in by for b in by if a < b}
    for (a, b), x in got.items():
        both = by[a] + by[b]
        u = sum((p > q) + (p == q) / 2 for p in by[a] for q in by[b])
        ties = sum(n**3 - n for n in (both.count(v) for v in set(both)))
        assert (x["na"], x["nb"], x["u"], x["ties"]) == (len(by[a]), len(by[b]), u, ties)
        n, gap = len(both), u - len(by[a]) * len(by[b]) / 2
        sd = (len(by[a]) * len(by[b]) / 12 * (n + 1 - ties / (n * (n - 1)))) ** 0.5
        assert x["z"] == pytest.approx(np.sign(gap) * max(abs(gap) - 0.5, 0) / sd)
