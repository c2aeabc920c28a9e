"""Graph operators through joins equal those by tasks, and plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.operators import graph as G


@pytest.fixture(scope="module")
def many(spark):
    """Five graphs: two of random edges, a cycle, one edge, and one without weight."""
    r = np.random.default_rng(4)
    rows = [(g, int(a), int(b), float(r.integers(1, 9))) for g, n in (("p", 12), ("q", 30)) for a in range(n) for b in range(n) if a != b and r.random() < 0.3]
    rows += [("cycle", i, (i + 1) % 4, 1.0) for i in range(4)] + [("edge", 5, 9, 2.0), ("none", 1, 2, 0.0), ("none", 2, 3, 0.0)]
    return spark.createDataFrame(rows, "g string, src long, dst long, w double")


@pytest.mark.parametrize("on_zero", ["nan", "skip", "stop"])
def test_rank1_of_many_graphs_by_joins(many, on_zero):
    key = lambda df: {(r["g"], r["node"]): r for r in df.collect()}
    many = many if on_zero == "stop" else many.where("g NOT IN ('p', 'q')")
    by_task = key(G.rank1_by_group(many, ["g"], 200, 1e-8, on_zero))
    joined = key(G.rank1_by_group(many, ["g"], 200, 1e-8, on_zero, task_edges=0))
    assert set(by_task) == set(joined)
    for k, r in by_task.items():
        for c in ("c_out", "c_in", "dca"):
            assert joined[k][c] == pytest.approx(r[c], abs=1e-6, nan_ok=True)
    steps = {g: max(r["iterations"] for (x, _), r in joined.items() if x == g) for g in ("p", "q", "cycle", "none") if any(x == g for x, _ in joined)}
    assert steps["cycle"] <= 10 and steps["none"] <= 2 and all(s < 200 for s in steps.values())  # each graph ends by itself


def test_rank1_stops_at_the_last_round(many):
    few = many.where("g IN ('p', 'q')")
    a = {(r["g"], r["node"]): r["dca"] for r in G.rank1_by_group(few, ["g"], 7, 0.0).collect()}
    b = {(r["g"], r["node"]): r["dca"] for r in G.rank1_by_joins(few, ["g"], 7, 0.0, every=3).collect()}
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(a[k], abs=1e-12) for k in a)


def test_rank1_of_text_nodes_equals_the_matrix(spark, many):
    rows = many.where("g = 'p'").collect()
    names = sorted({r["src"] for r in rows} | {r["dst"] for r in rows})
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[names.index(r["src"]), names.index(r["dst"])] += r["w"]
    u, _, v = np.linalg.svd(m)
    got = {r["node"]: r for r in G.rank1_by_group(many.where("g = 'p'").withColumns({c: F.format_string("n%03d", c) for c in ("src", "dst")}), ["g"], 1000, 1e-12).collect()}
    assert [got[f"n{i:03d}"]["c_out"] for i in names] == pytest.approx(np.abs(u[:, 0]).tolist(), abs=1e-6)
    assert [got[f"n{i:03d}"]["c_in"] for i in names] == pytest.approx(np.abs(v[0]).tolist(), abs=1e-6)


@pytest.mark.parametrize("pair_totals", [False, True])
def test_null_by_joins_keeps_margins(spark, pair_totals):
    rounds = 3
    r = np.random.default_rng(8)
    rows = [(g, a, b, float(r.integers(1, 6))) for g in (0, 1) for a in range(9) for b in range(9) if a % 3 != b % 3 and r.random() < 0.8]
    edges = spark.createDataFrame(rows, "draw int, src long, dst long, w double")
    nodes = spark.createDataFrame([(i, i % 3) for i in range(9)], "node long, region int")
    got = G.maximum_entropy_null(edges, nodes, ["draw"], rounds, pair_totals=pair_totals, task_pairs=1).toPandas()
    task = G.maximum_entropy_null(edges, nodes, ["draw"], rounds, pair_totals=pair_totals).toPandas()
    e = edges.toPandas()
    for d in (0, 1):
        mine, real, other = (x[x["draw"] == d] for x in (got, e, task))
        assert set(zip(mine["src"], mine["dst"], strict=True)) == set(zip(other["src"], other["dst"], strict=True))
        for end in ("src", "dst"):
            assert np.allclose(mine.groupby(end)["w"].sum(), real.groupby(end)["w"].sum(), rtol=0.2)
        if pair_totals:
            assert np.allclose(mine.groupby([mine["src"] % 3, mine["dst"] % 3])["w"].sum(), real.groupby([real["src"] % 3, real["dst"] % 3])["w"].sum())
        off = max((abs(mine.groupby(end)["w"].sum() - real.groupby(end)["w"].sum()) / real.groupby(end)["w"].sum().clip(lower=1)).max() for end in ("src", "dst"))
        assert mine["margin_error"].iloc[0] == pytest.approx(off, abs=1e-9)
    assert not np.allclose(got[got["draw"] == 0]["w"].head(5), got[got["draw"] == 1]["w"].head(5))


def test_modularity_within_counts_lone_nodes(spark):
    edges = spark.createDataFrame([(0, 1, 2, 1.0), (0, 3, 4, 1.0)], "region int, src long, dst long, w double")
    nodes = spark.createDataFrame([(0, i) for i in range(1, 7)] + [(1, 8), (1, 9)], "region int, node long")
    got = {r["region"]: r for r in G.modularity_within(edges, "region", nodes).collect()}
    assert got[0]["n_communities"] == 4 and got[0]["q"] == pytest.approx(0.5)
    assert got[1]["n_communities"] == 0 and (got[1]["q"] is None or math.isnan(got[1]["q"]))


@pytest.mark.parametrize("delta", [None, 0.5, 100.0])
def test_paths_by_joins_equal_those_by_tasks(spark, delta):
    r = np.random.default_rng(2)
    rows = [(g, int(a), int(b), float(w)) for g, n in ((0, 30), (1, 12)) for a, b, w in zip(r.integers(0, n, 2 * n), r.integers(0, n, 2 * n), r.integers(0, 9, 2 * n), strict=True)]
    rows += [(0, 100, 101, 1.0), (2, 1, 2, 3.0)]
    segments = spark.createDataFrame(rows, "block int, a long, b long, w double")
    sources = spark.createDataFrame([(0, 0), (0, 5), (1, 3), (3, 8)], "block int, node long")
    key = lambda df: {(x["block"], x["node"]): x["distance"] for x in df.collect()}
    want = key(G.shortest_paths(segments, sources, ["block"]))
    assert key(G.paths_by_joins(segments, sources, ["block"], delta)) == want
    assert want[0, 101] == math.inf and want[2, 1] == math.inf and want[3, 8] == 0
    if delta is None:
        assert key(G.shortest_paths(segments, sources, ["block"], task_edges=20)) == want


@pytest.mark.parametrize("name", ["support_filter", "morph_subsample"])
def test_items_meet_orders_in_tasks_of_bounded_size(spark, monkeypatch, name):
    from tesselon.plans import base, catalogue

    key = lambda df: sorted(map(tuple, df.collect()))
    whole = key(catalogue.queries()[name](spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(base, "TASK_ITEMS", 300)
    e = base.cell_edges(spark, "/root/testdata/sf0.001")
    sizes = [r["n"] for r in e.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert len(sizes) > n // 400 and max(sizes) < 600 and sum(sizes) == e.count()
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") + plan.count("BroadcastHashJoin") <= 3  # the tables are joined once
    assert key(df) == whole


def test_mapped_network_joins_its_tables_once(spark):
    from tesselon.operators.structure import mapped_network
    from tesselon.plans import catalogue

    plan = catalogue.queries()["mapped_network"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # only the counts of the one join are read again
    r = np.random.default_rng(9)
    rows = [(int(a), int(b), int(w), int(n)) for a, b, w, n in zip(r.integers(0, 12, 200), r.integers(0, 12, 200), r.integers(1, 5, 200), r.integers(1, 4, 200), strict=True)]
    few = spark.createDataFrame(rows, "src long, dst long, w long, n long")
    cells = spark.createDataFrame([(i, f"R{i % 2}_{'LR'[i % 3 % 2]}") for i in range(12)], "cell long, region string")
    each = few.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("src", "dst", "w")
    a, b = ({x["region"]: x for x in df.collect()} for df in (mapped_network(few, cells, 2, "n"), mapped_network(each, cells, 2)))
    assert a.keys() == b.keys() and all(a[k][c] == pytest.approx(b[k][c]) for k in a for c in ("post_dca", "pre_dca", "oo", "n_cells"))


def test_paths_of_a_task_hold_arrays(monkeypatch):
    import tracemalloc

    n = 200_000
    child = np.arange(1, n)
    w = np.random.default_rng(1).random(n - 1)
    tracemalloc.start()
    got = G.distances(child // 2, child, w, np.array([0]), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = np.zeros(n)
    for i in range(1, n):
        want[i] = want[i // 2] + w[i - 1]
    assert np.array_equal(got, want)
    assert peak < 250 * n  # lists of neighbours took about twice this
