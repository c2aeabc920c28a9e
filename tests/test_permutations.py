"""Permutations in blocks of draws against one draw after the other."""

import numpy as np
import pytest

from tesselon.operators import stats as ST

number = lambda k, d: (k * 1000003 + d * 7919) * 48271 % 2147483647


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    out = [(g, int(i % 3), i, float(r.integers(0, 9)), float(r.standard_normal())) for g, n in (("p", 20), ("q", 47)) for i in range(n)]
    out += [("flat", 0, i, 1.0, float(i)) for i in range(5)] + [("one", 0, 7, 1.0, 2.0), ("p", 1, 90, None, 1.0), ("q", 1, 91, 1.0, None)]
    return spark.createDataFrame(out, "g string, s int, k long, x double, y double")


def _plain(rows, draws, strata):
    out, whole = {}, rows.toPandas().dropna()
    for g, t in whole.groupby("g"):
        for d in range(draws):
            x, y = [], []
            for _, u in t.groupby("s") if strata else [(0, t)]:
                u = u.sort_values("k")
                order = sorted(range(len(u)), key=lambda j: (number(int(u["k"].iloc[j]), d), u["k"].iloc[j]))
                x += u["x"].iloc[order].tolist()
                y += u["y"].tolist()
            out[g, d] = np.corrcoef(x, y)[0, 1] if len(x) > 1 and np.ptp(x) and np.ptp(y) else None
    return out


@pytest.mark.parametrize("strata", [[], ["s"]])
def test_permutation_blocks(rows, strata):
    want = _plain(rows, 25, strata)
    for task_rows, parts in ((1000, 1), (1000, 7), (30, 3), (0, 2)):  # in tasks, both ways, through windows
        got = {(r["g"], r["draw"]): r["r"] for r in ST.permutation_blocks(rows.repartition(parts), "k", "x", "y", 25, number, ["g"], strata, block=10, task_rows=task_rows).collect()}
        assert got.keys() == want.keys()
        for k, r in want.items():
            assert (got[k] is None) if r is None else got[k] == pytest.approx(r, abs=1e-9)


def test_a_block_leaves_a_task_as_one_row(rows):
    plan = ST.permutation_blocks(rows, "k", "x", "y", 1000, number, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and plan.count("Window") == 0 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_permutations_of_nothing(spark, rows):
    assert ST.permutation_blocks(rows.limit(0), "k", "x", "y", 10, number, ["g"]).count() == 0
    assert ST.permutation_blocks(rows.limit(0), "k", "x", "y", 10, number).count() == 0
    with pytest.raises(Exception, match="key is missing"):
        ST.permutation_blocks(spark.createDataFrame([(None, 1, 1, 1.0, 2.0)], rows.schema), "k", "x", "y", 10, number, ["g"]).collect()
