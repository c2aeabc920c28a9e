"""K-means units over slices against those of a task."""

import numpy as np
import pytest

from tesselon.operators import units as U


@pytest.fixture(scope="module")
def regions(spark):
    """Two regions of blobs, one of equal points, one too small to be cut."""
    r = np.random.default_rng(8)
    rows = []
    for g, n, blobs in (("a", 900, 9), ("b", 500, 5)):
        at = r.uniform(0, 60, (blobs, 3))
        rows += [(g, i, (at[i % blobs] + r.standard_normal(3)).tolist()) for i in range(n)]
    rows += [("same", i, [1.0, 2.0, 3.0]) for i in range(250)] + [("small", i, [float(i), 0.0, 1.0]) for i in range(30)]
    return spark.createDataFrame(rows, "g string, id long, v array<double>")


def test_units_over_slices(spark, regions, monkeypatch):
    monkeypatch.setattr(U, "SLICE_POINTS", 150)
    by_task = U.kmeans_units(regions, ["g"], "v", 100).toPandas()
    got = U.kmeans_units(regions.repartition(5), ["g"], "v", 100, task_points=40).toPandas()
    assert len(got) == len(by_task) == 1680 and not got.duplicated(["g", "id"]).any()
    points = {(r["g"], r["id"]): r["v"] for r in regions.collect()}
    for g, k in (("a", 9), ("b", 5), ("same", 1), ("small", 1)):
        one, other = got[got["g"] == g], by_task[by_task["g"] == g]
        assert one["unit"].nunique() == k
        x = np.array([points[g, i] for i in one["id"]])
        centre = np.stack([x[one["unit"] == j].mean(axis=0) for j in sorted(one["unit"].unique())])
        d = ((x[:, None] - centre) ** 2).sum(axis=2)
        assert one["inertia"].iloc[0] == pytest.approx(d[np.arange(len(x)), one["unit"].rank(method="dense").astype(int) - 1].sum(), rel=1e-6)
        assert one["inertia"].iloc[0] == pytest.approx(d.min(axis=1).sum(), rel=1e-6)
        assert one["inertia"].iloc[0] <= 1.02 * other["inertia"].iloc[0] + 1e-9


def test_units_of_odd_input(spark, regions):
    none = regions.limit(0)
    assert U.kmeans_units(none, ["g"], "v", 10).count() == 0
    odd = regions.where("g = 'small'").unionByName(spark.createDataFrame([("small", 99, None), ("void", 1, None)], regions.schema))
    got = U.kmeans_units(odd, ["g"], "v", 10, task_points=5).toPandas()
    assert len(got) == 30 and got["unit"].nunique() == 3 and set(got["g"]) == {"small"}
    with pytest.raises(Exception, match="key is missing"):
        U.kmeans_units(spark.createDataFrame([(None, 1, [0.0])], regions.schema), ["g"], "v", 10).collect()


def test_counts_of_units(spark):
    from pyspark.sql import functions as F

    n = spark.range(1, 1300).withColumn("k", U._count_of_units(F.col("id"), 400)).collect()
    for r in n:
        want = r["id"] // 400 - (1 if r["id"] > 400 and 0 < r["id"] % 400 < 100 else 0)
        assert r["k"] == max(want, 1)
