"""Connected components of an undirected edge table by star contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm.common import BROADCAST_BYTES, dropped, new_folder


def _forest(batches):
    """A star for each tree that a partition's edges form: far fewer edges, the
    same reachability."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def stars():
        nodes = [x for x in up if root(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([up[x] for x in nodes], pa.int64())], names=["a", "b"])
        up.clear()
        return out

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            low, high = min(x, y), max(x, y)
            up[low], up[high] = low, low
        if len(up) > 1_000_000:
            yield stars()
    yield stars()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that it reaches) of every node of edges
    (a, b).

    First each partition replaces its edges by a spanning star of each tree in them.
    Then large and small star rounds: each node's larger neighbours, then its smaller
    ones, are attached to the smallest node of its neighbourhood. Each round is
    written to the shared folder, so no lineage grows; minima are pre-aggregated
    before they are shuffled, and a hub's edges are rows of a join, never a collected
    group: the minima are broadcast if the counted edges bound them, else written, so
    that the join can split a hub. Ends when a round changes nothing, after about
    log(longest path) rounds. No edges give no rows; loops and repeated edges count for
    nothing; edges have no null ends.
    """
    spark = edges.sparkSession

    def saved(df: DataFrame) -> tuple[DataFrame, str]:
        path = new_folder(spark, "stars")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    written: list[str] = []

    def beside(low: DataFrame, n: int) -> DataFrame:
        """Minima of at most 2 n nodes as a join's side."""
        if 2 * n * 48 <= BROADCAST_BYTES:
            return F.broadcast(low)
        df, path = saved(low)
        written.append(path)
        return df

    def star(e: DataFrame, large: bool, n: int) -> DataFrame:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if large:
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            return both.where("b > a").join(beside(low, n), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = both.where("b < a")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        return down.join(beside(low, n), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    now, path = saved(clean.mapInArrow(_forest, "a long, b long").distinct())
    before = mark(now)
    while before[0]:
        step = star(star(now, True, before[0]).where("a <> b").distinct(), False, before[0]).where("a <> b").distinct()
        after_df, after_path = saved(step)
        after = mark(after_df)
        for old in [path, *written]:
            dropped(spark, old)
        written.clear()
        now, path = after_df, after_path
        if after == before:
            break
        before = after
    # every node now points at its component directly
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
