"""Base tables of the catalogue on the driver's star schema, and their SQL.

Recordings are event types, units are users modulo 25 (one for each nation), frames are
half days. The graph joins supplier nations to customer nations through line items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.operators.sequence import dense_series
from tesselon.sources.tables import table

WIDTH, STEP = 20, 5


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def binned(spark: SparkSession, sf: str) -> DataFrame:
    """recording, unit, bin, value of every event."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("recording"),
        F.pmod("user_id", F.lit(25)).cast("long").alias("unit"),
        (F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) * 2 + F.when(F.hour("ts") >= 12, 1).otherwise(0)).cast("long").alias("bin"),
        "value",
    )


def units(spark: SparkSession, sf: str, what: str = "value") -> DataFrame:
    """recording, unit, values: the sum of values (or the count) in each frame, 0 where
    there are no events."""
    b = binned(spark, sf)
    lim = b.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    measure = F.sum("value") if what == "value" else F.count("bin").cast("double")
    sums = b.groupBy("recording", "unit", "bin").agg(measure.alias("value")).crossJoin(F.broadcast(lim))  # lim is one row
    framed = sums.select("recording", "unit", (F.col("bin") - F.col("lo")).alias("frame"), F.coalesce("value", F.lit(0.0)).alias("value"), (F.col("hi") - F.col("lo") + 1).cast("int").alias("n"))
    return dense_series(framed.withColumn("n_", F.col("n")), ["recording", "unit", "n"], "frame", "value", F.col("n")).select("recording", "unit", "values")


TRACES_SQL = """
b AS (SELECT event_type AS recording, user_id % 25 AS unit,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 2 + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS bin, value FROM events),
lim AS (SELECT min(bin) AS lo, max(bin) AS hi FROM b),
fr AS (SELECT unnest(range(lo, hi + 1)) - lo AS frame, lo FROM lim),
un AS (SELECT DISTINCT recording, unit FROM b),
t AS (SELECT un.recording, un.unit, fr.frame, coalesce(sum(b.value), 0) AS value, count(b.bin)::DOUBLE AS n
  FROM un CROSS JOIN fr LEFT JOIN b ON b.recording = un.recording AND b.unit = un.unit AND b.bin = fr.frame + fr.lo GROUP BY ALL)"""

PAIRS_SQL = TRACES_SQL + f""",
k AS (SELECT unnest(range(0, (hi - lo + 1 - {WIDTH}) // {STEP} + 1)) AS win FROM lim),
pw AS (SELECT x.recording, k.win, x.unit AS u, y.unit AS v,
  CASE WHEN stddev_pop(x.value) > 1e-13 AND stddev_pop(y.value) > 1e-13
    THEN greatest(-1, least(1, covar_pop(x.value, y.value) / (stddev_pop(x.value) * stddev_pop(y.value)))) END AS r
  FROM t x JOIN t y ON x.recording = y.recording AND x.frame = y.frame AND x.unit < y.unit
  JOIN k ON x.frame >= k.win * {STEP} AND x.frame < k.win * {STEP} + {WIDTH} GROUP BY ALL),
bw AS (SELECT recording, win, u, v, r FROM pw UNION ALL SELECT recording, win, v, u, r FROM pw)"""


def nation_table(spark: SparkSession, sf: str) -> DataFrame:
    """k, g, x, y, z: mean balance, mean order value and orders of each nation."""
    n, c, o = table(spark, sf, "nation"), table(spark, sf, "customer"), table(spark, sf, "orders")
    return (
        o.select("o_custkey", "o_totalprice").join(c.select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("x"), F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("z"))
        .join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("g"), "x", "y", "z")
    )


NATIONS_SQL = """
nat AS (SELECT n_nationkey::BIGINT AS k, n_regionkey::BIGINT AS g, avg(c_acctbal) AS x, avg(o_totalprice) AS y, count(*)::DOUBLE AS z
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


#: Line items of a task where they meet their orders.
TASK_ITEMS = 500_000


def cell_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src_unit, dst_unit, block: one row for each line item, supplier nation to customer
    nation, with its order as the block. Items and orders take their nations first and meet
    last, dealt by order to as many tasks as their number asks for, so that what a task holds
    doesn't grow with the tables and rows of a block are together."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    tasks = max(spark.sparkContext.defaultParallelism, -(-items.count() // TASK_ITEMS))
    src = items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("block"), F.col("s_nationkey").cast("long").alias("src"))
    dst = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("block"), F.col("c_nationkey").cast("long").alias("dst"))
    return src.repartition(tasks, "block").join(dst.repartition(tasks, "block"), "block").select("src", "dst", "block")


def nation_graph(spark: SparkSession, sf: str, least: int = 1) -> DataFrame:
    """src, dst, w, src_region, dst_region: edges between nations of different regions
    with at least least line items."""
    n = table(spark, sf, "nation")
    r = lambda end: n.select(F.col("n_nationkey").cast("long").alias(end), F.col("n_regionkey").cast("long").alias(f"{end}_region"))
    w = cell_edges(spark, sf).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    return w.join(r("src"), "src").join(r("dst"), "dst").where((F.col("src") != F.col("dst")) & (F.col("src_region") != F.col("dst_region")) & (F.col("w") >= least))


GRAPH_SQL = """
cells AS (SELECT s_nationkey::BIGINT AS src, c_nationkey::BIGINT AS dst, l_orderkey AS block FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
adj AS (SELECT src, dst, count(*)::DOUBLE AS w, p.n_regionkey::BIGINT AS src_region, q.n_regionkey::BIGINT AS dst_region
  FROM cells JOIN nation p ON p.n_nationkey = src JOIN nation q ON q.n_nationkey = dst
  WHERE src <> dst AND p.n_regionkey <> q.n_regionkey GROUP BY ALL)"""


def balance_scores(graph: DataFrame) -> DataFrame:
    """node, dca: (out - in) / (out + in) strength, a score that SQL repeats exactly."""
    out = graph.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("o"))
    into = graph.groupBy(F.col("dst").alias("node")).agg(F.sum("w").alias("i"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.join(into, "node", "full_outer").select("node", ((z("o") - z("i")) / (z("o") + z("i"))).alias("dca"))


SCORES_SQL = GRAPH_SQL + """,
so AS (SELECT src AS node, sum(w) AS o FROM adj GROUP BY ALL),
si AS (SELECT dst AS node, sum(w) AS i FROM adj GROUP BY ALL),
dca AS (SELECT coalesce(so.node, si.node) AS node, (coalesce(o, 0) - coalesce(i, 0)) / (coalesce(o, 0) + coalesce(i, 0)) AS dca FROM so FULL JOIN si ON so.node = si.node),
e AS (SELECT adj.*, p.dca AS dca_src, q.dca AS dca_dst FROM adj JOIN dca p ON p.node = src JOIN dca q ON q.node = dst)"""


def scored_edges(spark: SparkSession, sf: str) -> DataFrame:
    g = nation_graph(spark, sf)
    d = balance_scores(g)
    return g.join(d.withColumnsRenamed({"node": "src", "dca": "dca_src"}), "src").join(d.withColumnsRenamed({"node": "dst", "dca": "dca_dst"}), "dst")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """id, block, x, y, z: the first three components of each embedding."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("block"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


POINTS_SQL = """
pts AS (SELECT vec_id AS id, label::BIGINT AS block, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"""
