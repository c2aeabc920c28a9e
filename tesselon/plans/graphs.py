"""Queries on the nation graph and on points."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import graph as G
from tesselon.operators import relational as R
from tesselon.operators import spatial as P
from tesselon.operators.sequence import mean_of  # noqa: F401
from tesselon.plans.base import GRAPH_SQL, POINTS_SQL, SCORES_SQL, balance_scores, cell_edges, nation_graph, points, rnd, scored_edges
from tesselon.plans.catalogue import query
from tesselon.sources.tables import table


@query("unit_adjacency", f"WITH {GRAPH_SQL} SELECT src AS src_unit, dst AS dst_unit, w FROM adj")
def unit_adjacency(spark, sf):
    """Cell edges counted between units of different regions."""
    cells = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), F.col("n_nationkey").cast("long").alias("unit"), F.col("n_regionkey").cast("long").alias("region"))
    return G.unit_adjacency(cell_edges(spark, sf).select("src", "dst"), cells)


_RANK1 = f"""WITH RECURSIVE {GRAPH_SQL},
nodes AS (SELECT DISTINCT node FROM (SELECT src AS node FROM adj UNION ALL SELECT dst FROM adj)),
m AS (SELECT (SELECT list(r ORDER BY s) FROM (SELECT s.node AS s, list(coalesce(w, 0) ORDER BY d.node) AS r FROM nodes s CROSS JOIN nodes d LEFT JOIN adj ON src = s.node AND dst = d.node GROUP BY ALL)) AS a,
  (SELECT list(r ORDER BY s) FROM (SELECT s.node AS s, list(coalesce(w, 0) ORDER BY d.node) AS r FROM nodes s CROSS JOIN nodes d LEFT JOIN adj ON dst = s.node AND src = d.node GROUP BY ALL)) AS t,
  (SELECT list(node ORDER BY node) FROM nodes) AS names),
it AS (SELECT 0 AS i, list_transform(names, lambda x: 1.0::DOUBLE) AS o, list_transform(names, lambda x: 1.0::DOUBLE) AS n FROM m
  UNION ALL SELECT i + 1, list_transform(raw_o, lambda x: x / so), list_transform(raw_n, lambda x: x / sqrt(list_dot_product(raw_n, raw_n))) FROM (
    SELECT i, raw_o, so, list_transform(t, lambda r: list_dot_product(r, raw_o) / so) AS raw_n FROM (
      SELECT i, t, raw_o, sqrt(list_dot_product(raw_o, raw_o)) AS so FROM (SELECT i, t, list_transform(a, lambda r: list_dot_product(r, it.n)) AS raw_o FROM it, m WHERE i < 50))))
SELECT node, round(c_out, 6) + 0.0 AS c_out, round(c_in, 6) + 0.0 AS c_in, round(c_out - c_in, 6) + 0.0 AS dca FROM (SELECT unnest(names) AS node, unnest(o) AS c_out, unnest(n) AS c_in FROM it, m WHERE i = 50)"""


@query("rank1_dca", _RANK1)
def rank1_dca(spark, sf):
    """Leading singular vectors of the nation graph."""
    r = G.rank1_by_group(nation_graph(spark, sf).withColumn("g", F.lit(0)), ["g"], 1000, 1e-10)
    return r.select("node", rnd("c_out").alias("c_out"), rnd("c_in").alias("c_in"), rnd("dca").alias("dca"))


@query("rank1_distributed", _RANK1)
def rank1_distributed(spark, sf):
    """The same by joins, for graphs of any size, to the same tolerance."""
    r = G.rank1_distributed(nation_graph(spark, sf).select("src", "dst", "w"), 1000, 1e-10)
    return r.select("node", rnd("c_out").alias("c_out"), rnd("c_in").alias("c_in"), rnd("dca").alias("dca"))


@query("local_dca")
def local_dca(spark, sf):
    """Rank-1 scores inside each part, of binary edges without loops."""
    e = cell_edges(spark, sf).where("src <> dst").select((F.col("block") % 4).cast("long").alias("part"), "src", "dst").distinct().withColumn("w", F.lit(1.0))
    return G.rank1_by_group(e, ["part"], 300, 1e-9, "stop")


@query("region_structure", f"""WITH {SCORES_SQL},
po AS (SELECT src_region AS region, sum(w * dca_dst) / sum(w) AS dca_post, sum(CASE WHEN dca_src > 0 AND dca_dst > 0 THEN w ELSE 0 END) / sum(w) AS oo, sum(w) AS o, count(*)::BIGINT AS n FROM e GROUP BY ALL),
pr AS (SELECT dst_region AS region, sum(w * dca_src) / sum(w) AS dca_pre, sum(w) AS i FROM e GROUP BY ALL)
SELECT r_regionkey::BIGINT AS region, round(dca_post, 6) + 0.0 AS dca_post, round(dca_pre, 6) + 0.0 AS dca_pre, round(oo, 6) + 0.0 AS hard_oo, round(ln((coalesce(o, 0) + 1) / (coalesce(i, 0) + 1)), 6) + 0.0 AS log_out_in, coalesce(n, 0) AS n_edges
FROM region LEFT JOIN po ON po.region = r_regionkey LEFT JOIN pr ON pr.region = r_regionkey""")
def region_structure(spark, sf):
    """One row of measures for each region."""
    g = nation_graph(spark, sf)
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("region"))
    r = G.region_structure(g, balance_scores(g), regions)
    return r.select("region", *[rnd(c).alias(c) for c in ("dca_post", "dca_pre", "hard_oo", "log_out_in")], "n_edges")


@query("oo_counts", f"""WITH {SCORES_SQL} SELECT src_region AS region, round(count(*) FILTER (dca_src > 0 AND dca_dst > 0) / count(*)::DOUBLE, 6) + 0.0 AS oo, round(count(*) FILTER (dca_src > 0 AND dca_dst > 0) / count(DISTINCT dst)::DOUBLE, 6) + 0.0 AS oo_targets,
round(avg(CASE WHEN dca_src > 0 AND dca_dst > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS oo_mean FROM e GROUP BY ALL""")
def oo_counts(spark, sf):
    """H3 H4 H5: shares of edges, unweighted."""
    e = scored_edges(spark, sf)
    a = G.oo_by_count(e, ["src_region"]).withColumnRenamed("oo", "oo_a")
    b = G.oo_by_distinct_targets(e, ["src_region"]).withColumnRenamed("oo", "oo_b")
    from tesselon.functions.scalars import share

    c = e.groupBy("src_region").agg(share((F.col("dca_src") > 0) & (F.col("dca_dst") > 0)).alias("oo_c"))
    return a.join(b, "src_region").join(c, "src_region").select(F.col("src_region").alias("region"), rnd("oo_a").alias("oo"), rnd("oo_b").alias("oo_targets"), rnd("oo_c").alias("oo_mean"))


@query("oo_threshold_sweep", f"""WITH {SCORES_SQL}, th AS (SELECT unnest([0.0, 0.01, 0.02, 0.05]) AS threshold),
s AS (SELECT threshold::DOUBLE AS threshold, src_region AS region, sum(CASE WHEN dca_src > threshold AND dca_dst > threshold THEN w ELSE 0 END) / sum(w) AS oo, sum(CASE WHEN dca_src > threshold THEN w ELSE 0 END) / sum(w) AS sp, sum(CASE WHEN dca_dst > threshold THEN w ELSE 0 END) / sum(w) AS tp FROM e CROSS JOIN th GROUP BY ALL)
SELECT threshold, region, round(oo, 6) + 0.0 AS oo, round(sp, 6) + 0.0 AS source_positive, round(tp, 6) + 0.0 AS target_positive, CASE WHEN sp > 0 THEN round(oo / sp, 6) + 0.0 END AS conditional, round(oo - sp * tp, 6) + 0.0 AS oo_minus_independence FROM s""")
def oo_threshold_sweep(spark, sf):
    """Five measures at each threshold."""
    th = spark.createDataFrame([(0.0,), (0.01,), (0.02,), (0.05,)], "threshold double")
    e = scored_edges(spark, sf).crossJoin(F.broadcast(th))  # four thresholds
    r = G.oo_measures(e, F.col("threshold"), ["threshold", F.col("src_region").alias("region")])
    return r.select("threshold", "region", *[rnd(c).alias(c) for c in ("oo", "source_positive", "target_positive", "conditional", "oo_minus_independence")])


@query("oo_exclusion", f"""WITH {SCORES_SQL}, th AS (SELECT unnest([0.0, 0.01, 0.03]) AS band),
k AS (SELECT band::DOUBLE AS band, src_region AS region, w, CASE WHEN abs(dca_src) > band AND abs(dca_dst) > band THEN w ELSE 0 END AS kept, dca_src > 0 AND dca_dst > 0 AS pos FROM e CROSS JOIN th)
SELECT band, region, CASE WHEN sum(kept) > 0 THEN round(sum(CASE WHEN pos THEN kept ELSE 0 END) / sum(kept), 6) + 0.0 END AS oo, round(sum(kept) / sum(w), 6) + 0.0 AS retained FROM k GROUP BY ALL""")
def oo_exclusion(spark, sf):
    """Hard OO without edges near zero."""
    th = spark.createDataFrame([(0.0,), (0.01,), (0.03,)], "band double")
    r = G.oo_excluding(scored_edges(spark, sf).crossJoin(F.broadcast(th)), F.col("band"), ["band", F.col("src_region").alias("region")])  # three bands
    return r.select("band", "region", rnd("oo").alias("oo"), rnd("retained").alias("retained"))


@query("oo_soft", f"""WITH {SCORES_SQL}, th AS (SELECT unnest([0.01, 0.1]) AS temperature)
SELECT temperature::DOUBLE AS temperature, src_region AS region, round(sum(w / (1 + exp(-greatest(-40, least(40, dca_src / temperature)))) / (1 + exp(-greatest(-40, least(40, dca_dst / temperature))))) / sum(w), 6) + 0.0 AS soft_oo FROM e CROSS JOIN th GROUP BY ALL""")
def oo_soft(spark, sf):
    """Logistic OO at two temperatures."""
    th = spark.createDataFrame([(0.01,), (0.1,)], "temperature double")
    r = G.oo_soft(scored_edges(spark, sf).crossJoin(F.broadcast(th)), F.col("temperature"), ["temperature", F.col("src_region").alias("region")])  # two temperatures
    return r.select("temperature", "region", rnd("soft_oo").alias("soft_oo"))


def _region_edges(spark, sf):
    return nation_graph(spark, sf).groupBy(F.col("src_region").alias("src"), F.col("dst_region").alias("dst")).agg(F.sum("w").alias("w"))


@query("reciprocity", f"""WITH {GRAPH_SQL}, r AS (SELECT src_region AS s, dst_region AS d, sum(w) AS w FROM adj GROUP BY ALL)
SELECT a.s AS region, round(sum(least(a.w, coalesce(b.w, 0))) / sum(a.w), 6) + 0.0 AS reciprocity FROM r a LEFT JOIN r b ON a.s = b.d AND a.d = b.s GROUP BY ALL""")
def reciprocity(spark, sf):
    """Reciprocated share of region strength."""
    return G.reciprocity(_region_edges(spark, sf)).select("region", rnd("reciprocity").alias("reciprocity"))


def _least(sf_rows: int) -> int:
    return max(1, sf_rows // 500)


@query("cycle_participation", f"""WITH {GRAPH_SQL}, lim AS (SELECT greatest(1, count(*) // 500) AS least FROM cells), s AS (SELECT adj.* FROM adj, lim WHERE w >= least),
p AS (SELECT DISTINCT b.dst AS i, a.src AS j FROM s a JOIN s b ON a.dst = b.src)
SELECT src_region AS region, round(sum(CASE WHEN p.i IS NOT NULL THEN w ELSE 0 END) / sum(w), 6) + 0.0 AS cycles FROM s LEFT JOIN p ON p.i = s.src AND p.j = s.dst GROUP BY ALL""")
def cycle_participation(spark, sf):
    """Weight on edges that close a directed triangle, of the strong edges."""
    n = table(spark, sf, "lineitem").count()
    return G.cycle_participation(nation_graph(spark, sf, _least(n))).select("region", rnd("cycles").alias("cycles"))


@query("output_participation", f"""WITH {GRAPH_SQL}, c AS (SELECT src, src_region, dst_region, sum(w) AS s FROM adj GROUP BY ALL), u AS (SELECT src, src_region, sum(s) AS t, sum(s * s) AS q FROM c GROUP BY ALL)
SELECT src_region AS region, round(sum(t * (1 - q / (t * t))) / sum(t), 6) + 0.0 AS participation FROM u GROUP BY ALL""")
def output_participation(spark, sf):
    """H9: spread of outputs over communities (regions)."""
    return G.output_participation(nation_graph(spark, sf).withColumn("dst_community", F.col("dst_region"))).select("region", rnd("participation").alias("participation"))


@query("modularity", f"""WITH {GRAPH_SQL}, e2 AS (SELECT src % 4 AS a, dst % 4 AS b, w FROM adj UNION ALL SELECT dst % 4, src % 4, w FROM adj), c AS (SELECT a, sum(CASE WHEN a = b THEN w ELSE 0 END) AS i, sum(w) AS d FROM e2 GROUP BY ALL), m AS (SELECT sum(d) AS m2 FROM c)
SELECT round(sum(i / m2 - (d / m2) * (d / m2)), 6) + 0.0 AS q FROM c, m""")
def modularity(spark, sf):
    """H7 H8: modularity of given labels."""
    g = nation_graph(spark, sf)
    labels = R.degrees(g, "src", "dst", "w").select("node", (F.col("node") % 4).alias("community"))
    return G.modularity(g, labels).select(rnd("q").alias("q"))


@query("communities")
def communities(spark, sf):
    """H7 H8: communities of the symmetrised graph by greedy modularity."""
    return G.communities(nation_graph(spark, sf).withColumn("g", F.lit(0)), ["g"])


@query("support_filter", f"""WITH {GRAPH_SQL}, s AS (SELECT src, dst, count(DISTINCT block)::BIGINT AS n_blocks FROM cells WHERE src <> dst GROUP BY ALL)
SELECT least, count(*)::BIGINT AS n_pairs, sum(n_blocks)::BIGINT AS n_blocks FROM s CROSS JOIN (SELECT unnest([1, 2, 3])::BIGINT AS least) WHERE n_blocks >= least * 3 GROUP BY ALL""")
def support_filter(spark, sf):
    """Pairs by the number of blocks behind them, at three levels."""
    s = G.support(cell_edges(spark, sf).where("src <> dst"), "block", "src", "dst")
    levels = spark.createDataFrame([(1,), (2,), (3,)], "least long")
    return s.crossJoin(F.broadcast(levels)).where("n_blocks >= least * 3").groupBy("least").agg(F.count("*").alias("n_pairs"), F.sum("n_blocks").alias("n_blocks"))  # three levels


@query("morph_subsample", f"""WITH {GRAPH_SQL}, t AS (SELECT src, dst, count(DISTINCT block) AS n, count(DISTINCT CASE WHEN block % 5 <> 0 THEN block END) AS k, count(*)::DOUBLE AS w FROM cells GROUP BY ALL)
SELECT src, dst, round(w * k / n, 6) + 0.0 AS w FROM t""")
def morph_subsample(spark, sf):
    """Weights scaled by the selected share of the support."""
    counts = cell_edges(spark, sf).groupBy("block", "src", "dst").agg(F.count("*").alias("w"))
    t = counts.groupBy("src", "dst").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("block") % 5 != 0).alias("k"), F.sum("w").cast("double").alias("w"))
    return t.select("src", "dst", rnd(F.col("w") * F.col("k") / F.col("n_blocks")).alias("w"))


@query("block_overwrite", """WITH m AS (SELECT DISTINCT l_orderkey // 8 AS block, l_suppkey % 40 AS cell FROM lineitem), r AS (SELECT block, cell, (cell + block) % 2 = 0 AS s, (cell + block) % 3 = 0 AS t FROM m),
p AS (SELECT a.block, a.cell AS src, b.cell AS dst, a.s AND b.t AS edge FROM r a JOIN r b ON a.block = b.block AND a.cell <> b.cell)
SELECT src, dst FROM (SELECT src, dst, arg_max(edge, block) AS edge FROM p GROUP BY ALL) WHERE edge""")
def block_overwrite(spark, sf):
    """K6 K7: the last block that holds a pair decides its edge."""
    m = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 8).alias("block"), (F.col("l_suppkey") % 40).alias("cell")).distinct()
    return G.block_overwrite(m.select("block", "cell", ((F.col("cell") + F.col("block")) % 2 == 0).alias("is_source"), ((F.col("cell") + F.col("block")) % 3 == 0).alias("is_target")))


def _null(spark, sf, pair_totals):
    """250 realisations (the reference's number), summed up by region pair and draw."""
    nodes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("region"))
    g = nation_graph(spark, sf).select("src", "dst", "w").crossJoin(F.broadcast(spark.range(250).select(F.col("id").alias("draw"))))  # 250 draws
    return G.maximum_entropy_null(g, nodes, ["draw"], 100, pair_totals=pair_totals)


@query("maxent_null")
def maxent_null(spark, sf):
    """Random weights over all pairs of different regions with the graph's strengths."""
    return _null(spark, sf, False)


@query("maxent_null_pairs")
def maxent_null_pairs(spark, sf):
    """The same with the totals of region pairs."""
    return _null(spark, sf, True)


@query("community_summary")
def community_summary(spark, sf):
    """H7: number and modularity of the detected communities, weights of both directions added."""
    g = nation_graph(spark, sf)
    labels = G.communities(g.withColumn("g", F.lit(0)), ["g"]).select("node", "community")
    return G.modularity(g, labels).crossJoin(labels.agg(F.countDistinct("community").alias("n_communities"))).select("n_communities", rnd("q").alias("q"))  # one row each


@query("region_modularity")
def region_modularity(spark, sf):
    """H8: modularity of the detected communities within each destination region's graph of
    customers' and suppliers' nations."""
    from tesselon.plans.base import cell_edges

    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("region"))
    e = cell_edges(spark, sf).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    ends = e.join(n.withColumnsRenamed({"node": "src", "region": "region"}), "src").join(n.withColumnsRenamed({"node": "dst", "region": "other"}), "dst")
    return G.modularity_within(ends.where("region = other").select("region", "src", "dst", "w"), "region").select("region", "n_communities", rnd("q").alias("q"))


_R2 = 0.004


@query("radius_join", f"WITH {POINTS_SQL} SELECT a.id AS a_id, b.id AS b_id, round((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2, 9) + 0.0 AS d2 FROM pts a JOIN pts b ON a.id < b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < {_R2}")
def radius_join(spark, sf):
    """Pairs of points closer than a radius, by grid cells."""
    p = points(spark, sf)
    return P.radius_join(p, p, "id", "id", _R2).where("a_id < b_id").select("a_id", "b_id", rnd("d2", 9).alias("d2"))


@query("nearest_join", f"""WITH {POINTS_SQL}, c AS (SELECT a.id AS a_id, b.id AS b_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a JOIN pts b ON a.x >= 0 AND b.x < 0)
SELECT a_id, b_id, round(d2, 9) + 0.0 AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) AS n FROM c WHERE d2 < 0.02) WHERE n = 1""")
def nearest_join(spark, sf):
    """The nearest point of the other half space within a radius."""
    p = points(spark, sf)
    return P.nearest_join(p.where("x >= 0"), p.where("x < 0"), "id", "id", 0.02).select("a_id", "b_id", rnd("d2", 9).alias("d2"))


@query("nearest_vertex", f"""WITH {POINTS_SQL}, c AS (SELECT a.block, a.id AS point, b.id AS vertex, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + 4 * (a.z - b.z) * (a.z - b.z) AS d2 FROM pts a JOIN pts b ON a.block = b.block AND a.y < 0 AND b.y >= 0)
SELECT block, point, vertex, round(d2, 9) + 0.0 AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d2, vertex) AS n FROM c) WHERE n = 1""")
def nearest_vertex(spark, sf):
    """The nearest vertex of the same block, z doubled."""
    p = points(spark, sf)
    r = P.nearest_vertex(p.where("y < 0").withColumnRenamed("id", "point"), p.where("y >= 0").withColumnRenamed("id", "vertex"), ["block"])
    return r.select("block", "point", "vertex", rnd("d2", 9).alias("d2"))


@query("affine_points", f"WITH {POINTS_SQL} SELECT id, round(2 * y + 0.5 * z + 1, 6) + 0.0 AS x, round(0.1 * y + 3 * x - 2, 6) + 0.0 AS y, round(-z + 0.25, 6) + 0.0 AS z FROM pts")
def affine_points(spark, sf):
    """K1: affine map after swapping x and y."""
    r = G.transform_points(points(spark, sf), [[2.0, 0.0, 0.5, 1.0], [0.1, 3.0, 0.0, -2.0], [0.0, 0.0, -1.0, 0.25]])
    return r.select("id", *[rnd(c).alias(c) for c in "xyz"])


@query("legacy_labels", f"WITH {POINTS_SQL}, c AS (SELECT block, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM pts GROUP BY ALL) SELECT id, (x - cx) * (x - cx) + (y - cy) * (y - cy) + 4 * (z - cz) * (z - cz) < 0.05 AS is_source FROM pts JOIN c USING (block)")
def legacy_labels(spark, sf):
    """K5: label by a scaled distance from the block's centre."""
    p = points(spark, sf)
    c = p.groupBy("block").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])
    d = p.join(c, "block")
    sq = lambda a: (F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}"))
    return d.select("id", (sq("x") + sq("y") + 4 * sq("z") < 0.05).alias("is_source"))


@query("split_1d_2means", """WITH v AS (SELECT c_nationkey::BIGINT AS g, c_custkey AS k, round(c_acctbal) AS x FROM customer),
o AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY g) AS n, sum(x) OVER (PARTITION BY g) AS t, sum(x) OVER (PARTITION BY g ORDER BY x, k ROWS UNBOUNDED PRECEDING) AS s FROM v WINDOW w AS (PARTITION BY g ORDER BY x, k)),
b AS (SELECT *, CASE WHEN i < n THEN round(s * s / i + (t - s) * (t - s) / (n - i), 9) END AS b FROM o),
c AS (SELECT *, first_value(i) OVER (PARTITION BY g ORDER BY b DESC NULLS LAST, i) AS cut FROM b) SELECT k, i <= cut AS low_group FROM c""")
def split_1d_2means(spark, sf):
    """K4: exact two-means split of one dimension."""
    v = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("g"), F.col("c_custkey").alias("k"), F.round("c_acctbal").alias("x"))
    return G.split_two_means(v, ["g"], "x", ["k"]).select("k", "low_group")


@query("dijkstra_skeleton")
def dijkstra_skeleton(spark, sf):
    """K3: path lengths from each block's root along its orders (a tree by halving)."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 10).alias("block"), F.floor(F.col("o_orderkey") / 10).alias("b"), F.col("o_totalprice").alias("w")).where("b > 0")
    seg = o.select("block", F.floor(F.col("b") / 2).alias("a"), "b", "w")
    return G.shortest_paths(seg, seg.select("block", F.lit(0).cast("long").alias("node")).distinct(), ["block"])


@query("kmeans_units")
def kmeans_units(spark, sf):
    """K2: units of about 20 points in each block."""
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("block"), F.col("vec_id").alias("id"), F.slice("embedding", 1, 3).alias("v"))
    return G.kmeans_units(e, ["block"], "v", 20)


@query("calibrated_strength", f"""WITH {GRAPH_SQL}, s AS (SELECT block % 50 AS block, src % 5 AS region, count(*)::BIGINT AS n FROM cells GROUP BY ALL), t AS (SELECT block % 50 AS block, dst % 5 AS region, count(*)::BIGINT AS n FROM cells GROUP BY ALL),
c AS (SELECT s.region AS r, t.region AS t, sum(s.n * t.n)::DOUBLE AS c FROM s JOIN t USING (block) GROUP BY ALL), z AS (SELECT n_nationkey % 5 AS region, count(*) AS n FROM nation GROUP BY ALL)
SELECT a.r::BIGINT AS region, round(sum(ln(1 + (a.c + coalesce(b.c, 0)) / (p.n * q.n))) / 4, 6) + 0.0 AS strength FROM c a LEFT JOIN c b ON a.r = b.t AND a.t = b.r JOIN z p ON p.region = a.r JOIN z q ON q.region = a.t WHERE a.r <> a.t GROUP BY ALL""")
def calibrated_strength(spark, sf):
    """Symmetrised block counts over region sizes, as log1p means."""
    e = cell_edges(spark, sf).withColumn("block", F.col("block") % 50)
    s = e.groupBy("block", (F.col("src") % 5).alias("region")).agg(F.count("*").alias("n_source"))
    t = e.groupBy("block", (F.col("dst") % 5).alias("region")).agg(F.count("*").alias("n_target"))
    sizes = table(spark, sf, "nation").groupBy((F.col("n_nationkey") % 5).cast("long").alias("region")).agg(F.count("*").alias("n"))
    ends = s.join(t, ["block", "region"], "full_outer").na.fill(0, ["n_source", "n_target"])
    return G.calibrated_strength(ends, sizes).select("region", rnd("strength").alias("strength"))
