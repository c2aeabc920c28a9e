"""Queries on scans, projections, joins, aggregations, sorting and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.functions import scalars as X
from tesselon.operators import relational as R
from tesselon.operators import sequence as S
from tesselon.plans.base import GRAPH_SQL, NATIONS_SQL, cell_edges, nation_graph, nation_table, rnd
from tesselon.plans.catalogue import query
from tesselon.sources.tables import table


@query("pruned_scan", "SELECT l_returnflag AS flag, round(sum(l_quantity), 6) + 0.0 AS qty FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL")
def pruned_scan(spark, sf):
    """Three columns of a scan, with a pushed filter."""
    return table(spark, sf, "lineitem").where("l_discount >= 0.05").groupBy(F.col("l_returnflag").alias("flag")).agg(rnd(F.sum("l_quantity")).alias("qty"))


@query("select_rename", "SELECT n_nationkey::BIGINT AS node, n_name AS label, 'nation' AS species FROM nation")
def select_rename(spark, sf):
    """Select, rename, literal column, cast."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_name").alias("label"), F.lit("nation").alias("species"))


@query("predicate_filters", """SELECT p_partkey, p_brand, p_size FROM part
WHERE p_size > 10 AND p_brand IN (SELECT min(p_brand) FROM part UNION ALL SELECT max(p_brand) FROM part) AND NOT (p_size BETWEEN 20 AND 30) AND p_retailprice IS NOT NULL""")
def predicate_filters(spark, sf):
    """Comparisons, membership by semi-join, a string predicate."""
    p = table(spark, sf, "part")
    ends = p.agg(F.min("p_brand").alias("p_brand")).union(p.agg(F.max("p_brand")))
    return p.where("p_size > 10 and not (p_size between 20 and 30)").na.drop(subset=["p_retailprice"]).join(ends, "p_brand", "left_semi").select("p_partkey", "p_brand", "p_size")


@query("close_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-8 + 1e-5 * abs(0.05)")
def close_filter(spark, sf):
    """Filter by a float within tolerance."""
    return table(spark, sf, "lineitem").where(X.is_close("l_discount", 0.05)).select("l_orderkey", "l_linenumber")


@query("anti_membership", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_membership(spark, sf):
    """Customers without orders."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


@query("clean_and_impute", """WITH v AS (SELECT c_custkey AS k, c_nationkey::BIGINT AS g, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x FROM customer)
SELECT k, x IS NOT NULL AS complete, round(coalesce(x, avg(x) OVER (PARTITION BY g)), 6) + 0.0 AS imputed, round(coalesce(x, 0), 6) + 0.0 AS filled FROM v""")
def clean_and_impute(spark, sf):
    """Infinities and NaN to null, mean imputation, default fill."""
    from pyspark.sql import Window

    odd = F.when(F.col("c_custkey") % 14 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), X.clean(odd).alias("x"))
    return v.select("k", X.complete("x").alias("complete"), rnd(F.coalesce("x", F.avg("x").over(Window.partitionBy("g")))).alias("imputed"), rnd(F.coalesce("x", F.lit(0.0))).alias("filled"))


@query("numeric_coercion", """SELECT p_partkey, TRY_CAST(regexp_extract(p_name, '([0-9]+)', 1) AS DOUBLE) AS a, TRY_CAST(p_type AS DOUBLE) AS b FROM part""")
def numeric_coercion(spark, sf):
    """Text to numbers, null where it is none."""
    p = table(spark, sf, "part")
    num = lambda c: F.expr(f"try_cast({c} as double)")
    return p.withColumn("n", F.regexp_extract("p_name", "([0-9]+)", 1)).select("p_partkey", num("n").alias("a"), num("p_type").alias("b"))


@query("recode_names", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status,
CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS status_rank FROM orders""")
def recode_names(spark, sf):
    """Dictionary recodes with default, and a custom order."""
    return table(spark, sf, "orders").select("o_orderkey", X.recode("o_orderstatus", {"F": "final", "O": "open"}, "other").alias("status"), X.order_rank("o_orderstatus", ["O", "P", "F"]).alias("status_rank"))


@query("regex_normalise", r"""WITH n AS (SELECT c_custkey, 'AB' || lpad(c_custkey::VARCHAR, 6, '0') AS a, c_name || CASE WHEN c_custkey % 3 = 0 THEN '_L' WHEN c_custkey % 3 = 1 THEN '_R' ELSE '' END AS b FROM customer)
SELECT c_custkey, regexp_replace(trim(a), '^([A-Z]+)0+([0-9]+)$', '\1\2') AS short, CASE WHEN regexp_matches(b, '_[LR]$') THEN left(b, length(b) - 2) ELSE b END AS name, CASE WHEN regexp_matches(b, '_[LR]$') THEN right(b, 1) ELSE '' END AS side,
CASE WHEN c_custkey % 2 = 0 THEN 'Pos' ELSE 'lower' END AS bare FROM n""")
def regex_normalise(spark, sf):
    """Zero-padding, side suffix and prefix."""
    c = table(spark, sf, "customer")
    n = c.select("c_custkey", F.concat(F.lit("AB"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("a"), F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, "_L").when(F.col("c_custkey") % 3 == 1, "_R").otherwise("")).alias("b"), F.when(F.col("c_custkey") % 2 == 0, "lPos").otherwise("lower").alias("p"))
    name, side = X.side_suffix("b")
    return n.select("c_custkey", X.without_leading_zeros("a").alias("short"), name.alias("name"), side.alias("side"), X.side_prefix("p").alias("bare"))


@query("name_numbers", "SELECT n_nationkey::BIGINT AS k, CAST(list_extract(string_split(n_name, '_'), -1) AS BIGINT) AS n FROM nation")
def name_numbers(spark, sf):
    """The integer at a name's end."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), X.last_int("n_name", "_").alias("n"))


@query("token_filter", """WITH s AS (SELECT o_custkey AS k, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS tokens FROM orders GROUP BY ALL)
SELECT k, tokens FROM s WHERE len(list_intersect(string_split(tokens, ';'), ['1-URGENT', '5-LOW'])) > 0""")
def token_filter(spark, sf):
    """Sorted token lists and membership in them."""
    s = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(X.joined_sorted("o_orderpriority").alias("tokens"))
    return s.where(X.has_token("tokens", ["1-URGENT", "5-LOW"]))


@query("scalar_math", """SELECT s_suppkey, round(ln(1 + abs(s_acctbal)), 6) + 0.0 AS a, round(log10(1 + abs(s_acctbal)), 6) + 0.0 AS b, round(tanh(s_acctbal / 1000), 6) + 0.0 AS c,
round(atanh(greatest(-0.999999, least(0.999999, s_acctbal / 5000))), 6) + 0.0 AS d, sign(s_acctbal)::DOUBLE + 0.0 AS e, round(ln((s_suppkey + 1) / (s_nationkey + 1.0)), 6) + 0.0 AS f,
CASE WHEN s_nationkey > 0 THEN round(s_acctbal / s_nationkey, 6) + 0.0 END AS g FROM supplier""")
def scalar_math(spark, sf):
    """Guarded division, log ratios, clipped functions."""
    b = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        "s_suppkey", rnd(F.log1p(F.abs(b))).alias("a"), rnd(F.log10(1 + F.abs(b))).alias("b"), rnd(F.tanh(b / 1000)).alias("c"), rnd(X.fisher_z(b / 5000)).alias("d"),
        (F.signum(b) + 0.0).alias("e"), rnd(X.log_ratio("s_suppkey", "s_nationkey")).alias("f"), rnd(X.divide_positive(b, "s_nationkey")).alias("g"),
    )


@query("p_labels", """WITH p AS (SELECT p_partkey, (p_partkey % 1000) / 1000.0 AS p FROM part)
SELECT p_partkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, CASE WHEN p < 0.001 THEN 'p<0.001' ELSE 'p=' || printf('%.3f', p) END AS label FROM p""")
def p_labels(spark, sf):
    """Significance marks and p texts."""
    p = table(spark, sf, "part").select("p_partkey", ((F.col("p_partkey") % 1000) / 1000).alias("p"))
    return p.select("p_partkey", X.stars("p").alias("stars"), X.p_text("p").alias("label"))


@query("dummies", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.0 END AS s_O, CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0 END AS s_P FROM orders")
def dummies(spark, sf):
    """Dummy columns without the first level."""
    return table(spark, sf, "orders").select("o_orderkey", *X.dummies("o_orderstatus", ["F", "O", "P"], "s"))


@query("unpivot_measures", """WITH s AS (SELECT s_suppkey, s_acctbal AS balance, s_nationkey::DOUBLE AS nation FROM supplier)
SELECT s_suppkey, measure, value FROM s UNPIVOT (value FOR measure IN (balance, nation))""")
def unpivot_measures(spark, sf):
    """Wide to long."""
    return R.long(table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")), ["s_suppkey"], ["balance", "nation"])


@query("pivot_measures", """SELECT c_nationkey::BIGINT AS k, round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END), 6) + 0.0 AS building, round(avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 6) + 0.0 AS machinery FROM customer GROUP BY ALL""")
def pivot_measures(spark, sf):
    """Pivot of means over given columns."""
    p = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.avg("c_acctbal"))
    return p.select("k", rnd("BUILDING").alias("building"), rnd("MACHINERY").alias("machinery"))


@query("inner_join_multi", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_quantity <= 10")
def inner_join_multi(spark, sf):
    """Inner join of differently named keys with a second condition."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.where("l_quantity <= 10").join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("left_join_checked", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def left_join_checked(spark, sf):
    """Left join whose right keys are checked to be unique."""
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name").join(s, "c_nationkey", "left_semi")
    return R.join_checked(table(spark, sf, "customer"), n, ["c_nationkey"]).select("c_custkey", "n_name")


_HALVES = """a AS (SELECT c_nationkey::BIGINT AS k, count(*)::BIGINT AS n_customers FROM customer WHERE c_acctbal < -700 GROUP BY ALL),
z AS (SELECT s_nationkey::BIGINT AS k, count(*)::BIGINT AS n_suppliers FROM supplier WHERE s_acctbal > 7000 GROUP BY ALL)"""


def _halves(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal < -700").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").alias("n_customers"))
    s = table(spark, sf, "supplier").where("s_acctbal > 7000").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return c, s


@query("outer_with_source", f"WITH {_HALVES} SELECT coalesce(a.k, z.k) AS k, n_customers, n_suppliers, CASE WHEN a.k IS NULL THEN 'right_only' WHEN z.k IS NULL THEN 'left_only' ELSE 'both' END AS source FROM a FULL JOIN z ON a.k = z.k")
def outer_with_source(spark, sf):
    """Full outer join with provenance."""
    return R.outer_with_source(*_halves(spark, sf), ["k"])


@query("outer_zero_filled", f"WITH {_HALVES} SELECT coalesce(a.k, z.k) AS k, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers FROM a FULL JOIN z ON a.k = z.k")
def outer_zero_filled(spark, sf):
    """Full outer join, zeros for what is missing."""
    return R.outer_zero_filled(*_halves(spark, sf), ["k"])


@query("set_difference", f"WITH {_HALVES} SELECT coalesce(a.k, z.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' ELSE 'left_only' END AS source FROM a FULL JOIN z ON a.k = z.k WHERE a.k IS NULL OR z.k IS NULL")
def set_difference(spark, sf):
    """Keys of one table only."""
    return R.same_keys(*_halves(spark, sf), ["k"])


@query("key_compare", f"""WITH {_HALVES} SELECT coalesce(a.k, z.k) AS k, CASE WHEN a.k IS NULL THEN 'right_only' WHEN z.k IS NULL THEN 'left_only' ELSE 'both' END AS source, 'v' AS measure, n_customers::DOUBLE AS a, n_suppliers::DOUBLE AS b
FROM a FULL JOIN z ON a.k = z.k WHERE a.k IS NULL OR z.k IS NULL OR abs(n_customers - n_suppliers) > 1e-12 + 1e-10 * abs(n_suppliers)""")
def key_compare(spark, sf):
    """ST30 J3: rows and measures that differ between two tables."""
    c, s = _halves(spark, sf)
    return R.compare(c.withColumnRenamed("n_customers", "v"), s.withColumnRenamed("n_suppliers", "v"), ["k"])


@query("endpoint_lookup", """SELECT p.n_regionkey::BIGINT AS a, q.n_regionkey::BIGINT AS b, count(*)::BIGINT AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation p ON p.n_nationkey = s_nationkey JOIN nation q ON q.n_nationkey = c_nationkey GROUP BY ALL""")
def endpoint_lookup(spark, sf):
    """Attributes of both ends of every edge."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("region"))
    return R.with_endpoints(cell_edges(spark, sf), n, "node", "src", "dst").groupBy(F.col("src_region").alias("a"), F.col("dst_region").alias("b")).agg(F.count("*").alias("n"))


@query("pair_grid", f"WITH {NATIONS_SQL} SELECT a.k AS a, b.k AS b, round(a.x - b.x, 6) + 0.0 AS d FROM nat a JOIN nat b ON a.g = b.g AND a.k < b.k")
def pair_grid(spark, sf):
    """Unordered pairs within groups."""
    n = nation_table(spark, sf)
    a, b = n.select(F.col("k").alias("a"), "g", F.col("x").alias("xa")), n.select(F.col("k").alias("b"), "g", F.col("x").alias("xb"))
    return a.join(b, "g").where("a < b").select("a", "b", rnd(F.col("xa") - F.col("xb")).alias("d"))


@query("parameter_grid", "SELECT a::BIGINT AS size, b / 10.0::DOUBLE AS radius, count(*)::BIGINT AS n FROM (SELECT unnest([10, 20, 30]) AS a) CROSS JOIN (SELECT unnest([1, 2]) AS b) JOIN part ON p_size >= a GROUP BY ALL")
def parameter_grid(spark, sf):
    """A grid of settings against a table."""
    grid = spark.createDataFrame([(a, b / 10) for a in (10, 20, 30) for b in (1, 2)], "size long, radius double")
    p = table(spark, sf, "part").groupBy("p_size").agg(F.count("*").alias("c"))
    return p.crossJoin(F.broadcast(grid)).where("p_size >= size").groupBy("size", "radius").agg(F.sum("c").alias("n"))  # six settings


@query("in_all_groups", """SELECT o_custkey AS k FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)""")
def in_all_groups(spark, sf):
    """Keys found in every group."""
    return R.in_all_groups(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus"), "k", "o_orderstatus")


@query("named_aggregates", """SELECT o_orderpriority AS p, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS n_customers, round(avg(o_totalprice), 4) + 0.0 AS mean, round(min(o_totalprice), 4) + 0.0 AS lo, round(max(o_totalprice), 4) + 0.0 AS hi, round(median(o_totalprice), 4) + 0.0 AS med,
round(quantile_cont(o_totalprice, 0.025), 4) + 0.0 AS q1, round(quantile_cont(o_totalprice, 0.975), 4) + 0.0 AS q2, round(avg((o_orderstatus = 'F')::INT), 6) + 0.0 AS share_final, count(*) FILTER (o_totalprice > 100000)::BIGINT AS n_large FROM orders GROUP BY ALL""")
def named_aggregates(spark, sf):
    """Counts, means, exact quantiles, shares."""
    v = F.col("o_totalprice")
    q = lambda p: rnd(F.percentile(v, F.lit(p)), 4)
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("n_customers"), rnd(F.avg(v), 4).alias("mean"), rnd(F.min(v), 4).alias("lo"), rnd(F.max(v), 4).alias("hi"), q(0.5).alias("med"),
        q(0.025).alias("q1"), q(0.975).alias("q2"), rnd(X.share(F.col("o_orderstatus") == "F")).alias("share_final"), F.count_if(v > 100000).alias("n_large"),
    )


@query("spread_summary", """SELECT p_brand AS b, count(p_retailprice)::BIGINT AS n, round(avg(p_retailprice), 6) + 0.0 AS mean, round(stddev_samp(p_retailprice), 6) + 0.0 AS sd, round(stddev_samp(p_retailprice) / sqrt(count(p_retailprice)), 6) + 0.0 AS sem, round(median(p_retailprice), 6) + 0.0 AS median FROM part GROUP BY ALL""")
def spread_summary(spark, sf):
    """A6 ST31: n, mean, deviation, standard error, median."""
    from tesselon.operators.stats import summary

    s = summary(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return s.select(F.col("p_brand").alias("b"), "n", *[rnd(c).alias(c) for c in ("mean", "sd", "sem", "median")])


@query("mode_group", "SELECT k, m FROM (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY c DESC, m) AS n FROM (SELECT o_custkey AS k, o_orderpriority AS m, count(*) AS c FROM orders GROUP BY ALL)) WHERE n = 1")
def mode_group(spark, sf):
    """Mode, ties to the smallest."""
    return R.mode(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("m")), ["k"], "m")


@query("dominant_region", """WITH c AS (SELECT o_custkey AS k, o_orderpriority AS r, count(*)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT k, r, n, round(n / total, 6) + 0.0 AS confidence FROM (SELECT *, sum(n) OVER (PARTITION BY k) AS total, row_number() OVER (PARTITION BY k ORDER BY n DESC, r) AS i FROM c) WHERE i = 1 AND n / total >= 0.3""")
def dominant_region(spark, sf):
    """The largest category of each key with its share, first of ties."""
    from pyspark.sql import Window

    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("r")).agg(F.count("*").alias("n"))
    c = c.withColumn("confidence", X.divide("n", F.sum("n").over(Window.partitionBy("k"))))
    return R.best_row(c, ["k"], "n", ["r"]).where("confidence >= 0.3").select("k", "r", "n", rnd("confidence").alias("confidence"))


@query("upsert_latest", """WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal >= 0), n AS (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT k, v FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)""")
def upsert_latest(spark, sf):
    """New rows in place of old ones of the same key."""
    c = table(spark, sf, "customer")
    old = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), (-F.col("c_acctbal")).alias("v"))
    return R.upsert(old, new, ["k"])


@query("weighted_means", "SELECT l_returnflag AS f, l_linestatus AS s, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) + 0.0 AS m FROM lineitem GROUP BY ALL")
def weighted_means(spark, sf):
    """Pooled weighted mean."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_quantity", "l_discount")
    return R.weighted_mean(li, ["f", "s"], "l_discount", "l_quantity", "m").withColumn("m", rnd("m"))


@query("dense_counts", """SELECT n_nationkey::BIGINT AS k, count(s_suppkey)::BIGINT AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY ALL""")
def dense_counts(spark, sf):
    """A count for every key of the domain."""
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.count("*").alias("n"))
    return R.densified(s, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k")), ["k"], {"n": 0})


@query("undirected_multiplicity", f"WITH {GRAPH_SQL} SELECT least(src, dst) AS lo, greatest(src, dst) AS hi, count(*)::BIGINT AS n FROM cells GROUP BY ALL")
def undirected_multiplicity(spark, sf):
    """Undirected pairs with multiplicity."""
    return R.unordered_pairs(cell_edges(spark, sf), "src", "dst")


@query("histogram_density", """WITH v AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer WHERE c_acctbal BETWEEN -1000 AND 10000),
h AS (SELECT g, least(floor((x + 1000) / 1100), 9)::BIGINT AS bin, count(*)::BIGINT AS n FROM v GROUP BY ALL)
SELECT g, bin, n, round(n / (sum(n) OVER (PARTITION BY g) * 1100), 9) + 0.0 AS density FROM h""")
def histogram_density(spark, sf):
    """Equal bins, the last closed, with density."""
    h = R.histogram(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x")), "x", -1000, 10000, 10, ["g"])
    return h.withColumn("density", rnd("density", 9))


@query("degree_strength", f"""WITH {GRAPH_SQL}, o AS (SELECT src AS node, count(*)::BIGINT AS od, sum(w) AS os FROM adj GROUP BY ALL), i AS (SELECT dst AS node, count(*)::BIGINT AS id, sum(w) AS is_ FROM adj GROUP BY ALL)
SELECT coalesce(o.node, i.node) AS node, coalesce(od, 0) AS out_degree, coalesce(os, 0) AS out_strength, coalesce(id, 0) AS in_degree, coalesce(is_, 0) AS in_strength FROM o FULL JOIN i ON o.node = i.node""")
def degree_strength(spark, sf):
    """Degrees and strengths of every node."""
    return R.degrees(nation_graph(spark, sf), "src", "dst", "w")


@query("duplicate_keys", "SELECT l_orderkey, l_returnflag, count(*)::BIGINT AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    """Keys that repeat."""
    return R.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"])


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    """Distinct rows."""
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("qc_block", """SELECT 'rows' AS quantity, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'customers', count(DISTINCT o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'statuses', count(DISTINCT o_orderstatus)::VARCHAR FROM orders""")
def qc_block(spark, sf):
    """Scalar figures as rows."""
    return R.qc_block(table(spark, sf, "orders"), {"rows": F.count("*"), "customers": F.countDistinct("o_custkey"), "statuses": F.countDistinct("o_orderstatus")})


@query("two_level", "SELECT g, count(*)::BIGINT AS n, round(stddev_pop(m), 6) + 0.0 AS sd FROM (SELECT n_regionkey::BIGINT AS g, n_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL) GROUP BY g")
def two_level(spark, sf):
    """Deviation of group means."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    m = c.join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy(F.col("n_regionkey").cast("long").alias("g"), "n_nationkey").agg(F.avg("c_acctbal").alias("m"))
    return m.groupBy("g").agg(F.count("*").alias("n"), rnd(F.stddev_pop("m")).alias("sd"))


@query("zscores", f"""WITH {NATIONS_SQL} SELECT k, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) + 0.0 AS x_z, round((y - avg(y) OVER w) / stddev_samp(y) OVER w, 6) + 0.0 AS y_z FROM nat WINDOW w AS (PARTITION BY g)""")
def zscores(spark, sf):
    """Z scores overall and within groups."""
    z = S.zscore(S.zscore(nation_table(spark, sf), "x", []), "y", ["g"], 1)
    return z.select("k", rnd("x_z").alias("x_z"), rnd("y_z").alias("y_z"))


@query("average_ranks", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS rk FROM part")
def average_ranks(spark, sf):
    """Ranks with ties averaged."""
    return S.avg_rank(table(spark, sf, "part"), "p_size", ["p_brand"], "rk").select("p_partkey", "rk")


@query("first_per_group", """SELECT g, k, x FROM (SELECT g, k, round(x, 6) + 0.0 AS x, row_number() OVER (PARTITION BY g ORDER BY x DESC, k) AS n FROM (WITH """ + NATIONS_SQL + """ SELECT * FROM nat)) WHERE n = 1""")
def first_per_group(spark, sf):
    """The top row of each group under a stable order."""
    return R.best_row(nation_table(spark, sf), ["g"], "x", ["k"]).select("g", "k", rnd("x").alias("x"))


@query("best_pair", f"WITH {NATIONS_SQL} SELECT CASE WHEN d >= 0 THEN a ELSE b END AS a, CASE WHEN d >= 0 THEN b ELSE a END AS b, round(abs(d), 6) + 0.0 AS d FROM (SELECT a.k AS a, b.k AS b, a.x - b.x AS d FROM nat a JOIN nat b ON a.k < b.k) ORDER BY abs(d) DESC, a, b LIMIT 1")
def best_pair(spark, sf):
    """The pair with the largest difference, oriented to be positive."""
    n = nation_table(spark, sf)
    p = n.select(F.col("k").alias("a"), F.col("x").alias("xa")).join(n.select(F.col("k").alias("b"), F.col("x").alias("xb")), F.col("a") < F.col("b")).withColumn("d", F.col("xa") - F.col("xb"))
    top = p.orderBy(F.desc(F.abs("d")), "a", "b").limit(1)
    return top.select(F.when(F.col("d") >= 0, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("d") >= 0, F.col("b")).otherwise(F.col("a")).alias("b"), rnd(F.abs("d")).alias("d"))


@query("unions", "SELECT c_nationkey::BIGINT AS k, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def unions(spark, sf):
    """Union by name with missing columns."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_acctbal").alias("balance"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@query("endpoint_union", f"WITH {GRAPH_SQL} SELECT src AS node FROM cells UNION SELECT dst FROM cells")
def endpoint_union(spark, sf):
    """The distinct ends of all edges."""
    e = cell_edges(spark, sf)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query("intersections", "SELECT s_nationkey::BIGINT AS k FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal < 0")
def intersections(spark, sf):
    """Keys in both tables."""
    return table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").cast("long").alias("k")).intersect(table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").cast("long")))
