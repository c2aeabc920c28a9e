"""Queries on statistics: correlation, rank tests, resampling, corrections, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import connectivity as C
from tesselon.operators import stats as ST
from tesselon.operators.sequence import endpoint_difference, interpolated, padded_edges, trimmed_spread, well_width
from tesselon.plans.base import NATIONS_SQL, nation_table, rnd
from tesselon.plans.catalogue import query
from tesselon.sources.tables import table

_LINE = "SELECT l_returnflag AS f, l_linestatus AS s, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t FROM lineitem"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


@query("pearson_by_group", f"WITH v AS ({_LINE}) SELECT f, s, count(*)::BIGINT AS n, round(corr(q, e), 6) + 0.0 AS r FROM v GROUP BY ALL")
def pearson_by_group(spark, sf):
    """ST1 T3: Pearson r by group."""
    return ST.pearson(_lines(spark, sf), "q", "e", ["f", "s"]).select("f", "s", "n", rnd("r").alias("r"))


@query("pearson_with_p")
def pearson_with_p(spark, sf):
    """ST1 ST11 ST28: r with its two-sided p."""
    return ST.with_p(ST.pearson(nation_table(spark, sf), "x", "y", ["g"]))


@query("spearman_by_group", f"""WITH v AS ({_LINE}), r AS (SELECT f, s, rank() OVER (PARTITION BY f, s ORDER BY q) + (count(*) OVER (PARTITION BY f, s, q) - 1) / 2.0 AS a, rank() OVER (PARTITION BY f, s ORDER BY e) + (count(*) OVER (PARTITION BY f, s, e) - 1) / 2.0 AS b FROM v)
SELECT f, s, count(*)::BIGINT AS n, round(corr(a, b), 6) + 0.0 AS r FROM r GROUP BY ALL""")
def spearman_by_group(spark, sf):
    """ST2 W3: Spearman rho by group, ties averaged."""
    return ST.spearman(_lines(spark, sf), "q", "e", ["f", "s"]).select("f", "s", "n", rnd("r").alias("r"))


@query("correlation_grid", f"""WITH {NATIONS_SQL}, a AS (SELECT k, 'x' AS x, x AS v FROM nat UNION ALL SELECT k, 'y', y FROM nat), b AS (SELECT k, 'y' AS y, y AS w FROM nat UNION ALL SELECT k, 'z', z FROM nat)
SELECT x, y, count(*)::BIGINT AS n, round(corr(v, w), 6) + 0.0 AS r FROM a JOIN b USING (k) GROUP BY ALL""")
def correlation_grid(spark, sf):
    """ST3: every left measure with every right one."""
    return ST.correlation_grid(nation_table(spark, sf), ["x", "y"], ["y", "z"], ["k"]).select("x", "y", "n", rnd("r").alias("r"))


@query("group_residual", f"WITH {NATIONS_SQL} SELECT k, round(x - avg(x) OVER (PARTITION BY g), 6) + 0.0 AS rest FROM nat")
def group_residual(spark, sf):
    """ST9 W1: residuals on group dummies."""
    return ST.group_residual(nation_table(spark, sf), "x", ["g"], "rest").select("k", rnd("rest").alias("rest"))


@query("partial_corr", f"""WITH v AS ({_LINE}), c AS (SELECT f, count(*)::BIGINT AS n, corr(q, e) AS a, corr(q, t) AS b, corr(e, t) AS c FROM v GROUP BY ALL)
SELECT f, n, round((a - b * c) / sqrt((1 - b * b) * (1 - c * c)), 6) + 0.0 AS r FROM c""")
def partial_corr(spark, sf):
    """ST8: partial correlation given one covariate."""
    return ST.partial_correlation(_lines(spark, sf), "q", "e", "t", ["f"]).select("f", "n", rnd("r").alias("r"))


@query("partial_corr_many")
def partial_corr_many(spark, sf):
    """ST8 ST11: partial correlation given several covariates, with p."""
    v = nation_table(spark, sf).withColumns({"all": F.lit(1), "g1": (F.col("g") == 1).cast("double")})
    return ST.partial_correlation_many(v, "x", "y", ["z", "g1"], ["all"])


_DRAWS = """d AS (SELECT draw, pos, ((((pos * 1000003 + draw * 7919 + {salt}) * 48271) % 2147483647) * 69621) % 2147483647 % {n} AS idx FROM (SELECT unnest(range({draws})) AS draw) CROSS JOIN (SELECT unnest(range({n})) AS pos))"""


@query("bootstrap_r", f"""WITH {NATIONS_SQL}, {_DRAWS.format(salt=0, n=25, draws=2000)}, r AS (SELECT draw, corr(x, y) AS r FROM d JOIN nat ON k = idx GROUP BY ALL)
SELECT round(quantile_cont(r, 0.025), 6) + 0.0 AS low, round(quantile_cont(r, 0.975), 6) + 0.0 AS high, round(avg(r), 6) + 0.0 AS mean, round(stddev_samp(r), 6) + 0.0 AS sd, round(avg((r > 0)::INT), 6) + 0.0 AS share_positive FROM r""")
def bootstrap_r(spark, sf):
    """ST4 ST25 ST27 A5: bootstrap interval of r over 2,000 draws."""
    rows = nation_table(spark, sf).withColumn("idx", F.col("k"))
    r = ST.bootstrap_r(rows, ST.hash_draws(spark, 25, 2000), "x", "y")
    return ST.interval(r, "r", []).select(*[rnd(c).alias(c) for c in ("low", "high", "mean", "sd", "share_positive")])


@query("permutation_p", f"""WITH {NATIONS_SQL}, {_DRAWS.format(salt=5, n=1000003, draws=1).replace('unnest(range(1000003))', 'unnest(range(25 * 10000))')},
p AS (SELECT pos // 25 AS draw, pos % 25 AS pos, row_number() OVER (PARTITION BY pos // 25 ORDER BY idx, pos) - 1 AS idx FROM d),
r AS (SELECT p.draw, corr(a.x, b.y) AS r FROM p JOIN nat a ON a.k = p.pos JOIN nat b ON b.k = p.idx GROUP BY ALL), o AS (SELECT corr(x, y) AS obs FROM nat), m AS (SELECT avg(r) AS m FROM r)
SELECT round(obs, 6) + 0.0 AS obs, round((1 + count(*) FILTER (round(abs(r), 12) >= round(abs(obs), 12))) / (count(*) + 1.0::DOUBLE), 6) + 0.0 AS p_two_sided, round((1 + count(*) FILTER (round(r, 12) >= round(obs, 12))) / (count(*) + 1.0::DOUBLE), 6) + 0.0 AS p_upper, round((1 + count(*) FILTER (round(abs(r - m), 12) >= round(abs(obs - m), 12))) / (count(*) + 1.0::DOUBLE), 6) + 0.0 AS p_centred FROM r, o, m GROUP BY obs, m""")
def permutation_p(spark, sf):
    """ST5 ST6 ST7: permutation p of r over 10,000 draws, three conventions."""
    n = nation_table(spark, sf)
    r = ST.permutation_blocks(n, "k", "x", "y", 10_000, lambda k, d: ((((d * 25 + k) * 1000003 + 5) * 48271) % 2147483647 * 69621) % 2147483647 % 1000003)
    e = ST.empirical_p(r, ST.pearson(n, "x", "y", []).select(F.col("r").alias("obs")), "r", [])
    return e.select(*[rnd(c).alias(c) for c in ("obs", "p_two_sided", "p_upper", "p_centred")])


@query("permutation_within", f"""WITH {NATIONS_SQL}, z AS (SELECT k, g, x - avg(x) OVER (PARTITION BY g) AS x, y - avg(y) OVER (PARTITION BY g) AS y, row_number() OVER (PARTITION BY g ORDER BY k) AS i FROM nat),
p AS (SELECT draw, g, k, row_number() OVER (PARTITION BY draw, g ORDER BY ((k * 1000003 + draw * 7919) * 48271) % 2147483647, k) AS i FROM z CROSS JOIN (SELECT unnest(range(20000)) AS draw)),
r AS (SELECT p.draw, corr(a.x, b.y) AS r FROM p JOIN z a ON a.k = p.k JOIN z b ON b.g = p.g AND b.i = p.i GROUP BY ALL), o AS (SELECT corr(x, y) AS obs FROM z)
SELECT round(obs, 6) + 0.0 AS obs, round((1 + count(*) FILTER (round(abs(r), 12) >= round(abs(obs), 12))) / (count(*) + 1.0::DOUBLE), 6) + 0.0 AS p FROM r, o GROUP BY obs""")
def permutation_within(spark, sf):
    """ST10 ST9: 20,000 permutations within groups of group-adjusted values."""
    n = ST.group_residual(ST.group_residual(nation_table(spark, sf), "x", ["g"], "x"), "y", ["g"], "y")
    r = ST.permutation_blocks(n, "k", "x", "y", 20_000, lambda k, d: (k * 1000003 + d * 7919) * 48271 % 2147483647, strata=["g"])
    e = ST.empirical_p(r, ST.pearson(n, "x", "y", []).select(F.col("r").alias("obs")), "r", [])
    return e.select(rnd("obs").alias("obs"), rnd("p_two_sided").alias("p"))


@query("fisher_z_meta", f"""WITH v AS ({_LINE}), g AS (SELECT f || s AS g, count(*) AS n, corr(q, d) AS r FROM v GROUP BY ALL), z AS (SELECT atanh(r) AS z, 1.0 / (n - 3) AS v FROM g WHERE n > 3),
a AS (SELECT count(*)::BIGINT AS k, sum(1 / v) AS w, sum(z / v) AS wx, sum(1 / (v * v)) AS w2, sum(z * z / v) AS wxx FROM z), b AS (SELECT k, wxx - wx * wx / w AS q, w, w2 FROM a),
c AS (SELECT k, q, greatest(0, (q - (k - 1)) / (w - w2 / w)) AS tau2, CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END AS i2 FROM b)
SELECT k, round(q, 6) + 0.0 AS q, round(tau2, 6) + 0.0 AS tau2, round(i2, 6) + 0.0 AS i2, round(sum(z / (v + tau2)) / sum(1 / (v + tau2)), 6) + 0.0 AS estimate, round(sqrt(1 / sum(1 / (v + tau2))), 6) + 0.0 AS se FROM z, c GROUP BY k, q, tau2, i2""")
def fisher_z_meta(spark, sf):
    """ST12 ST13: random-effects summary of group correlations."""
    v = _lines(spark, sf).withColumn("g", F.concat("f", "s"))
    m = ST.random_effects(ST.fisher_summary(v, "q", "d", ["g"]))
    return m.select("k", *[rnd(c).alias(c) for c in ("q", "tau2", "i2", "estimate", "se")])


@query("meta_with_p")
def meta_with_p(spark, sf):
    """ST12 ST13 ST28: the same with normal and chi-squared tails."""
    v = _lines(spark, sf).withColumn("g", F.concat("f", "s"))
    return ST.with_random_effects_p(ST.random_effects(ST.fisher_summary(v, "q", "d", ["g"])))


@query("kruskal_h", """WITH r AS (SELECT p_brand AS g, p_size AS v, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS rk FROM part),
g AS (SELECT g, count(*)::DOUBLE AS n, sum(rk) AS s FROM r GROUP BY ALL), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT v, count(*)::DOUBLE AS c FROM r GROUP BY ALL)), a AS (SELECT count(*)::BIGINT AS k, sum(n) AS n, sum(s * s / n) AS ss FROM g)
SELECT k, n::BIGINT AS n, round((12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) + 0.0 AS h FROM a, t""")
def kruskal_h(spark, sf):
    """ST17 ST29: Kruskal-Wallis H with tie correction."""
    return ST.kruskal(table(spark, sf, "part").select("p_size", "p_brand"), "p_size", "p_brand").select("k", "n", rnd("h").alias("h"))


@query("mann_whitney_u", """WITH p AS (SELECT DISTINCT p_brand AS g FROM part), q AS (SELECT a.g AS a, b.g AS b FROM p a JOIN p b ON a.g < b.g),
v AS (SELECT a, b, p_brand AS g, p_size AS v FROM q JOIN part ON p_brand = a OR p_brand = b), r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY v) + (count(*) OVER (PARTITION BY a, b, v) - 1) / 2.0::DOUBLE AS rk FROM v)
SELECT a, b, count(*) FILTER (g = a)::BIGINT AS na, count(*) FILTER (g = b)::BIGINT AS nb, sum(CASE WHEN g = a THEN rk END) - count(*) FILTER (g = a) * (count(*) FILTER (g = a) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY ALL""")
def mann_whitney_u(spark, sf):
    """ST16: U of every pair of groups."""
    return ST.mann_whitney(table(spark, sf, "part").select("p_size", "p_brand"), "p_size", "p_brand").select("a", "b", "na", "nb", "u")


@query("division_statistics")
def division_statistics(spark, sf):
    """ST29 ST14 ST16: all pairs of groups with Holm-corrected p."""
    o = table(spark, sf, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    return ST.division_statistics(o, "o_totalprice", "o_orderstatus", "o_orderpriority")


@query("wilcoxon_w", """WITH d AS (SELECT l_returnflag AS f, round(l_discount * 100) - round(l_tax * 100) AS d FROM lineitem), r AS (SELECT f, d, rank() OVER (PARTITION BY f ORDER BY abs(d)) + (count(*) OVER (PARTITION BY f, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d WHERE d <> 0)
SELECT f, count(*)::BIGINT AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS w_minus FROM r GROUP BY ALL""")
def wilcoxon_w(spark, sf):
    """ST18: signed rank sums of pairs."""
    v = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("f"), F.round(F.col("l_discount") * 100).alias("a"), F.round(F.col("l_tax") * 100).alias("b"))
    return ST.wilcoxon(v, "a", "b", ["f"]).select("f", "n", "w_plus", "w_minus")


@query("wilcoxon_p")
def wilcoxon_p(spark, sf):
    """ST18: p of paired nation measures by region, exact for few pairs without ties."""
    n = nation_table(spark, sf)
    return ST.with_wilcoxon_p(ST.wilcoxon(n.withColumn("y", F.col("y") / 30), "x", "y", ["g"]))


@query("mann_whitney_p")
def mann_whitney_p(spark, sf):
    """ST16: p of every pair of regions, exact for few values without ties."""
    return ST.with_mann_whitney_p(ST.mann_whitney(nation_table(spark, sf), "x", "g"))


@query("one_sample_t", "SELECT c_mktsegment AS g, count(c_acctbal)::BIGINT AS n, round(avg(c_acctbal), 6) + 0.0 AS mean, round((avg(c_acctbal) - 4500) / (stddev_samp(c_acctbal) / sqrt(count(c_acctbal))), 6) + 0.0 AS t FROM customer GROUP BY ALL")
def one_sample_t(spark, sf):
    """ST19: t against a mean."""
    return ST.one_sample_t(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), "c_acctbal"), "c_acctbal", ["g"], 4500).select("g", "n", rnd("mean").alias("mean"), rnd("t").alias("t"))


_P = "p AS (SELECT p_partkey AS k, p_brand AS g, ((p_partkey * 7919) % 997 + 1) / 1000.0::DOUBLE AS p FROM part)"


def _p_values(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), ((F.col("p_partkey") * 7919 % 997 + 1) / 1000).alias("p"))


@query("holm", f"""WITH {_P}, s AS (SELECT *, (count(*) OVER (PARTITION BY g) - row_number() OVER w + 1) * p AS s FROM p WINDOW w AS (PARTITION BY g ORDER BY p, k))
SELECT k, round(least(1, max(s) OVER (PARTITION BY g ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 9) + 0.0 AS p_holm FROM s""")
def holm(spark, sf):
    """ST14 W9: Holm correction within groups."""
    return C.holm(_p_values(spark, sf), "p", ["g"], ["k"]).select("k", rnd("p_holm", 9).alias("p_holm"))


@query("bh_fdr", f"""WITH {_P}, s AS (SELECT *, p * count(*) OVER (PARTITION BY g) / (rank() OVER (PARTITION BY g ORDER BY p) + count(*) OVER (PARTITION BY g, p) - 1) AS s FROM p)
SELECT k, round(least(1, min(s) OVER (PARTITION BY g ORDER BY p DESC)), 9) + 0.0 AS q FROM s""")
def bh_fdr(spark, sf):
    """ST15 W9: Benjamini-Hochberg within groups."""
    return C.benjamini_hochberg(_p_values(spark, sf), "p", ["g"]).select("k", rnd("q", 9).alias("q"))


@query("ols_slope", f"WITH v AS ({_LINE}) SELECT f, s, round(regr_slope(e, q), 6) + 0.0 AS slope, round(regr_intercept(e, q), 4) + 0.0 AS intercept FROM v GROUP BY ALL")
def ols_slope(spark, sf):
    """ST21: slope and intercept by group."""
    return ST.line(_lines(spark, sf), "q", "e", ["f", "s"]).select("f", "s", rnd("slope").alias("slope"), rnd("intercept", 4).alias("intercept"))


@query("bootstrap_diff", f"""WITH {NATIONS_SQL}, {_DRAWS.format(salt=1, n=25, draws=10000)}, m AS (SELECT d.draw, avg(a.x) - avg(b.z) AS d FROM d JOIN nat a ON a.k = idx JOIN nat b ON b.k = idx GROUP BY ALL)
SELECT round(avg(d), 6) + 0.0 AS mean, round(quantile_cont(d, 0.025), 6) + 0.0 AS low, round(quantile_cont(d, 0.975), 6) + 0.0 AS high, round(least(1, 2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT))), 6) + 0.0 AS p FROM m""")
def bootstrap_diff(spark, sf):
    """ST20: bootstrap difference of two measures' means over the nations."""
    n = nation_table(spark, sf)
    d = ST.hash_draws(spark, 25, 10_000, 1)
    r = ST.bootstrap_difference(n.select(F.col("k").alias("idx"), "x"), n.select(F.col("k").alias("idx"), F.col("z").alias("x")), d, d, "x")
    return r.select(*[rnd(c).alias(c) for c in ("mean", "low", "high", "p")])


@query("cv_residual", """WITH v AS (SELECT p_partkey AS k, p_size::DOUBLE AS x, p_retailprice AS y, p_partkey % 5 AS f FROM part), m AS (SELECT o.f, regr_slope(i.y, i.x) AS b, regr_intercept(i.y, i.x) AS a FROM (SELECT DISTINCT f FROM v) o JOIN v i ON i.f <> o.f GROUP BY ALL)
SELECT k, round(a + b * x, 4) + 0.0 AS predicted, round(y - a - b * x, 4) + 0.0 AS residual FROM v JOIN m USING (f)""")
def cv_residual(spark, sf):
    """ST23: out-of-fold predictions of a line."""
    v = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), (F.col("p_partkey") % 5).alias("f"))
    return ST.cv_residuals(v, "k", "x", "y", "f").select("k", rnd("predicted", 4).alias("predicted"), rnd("residual", 4).alias("residual"))


@query("ward_clusters")
def ward_clusters(spark, sf):
    """ST22 O5: Ward clusters of the nations and their leaf order."""
    return ST.ward(nation_table(spark, sf).withColumn("all", F.lit(1)), ["all"], "k", ["x", "y", "z"], 3)


@query("grid_validation", """SELECT p_brand AS g, count(p_retailprice)::BIGINT AS n, round(min(p_retailprice), 4) + 0.0 AS least, round(max(p_retailprice), 4) + 0.0 AS most, round(median(p_retailprice), 4) + 0.0 AS median, count(*) FILTER (p_retailprice > 0)::BIGINT AS n_positive FROM part GROUP BY ALL""")
def grid_validation(spark, sf):
    """ST26 P20: summary over a grid of settings."""
    g = ST.grid_summary(table(spark, sf, "part").select(F.col("p_brand").alias("g"), "p_retailprice"), ["g"], "p_retailprice")
    return g.select("g", "n", *[rnd(c, 4).alias(c) for c in ("least", "most", "median")], "n_positive")


@query("two_way_subsample", """WITH v AS (SELECT o_orderpriority AS s, c_nationkey::BIGINT AS r, avg(o_totalprice) AS x, avg(c_acctbal) AS y FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
n AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT DISTINCT s FROM v)), d AS (SELECT unnest(range(5000)) AS draw),
k AS (SELECT draw, v.* FROM v JOIN n USING (s) CROSS JOIN d WHERE n.i <> draw % 5 AND (r * 7 + draw * 3) % 25 >= 5), m AS (SELECT draw, r, avg(x) AS x, avg(y) AS y FROM k GROUP BY ALL)
SELECT draw, count(*)::BIGINT AS n, round(corr(x, y), 6) + 0.0 AS r FROM m GROUP BY ALL""")
def two_way_subsample(spark, sf):
    """ST24: correlations with one subject and a fifth of the regions left out."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    v = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("o_orderpriority").alias("s"), F.col("c_nationkey").cast("long").alias("r")).agg(F.avg("o_totalprice").alias("x"), F.avg("c_acctbal").alias("y"))
    names = sorted(r["s"] for r in v.select("s").distinct().collect())  # five priorities
    rows = [(d, "subject", names[d % 5]) for d in range(5000)] + [(d, "region", str(r)) for d in range(5000) for r in range(25) if (r * 7 + d * 3) % 25 < 5]
    draws = spark.createDataFrame(rows, "draw long, what string, dropped string")
    return ST.two_way_subsample(v, draws, "s", "r", "x", "y").select("draw", "n", rnd("r").alias("r"))


@query("endpoint_difference", f"WITH {NATIONS_SQL} SELECT g, round(arg_max(x, k) - arg_min(x, k), 6) + 0.0 AS difference FROM nat GROUP BY ALL")
def endpoint_diff(spark, sf):
    """Value at the largest key less that at the smallest."""
    return endpoint_difference(nation_table(spark, sf), ["g"], "k", "x").select("g", rnd("difference").alias("difference"))


@query("trimmed_spread", """WITH e AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.005) AS a, quantile_cont(c_acctbal, 0.995) AS b FROM customer GROUP BY ALL)
SELECT g, round(quantile_cont(c_acctbal, 0.95) - quantile_cont(c_acctbal, 0.05), 6) + 0.0 AS spread FROM customer JOIN e ON g = c_mktsegment AND c_acctbal BETWEEN a AND b GROUP BY ALL""")
def trimmed(spark, sf):
    """Percentile spread after trimming."""
    return trimmed_spread(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), "c_acctbal"), ["g"], "c_acctbal").select("g", rnd("spread").alias("spread"))


@query("histogram_edges", """WITH q AS (SELECT c_mktsegment AS g, quantile_cont(c_acctbal, 0.001) AS a, quantile_cont(c_acctbal, 0.999) AS b FROM customer GROUP BY ALL)
SELECT g, round(a - 0.25 * (b - a), 4) + 0.0 AS low, round(b + 0.25 * (b - a), 4) + 0.0 AS high, round(1.5 * (b - a) / 40, 4) + 0.0 AS width FROM q""")
def histogram_edges(spark, sf):
    """Padded percentile edges."""
    e = padded_edges(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), "c_acctbal"), ["g"], "c_acctbal", 40)
    return e.select("g", *[rnd(c, 4).alias(c) for c in ("low", "high", "width")])


@query("interp_grid", f"""WITH {NATIONS_SQL}, grid AS (SELECT unnest(range(-1, 27)) AS q), p AS (SELECT g.g, q, max(CASE WHEN k <= q THEN k END) AS a, min(CASE WHEN k >= q THEN k END) AS b FROM (SELECT DISTINCT g FROM nat) g CROSS JOIN grid JOIN nat n ON n.g = g.g GROUP BY ALL)
SELECT p.g, q::DOUBLE AS k, CASE WHEN a = b THEN round(x.x, 6) + 0.0 ELSE round(x.x + (y.x - x.x) * (q - a) / (b - a)::DOUBLE, 6) + 0.0 END AS x FROM p LEFT JOIN nat x ON x.g = p.g AND x.k = a LEFT JOIN nat y ON y.g = p.g AND y.k = b""")
def interp_grid(spark, sf):
    """Linear interpolation on a grid, null outside."""
    n = nation_table(spark, sf).select("g", F.col("k").cast("double").alias("k"), "x")
    grid = spark.range(-1, 27).select(F.col("id").cast("double").alias("k"))
    full = n.select("g").distinct().crossJoin(F.broadcast(grid))  # 28 grid points
    return interpolated(n, full, ["g"], "k", "x").select("g", "k", rnd("x").alias("x"))


@query("well_width", """WITH h AS (SELECT c_mktsegment AS g, floor(c_acctbal / 500)::BIGINT AS b, -count(*)::DOUBLE AS u FROM customer GROUP BY ALL), m AS (SELECT *, min(u) OVER (PARTITION BY g) AS lo FROM h),
i AS (SELECT *, sum((u > lo + 20)::INT) OVER (PARTITION BY g ORDER BY b) AS k FROM m), s AS (SELECT g, k, min(b) AS low, max(b) AS high, min(u) AS u, min(lo) AS lo FROM i WHERE u <= lo + 20 GROUP BY ALL)
SELECT g, low, high, high - low AS width FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY low) AS n FROM s WHERE u = lo) WHERE n = 1""")
def well(spark, sf):
    """The contiguous well around the minimum."""
    h = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("g"), F.floor(F.col("c_acctbal") / 500).alias("b")).agg((-F.count("*")).cast("double").alias("u"))
    return well_width(h, ["g"], "b", "u", 20)
