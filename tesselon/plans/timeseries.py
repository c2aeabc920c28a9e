"""Queries on windowed traces: correlation, variability, transfer entropy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselon.operators import connectivity as C
from tesselon.operators import sequence as S
from tesselon.operators import stats as ST
from tesselon.operators.relational import entropy_bits
from tesselon.plans.base import PAIRS_SQL, STEP, TRACES_SQL, WIDTH, rnd, units
from tesselon.plans.catalogue import query
from tesselon.sources.tables import table


#: Circular shifts of surrogate_null, and the least of them in frames.
DRAWS, LEAST = 200, 20


def _pairs(spark, sf):
    return C.window_correlation(units(spark, sf), WIDTH, STEP)


@query("region_fcv", f"""WITH {PAIRS_SQL},
fcv AS (SELECT recording, u AS unit, CASE WHEN min(n) >= 3 THEN avg(sd) END AS fcv FROM (SELECT recording, u, v, stddev_pop(r) AS sd, count(*) AS n FROM bw GROUP BY ALL) GROUP BY ALL),
fcs AS (SELECT recording, u AS unit, avg(m) AS fcs FROM (SELECT recording, u, win, avg(r) AS m FROM bw GROUP BY ALL) GROUP BY ALL)
SELECT n_regionkey::BIGINT AS region, count(*)::BIGINT AS n_units, round(avg(fcv), 6) + 0.0 AS fcv, round(avg(fcs), 6) + 0.0 AS fcs
FROM fcv JOIN fcs USING (recording, unit) JOIN nation ON n_nationkey = unit GROUP BY ALL""")
def region_fcv(spark, sf):
    """Correlation variability and strength by region."""
    p = _pairs(spark, sf)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("unit"), F.col("n_regionkey").cast("long").alias("region"))
    both = C.variability(p).join(C.strength(p), ["recording", "unit"]).join(n, "unit")
    return both.groupBy("region").agg(F.count("*").alias("n_units"), rnd(F.avg("fcv")).alias("fcv"), rnd(F.avg("fcs")).alias("fcs"))


@query("fcv_zero_filled", f"""WITH {PAIRS_SQL}
SELECT recording, u AS unit, round(CASE WHEN min(n) >= 3 THEN avg(sd) END, 6) + 0.0 AS fcv
FROM (SELECT recording, u, v, stddev_pop(coalesce(r, 0)) AS sd, count(*) AS n FROM bw GROUP BY ALL) GROUP BY ALL""")
def fcv_zero_filled(spark, sf):
    """F8: variability with undefined correlations as 0."""
    return C.variability(_pairs(spark, sf), missing_as_zero=True).select("recording", "unit", rnd("fcv").alias("fcv"))


@query("profile_corr_dist", f"""WITH {PAIRS_SQL},
m AS (SELECT recording, u, v, avg(r) AS m FROM bw GROUP BY ALL),
d AS (SELECT bw.recording, bw.u, bw.win, covar_pop(bw.r, m.m) AS c, stddev_pop(CASE WHEN bw.r IS NOT NULL THEN bw.r END) * stddev_pop(m.m) AS s, count(bw.r) AS n
  FROM bw JOIN m USING (recording, u, v) GROUP BY ALL)
SELECT recording, u AS unit, round(avg(CASE WHEN s * n > 1e-12 THEN 1 - greatest(-1, least(1, c / s)) END), 6) + 0.0 AS distance FROM d GROUP BY ALL""")
def profile_corr_dist(spark, sf):
    """distance of a window's correlation profile from the mean profile."""
    return C.profile_distance(_pairs(spark, sf)).select("recording", "unit", rnd("distance").alias("distance"))


@query("window_fc_summary", f"""WITH {PAIRS_SQL}
SELECT recording, u, v, round(avg(r), 6) + 0.0 AS mean_r, round(stddev_pop(r), 6) + 0.0 AS sd_r, count(r)::BIGINT AS n FROM pw GROUP BY ALL""")
def window_fc_summary(spark, sf):
    """Mean and deviation over windows of every pair."""
    return _pairs(spark, sf).groupBy("recording", "u", "v").agg(rnd(F.avg("r")).alias("mean_r"), rnd(F.stddev_pop("r")).alias("sd_r"), F.count("r").alias("n"))


@query("subject_region_fc", f"""WITH {PAIRS_SQL},
m AS (SELECT recording, u, v, avg(r) AS r FROM bw GROUP BY ALL)
SELECT recording, p.n_regionkey::BIGINT AS region_a, q.n_regionkey::BIGINT AS region_b, round(avg(r), 6) + 0.0 AS fc
FROM m JOIN nation p ON p.n_nationkey = u JOIN nation q ON q.n_nationkey = v GROUP BY ALL""")
def subject_region_fc(spark, sf):
    """Region block means of the mean correlation matrix."""
    m = C.both_ways(_pairs(spark, sf)).groupBy("recording", "u", "v").agg(F.avg("r").alias("r"))
    n = table(spark, sf, "nation")
    at = lambda c, name: n.select(F.col("n_nationkey").cast("long").alias(c), F.col("n_regionkey").cast("long").alias(name))
    return m.join(at("u", "region_a"), "u").join(at("v", "region_b"), "v").groupBy("recording", "region_a", "region_b").agg(rnd(F.avg("r")).alias("fc"))


@query("stimulus_fcv", """WITH b AS (SELECT event_type AS stimulus, user_id % 25 AS unit, CAST(ts AS DATE) AS day, value FROM events),
f AS (SELECT stimulus, day, row_number() OVER (PARTITION BY stimulus ORDER BY day) - 1 AS frame FROM (SELECT DISTINCT stimulus, day FROM b WHERE extract('dow' FROM day) <> 0)),
un AS (SELECT DISTINCT stimulus, unit FROM b),
t AS (SELECT f.stimulus, un.unit, f.frame, coalesce(sum(value), 0) AS value FROM f JOIN un ON un.stimulus = f.stimulus LEFT JOIN b ON b.stimulus = f.stimulus AND b.day = f.day AND b.unit = un.unit GROUP BY ALL),
k AS (SELECT stimulus, unnest(range(0, (count(*) - 10) // 4 + 1)) AS win FROM f GROUP BY stimulus),
ok AS (SELECT stimulus, unit FROM t GROUP BY ALL HAVING stddev_pop(value) > 1e-12),
pw AS (SELECT x.stimulus, k.win, x.unit AS u, y.unit AS v, CASE WHEN stddev_pop(x.value) > 1e-13 AND stddev_pop(y.value) > 1e-13 THEN covar_pop(x.value, y.value) / (stddev_pop(x.value) * stddev_pop(y.value)) END AS r
  FROM t x JOIN t y ON x.stimulus = y.stimulus AND x.frame = y.frame AND x.unit <> y.unit JOIN k ON k.stimulus = x.stimulus AND x.frame >= k.win * 4 AND x.frame < k.win * 4 + 10
  JOIN ok p ON p.stimulus = x.stimulus AND p.unit = x.unit JOIN ok q ON q.stimulus = y.stimulus AND q.unit = y.unit GROUP BY ALL HAVING count(*) = 10),
s AS (SELECT stimulus, u AS unit, avg(sd) AS fcv, avg(m) AS fcs FROM (SELECT stimulus, u, v, stddev_pop(r) AS sd, avg(r) AS m FROM pw GROUP BY ALL) GROUP BY ALL)
SELECT stimulus, unit, round((fcv - avg(fcv) OVER w) / stddev_pop(fcv) OVER w, 6) + 0.0 AS fcv_z, round((fcs - avg(fcs) OVER w) / stddev_pop(fcs) OVER w, 6) + 0.0 AS fcs_z FROM s WINDOW w AS (PARTITION BY stimulus)""")
def stimulus_fcv(spark, sf):
    """Variability over the concatenated frames of a condition (working
    days of an event type), z scored within it."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("recording"), F.pmod("user_id", F.lit(25)).cast("long").alias("unit"), F.to_date("ts").alias("day"), "value").where(F.dayofweek("day") != 1)
    from pyspark.sql import Window

    days = e.select("recording", "day").distinct().withColumn("frame", F.row_number().over(Window.partitionBy("recording").orderBy("day")) - 1)
    total = days.groupBy("recording").agg(F.count("*").cast("int").alias("n"))
    sums = e.groupBy("recording", "unit", "day").agg(F.sum("value").alias("value")).join(days, ["recording", "day"]).join(total, "recording")
    a = S.dense_series(sums, ["recording", "unit", "n"], "frame", "value", F.col("n")).where(S.unit_vector(F.col("values")).isNotNull())
    p = C.window_correlation(a.select("recording", "unit", "values"), 10, 4)
    by_pair = C.both_ways(p).groupBy("recording", "u", "v").agg(F.stddev_pop("r").alias("sd"), F.avg("r").alias("m"))
    s = by_pair.groupBy(F.col("recording").alias("stimulus"), F.col("u").alias("unit")).agg(F.avg("sd").alias("fcv"), F.avg("m").alias("fcs"))
    z = S.zscore(S.zscore(s, "fcv", ["stimulus"]), "fcs", ["stimulus"])
    return z.select("stimulus", "unit", rnd("fcv_z").alias("fcv_z"), rnd("fcs_z").alias("fcs_z"))


_STATES = TRACES_SQL + """,
q AS (SELECT recording, unit, min(n) = max(n) AS flat, list_distinct([quantile_cont(n, 0.25), quantile_cont(n, 0.5), quantile_cont(n, 0.75)]) AS edges FROM t GROUP BY ALL),
st AS (SELECT t.recording, t.unit, t.frame, CASE WHEN flat THEN -1 ELSE len(list_filter(edges, lambda e: e <= n)) END AS state FROM t JOIN q USING (recording, unit)),
tr AS (SELECT recording, unit, frame, state AS now, lead(state) OVER (PARTITION BY recording, unit ORDER BY frame) AS nxt FROM st WHERE state >= 0),
yx AS (SELECT y.recording, y.unit AS target, x.unit AS source, y.nxt AS y1, y.now AS y, x.now AS x FROM tr y JOIN tr x ON x.recording = y.recording AND x.frame = y.frame AND x.unit <> y.unit WHERE y.nxt IS NOT NULL),
te AS (SELECT recording, source, target, entropy(y1 * 10 + y) - entropy(y) - entropy(y1 * 100 + y * 10 + x) + entropy(y * 10 + x) AS te FROM yx GROUP BY ALL HAVING count(*) > 10)"""


def _te(spark, sf):
    long = S.rows(units(spark, sf, "count"), ["recording", "unit"])
    return C.transfer_entropy(C.quantile_bins(long, ["recording", "unit"]))


@query("quantile_states", f"WITH {_STATES} SELECT recording, unit, frame::INTEGER AS frame, state::BIGINT AS state FROM st")
def quantile_states(spark, sf):
    """Q1: quartile states of every frame."""
    return C.quantile_bins(S.rows(units(spark, sf, "count"), ["recording", "unit"]), ["recording", "unit"]).select("recording", "unit", "frame", "state")


@query("transfer_entropy", f"WITH {_STATES} SELECT recording, source, target, round(te, 6) + 0.0 AS te FROM te")
def transfer_entropy(spark, sf):
    """Transfer entropy of all ordered pairs."""
    return _te(spark, sf).select("recording", "source", "target", rnd("te").alias("te"))


@query("net_te_drive", f"""WITH {_STATES} SELECT a.recording, a.source AS unit, round(avg(a.te - b.te), 6) + 0.0 AS drive
FROM te a JOIN te b ON a.recording = b.recording AND a.source = b.target AND a.target = b.source GROUP BY ALL""")
def net_te_drive(spark, sf):
    """Mean net transfer of each unit."""
    return C.drive(C.net_transfer(_te(spark, sf))).select("recording", "unit", rnd("drive").alias("drive"))


@query("neighbor_drive")
def neighbor_drive(spark, sf):
    """Q4 Q5 Q6 ST15: drive over partners with significant mean correlation."""
    u = units(spark, sf, "count")
    n = u.agg(F.max(F.size("values"))).first()[0]
    return C.neighbour_drive(C.net_transfer(_te(spark, sf)), C.mean_correlation(u, WIDTH, STEP), n, 0.2)


@query("surrogate_null")
def surrogate_null(spark, sf):
    """Q7 Q8 W6 ST6 ST7: circular-shift null of the mean absolute net transfer, with
    cross-fitted exceedance of the pairs' 95th percentiles."""
    u = units(spark, sf, "count")
    shapes = u.groupBy("recording").agg(F.max("unit").alias("u"), F.max(F.size("values")).alias("n")).orderBy("recording").collect()  # one row a recording
    offsets = spark.createDataFrame(C.surrogate_offsets([(r["recording"], r["u"] + 1, r["n"]) for r in shapes], DRAWS, LEAST, 1307), "recording string, draw int, unit long, offset int")
    observed_units = u.withColumns({"draw": F.lit(-1), "offset": F.lit(0)})
    shifted = S.rolled(u.join(offsets, ["recording", "unit"]).unionByName(observed_units), F.col("offset"))
    te = C.transfer_entropy_arrays(shifted.select("recording", "draw", "unit", "values"), ["recording", "draw"])
    net = C.net_transfer(te.withColumn("recording", F.concat_ws("|", "recording", "draw")).drop("draw"))
    parts = F.split("recording", r"\|")
    net = net.where("source < target").select(parts[0].alias("recording"), parts[1].cast("int").alias("draw"), "source", "target", F.abs("net").alias("a"))
    null, obs = net.where("draw >= 0"), net.where("draw < 0")
    means = null.groupBy("recording", "draw").agg(F.avg("a").alias("v"))
    global_p = ST.empirical_p(means, obs.groupBy("recording").agg(F.avg("a").alias("obs")), "v", ["recording"])
    cut = null.groupBy("recording", "source", "target", (1 - F.col("draw") % 2).alias("other")).agg(F.percentile("a", F.lit(0.95)).alias("cut"))
    other = null.withColumn("other", F.col("draw") % 2).join(cut, ["recording", "source", "target", "other"])
    exceed = other.groupBy("recording").agg(F.avg((F.col("a") > F.col("cut")).cast("double")).alias("exceedance"))
    return global_p.join(exceed, "recording")


@query("traces_zscored", f"""WITH {TRACES_SQL} SELECT recording, unit, frame::INTEGER AS frame,
round(CASE WHEN stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w ELSE 0 END, 6) + 0.0 AS z FROM t WINDOW w AS (PARTITION BY recording, unit)""")
def traces_zscored(spark, sf):
    """Row z scores, 0 for constant rows."""
    return S.zscore(S.rows(units(spark, sf), ["recording", "unit"]), "value", ["recording", "unit"], 0, "zero", "z").select("recording", "unit", "frame", rnd("z").alias("z"))


@query("detrended", f"""WITH {TRACES_SQL}, f AS (SELECT recording, unit, regr_slope(value, frame) AS s, regr_intercept(value, frame) AS i FROM t GROUP BY ALL)
SELECT recording, unit, frame::INTEGER AS frame, round(value - i - s * frame, 6) + 0.0 AS value FROM t JOIN f USING (recording, unit)""")
def detrended(spark, sf):
    """Residuals of a line through each trace."""
    return S.detrended(S.rows(units(spark, sf), ["recording", "unit"]), ["recording", "unit"]).select("recording", "unit", "frame", rnd("value").alias("value"))


@query("preprocessed_traces")
def preprocessed_traces(spark, sf):
    """Detrend, zero-phase high-pass, z score."""
    long = S.detrended(S.rows(units(spark, sf), ["recording", "unit"]), ["recording", "unit"])
    h = S.highpass(S.series(long, ["recording", "unit"]), ["recording", "unit"], 0.03, 2.0)
    return S.zscore(S.rows(h, ["recording", "unit"]), "value", ["recording", "unit"], 0, "zero", "z")


@query("sine_removed")
def sine_removed(spark, sf):
    """Traces less their fitted slow sine."""
    return S.rows(S.sine_removed(units(spark, sf), ["recording", "unit"], 0.1, 0.5), ["recording", "unit"])


@query("smoothed", f"""WITH {TRACES_SQL} SELECT recording, unit, frame::INTEGER AS frame, round(coalesce(sum(value) OVER (PARTITION BY recording, unit ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) / 7, 6) + 0.0 AS value FROM t""")
def smoothed(spark, sf):
    """Moving sums over seven frames divided by seven."""
    a = units(spark, sf).withColumn("values", S.boxcar("values", 7))
    return S.rows(a, ["recording", "unit"]).select("recording", "unit", "frame", rnd("value").alias("value"))


@query("gaussian_smoothed", f"""WITH {TRACES_SQL}, g AS (SELECT k, exp(-0.5 * (k / 1.2) * (k / 1.2)) AS g FROM (SELECT unnest(range(-3, 4)) AS k))
SELECT t.recording, t.unit, t.frame::INTEGER AS frame, round(sum(o.value * g) / (SELECT sum(g) FROM g), 6) + 0.0 AS value FROM t CROSS JOIN g JOIN t o ON o.recording = t.recording AND o.unit = t.unit AND o.frame = t.frame + g.k GROUP BY t.recording, t.unit, t.frame""")
def gaussian_smoothed(spark, sf):
    """Seven Gaussian taps, zeros beyond the ends."""
    a = units(spark, sf).withColumn("values", S.gaussian("values"))
    return S.rows(a, ["recording", "unit"]).select("recording", "unit", "frame", rnd("value").alias("value"))


@query("circular_shift", f"""WITH {TRACES_SQL} SELECT recording, unit, ((frame + 3 * unit + 1) % (hi - lo + 1))::INTEGER AS frame, round(value, 6) + 0.0 AS value FROM t CROSS JOIN lim""")
def circular_shift(spark, sf):
    """Each trace shifted around its end."""
    a = S.rolled(units(spark, sf), F.col("unit") * 3 + 1)
    return S.rows(a, ["recording", "unit"]).select("recording", "unit", "frame", rnd("value").alias("value"))


@query("best_window", f"""WITH {TRACES_SQL}, s AS (SELECT recording, unit, frame, coalesce(sum(value) OVER (PARTITION BY recording, unit ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5 AS v FROM t),
k AS (SELECT unnest(range(0, (hi - lo + 1 - {WIDTH}) // {STEP} + 1)) AS win FROM lim),
d AS (SELECT recording, win, sum(sd) AS score FROM (SELECT recording, unit, win, stddev_pop(v) AS sd FROM s JOIN k ON frame >= win * {STEP} AND frame < win * {STEP} + {WIDTH} GROUP BY ALL) GROUP BY ALL)
SELECT recording, win::INTEGER AS win, round(score, 5) + 0.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, win) AS n FROM d) WHERE n = 1""")
def best_window(spark, sf):
    """The window with the largest sum of deviations."""
    return S.best_window(units(spark, sf), ["recording", "unit"], ["recording"], WIDTH, STEP, 5).select("recording", "win", rnd("score", 5).alias("score"))


@query("activity_runs", f"""WITH {TRACES_SQL}, c AS (SELECT recording, unit, frame, n > 0 AS on_ FROM t),
m AS (SELECT *, frame - row_number() OVER (PARTITION BY recording, unit, on_ ORDER BY frame) AS g FROM c)
SELECT recording, unit, on_ AS active, min(frame)::INTEGER AS start, max(frame)::INTEGER AS "end", count(*)::BIGINT AS n FROM m GROUP BY recording, unit, on_, g""")
def activity_runs(spark, sf):
    """Runs of frames with and without events."""
    long = S.rows(units(spark, sf, "count"), ["recording", "unit"]).withColumn("active", F.col("value") > 0)
    return S.runs(long, "active", ["recording", "unit"], "frame")


@query("running_peak", f"""WITH {TRACES_SQL} SELECT recording, unit, frame::INTEGER AS frame, max(n) OVER (PARTITION BY recording, unit ORDER BY frame) AS peak FROM t""")
def running_peak(spark, sf):
    """Running maximum."""
    return S.running(S.rows(units(spark, sf, "count"), ["recording", "unit"]), "value", ["recording", "unit"], ["frame"], "max", "peak").select("recording", "unit", "frame", "peak")


@query("state_entropy", f"WITH {_STATES} SELECT recording, unit, round(entropy(state), 6) + 0.0 AS h FROM st GROUP BY ALL")
def state_entropy(spark, sf):
    """Entropy of the states of each unit."""
    s = C.quantile_bins(S.rows(units(spark, sf, "count"), ["recording", "unit"]), ["recording", "unit"])
    return entropy_bits(s, ["recording", "unit"], ["state"]).select("recording", "unit", rnd("h").alias("h"))


@query("leave_one_out", f"""WITH {PAIRS_SQL},
f AS (SELECT recording, u AS unit, avg(sd) AS fcv, avg(m) AS fcs FROM (SELECT recording, u, v, stddev_pop(r) AS sd, avg(r) AS m FROM bw GROUP BY ALL) GROUP BY ALL),
o AS (SELECT DISTINCT recording AS omitted FROM f UNION ALL SELECT 'none'),
m AS (SELECT omitted, unit, avg(fcv) AS x, avg(fcs) AS y FROM f JOIN o ON recording <> omitted GROUP BY ALL)
SELECT omitted, count(*)::BIGINT AS n, round(corr(x, y), 6) + 0.0 AS r FROM m GROUP BY ALL""")
def leave_one_out(spark, sf):
    """Q9: correlation of unit means with each recording left out."""
    p = C.both_ways(_pairs(spark, sf)).groupBy("recording", "u", "v").agg(F.stddev_pop("r").alias("sd"), F.avg("r").alias("m")).groupBy("recording", F.col("u").alias("unit")).agg(F.avg("sd").alias("fcv"), F.avg("m").alias("fcs"))
    return ST.leave_one_out(p, "recording", "unit", "fcv", "fcs").select("omitted", "n", rnd("r").alias("r"))


@query("recording_similarity", f"""WITH {TRACES_SQL}, m AS (SELECT recording, unit, avg(value) AS v FROM t GROUP BY ALL),
z AS (SELECT recording, unit, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM m WINDOW w AS (PARTITION BY recording))
SELECT a.recording AS a, b.recording AS b, count(*)::BIGINT AS n, round(corr(a.z, b.z), 6) + 0.0 AS r FROM z a JOIN z b ON a.unit = b.unit AND a.recording < b.recording GROUP BY ALL""")
def recording_similarity(spark, sf):
    """Correlation of z scored unit profiles between recordings."""
    m = units(spark, sf).select("recording", "unit", S.mean_of(F.col("values")).alias("v"))
    z = S.zscore(m, "v", ["recording"], 0, "zero", "z")
    a, b = z.select(F.col("recording").alias("a"), "unit", F.col("z").alias("x")), z.select(F.col("recording").alias("b"), "unit", F.col("z").alias("y"))
    return ST.pearson(a.join(b, "unit").where("a < b"), "x", "y", ["a", "b"]).select("a", "b", "n", rnd("r").alias("r"))


@query("condition_sd", """WITH m AS (SELECT event_type AS c, user_id % 25 AS unit, avg(value) AS v FROM events GROUP BY ALL)
SELECT unit, count(*)::BIGINT AS n, round(stddev_pop(v), 6) + 0.0 AS sd FROM m GROUP BY ALL""")
def condition_sd(spark, sf):
    """Deviation over conditions of a unit's mean."""
    m = table(spark, sf, "events").groupBy("event_type", F.pmod("user_id", F.lit(25)).cast("long").alias("unit")).agg(F.avg("value").alias("v"))
    return m.groupBy("unit").agg(F.count("*").alias("n"), rnd(F.stddev_pop("v")).alias("sd"))


@query("node_z_over_recordings", f"""WITH {TRACES_SQL}, m AS (SELECT recording, unit, avg(value) AS v FROM t GROUP BY ALL),
z AS (SELECT recording, unit, v, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM m WINDOW w AS (PARTITION BY recording))
SELECT unit, count(*)::BIGINT AS n_recordings, round(avg(z), 6) + 0.0 AS z, round(avg(v), 6) + 0.0 AS raw FROM z GROUP BY ALL""")
def node_z_over_recordings(spark, sf):
    """Node means, z scored in each recording, then averaged."""
    m = units(spark, sf).select("recording", "unit", S.mean_of(F.col("values")).alias("v"))
    return S.zscore(m, "v", ["recording"], 0, "zero", "z").groupBy("unit").agg(F.count("*").alias("n_recordings"), rnd(F.avg("z")).alias("z"), rnd(F.avg("v")).alias("raw"))


@query("windowed_activity", """WITH w AS (SELECT user_id % 5 AS unit, value, ts, unnest(range(0, 4)) AS j FROM events),
s AS (SELECT unit, value, epoch_us(ts) // 216000000000 * 216000000000 - j * 216000000000 AS start FROM w)
SELECT start, unit, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS sd FROM s GROUP BY ALL""")
def windowed_activity(spark, sf):
    """Extension: event-time windows of ten days every 60 hours, also for streams."""
    from tesselon.streaming.windows import windowed_activity as w

    e = table(spark, sf, "events").select("ts", F.pmod("user_id", F.lit(5)).cast("long").alias("unit"), "value")
    e = e.withColumn("ts", F.timestamp_micros(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000_000 + F.hour("ts").cast("long") * 3_600_000_000 + F.minute("ts").cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), "ts") * 1_000_000).cast("long")))
    return w(e).select(F.unix_micros("start").alias("start"), "unit", "n", rnd("mean").alias("mean"), rnd("sd").alias("sd"))
