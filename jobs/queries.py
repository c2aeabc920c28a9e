"""The jobs as registered queries: each runs twice into one new folder of the shared
place and returns what stands there then."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import recordings, release
from tesselon.sources.tables import shared_folder

_HERE = Path(__file__).parent


def settings(name: str) -> dict:
    return json.loads((_HERE / f"{name}.json").read_text())


def job1_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces and variability of growing recordings."""
    at = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    for _ in range(2):
        out = recordings.run(spark, settings("recordings"), f"{sf_dir}/events.parquet*", f"{at}/out", f"{at}/checkpoint")
    r = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return out.select("recording", "unit", "n_events", "n_frames", r("mean"), r("sd"), r("fcv"), r("fcs"))


def job2_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 S17 P20 A23 J3 ST30: inventory and audit of the text tables."""
    at = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    for _ in range(2):
        out = release.run(spark, settings("release"), sf_dir, at)
    return out.withColumn("digest", F.col("digest").cast("string"))


_METRICS = """
WITH b AS (SELECT event_type AS recording, user_id % 25 AS unit,
  date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 2 + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS bin, coalesce(value, 0) AS value
  FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL AND ts IS NOT NULL),
lim AS (SELECT recording, min(bin) AS lo, max(bin) AS hi FROM b GROUP BY ALL),
fr AS (SELECT recording, unnest(range(lo, hi + 1)) - lo AS frame, lo FROM lim),
un AS (SELECT recording, unit, count(*)::BIGINT AS n_events FROM b GROUP BY ALL),
t AS (SELECT un.recording, un.unit, fr.frame, coalesce(sum(b.value), 0) AS value
  FROM un JOIN fr USING (recording) LEFT JOIN b ON b.recording = un.recording AND b.unit = un.unit AND b.bin = fr.frame + fr.lo GROUP BY ALL),
k AS (SELECT recording, unnest(range(0, (hi - lo + 1 - 20) // 5 + 1)) AS win FROM lim),
pw AS (SELECT x.recording, k.win, x.unit AS u, y.unit AS v,
  CASE WHEN stddev_pop(x.value) > 1e-13 AND stddev_pop(y.value) > 1e-13
    THEN greatest(-1, least(1, covar_pop(x.value, y.value) / (stddev_pop(x.value) * stddev_pop(y.value)))) END AS r
  FROM t x JOIN t y ON x.recording = y.recording AND x.frame = y.frame AND x.unit < y.unit
  JOIN k ON k.recording = x.recording AND x.frame >= k.win * 5 AND x.frame < k.win * 5 + 20 GROUP BY ALL),
bw AS (SELECT recording, win, u, v, r FROM pw UNION ALL SELECT recording, win, v, u, r FROM pw),
fcv AS (SELECT recording, u AS unit, CASE WHEN min(n) >= 3 THEN avg(sd) END AS fcv FROM (SELECT recording, u, v, stddev_pop(r) AS sd, count(*) AS n FROM bw GROUP BY ALL) GROUP BY ALL),
fcs AS (SELECT recording, u AS unit, avg(m) AS fcs FROM (SELECT recording, u, win, avg(r) AS m FROM bw GROUP BY ALL) GROUP BY ALL),
s AS (SELECT recording, unit, count(*)::INTEGER AS n_frames, avg(value) AS mean, stddev_pop(value) AS sd FROM t GROUP BY ALL)
SELECT recording, unit, n_events, n_frames, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(fcv, 6) + 0.0 AS fcv, round(fcs, 6) + 0.0 AS fcs
FROM un JOIN s USING (recording, unit) LEFT JOIN fcv USING (recording, unit) LEFT JOIN fcs USING (recording, unit)"""


def _inventory(spec: dict) -> str:
    keys = spec["keys"]
    key = " || '/' || ".join(f"coalesce({k}::VARCHAR, '')" for k in keys)
    group = f"{spec['group']}::VARCHAR" if spec["group"] else "'all'"
    return (
        f"SELECT '{spec['name']}' AS table_name, {key} AS key, {' AND '.join(f'{k} IS NOT NULL' for k in keys)} AS whole, {group} AS group_name, sha256({spec['text']}) AS sha256,"
        f" length({spec['text']})::BIGINT AS n_chars, octet_length(encode({spec['text']}))::BIGINT AS n_bytes, row_number() OVER (ORDER BY {', '.join(f'{k} NULLS FIRST' for k in keys)}) AS place FROM {spec['name']}"
    )


_RELEASE = f"""
WITH r AS ({" UNION ALL ".join(_inventory(t) for t in settings("release")["tables"])}),
x AS (SELECT *, count(*) OVER (PARTITION BY table_name, sha256) AS copies, count(*) FILTER (WHERE whole) OVER (PARTITION BY table_name, key) AS same,
  first_value(key) OVER (PARTITION BY table_name, sha256 ORDER BY place) AS first FROM r),
g AS (SELECT table_name, group_name, sum(('0x' || substr(sha256(key || ':' || coalesce(sha256, '')), 1, 15))::HUGEINT)::VARCHAR AS digest FROM r GROUP BY ALL)
SELECT x.table_name, x.key, x.group_name, x.sha256, n_chars, n_bytes, CASE WHEN sha256 IS NOT NULL THEN first END AS first_key, CASE WHEN sha256 IS NOT NULL THEN copies END AS n_copies,
  CASE WHEN NOT whole THEN 'missing' WHEN same > 1 THEN 'repeated' ELSE 'ok' END AS key_state, coalesce(substr(sha256, 1, 1), '-') AS prefix, digest, 'NEW' AS status
FROM x JOIN g ON g.table_name = x.table_name AND g.group_name IS NOT DISTINCT FROM x.group_name"""

QUERIES = {"job1_recordings": job1_recordings, "job2_release": job2_release}
SQL = {"job1_recordings": _METRICS, "job2_release": _RELEASE}
