"""The jobs over growing and changed copies of the tables, after failures, and by command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, recordings, release

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def plain(rows):
    return sorted(repr(tuple(r)) for r in rows)


def rounded(df):
    return plain(df.select("recording", "unit", "n_events", "n_frames", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean", "sd", "fcv", "fcs")]).collect())


def from_sql(files):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet({files})")
    return plain(c.execute(queries.SQL["job1_recordings"]).fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("events", "documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = c.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain(df.select(*columns).collect()) == plain(cur.fetchall())


@pytest.fixture
def feed(spark, tmp_path):
    """A folder of events that grows: put(rows, name) adds a file."""
    events = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    folder = tmp_path / "events"
    folder.mkdir()

    def put(rows, name):
        rows.to_parquet(folder / f"{name}.parquet", index=False, coerce_timestamps="us")

    return events, folder, put


def files(folder):
    return {p.relative_to(folder): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("part-*")}


def test_second_run_takes_only_what_is_new(spark, tmp_path, feed):
    events, folder, put = feed
    config, out, mark = queries.settings("recordings"), str(tmp_path / "out"), str(tmp_path / "mark")
    run = lambda: recordings.run(spark, config, str(folder), out, mark)
    kinds = sorted(events["event_type"].unique())
    first, later = events[events.index % 3 > 0], events[events.index % 3 == 0]
    put(first, "a")
    assert rounded(run()) == from_sql([str(folder / "a.parquet")])
    before = files(out)
    # one recording grows, a new one comes
    more = later[later["event_type"] == kinds[0]].assign(event_type=lambda x: ["new/one" if i % 2 else kinds[0] for i in range(len(x))])
    put(more, "b")
    assert rounded(run()) == from_sql([str(folder / "a.parquet"), str(folder / "b.parquet")])
    batches = spark.read.parquet(f"{out}/activity/{os.listdir(f'{out}/activity')[0]}").groupBy("batch").agg(F.sum("n")).collect()
    assert sorted(r[1] for r in batches) == sorted([len(first), len(more)])
    after = files(out)
    touched = {k.parts[1] for k in after if k.parts[0] == "metrics" and before.get(k) != after[k]}
    assert touched == {f"recording={kinds[0]}", "recording=new%2Fone"}
    # nothing new
    assert rounded(run()) == from_sql([str(folder / "a.parquet"), str(folder / "b.parquet")])
    assert files(out) == after


@pytest.mark.parametrize("at", ["metrics", "traces", "activity"])
def test_a_run_that_died_is_completed_by_the_next(spark, tmp_path, feed, monkeypatch, at):
    events, folder, put = feed
    config, out, mark = queries.settings("recordings"), str(tmp_path / "out"), str(tmp_path / "mark")
    put(events[:500], "a")
    recordings.run(spark, config, str(folder), out, mark)
    put(events[500:], "b")

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(recordings, at, dies)
        with pytest.raises(Exception, match="lost"):
            recordings.run(spark, config, str(folder), out, mark)
    both = from_sql([str(folder / "a.parquet"), str(folder / "b.parquet")])
    assert rounded(recordings.run(spark, config, str(folder), out, mark)) == both
    # a new checkpoint counts nothing twice
    assert rounded(recordings.run(spark, config, str(folder), out, str(tmp_path / "other"))) == both


def test_events_without_a_place(spark, tmp_path, feed):
    events, folder, put = feed
    odd = events[:200].copy()
    odd["value"] = odd["value"].where(odd.index % 5 > 0)
    odd["event_type"] = odd["event_type"].where(odd.index % 7 > 0)
    odd["user_id"] = odd["user_id"].astype("Int64").where(odd.index % 11 > 0)
    put(odd, "a")
    out = recordings.run(spark, queries.settings("recordings"), str(folder), str(tmp_path / "out"), str(tmp_path / "mark"))
    assert rounded(out) == from_sql([str(folder / "a.parquet")])
    assert out.agg(F.sum("n_events")).first()[0] == len(odd.dropna(subset=["event_type", "user_id"]))


# --- release ---


@pytest.fixture
def tables(spark, tmp_path):
    """put(rows, name) writes the table documents or pages of a release."""

    def put(rows, folder="in"):
        df = spark.createDataFrame(rows, "doc_id long, part int, text string, source string")
        df.repartition(3).write.mode("overwrite").parquet(str(tmp_path / folder / "documents.parquet"))
        return str(tmp_path / folder)

    return put


CONFIG = {"tables": [{"name": "documents", "keys": ["doc_id", "part"], "text": "text", "group": "source"}], "expected": None}
ROWS = [(10, 1, "same é", "a"), (9, 1, "same é", "b"), (2, 1, None, "a"), (3, None, "lost", "a"), (4, 1, "", None), (5, 1, "twice", "b"), (5, 1, "others", "b")]


def test_inventory_of_a_release(spark, tmp_path, tables):
    at, out = tables(ROWS), str(tmp_path / "out")
    got = {(r["key"], r["n_chars"]): r for r in release.run(spark, CONFIG, at, out).collect()}
    assert len(got) == 7
    assert [got["10/1", 6][c] for c in ("first_key", "n_copies", "n_bytes", "key_state")] == ["9/1", 2, 7, "ok"]  # 9 comes before 10 as a number
    assert [got["2/1", None][c] for c in ("sha256", "first_key", "n_copies", "prefix")] == [None, None, None, "-"]
    assert got["3/", 4]["key_state"] == "missing" and got["5/1", 5]["key_state"] == "repeated"
    assert got["4/1", 0]["group_name"] is None and got["4/1", 0]["digest"] is not None
    m = {r["group_name"]: r for r in spark.read.parquet(f"{out}/manifest").collect()}
    assert [m["a"][c] for c in ("n_rows", "n_keys", "n_texts", "n_missing", "n_chars", "status")] == [3, 2, 2, 1, 10, "NEW"]
    again = plain(release.run(spark, CONFIG, at, out).collect())
    assert again == plain(got.values())


def test_audit_against_an_earlier_release(spark, tmp_path, tables):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    release.run(spark, CONFIG, tables(ROWS), old)
    # group a as it was in another order, b lost a row, the null group went, c came
    changed = [ROWS[3], ROWS[2], ROWS[0], ROWS[1], ROWS[5], (6, 1, "x", "c")]
    release.run(spark, CONFIG | {"expected": f"{old}/manifest"}, tables(changed, "later"), new)
    assert {r["group_name"]: r["status"] for r in spark.read.parquet(f"{new}/manifest").collect()} == {"a": "OK", "b": "CHANGED", None: "MISSING", "c": "NEW"}
    # one character
    moved = [(i, p, t.replace("lost", "lose") if t else t, s) for i, p, t, s in ROWS]
    release.run(spark, CONFIG | {"expected": f"{old}/manifest"}, tables(moved, "moved"), new)
    assert {r["group_name"]: r["status"] for r in spark.read.parquet(f"{new}/manifest").collect()} == {"a": "CHANGED", "b": "OK", None: "OK"}


def test_release_of_an_empty_table_and_wrong_settings(spark, tmp_path, tables):
    at, out = tables([]), str(tmp_path / "out")
    assert release.run(spark, CONFIG, at, out).collect() == []
    with pytest.raises(ValueError, match="missing columns"):
        release.run(spark, {"tables": [CONFIG["tables"][0] | {"text": "body"}], "expected": None}, at, out)


def test_a_table_that_shrinks_leaves_nothing_behind(spark, tmp_path, tables):
    out = str(tmp_path / "out")
    release.run(spark, CONFIG, tables(ROWS), out)
    assert len(release.run(spark, CONFIG, tables(ROWS[:1], "less"), out).collect()) == 1


@pytest.mark.parametrize("name,options", [("recordings", ["--input", f"{SF}/events.parquet*", "--output", "OUT", "--checkpoint", "MARK"]), ("release", ["--input", SF, "--output", "OUT"])])
def test_command_line(tmp_path, name, options):
    options = [str(tmp_path / o) if o in ("OUT", "MARK") else o for o in options]
    settings = tmp_path / "settings.json"
    settings.write_text(json.dumps(queries.settings(name)))
    got = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--config", str(settings), *options], cwd=ROOT, capture_output=True, text=True, timeout=300, check=False)
    assert got.returncode == 0, got.stderr[-2000:]
    assert "read" in got.stderr and list((tmp_path / "OUT").rglob("part-*.parquet"))
