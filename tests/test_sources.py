import gzip
import hashlib
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesselon.sources import tables as T
from tesselon.streaming.windows import windowed_activity


def test_csv_round_trip_and_gzip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x\n1,0.5\n2,nan\n3,\n")
    df = T.read_csv(spark, str(tmp_path / "a.csv"), "k int, x double")
    assert [r["x"] for r in df.orderBy("k").collect()] == [0.5, None, None]
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("k,x\n4,1.5\n")
    assert T.read_csv(spark, str(tmp_path / "b.csv.gz")).first()["x"] == 1.5
    T.write_csv(df, str(tmp_path / "out"))
    assert T.read_csv(spark, str(tmp_path / "out"), "k int, x double").count() == 3
    both = T.read_csv(spark, str(tmp_path / "[ab].csv*"), "k int, x double", ["source_file", "k"])
    assert both.select("file_path").distinct().count() == 2


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "n.npz", edges=np.array([[1, 2], [3, 4]]), region=np.array([5, 6]))
    np.save(tmp_path / "ids.npy", np.array([7, 8, 9]))
    assert [r["value"] for r in T.read_arrays(spark, str(tmp_path / "n.npz"), "edges").orderBy("i", "j").collect()] == [1, 2, 3, 4]
    assert T.read_arrays(spark, str(tmp_path / "ids.npy")).count() == 3


def test_trusted_pickle_and_feather(spark, tmp_path):
    with open(tmp_path / "r.pkl", "wb") as f:
        pickle.dump({"traces": np.ones((2, 3)), "cluster_ids": [4, 5], "root_area_names": ["a", "b"], "recording_id": "x"}, f)
    T.convert_trusted_pickle(str(tmp_path / "r.pkl"), str(tmp_path / "r.parquet"))
    assert spark.read.parquet(str(tmp_path / "r.parquet")).select("unit", F.size("values").alias("n")).orderBy("unit").collect() == [(4, 3), (5, 3)]
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"a": [1, 2], "b": [3, 4]}), tmp_path / "t.feather")
    assert T.read_feather(spark, str(tmp_path / "t.feather"), str(tmp_path / "t.parquet"), ["b"]).columns == ["b"]


def test_inventory_and_manifest(spark, tmp_path):
    d = tmp_path / "raw" / "x"
    d.mkdir(parents=True)
    (d / "one.dat").write_bytes(b"abc")
    got = T.inventory(spark, str(tmp_path / "raw")).first()
    assert got["sha256"] == hashlib.sha256(b"abc").hexdigest() and got["bytes"] == 3
    m = spark.createDataFrame([("a", "x/*.dat"), ("b", "y/*.dat")], "name string, relative_path string")
    assert {r["name"]: (r["n_files"], r["status"]) for r in T.manifest_audit(spark, m, str(tmp_path / "raw")).collect()} == {"a": (1, "OK"), "b": (0, "MISSING")}
    with pytest.raises(FileNotFoundError):
        T.manifest_audit(spark, m, str(tmp_path / "raw"), strict=True)


def test_manifest_patterns_equal_globs(spark, tmp_path):
    root = tmp_path / "raw (a)"
    for name in ("a.txt", "b+c.txt", "x/a.txt", "x/ab.txt", "x/y/a.txt", "x/y/z$.dat", "x/y/q/a.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"1")
    globs = ["*.txt", "b+c.txt", "x/*.txt", "x/?.txt", "x/*/*.txt", "**/a.txt", "x/**/*.txt", "x/y/z$.dat", "x/*b.txt", "no/*.txt", "x/y/z.dat", "./a.txt", "x/[ab].txt", "x/[!b].txt", "x/a[a-c].txt"]
    want = {g: sum(p.is_file() for p in root.glob(g)) for g in globs} | {"x/y": 3, "x/": 5}
    m = spark.createDataFrame([(g, g) for g in want], "name string, relative_path string")
    assert {r["name"]: r["n_files"] for r in T.manifest_audit(spark, m, str(root)).collect()} == want


def test_cache_is_reused_if_complete(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert T.cached_if_complete(spark, str(tmp_path / "c"), make, 5).count() == 5
    assert len(calls) == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.col("id") * 40000).alias("ts"), (F.col("id") % 3).alias("unit"), (F.col("id") * 1.5).alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    q = windowed_activity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("activity").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("activity").collect())) == sorted(map(tuple, windowed_activity(rows).collect()))


def test_matlab_files(spark, tmp_path):
    import struct
    import zlib

    from tesselon.sources import matlab

    def element(kind, body):
        return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    def matrix(name, a, kind=6, body=None):
        a = np.asarray(a, float) if body is None else a
        head = element(6, struct.pack("<II", kind, 0)) + element(5, struct.pack("<ii", *a.shape)) + element(1, name.encode())
        return element(14, head + (element(9, a.tobytes(order="F")) if body is None else body))

    x, y = np.arange(6.0).reshape(2, 3), np.array([[7.5]])
    cell = matrix("c", np.empty((1, 2)), 1, matrix("", x) + matrix("", y))
    text = matrix("t", np.empty((1, 2)), 4, element(4, np.array([104, 105], "<u2").tobytes()))
    record = matrix("s", np.empty((1, 1)), 2, struct.pack("<HHi", 5, 4, 8) + element(1, b"f\0\0\0\0\0\0\0") + matrix("", y))
    packed = zlib.compress(matrix("z", y))
    data = b"MATLAB".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + matrix("x", x) + cell + text + record + struct.pack("<II", 15, len(packed)) + packed
    got = matlab.load(data)
    assert (got["x"] == x).all() and (got["c"][0, 0] == x).all() and got["t"] == "hi" and got["s"]["f"][0, 0] == 7.5 and got["z"][0, 0] == 7.5
    (tmp_path / "a.mat").write_bytes(data)
    assert matlab.read_matlab(spark, str(tmp_path / "a.mat"), "c").groupBy("cell").count().orderBy("cell").collect() == [(0, 6), (1, 1)]


def test_files_written_by_tasks_come_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"g {i % 3}", i / 2 if i % 5 else None) for i in range(40)], "k long, g string, x double")
    arrow = str(tmp_path / "arrow")
    assert T.write_feather(df.repartition(4).where("k < 38 AND k <> 7"), arrow) == 37
    got = T.read_feather(spark, f"{arrow}/*.arrow").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in df.where("k < 38 AND k <> 7").collect())
    assert T.write_feather(df.where("false"), str(tmp_path / "none")) == 0
    assert T.write_feather(df.repartition(4), arrow) == 40 and len(list((tmp_path / "arrow").iterdir())) <= 4  # a repeat replaces its files
    arrays = str(tmp_path / "arrays")
    assert T.write_arrays(df, arrays, "g", "k") == 3
    x = np.load(f"{arrays}/g 1.npz", allow_pickle=False)
    assert x["k"].tolist() == list(range(1, 40, 3)) and sorted(x.files) == ["k", "x"]
    back = T.read_arrays(spark, f"{arrays}/*.npz", "k").groupBy("path").agg({"value": "sum"}).collect()
    assert sorted(r[1] for r in back) == sorted(sum(range(i, 40, 3)) for i in range(3))
