"""Readers and writers: CSV, Parquet, Arrow files, numpy bundles, manifests.

Array files are read as binary rows and unpacked by pandas functions, so any number
of them is read in parallel from any store that Spark reaches. Pickles and MATLAB
files are converted offline by convert_trusted_pickle; executors never unpickle.
"""

from __future__ import annotations

import io
import json
import pickle
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesselon.functions.scalars import clean


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, columns: list[str] | None = None, missing: bool = True) -> DataFrame:
    """CSV with a header, plain or gzip, one file or a glob (S1, S2, S9, S18). Without a
    schema types are inferred by a pass over the data. Doubles lose NaN and infinities
    unless missing is false. source_file holds each row's file if asked for."""
    r = spark.read.option("header", True).option("nanValue", "nan")
    df = (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)
    if columns is not None:
        df = df.select(*["_metadata.file_path" if c == "source_file" else c for c in columns])
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: clean(c) for c in doubles}) if missing and doubles else df


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where that is
    unset, a new local one on a single machine, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tesselon-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any store that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data))
    out.close()


def read_feather(spark: SparkSession, path: str, parquet: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Arrow files (Feather), each read by a task; the driver reads one for its schema.
    With parquet, by way of a Parquet table (S3)."""
    import pyarrow as pa
    import pyarrow.feather as feather
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")
    unpack = lambda content: feather.read_table(pa.BufferReader(bytes(content)), columns=columns)

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                yield from unpack(content).to_batches()

    df = files.mapInArrow(run, from_arrow_schema(unpack(files.first()["content"]).schema))
    if parquet is None:
        return df
    df.write.mode("overwrite").parquet(parquet)
    return spark.read.parquet(parquet)


def read_arrays(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """path, i, j, value of an array in .npz (by name) or .npy files; one-dimensional
    arrays have j = 0 (S4, S5). Object arrays are refused."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                a = np.atleast_1d(got[name] if name else got)
                a = a.reshape(len(a), -1)
                i, j = np.indices(a.shape)
                yield pd.DataFrame({"path": p, "i": i.ravel(), "j": j.ravel(), "value": a.ravel().astype(float)})

    return files.mapInPandas(run, "path string, i long, j long, value double")


def _put(folder: str, name: str, write) -> None:
    """A file of a folder in any store that a task reaches: write(sink) fills it under
    another name, then it gets its own, so a task that is repeated leaves one whole file."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    held = f"{at}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(held) as sink:
        write(sink)
    store.move(held, f"{at}/{name}")


def write_feather(df: DataFrame, path: str) -> int:
    """Arrow files (Feather), one written by each task, batch by batch; the number of rows
    (S3). A partition without rows has no file."""
    import pyarrow as pa
    from pyspark import TaskContext

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        n = [first.num_rows]

        def write(sink):
            with pa.ipc.new_file(sink, first.schema) as out:
                out.write_batch(first)
                for b in batches:
                    n[0] += b.num_rows
                    out.write_batch(b)

        _put(path, f"part-{TaskContext.get().partitionId():05d}.arrow", write)
        yield pa.RecordBatch.from_arrays([pa.array(n)], names=["n"])

    return df.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def write_arrays(df: DataFrame, path: str, by: str, order: str) -> int:
    """A bundle of named arrays (.npz) for each value of a column, with an array of every
    other column in the order of one of them; the number of bundles (S12). A bundle is
    written by one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        _put(path, f"{g[by].iloc[0]}.npz", lambda sink: sink.write(_bundle({c: g[c].to_numpy() for c in g.columns if c != by})))
        return pd.DataFrame({"n": [1]})

    return df.groupBy(by).applyInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _bundle(arrays: dict[str, np.ndarray]) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def write_array_table(df: DataFrame, path: str) -> None:
    """The Parquet form of an array bundle: one table for each array."""
    df.write.mode("overwrite").parquet(path)


def convert_trusted_pickle(path: str, parquet: str) -> None:
    """Offline: a pickled dict with traces [unit, frame], cluster_ids and root_area_names
    to a Parquet table recording_id, unit, region, values (S6). Only for files of
    one's own: unpickling runs code."""
    with open(path, "rb") as f:
        d = pickle.load(f)
    traces = np.asarray(d["traces"], float)
    pd.DataFrame({"recording_id": str(d["recording_id"]), "unit": list(d["cluster_ids"]), "region": list(d["root_area_names"]), "values": list(traces)}).to_parquet(parquet)


def read_config(path: str) -> dict:
    """A JSON configuration."""
    return json.loads(Path(path).read_text())


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_audit(spark: SparkSession, manifest: DataFrame, root: str, strict: bool = False) -> DataFrame:
    """Each row of manifest (name, relative_path: a file, a folder, or a glob) with
    n_files and status OK or MISSING; strict raises when one is missing (S10). ``*``, ``?``
    and ``[ ]`` stay inside a name, ``**`` is any number of folders; a folder counts all
    files below it. Files meet patterns by the folder before a pattern's first wildcard, an
    equi-join, whatever the number of either."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring("path", len(top) + 2, 1 << 30).alias("__file"))
    names = F.split("__file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    files = files.select("__file", F.explode(above).alias("__base"))
    path = F.regexp_replace("relative_path", "^(\\./)+|/+$", "")
    wild = path.rlike(r"[*?\[]")
    base = F.when(wild, F.regexp_replace(F.regexp_extract(path, r"^[^*?\[]*/", 0), "/$", "")).otherwise(path)
    pattern = F.regexp_replace(path, r"([.+(){}^$|\\])", r"\\$1")
    for glob, means in ((r"\*\*/", "\1"), (r"\[!", "[^"), (r"\?", "[^/]"), (r"\*", "[^/]*"), ("\1", "(?:[^/]+/)*")):
        pattern = F.regexp_replace(pattern, glob, means)
    asked = manifest.withColumns({"__base": base, "__wild": wild, "__pattern": F.concat(F.lit("^"), pattern, F.lit("$"))})
    matched = ~F.col("__wild") | F.regexp(F.col("__file"), F.col("__pattern"))
    found = asked.join(files, "__base", "left").withColumn("__hit", F.when(matched, F.col("__file")))
    out = found.groupBy(*manifest.columns).agg(F.count("__hit").alias("n_files")).withColumn("status", F.when(F.col("n_files") > 0, "OK").otherwise("MISSING"))
    if strict and (bad := out.where("status = 'MISSING'").limit(1).count()):
        raise FileNotFoundError(f"{bad} or more manifest entries have no file")
    return out


def cached_if_complete(spark: SparkSession, path: str, make, expected_rows: int) -> DataFrame:
    """The table stored at path if it has the expected rows, else made again."""
    try:
        old = spark.read.parquet(path)
        if old.count() == expected_rows:
            return old
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str) -> None:
    """Put the rows of new in place of rows of the same keys in the Parquet table at path,
    partitioned by a column that is one of the keys (S14). Only partitions that new has rows
    in are read and replaced; the others' files aren't touched. What replaces them is
    computed into the checkpoint folder first, and swapped in when all of it is written, so a
    run that dies before leaves the old table. Rows that repeat a key within new are an
    error."""
    from tesselon.operators.relational import CheckFailed, checkpointed, require_unique, upsert, with_keys

    if partition not in keys:
        raise CheckFailed(f"{partition} isn't one of the keys {keys}")
    new = checkpointed(require_unique(with_keys(new, keys), keys))
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], new.schema)
    touched = new.select(partition).distinct()
    rows = checkpointed(upsert(old.join(touched, partition, "left_semi"), new, keys).select(*new.columns))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
