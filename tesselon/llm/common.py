"""What the operators share: tables, the shared folder, small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast, after its rows and texts have been counted.
BROADCAST_BYTES = 32 << 20
#: Rows and bytes of a batch sent to a Python worker; rows of a batch read from Parquet.
BATCH_ROWS, BATCH_BYTES, READ_ROWS = 4096, 1 << 20, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where that is
    unset, a new local one is set on a single machine, and it is an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tesselon-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_made: set[str] = set()
_DRIVER = os.getpid()


def new_folder(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder; what lies there goes when the driver ends, if
    nothing deleted it before (dropped, scratch)."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _made.add(path)
    return path


@atexit.register
def _clear() -> None:
    for path in list(_made) if os.getpid() == _DRIVER else ():
        local = local_path(path)
        if local is not None:
            shutil.rmtree(local, ignore_errors=True)
        else:
            with contextlib.suppress(Exception):  # the session may have ended
                dropped(SparkSession.getActiveSession(), path)


def local_path(uri: str) -> str | None:
    """The path of a file: or plain URI, None for any other scheme."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: later uses
    neither recompute them nor carry their lineage."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder that is no longer needed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    _made.discard(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Gives written(), for tables that are deleted at the end."""
    paths: list[str] = []

    def keep(df: DataFrame, what: str) -> DataFrame:
        paths.append(new_folder(spark, what))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            dropped(spark, path)


def bounded(df: DataFrame) -> None:
    """Bound what a task holds by bytes: batches for Python workers end at BATCH_BYTES
    (or one long text), and Parquet is read READ_ROWS at a time. The settings are the
    same for all operators, so it does not matter when a lazy plan runs."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True if df has at most so many bytes, by a count of its rows and of the bytes of
    its strings."""
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    width = 32 + 8 * len(df.columns)
    size = F.count("*") * width + sum((F.coalesce(F.sum(F.octet_length(F.col(c)).cast("long")), F.lit(0)) for c in wide), F.lit(0))
    return df.agg(size.alias("size")).first()["size"] <= limit


def side(df: DataFrame) -> DataFrame:
    """df as a join's side: broadcast if it is small enough, else left to the planner."""
    return F.broadcast(df) if small_enough(df) else df


def crc_mod(column: str | Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def free_name(name: str, taken: list[str]) -> str:
    """A column name that no other column has."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name
