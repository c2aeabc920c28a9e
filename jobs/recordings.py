"""Keep unit traces and correlation variability of growing recordings up to date.

    python -m jobs.recordings --config jobs/recordings.json --input EVENTS --output OUT --checkpoint MARKS

A file stream takes the files of EVENTS (a folder of Parquet files, or a glob of files or
folders) that no earlier run took. Each batch is
summed to one row for each recording, unit and frame, and these sums are all that is kept of
the events:

    OUT/activity/stream=../batch=../recording=..   sums of one batch
    OUT/traces/recording=..                        unit, values: the dense trace
    OUT/metrics/recording=..                       unit, n_events, n_frames, mean, sd, fcv, fcs
    OUT/published                                  recording, stream, batch: what traces hold

Then the recordings whose newest batch is not published are computed again from their sums
and replace their own partitions; others stay as they are. A mark is appended last.

Reruns: a batch that is repeated replaces its own folder; a run that died before its mark
leaves recordings unpublished, which the next one computes again; a run without new files
changes nothing. A new checkpoint starts a new stream, whose sums alone count, so nothing is
counted twice.

Events without recording, unit or time have no place in a trace and are left out (logged); a
missing value counts as an event of value 0. A recording's frames run from its first event
to its last; fcv needs three windows, sd and correlations something that varies.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, stored
from tesselon.functions.scalars import clean
from tesselon.operators import connectivity
from tesselon.operators.sequence import dense_series, mean_of

log = logging.getLogger("recordings")

SUMS = "unit long, bin long, total double, n long, batch long, recording string"
TRACES = "unit long, n_events long, values array<double>, recording string"
PUBLISHED = "recording string, stream string, batch long"
METRICS = "unit long, n_events long, n_frames int, mean double, sd double, fcv double, fcs double, recording string"


def activity(events: DataFrame, config: dict) -> DataFrame:
    """recording, unit, bin, total, n: the values and events of each frame."""
    hours = config["frame_hours"]
    if 24 % hours:
        raise ValueError("frame_hours must divide a day")
    day = F.datediff(F.to_date(config["time"]), F.lit("1970-01-01").cast("date"))
    placed = events.select(
        F.col(config["recording"]).cast("string").alias("recording"),
        F.pmod(F.col(config["unit"]), F.lit(config["units"])).cast("long").alias("unit"),
        (day * (24 // hours) + F.floor(F.hour(config["time"]) / hours)).cast("long").alias("bin"),
        F.coalesce(clean(config["value"]), F.lit(0.0)).alias("value"),
    ).dropna(subset=["recording", "unit", "bin"])
    return placed.groupBy("recording", "unit", "bin").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def stream_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream that a checkpoint belongs to."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def ingest(spark: SparkSession, config: dict, events: str, output: str, checkpoint: str) -> None:
    """Sum every file that is new; wait for the stream to end."""

    def batch(df: DataFrame, number: int) -> None:
        path = f"{output}/activity/stream={stream_of(df.sparkSession, checkpoint)}/batch={number}"
        activity(df, config).write.mode("overwrite").partitionBy("recording").parquet(path)

    schema = spark.read.parquet(events).schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(events)
    query = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        if p.numInputRows:
            log.info("read batch %s: %s events of %s", p.batchId, p.numInputRows, events)


def traces(sums: DataFrame) -> DataFrame:
    """recording, unit, n_events, values: dense traces from the recording's first frame to
    its last."""
    by_frame = sums.groupBy("recording", "unit", "bin").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    ends = by_frame.groupBy("recording").agg(F.min("bin").alias("first"), (F.max("bin") - F.min("bin") + 1).cast("int").alias("frames"))
    framed = by_frame.join(ends, "recording").select("recording", "unit", "frames", (F.col("bin") - F.col("first")).alias("frame"), "total")
    events = by_frame.groupBy("recording", "unit").agg(F.sum("n").alias("n_events"))
    dense = dense_series(framed, ["recording", "unit", "frames"], "frame", "total", F.col("frames"))
    return dense.join(events, ["recording", "unit"]).select("recording", "unit", "n_events", "values")


def metrics(units: DataFrame, config: dict) -> DataFrame:
    """recording, unit, n_events, n_frames, mean, sd, fcv, fcs of traces."""
    pairs = connectivity.window_correlation(units, config["window"], config["step"])
    mean = mean_of(F.col("values"))
    spread = F.sqrt(mean_of(F.transform("values", lambda x: (x - F.col("mean")) * (x - F.col("mean")))))
    plain = units.select("recording", "unit", "n_events", F.size("values").alias("n_frames"), mean.alias("mean"), "values").withColumn("sd", spread).drop("values")
    for part in (connectivity.variability(pairs), connectivity.strength(pairs)):
        plain = plain.join(part, ["recording", "unit"], "left")
    return plain


def replaced(rows: DataFrame, path: str) -> None:
    """Write rows in place of the partitions of their recordings, and of no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("recording").parquet(path)


def refresh(spark: SparkSession, config: dict, output: str, stream: str) -> int:
    """Compute the unpublished recordings again; how many they are."""
    sums = stored(spark, f"{output}/activity/stream={stream}", SUMS)
    newest = sums.groupBy("recording").agg(F.max("batch").alias("batch"))
    done = stored(spark, f"{output}/published", PUBLISHED).where(F.col("stream") == stream).groupBy("recording").agg(F.max("batch").alias("done"))
    due = newest.join(done, "recording", "left").where("done IS NULL OR done < batch").select("recording", F.lit(stream).alias("stream"), "batch")
    if due.isEmpty():
        return 0
    replaced(traces(sums.join(due, "recording", "left_semi")), f"{output}/traces")
    fresh = spark.read.schema(TRACES).parquet(f"{output}/traces").join(due, "recording", "left_semi")
    replaced(metrics(fresh, config), f"{output}/metrics")
    n = due.count()
    due.write.mode("append").parquet(f"{output}/published")
    return n


def run(spark: SparkSession, config: dict, events: str, output: str, checkpoint: str) -> DataFrame:
    """Take what is new, refresh what it touches; the metrics as they stand."""
    ingest(spark, config, events, output, checkpoint)
    n = refresh(spark, config, output, stream_of(spark, checkpoint))
    out = stored(spark, f"{output}/metrics", METRICS)
    log.info("refreshed %s recordings in %s, which holds %s units", n, output, out.count())
    return out


if __name__ == "__main__":
    main("recordings", ["input", "output", "checkpoint"], run)
