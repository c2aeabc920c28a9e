"""Event-time form of the sliding windows, for streams.

An extension: the reference semantics are those of batch windows over frame
indices. Late rows beyond the watermark are dropped, as Structured Streaming does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_activity(events: DataFrame, ts: str = "ts", unit: str = "unit", value: str = "value", width: str = "10 days", step: str = "60 hours", late: str = "1 day") -> DataFrame:
    """start, unit, n, mean, sd of each event-time window; works on a stream and on a
    batch alike."""
    w = F.window(F.col(ts).cast("timestamp"), width, step)
    source = events.withColumn(ts, F.col(ts).cast("timestamp"))
    source = source.withWatermark(ts, late) if source.isStreaming else source
    got = source.groupBy(w.alias("w"), F.col(unit)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return got.select(F.col("w.start").alias("start"), unit, "n", "mean", "sd")
