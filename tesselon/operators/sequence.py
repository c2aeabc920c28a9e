"""Operators along an ordered frame index: windows, runs, smoothing, filters.

Traces come in two forms: long rows (keys, frame, value), and one row for each
series with its values as an array in frame order. Window kernels take the array
form: a window is a slice, and no frame is repeated as a row for each window.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import col, divide


def series(traces: DataFrame, keys: list[str], frame: str = "frame", value: str = "value") -> DataFrame:
    """keys, values: each series as an array in frame order."""
    return traces.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(frame, value))), lambda s: s[value]).alias("values"))


def dense_series(traces: DataFrame, keys: list[str], frame: str, value: str, n_frames: Column | int, fill: float = 0.0) -> DataFrame:
    """As series(), with every frame 0 .. n_frames - 1 present."""
    n = F.lit(n_frames) if isinstance(n_frames, int) else n_frames
    entries = traces.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(frame).cast("int"), F.col(value)))).alias("m"))
    return entries.select(*keys, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(fill))).alias("values"))


def rows(arrays: DataFrame, keys: list[str], values: str = "values") -> DataFrame:
    """Back to long rows."""
    return arrays.select(*keys, F.posexplode(values).alias("frame", "value"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean_of(a: Column) -> Column:
    return divide(total(a), F.size(a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once, also where body uses it inside a lambda
    (there it would be computed again for each element)."""
    return F.transform(F.array(value), body)[0]


def unit_vector(a: Column) -> Column:
    """The array centred and scaled to length 1; null where it is constant or has a
    missing value. The product of two such arrays is their Pearson r. Linear in the
    array: mean, centred array and length are each computed once."""
    scaled = lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda length: F.when(length > 1e-12, F.transform(c, lambda x: x / length)))
    return let(mean_of(a), lambda m: let(F.transform(a, lambda x: x - m), scaled))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sliding(arrays: DataFrame, keys: list[str], width: int, step: int, values: str = "values") -> DataFrame:
    """keys, win, window: slices of width frames every step (W4, F14);
    floor((n - width) / step) + 1 of each series, none if it is shorter."""
    n = F.floor((F.size(values) - width) / step).cast("int")
    return arrays.where(F.size(values) >= width).select(*keys, values, F.explode(F.sequence(F.lit(0), n)).alias("win")).select(*keys, "win", F.slice(values, F.col("win") * step + 1, F.lit(width)).alias("window"))


def windows_of_frames(long: DataFrame, width: int, step: int, n_frames: int, frame: str = "frame") -> DataFrame:
    """Each row once for every window that holds its frame, as win."""
    first = F.greatest(F.lit(0), F.ceil((F.col(frame) - (width - 1)) / step).cast("int"))
    last = F.least(F.lit((n_frames - width) // step), F.floor(F.col(frame) / step).cast("int"))
    return long.where(first <= last).withColumn("win", F.explode(F.sequence(first, last)))


def zscore(df: DataFrame, value: str, by: list[str], ddof: int = 0, on_constant: str = "null", name: str | None = None) -> DataFrame:
    """value as a z score within by (W1, W2, W15). on_constant: zero, null, raise or
    center (the difference from the mean) where the deviation is 0 (T6). Moments are
    aggregated and joined back, so a large group isn't gathered in one task; rows with a
    null key have no score."""
    sd = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    moments = (df.groupBy(*by) if by else df).agg(F.avg(value).alias("__mean"), sd.alias("__sd"))
    both = df.join(moments, by, "left") if by else df.crossJoin(F.broadcast(moments))  # without keys: one row
    z = divide(F.col(value) - F.col("__mean"), "__sd")
    flat = F.col("__sd").isNull() | (F.col("__sd") == 0)
    other = {
        "zero": F.when(F.col(value).isNotNull(), F.lit(0.0)),
        "null": F.lit(None).cast("double"),
        "center": F.col(value) - F.col("__mean"),
        "raise": F.raise_error(F.lit(f"{value} is constant")).cast("double"),
    }[on_constant]
    return both.withColumn(name or f"{value}_z", F.when(flat, other).otherwise(z)).drop("__mean", "__sd")


def running_total(df: DataFrame, order: str, n: str, name: str) -> DataFrame:
    """Sum of n over rows up to and including each, by order (a unique column), without
    gathering them: rows are range-partitioned, each partition sums its own, and the
    totals of the partitions before (one number each) are added."""
    from tesselon.operators.relational import checkpointed

    parts = checkpointed(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    before, offsets = 0, []
    for r in parts.groupBy("__p").agg(F.sum(n).alias("t")).orderBy("__p").collect():  # a row for each partition
        offsets.append((r["__p"], before))
        before += r["t"]
    if not offsets:
        return parts.drop("__p").withColumn(name, F.col(n))
    base = df.sparkSession.createDataFrame(offsets, "__p int, __before long")
    w = Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("__own", F.sum(n).over(w)).join(F.broadcast(base), "__p").withColumn(name, F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")


def avg_rank(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks from 1 within by, ties averaged; null values have none (W3, T8). Rows are
    counted by value first; ranks are those of the distinct values, joined back."""
    present = df.where(F.col(value).isNotNull())
    counts = present.groupBy(*by, value).agg(F.count("*").alias("__c"))
    if by:
        upto = counts.withColumn("__u", F.sum("__c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = running_total(counts, value, "__c", "__u")
    ranks = upto.select(*by, value, (F.col("__u") - (F.col("__c") - 1) / 2).alias(name))
    return present.join(ranks, [*by, value])


def lead_triples(long: DataFrame, keys: list[str], state: str, lag: int = 1, frame: str = "frame") -> DataFrame:
    """keys, frame, now, next: a state and the one lag frames later."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return long.select(*keys, frame, F.col(state).alias("now"), F.lead(state, lag).over(w).alias("next")).where("next IS NOT NULL")


def rolled(arrays: DataFrame, offset: Column, values: str = "values") -> DataFrame:
    """Each array shifted around its end by offset frames."""
    n = F.size(values)
    k = F.pmod(offset, n).cast("int")
    return arrays.withColumn(values, F.concat(F.slice(values, n - k + 1, k), F.slice(values, F.lit(1), n - k)))


def boxcar(values: str | Column, width: int) -> Column:
    """Centred moving sum divided by width, zeros beyond the ends."""
    a = col(values)
    half = width // 2
    return F.transform(
        a,
        lambda x, i: total(F.slice(a, F.greatest(i - half, F.lit(0)) + 1, F.least(i + width - half, F.size(a)) - F.greatest(i - half, F.lit(0)))) / width,
    )


def gaussian(values: str, sigma: float = 1.2, radius: int = 3) -> Column:
    """Normalised Gaussian taps, zeros beyond the ends."""
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps = (taps / taps.sum()).tolist()
    a = F.col(values)
    return F.transform(a, lambda x, i: sum((F.when((i + k >= 0) & (i + k < F.size(a)), F.get(a, i + k)).otherwise(0.0) * t for k, t in zip(range(-radius, radius + 1), taps, strict=True)), F.lit(0.0)))


def running(df: DataFrame, value: str, by: list[str], order: list[Column | str], how: str = "max", name: str = "running") -> DataFrame:
    """Running maximum or minimum."""
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, (F.max if how == "max" else F.min)(value).over(w))


def runs(df: DataFrame, value: str, by: list[str], frame: str) -> DataFrame:
    """by, value, start, end, n of each run of equal neighbours."""
    w = Window.partitionBy(*by or [F.lit(0)]).orderBy(frame)
    marked = df.withColumn("__new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    return marked.withColumn("__run", F.sum("__new").over(w)).groupBy(*by, "__run", value).agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("n")).drop("__run")


def well_width(df: DataFrame, by: list[str], x: str, u: str, depth: float) -> DataFrame:
    """Width of the contiguous part around the first minimum where u is at most its
    minimum plus depth (W11)."""
    w = Window.partitionBy(*by).orderBy(x)
    low = df.withColumn("__min", F.min(u).over(Window.partitionBy(*by)))
    marked = low.withColumn("__in", F.col(u) <= F.col("__min") + depth).withColumn("__break", F.sum((~F.col("__in")).cast("int")).over(w))
    islands = marked.where("__in").groupBy(*by, "__break").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.min(u).alias("__u"), F.first("__min").alias("__min"))
    first = Window.partitionBy(*by).orderBy("low")
    hit = islands.where("__u = __min").withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return hit.select(*by, "low", "high", (F.col("high") - F.col("low")).alias("width"))


def interpolated(known: DataFrame, grid: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, x, y of every grid point by linear interpolation; null outside."""
    points = known.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), F.lit(1).alias("known"))
    asked = known.select(*by).distinct().join(grid.select(F.col(x).alias("x")), how="cross") if not set(by) <= set(grid.columns) else grid.select(*by, F.col(x).alias("x"))
    both = points.unionByName(asked.withColumns({"y": F.lit(None).cast("double"), "known": F.lit(0)}))
    back = Window.partitionBy(*by).orderBy("x", F.desc("known")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy("x", "known").rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("known") == 1, F.struct("x", "y"))
    out = both.withColumn("a", F.last(seen, True).over(back)).withColumn("b", F.first(seen, True).over(ahead)).where("known = 0")
    at = F.when(F.col("a.x") == F.col("b.x"), F.col("a.y")).otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x")))
    return out.select(*by, F.col("x").alias(x), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), at).alias(y))


def endpoint_difference(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """y at the largest x minus y at the smallest."""
    return df.groupBy(*by).agg((F.max_by(y, x) - F.min_by(y, x)).alias("difference"))


def detrended(long: DataFrame, keys: list[str], frame: str = "frame", value: str = "value") -> DataFrame:
    """Residuals of a straight line through each series."""
    w = Window.partitionBy(*keys)
    slope = divide(F.covar_pop(frame, value).over(w), F.var_pop(frame).over(w))
    return long.withColumn(value, F.col(value) - F.avg(value).over(w) - F.coalesce(slope, F.lit(0.0)) * (F.col(frame) - F.avg(frame).over(w)))


def trimmed_spread(df: DataFrame, by: list[str], value: str, trim: tuple = (0.005, 0.995), spread: tuple = (0.05, 0.95)) -> DataFrame:
    """Percentile spread of the values within the trimming percentiles."""
    edges = df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, trim))).alias("__e"))
    inner = df.join(edges, by).where((F.col(value) >= F.col("__e")[0]) & (F.col(value) <= F.col("__e")[1]))
    return inner.groupBy(*by).agg((F.percentile(value, F.lit(spread[1])) - F.percentile(value, F.lit(spread[0]))).alias("spread"))


def padded_edges(df: DataFrame, by: list[str], value: str, bins: int, quantiles: tuple = (0.001, 0.999), pad: float = 0.25) -> DataFrame:
    """low, high, width of equal bins over the padded percentile range."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, quantiles))).alias("q"))
    span = F.col("q")[1] - F.col("q")[0]
    low, high = F.col("q")[0] - pad * span, F.col("q")[1] + pad * span
    return q.select(*by, low.alias("low"), high.alias("high"), ((high - low) / bins).alias("width"))


def best_window(arrays: DataFrame, keys: list[str], group: list[str], width: int, step: int, smooth: int) -> DataFrame:
    """The window of each group whose smoothed series have the largest sum of
    deviations, the first of equals (W18)."""
    sd = let(mean_of(F.col("window")), lambda m: F.sqrt(mean_of(F.transform("window", lambda x: F.pow(x - m, 2)))))
    score = sliding(arrays.withColumn("values", boxcar("values", smooth)), keys, width, step).withColumn("sd", sd).groupBy(*group, "win").agg(F.sum("sd").alias("score"))
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "win")
    return score.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed, second order."""
    out, (s, t) = np.empty_like(x), state
    for i, v in enumerate(x):
        y = b[0] * v + s
        s, t = b[1] * v - a[1] * y + t, b[2] * v - a[2] * y
        out[i] = y
    return out


def highpass_array(x: np.ndarray, cutoff: float, rate: float) -> np.ndarray:
    """Zero-phase second-order Butterworth high-pass: bilinear transform with
    prewarping, odd extension by 9 frames, steady-state initial conditions, forwards and
    backwards (W16)."""
    if cutoff <= 0 or len(x) <= 9:
        return x
    k = np.tan(np.pi * cutoff / rate)
    norm = 1 / (1 + np.sqrt(2) * k + k * k)
    b = np.array([1.0, -2.0, 1.0]) * norm
    a = np.array([1.0, 2 * (k * k - 1) * norm, (1 - np.sqrt(2) * k + k * k) * norm])
    steady = np.linalg.solve(np.array([[1 + a[1], -1.0], [a[2], 1.0]]), b[1:] - a[1:] * b[0])
    n = 9
    y = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    for _ in range(2):
        y = _filter(b, a, y, steady * y[0])[::-1]
    return y[n:-n]


def highpass(arrays: DataFrame, keys: list[str], cutoff: float, rate: float) -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: highpass_array(np.asarray(x, float), cutoff, rate))

    return arrays.select(*keys, run(F.col("values").cast("array<double>")).alias("values"))


def sine_removed(arrays: DataFrame, keys: list[str], frequency: float, dt: float) -> DataFrame:
    """Each series less its least-squares sine, cosine and constant of a frequency
    (W17)."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)
            t = 2 * np.pi * frequency * dt * np.arange(len(x))
            m = np.stack([np.sin(t), np.cos(t), np.ones_like(t)], axis=1)
            return x - m @ np.linalg.lstsq(m, x, rcond=None)[0]

        return v.map(one)

    return arrays.select(*keys, run(F.col("values").cast("array<double>")).alias("values"))
