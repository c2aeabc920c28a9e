"""Joins, aggregations and guards with the semantics of the analysis tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselon.functions.scalars import clean, col, divide
from tesselon.sources.tables import shared_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed into the shared checkpoint folder; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class CheckFailed(ValueError):
    """A table doesn't have the shape that was asked for."""


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [c for c in names if c not in df.columns]:
        raise CheckFailed(f"missing columns: {missing}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if duplicates(df, keys).limit(1).count():
        raise CheckFailed(f"keys {keys} repeat")
    return df


def require_rows(df: DataFrame, n: int) -> DataFrame:
    if (got := df.count()) != n:
        raise CheckFailed(f"{got} rows where {n} were expected")
    return df


def require_no_null(df: DataFrame, names: list[str]) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in names])
    if df.where(bad).limit(1).count():
        raise CheckFailed(f"nulls in {names}")
    return df


def with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, whose rows raise an error where a key is null or NaN, when they are read: joins
    would drop or match them otherwise than the analyses do (T9, T10). No job of its own."""
    wrong = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    bad = lambda k: F.col(k).isNull() | F.isnan(k) if k in wrong else F.col(k).isNull()
    return df.withColumns({k: F.when(bad(k), F.raise_error(F.lit(f"a key is missing: {k}")).cast(df.schema[k].dataType)).otherwise(F.col(k)) for k in keys})


def cleaned(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: clean(c) for c in names})


def join_checked(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join after its cardinality is checked."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for side in sides:
        require_unique(side, keys)
    return with_keys(left, keys).join(with_keys(right, keys), keys, how)


def outer_with_source(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with source: both, left_only or right_only."""
    a, b = with_keys(left, keys).withColumn("__l", F.lit(1)), with_keys(right, keys).withColumn("__r", F.lit(1))
    source = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, keys, "full_outer").withColumn("source", source).drop("__l", "__r")


def outer_zero_filled(left: DataFrame, right: DataFrame, keys: list[str], fill: float = 0) -> DataFrame:
    """Full outer join, missing measures filled."""
    out = with_keys(left, keys).join(with_keys(right, keys), keys, "full_outer")
    return out.na.fill(fill, [c for c in out.columns if c not in keys])


def with_endpoints(edges: DataFrame, nodes: DataFrame, key: str, src: str, dst: str) -> DataFrame:
    """Node attributes of both ends, as src_<name> and dst_<name> (J6, J7). Whether
    the nodes are broadcast is left to the size estimate."""
    rest = [c for c in nodes.columns if c != key]
    out = edges
    for end, at in (("src", src), ("dst", dst)):
        out = out.join(nodes.select(F.col(key).alias(at), *[F.col(c).alias(f"{end}_{c}") for c in rest]), at)
    return out


def densified(df: DataFrame, domain: DataFrame, keys: list[str], fill: dict) -> DataFrame:
    """Every key of domain, missing measures filled."""
    return domain.select(*keys).distinct().join(df, keys, "left").na.fill(fill)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that sorts last."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of rows of the same keys."""
    old, new = with_keys(old, keys), with_keys(new, keys)
    both = old.withColumn("__seq", F.lit(0)).unionByName(new.withColumn("__seq", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.col("__seq")]).drop("__seq")


def best_row(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of each key with the highest score, ties to the first by ties (A10)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *ties)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, ties to the smallest."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return best_row(n, keys, "__n", [value]).select(*keys, value)


def weighted_mean(df: DataFrame, keys: list[str], value: str | Column, weight: str, name: str) -> DataFrame:
    """sum(w x) / sum(w) of each key over rows where x is present."""
    x = col(value)
    return df.where(x.isNotNull()).groupBy(*keys).agg(divide(F.sum(x * F.col(weight)), F.sum(weight)).alias(name))


def unordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs with their multiplicity."""
    return df.groupBy(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """node, out/in degree and strength."""
    out = edges.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("out_degree"), F.sum(weight).alias("out_strength"))
    into = edges.groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("in_degree"), F.sum(weight).alias("in_strength"))
    return outer_zero_filled(out, into, ["node"])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: list[str] = ()) -> DataFrame:
    """bin, n, density of equal bins; the last is closed, values outside are dropped
    (A19)."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    n = inside.withColumn("bin", F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("long")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return n.withColumn("density", F.col("n") / (total * width))


def entropy_bits(df: DataFrame, keys: list[str], value: list[str], name: str = "h") -> DataFrame:
    """Shannon entropy of the value counts of each key."""
    n = df.groupBy(*keys, *value).agg(F.count("*").alias("__n"))
    # H = log2 N - sum(n log2 n) / N, one aggregation over the counts
    return n.groupBy(*keys).agg((F.log2(F.sum("__n")) - F.sum(F.col("__n") * F.log2("__n")) / F.sum("__n")).alias(name))


def long(df: DataFrame, keys: list[str], measures: list[str], name: str = "measure", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.select(*keys, *[F.col(m).cast("double") for m in measures]).unpivot(keys, measures, name, value)


def qc_block(df: DataFrame, figures: dict[str, Column]) -> DataFrame:
    """quantity, value (as text) of scalar figures."""
    one = df.agg(*[f.cast("string").alias(k) for k, f in figures.items()])
    return one.unpivot([], list(figures), "quantity", "value")


def in_all_groups(df: DataFrame, key: str, group: str) -> DataFrame:
    """Keys present in every group."""
    total = df.agg(F.countDistinct(group).alias("__all"))
    return df.groupBy(key).agg(F.countDistinct(group).alias("__n")).crossJoin(F.broadcast(total)).where("__n = __all").select(key)  # total is one row


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys in one table only; no rows if the sets are equal."""
    return outer_with_source(a.select(*keys).distinct(), b.select(*keys).distinct(), keys).where("source <> 'both'")


def compare(a: DataFrame, b: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-12) -> DataFrame:
    """One row for each key and measure that differs: values apart by more than
    atol + rtol * |b|, or present on one side only; missing equals missing (ST30)."""
    names = [c for c in a.columns if c not in keys]
    both = a.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in names], F.lit(1).alias("__a")).join(
        b.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in names], F.lit(1).alias("__b")), keys, "full_outer"
    )
    parts = F.array(*[F.struct(F.lit(c).alias("measure"), clean(f"a_{c}").alias("a"), clean(f"b_{c}").alias("b")) for c in names])
    rows = both.withColumn("source", F.when(F.col("__a").isNull(), "right_only").when(F.col("__b").isNull(), "left_only").otherwise("both")).select(*keys, "source", F.inline(parts))
    differs = F.col("a").isNull() != F.col("b").isNull()
    far = F.abs(F.col("a") - F.col("b")) > F.lit(atol) + F.lit(rtol) * F.abs(F.col("b"))
    return rows.where((F.col("source") != "both") | differs | F.coalesce(far, F.lit(False)))
