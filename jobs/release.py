"""Take stock of the text tables of a release and audit them against an earlier one.

    python -m jobs.release --config jobs/release.json --input TABLES --output OUT

For each table TABLES/name.parquet of the settings two partitioned tables are written:

    OUT/inventory/table_name=../prefix=..   key, group_name, sha256, n_chars, n_bytes, first_key, n_copies, key_state
    OUT/manifest/table_name=..              group_name, n_rows, n_keys, n_texts, n_missing, n_chars, digest, status

An inventory row is a row of the table: its text's checksum, the smallest key with the same
text, how many rows have it, and whether its key is ok, missing or repeated. prefix is the
checksum's first digit, so that a look-up by content reads one partition in 17 (missing texts
have ``-``). A manifest row is a group of the table: digest is the sum of 60 bits of the
checksum of each row's key and text, so it does not depend on the order of rows, and a row
changed, lost, added or moved changes it. Where the settings name an earlier manifest
(``expected``), status says how the group compares: OK, CHANGED, MISSING (only there) or NEW;
without one it is NEW.

Reruns: each table's partitions are written from the input alone and replace what was there,
so a run that died is repaired by the next, and a second run gives the same tables.

A null key part is shown as empty and makes the key missing; the null group is its own. Rows
of a hot group or of a text with many copies are pre-aggregated before they are shuffled, and
only rows whose text or key occurs more than once are joined to what they share.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, stored
from tesselon.operators import relational as R

log = logging.getLogger("release")

INVENTORY = "key string, group_name string, sha256 string, n_chars long, n_bytes long, first_key string, n_copies long, key_state string, table_name string, prefix string"
MANIFEST = "group_name string, n_rows long, n_keys long, n_texts long, n_missing long, n_chars long, digest decimal(38,0), status string, table_name string"


def key_text(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def fingerprints(df: DataFrame, spec: dict) -> DataFrame:
    """key, order (the key's parts), whole, group_name, sha256, n_chars, n_bytes of each row."""
    R.require_columns(df, [*spec["keys"], spec["text"], *([spec["group"]] if spec["group"] else [])])
    text = F.col(spec["text"])
    return df.select(
        key_text(spec["keys"]).alias("key"),
        F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(spec["keys"])]).alias("order"),
        reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in spec["keys"]]).alias("whole"),
        (F.col(spec["group"]).cast("string") if spec["group"] else F.lit("all")).alias("group_name"),
        F.sha2(text.cast("binary"), 256).alias("sha256"),
        F.length(text).cast("long").alias("n_chars"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def inventory(rows: DataFrame) -> DataFrame:
    """Rows of fingerprints() with first_key, n_copies and key_state."""
    texts = rows.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("n_copies"), F.min_by("key", "order").alias("first_key")).where("n_copies > 1")
    keys = R.duplicates(rows.where("whole"), ["key"]).withColumnRenamed("n_rows", "n_same")
    out = rows.join(texts, "sha256", "left").join(keys, "key", "left")
    state = F.when(~F.col("whole"), "missing").when(F.col("n_same") > 1, "repeated").otherwise("ok")
    return out.select(
        "key", "group_name", "sha256", "n_chars", "n_bytes",
        F.when(F.col("sha256").isNotNull(), F.coalesce("first_key", "key")).alias("first_key"),
        F.when(F.col("sha256").isNotNull(), F.coalesce("n_copies", F.lit(1))).cast("long").alias("n_copies"),
        state.alias("key_state"),
        F.coalesce(F.substring("sha256", 1, 1), F.lit("-")).alias("prefix"),
    )


def manifest(rows: DataFrame) -> DataFrame:
    """One row for each group of an inventory."""
    mark = F.sha2(F.concat_ws(":", "key", F.coalesce("sha256", F.lit(""))).cast("binary"), 256)
    bits = F.conv(F.substring(mark, 1, 15), 16, 10).cast("decimal(38,0)")
    by_text = rows.groupBy("group_name", "sha256", "n_chars").agg(F.count("*").alias("n"), F.count_if(F.col("key_state") == "ok").alias("n_ok"), F.sum(bits).alias("bits"))
    return by_text.groupBy("group_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum("n_ok").alias("n_keys"),
        F.count("sha256").alias("n_texts"),
        F.sum(F.when(F.col("sha256").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        F.coalesce(F.sum(F.col("n") * F.col("n_chars")), F.lit(0)).alias("n_chars"),
        F.sum("bits").cast("decimal(38,0)").alias("digest"),
    )


def audited(found: DataFrame, expected: DataFrame) -> DataFrame:
    """found with status; groups that only expected has come with their old figures."""
    old = expected.select(F.col("group_name").alias("o_group"), *[F.col(c).alias(f"o_{c}") for c in found.columns if c != "group_name"], F.lit(1).alias("o_there"))
    both = found.withColumn("there", F.lit(1)).join(old, F.col("group_name").eqNullSafe(F.col("o_group")), "full_outer")
    status = F.when(F.col("o_there").isNull(), "NEW").when(F.col("there").isNull(), "MISSING").when((F.col("digest") == F.col("o_digest")) & (F.col("n_rows") == F.col("o_n_rows")), "OK").otherwise("CHANGED")
    return both.select(*[F.when(F.col("there").isNull(), F.col("o_group" if c == "group_name" else f"o_{c}")).otherwise(F.col(c)).alias(c) for c in found.columns], status.alias("status"))


def run(spark: SparkSession, config: dict, tables: str, output: str) -> DataFrame:
    """Write inventory and manifest of every table; inventory rows with their group's
    digest and status."""
    for spec in config["tables"]:
        name = spec["name"]
        source = f"{tables}/{name}.parquet"
        at = f"{output}/inventory/table_name={name}"
        inventory(fingerprints(spark.read.parquet(source), spec)).write.mode("overwrite").partitionBy("prefix").parquet(at)
        rows = spark.read.schema(INVENTORY.replace(", table_name string", "")).parquet(at)
        expected = stored(spark, f"{config['expected']}/table_name={name}", MANIFEST.replace(", table_name string", "")) if config["expected"] else spark.createDataFrame([], MANIFEST)
        audited(manifest(rows), expected.drop("status", "table_name")).write.mode("overwrite").parquet(f"{output}/manifest/table_name={name}")
        for r in stored(spark, f"{output}/manifest/table_name={name}", MANIFEST.replace(", table_name string", "")).groupBy("status").agg(F.count("*").alias("groups"), F.sum("n_rows").alias("rows"), F.sum("n_missing").alias("missing")).collect():
            log.info("read %s: %s groups are %s, %s rows (%s without a text); wrote %s", source, r["groups"], r["status"], r["rows"], r["missing"], at)
    names = [t["name"] for t in config["tables"]]
    rows = stored(spark, f"{output}/inventory", INVENTORY).where(F.col("table_name").isin(names))
    groups = stored(spark, f"{output}/manifest", MANIFEST).where(F.col("table_name").isin(names)).select(F.col("table_name").alias("t"), F.col("group_name").alias("g"), "digest", "status")
    return rows.join(groups, (F.col("table_name") == F.col("t")) & F.col("group_name").eqNullSafe(F.col("g")), "left").drop("t", "g")


if __name__ == "__main__":
    main("release", ["input", "output"], run)
