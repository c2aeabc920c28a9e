"""Queries over files that are written from the tables first, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesselon.plans.catalogue import query
from tesselon.sources import tables as T

_CUSTOMERS = "SELECT c_custkey::BIGINT AS k, c_mktsegment AS g, c_acctbal AS x FROM customer"


def _folder(spark, what: str) -> str:
    return f"{T.shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _customers(spark, sf):
    return T.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("x"))


@query("csv_round_trip", _CUSTOMERS)
def csv_round_trip(spark, sf):
    """CSV files written and read by a glob with a schema."""
    path = _folder(spark, "csv")
    T.write_csv(_customers(spark, sf).repartition(3, "k"), path)
    return T.read_csv(spark, f"{path}/*.csv", "k long, g string, x double")


@query("csv_gzip_inferred", _CUSTOMERS)
def csv_gzip_inferred(spark, sf):
    """Compressed CSV, types inferred."""
    path = _folder(spark, "gzip")
    _customers(spark, sf).write.option("header", True).option("compression", "gzip").csv(path)
    return T.read_csv(spark, path).select(F.col("k").cast("long").alias("k"), "g", "x")


@query("arrow_scan", "SELECT c_custkey::BIGINT AS k, c_mktsegment AS g FROM customer")
def arrow_scan(spark, sf):
    """S3: Arrow files, written and read by tasks; columns are pruned."""
    path = _folder(spark, "arrow")
    T.write_feather(_customers(spark, sf).repartition(3, "k"), path)
    return T.read_feather(spark, f"{path}/*.arrow", columns=["k", "g"])


@query("array_scan", """SELECT c_mktsegment AS g, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, 0::BIGINT AS j, c_acctbal AS value FROM customer""")
def array_scan(spark, sf):
    """Bundles of arrays, written and read by tasks, one array of each stored as
    a table."""
    path = _folder(spark, "arrays")
    T.write_arrays(_customers(spark, sf), f"{path}/bundles", "g", "k")
    T.write_array_table(T.read_arrays(spark, f"{path}/bundles/*.npz", "x"), f"{path}/table")
    return spark.read.parquet(f"{path}/table").select(F.regexp_extract(F.url_decode("path"), r"([^/]+)\.npz$", 1).alias("g"), "i", "j", "value")


@query("manifest", """SELECT DISTINCT c_mktsegment AS name, 'g=' || c_mktsegment || '/part-*' AS relative_path, 1::BIGINT AS n_files, 'OK' AS status FROM customer
UNION ALL SELECT DISTINCT c_mktsegment || ' (old)', 'old/' || c_mktsegment || '/*.txt', 0, 'MISSING' FROM customer""")
def manifest(spark, sf):
    """Files behind each pattern of a manifest, of a table written in a folder for each
    market segment."""
    root, c = _folder(spark, "manifest"), _customers(spark, sf)
    c.repartition("g").write.partitionBy("g").parquet(root)
    names = c.select("g").distinct()
    there = names.select(F.col("g").alias("name"), F.format_string("g=%s/part-*", "g").alias("relative_path"))
    return T.manifest_audit(spark, there.unionAll(names.select(F.format_string("%s (old)", "g"), F.format_string("old/%s/*.txt", "g"))), root)


@query("file_inventory", """SELECT 'n=' || c_nationkey AS name, sum(octet_length(encode(c_name)) + 1)::BIGINT AS bytes, sha256(string_agg(c_name, chr(10) ORDER BY c_custkey) || chr(10)) AS sha256 FROM customer GROUP BY c_nationkey""")
def file_inventory(spark, sf):
    """Sizes and checksums of a folder's files, one of the customers of each nation."""
    root = _folder(spark, "inventory")
    c = T.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey", "c_name")
    c.repartition("n").sortWithinPartitions("n", "c_custkey").select("n", "c_name").write.partitionBy("n").text(root)
    return T.inventory(spark, f"{root}/n=*").select(F.regexp_extract("path", "(n=[^/]+)/[^/]+$", 1).alias("name"), "bytes", "sha256")


@query("json_settings", """SELECT r_name AS region, n_name AS node, n_nationkey::BIGINT AS id FROM nation JOIN region ON r_regionkey = n_regionkey""")
def json_settings(spark, sf):
    """Settings files, nested JSON of each region's nodes, read with a schema."""
    path = _folder(spark, "json")
    n, r = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    nested = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("region")).agg(F.collect_list(F.struct(F.col("n_name").alias("node"), F.col("n_nationkey").alias("id"))).alias("nodes"))
    nested.write.json(path)
    return spark.read.schema("region string, nodes array<struct<node: string, id: bigint>>").json(path).select("region", F.inline("nodes"))


@query("checked_cache", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def checked_cache(spark, sf):
    """A stored table that is complete is read, not made again."""
    path = _folder(spark, "cache")
    nations = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    T.cached_if_complete(spark, path, lambda: nations, 25)
    return T.cached_if_complete(spark, path, lambda: nations.limit(0), 25)


@query("upsert_sink", """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS g, c_acctbal AS x FROM customer), n AS (SELECT k, g, -x AS x FROM c WHERE g IN ('BUILDING', 'MACHINERY') AND k % 3 = 0)
SELECT * FROM n UNION ALL SELECT * FROM c WHERE k % 2 = 0 AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = c.k AND n.g = c.g)""")
def upsert_sink(spark, sf):
    """A stored table, new rows put into two of its partitions, read again."""
    path, c = _folder(spark, "upsert"), _customers(spark, sf)
    T.upsert_table(spark, path, c.where("k % 2 = 0"), ["g", "k"], "g")
    T.upsert_table(spark, path, c.where("g IN ('BUILDING', 'MACHINERY') AND k % 3 = 0").withColumn("x", -F.col("x")), ["g", "k"], "g")
    return spark.read.schema("k long, x double, g string").parquet(path)
