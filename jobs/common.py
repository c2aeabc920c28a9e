"""Command line and reading helpers of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON settings file in any store that Spark reads."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; no rows if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def main(what: str, paths: list[str], run: Callable) -> None:
    """Parse --config and one option for each path, and call run(spark, config, *paths) in
    a session of its own."""
    p = argparse.ArgumentParser(description=what)
    p.add_argument("--config", required=True)
    for name in paths:
        p.add_argument(f"--{name}", required=True)
    args = p.parse_args(sys.argv[1:])
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(what).getOrCreate()
    try:
        run(spark, read_config(spark, args.config), *(getattr(args, name) for name in paths))
    finally:
        spark.stop()
