"""Readers of the Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the directory; columns and filters of later steps reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log_records(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Records of the fact log of the given types (pushed to the scan), each delivery kept."""
    return table(spark, sf_dir, "kg_log").where(F.col("t").isin(*kinds))
