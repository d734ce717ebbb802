"""Parquet tables of a vault and its corpus, by name under one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; only the columns a plan uses are read, filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column with or without zone (without: as UTC); null stays null."""
    kind = dict(df.dtypes)[name]
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{name}` as timestamp_ntz))")
