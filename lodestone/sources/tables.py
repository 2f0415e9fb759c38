"""Loading of named Parquet tables from a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table `name`, with only `columns` if any are given, so that the scan reads no others."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def utc(df: DataFrame) -> DataFrame:
    """Timestamps without zone become timestamps in the session's zone (UTC by default), which watermarks need."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
