"""Parquet tables, the storage of choice for large packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions.names import POS, col, data_columns


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    """Table with the positions it was written with."""
    df = spark.read.parquet(path)
    return df.select(*[col(c).cast("string").alias(c) for c in data_columns(df)], F.col(POS))


def write_parquet_table(df: DataFrame, path: str) -> None:
    """Positions are stored as a column, so no sort is needed to keep the order."""
    df.write.mode("overwrite").parquet(path)
