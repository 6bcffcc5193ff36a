"""Parquet tables and the encoded matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_matrix(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Encoded matrix ``(row_id, features, label[, split])``; a split prunes partitions."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)
