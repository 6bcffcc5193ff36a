"""Sinks: matrices, predictions, metrics and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewatch.sources.delimited import head_sample


def write_matrix(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_predictions(df: DataFrame, path: str, columns: list[str] | None = None, fmt: str = "csv") -> None:
    """One schema everywhere: ``row_id, proba, pred`` and, with truth, ``true``."""
    if columns is None:
        columns = ["row_id", "proba", "pred"] + (["true"] if "true" in df.columns else [])
    writer = df.select(*columns).write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def with_scores(df: DataFrame, scored: DataFrame, row_id: str, threshold: float) -> DataFrame:
    """Input columns with ``proba`` and ``pred`` added; rows without a score stay, with both null."""
    joined = df.join(scored.select(row_id, "proba"), row_id, "left")
    return joined.withColumn("pred", (F.col("proba") >= F.lit(float(threshold))).cast("int"))


def write_metrics(df: DataFrame, path: str) -> None:
    """Metric tables have a row per model and metric: one file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_head(df: DataFrame, row_id: str, n: int, path: str) -> None:
    head_sample(df, row_id, n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
