"""Leakage scan: values that give the label away."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.functions.expressions import ratio
from tidewatch.operators.columns import numeric_columns
from tidewatch.operators.profiling import counted_values
from tidewatch.operators.statistics import information, information_sums, label_sums, mutual_info, pearson

# Label means at or beyond which a value is called deterministic.
LOW, HIGH = 0.001, 0.999


def cells(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """(feature, value, pos, neg, n): the counts the whole scan reads from."""
    y = F.col(label).cast("long").alias("__y")
    return counted_values(df, names, label_sums("__y"), [y]).withColumn("n", F.col("pos") + F.col("neg"))


def label_rate(df: DataFrame, names: list[str], label: str) -> DataFrame:
    return rates(cells(df, names, label))


def rates(table: DataFrame) -> DataFrame:
    """Rows and label mean of each value; a missing value is no group."""
    return table.where(F.col("value").isNotNull()).select(
        "feature", "value", "n", ratio(F.col("pos"), F.col("n")).alias("label_mean")
    )


def _deterministic(low: float, high: float, min_support: int):
    mean = ratio(F.col("pos"), F.col("n"))
    return F.col("value").isNotNull() & (F.col("n") >= min_support) & ((mean <= low) | (mean >= high))


def deterministic_values(
    df: DataFrame, names: list[str], label: str, low: float = LOW, high: float = HIGH, min_support: int = 1
) -> DataFrame:
    table = cells(df, names, label)
    is_det = _deterministic(low, high, min_support)
    return table.groupBy("feature").agg(
        F.count(F.when(is_det, 1)).alias("deterministic_values"),
        F.coalesce(F.sum(F.when(is_det, F.col("n"))), F.lit(0)).alias("rows_covered"),
        ratio(F.coalesce(F.sum(F.when(is_det, F.col("n"))), F.lit(0)), F.sum("n")).alias("rows_covered_pct"),
    )


def deterministic_examples(
    df: DataFrame, names: list[str], label: str, k: int = 5, low: float = LOW, high: float = HIGH, min_support: int = 1
) -> DataFrame:
    found = cells(df, names, label).where(_deterministic(low, high, min_support))
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    return found.select(
        "feature", "value", "n", ratio(F.col("pos"), F.col("n")).alias("label_mean"), F.row_number().over(order).alias("rank")
    ).where(F.col("rank") <= k)


def leakage_scan(
    df: DataFrame, names: list[str], label: str, bins: int = 10, k: int = 5,
    low: float = LOW, high: float = HIGH, min_support: int = 1,
) -> DataFrame:
    """Everything known about each feature, strongest mutual information first.

    ``label`` must be 0/1. Text columns use their values for mutual information,
    numeric columns exact quantile bins; correlation is for numeric columns only.
    """
    numbers = [c for c in numeric_columns(df) if c in names]
    texts = [c for c in names if c not in numbers]
    table = cells(df, names, label)
    is_det = _deterministic(low, high, min_support)
    covered = F.coalesce(F.sum(F.when(is_det, F.col("n"))), F.lit(0))
    stats = table.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"), ratio(F.count(F.lit(1)), F.sum("n")).alias("prop_unique"),
        F.count(F.when(is_det, 1)).alias("deterministic_values"), covered.alias("rows_covered"),
        ratio(covered, F.sum("n")).alias("rows_covered_pct"), *information_sums(),
    ).withColumn("of_values", information()).drop("__inner", "__pos", "__neg")
    common = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    top = (
        table.withColumn("r", F.row_number().over(common)).where(F.col("r") <= k)
        .groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("r", "value", "n"))).alias("t"))
        .select("feature", F.transform("t", lambda x: F.concat_ws("=", x["value"], x["n"].cast("string"))).alias("top_values"))
    )
    out = stats.join(top, "feature", "left")
    if numbers:
        binned = mutual_info(df, numbers, label, bins).withColumnRenamed("mutual_information", "of_bins")
        out = out.join(binned, "feature", "left").join(pearson(df, numbers, label), "feature", "left")
        is_text = F.col("feature").isin(texts) if texts else F.lit(False)
        out = out.withColumn("mutual_information", F.when(is_text, F.col("of_values")).otherwise(F.col("of_bins"))).drop("of_bins")
    else:
        out = out.withColumns({"mutual_information": F.col("of_values"), "correlation": F.lit(None).cast("double")})
    out = out.drop("of_values")
    return out.orderBy(F.col("mutual_information").desc_nulls_last(), "feature")
