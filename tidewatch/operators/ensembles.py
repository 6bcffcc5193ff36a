"""Combining predictions and feature tables by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expressions import nan_to_null


def concat(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def distinct_union(*tables: DataFrame) -> DataFrame:
    return concat(*tables).distinct()


def with_class_weight(df: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """Row weights by class, null labels included; a class without a weight keeps its rows, with weight null."""
    table = weights.select(F.col(label).alias("__class"), "weight")
    return df.join(table, df[label].eqNullSafe(table["__class"]), "left").drop("__class")


def align(predictions: DataFrame, truth: DataFrame, row_id: str) -> DataFrame:
    return predictions.join(truth, row_id)


def align_report(predictions: DataFrame, truth: DataFrame, row_id: str) -> DataFrame:
    """How far predictions and truth are from a one-to-one match."""
    side = lambda df, p, t: df.select(F.col(row_id), F.lit(p).alias("p"), F.lit(t).alias("t"))
    both = side(predictions, 1, 0).unionByName(side(truth, 0, 1)).groupBy(row_id).agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    hits = lambda c: F.count(F.when(c, 1))
    return both.agg(
        hits((F.col("p") == 1) & (F.col("t") == 1)).alias("matched"),
        hits((F.col("p") > 0) & (F.col("t") == 0)).alias("without_truth"),
        hits((F.col("p") == 0) & (F.col("t") > 0)).alias("without_prediction"),
        hits((F.col("p") > 1) | (F.col("t") > 1)).alias("repeated"),
    )


def stack_probas(long: DataFrame, models: list[str], row_id: str = "row_id") -> DataFrame:
    """One column per model; the model list is given, so no job is spent on finding it."""
    return long.groupBy(row_id).pivot("model_id", models).agg(F.first("proba"))


def compare_metrics(saved: DataFrame, new: DataFrame, tol: float = 1e-9) -> DataFrame:
    a = saved.select("metric", F.col("value").alias("saved"))
    b = new.select("metric", F.col("value").alias("recomputed"))
    both = a.join(b, "metric", "full_outer")
    return both.withColumn("same", F.coalesce(F.abs(F.col("saved") - F.col("recomputed")) <= tol, F.lit(False)))


def keep_features(long: DataFrame, features: DataFrame, key: str = "feature") -> DataFrame:
    return long.join(features.select(key), key, "left_semi")


def complement(every: DataFrame, kept: DataFrame, key: str = "feature") -> DataFrame:
    return every.join(kept.select(key), key, "left_anti")


def row_median(columns: list[Column]) -> Column:
    """Median over columns of one row; nulls are left out."""
    values = F.array_sort(F.array_compact(F.array(*columns)))
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(values, low) + F.get(values, high)) / 2)


def row_mean(columns: list[Column]) -> Column:
    known = [F.when(c.isNotNull(), 1).otherwise(0) for c in columns]
    total = sum([F.coalesce(c, F.lit(0.0)) for c in columns], F.lit(0.0))
    return F.try_divide(total, sum(known, F.lit(0)).cast("double"))


def blend_wide(df: DataFrame, models: list[str], how: str = "mean", out: str = "proba") -> DataFrame:
    """Blend score columns of the same row: no shuffle at all."""
    columns = [nan_to_null(F.col(m).cast("double")) for m in models]
    return df.withColumn(out, row_mean(columns) if how == "mean" else row_median(columns))


def blend(long: DataFrame, how: str = "mean", row_id: str = "row_id", keep: list[str] = ("y",)) -> DataFrame:
    """Blend stacked scores by row. A row's group is as large as the number of models."""
    p = nan_to_null(F.col("proba").cast("double"))
    agg = F.avg(p) if how == "mean" else F.median(p)
    return long.groupBy(row_id, *keep).agg(agg.alias("proba"))


def fold_mean(long: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Mean over fold models of each model's score of a row."""
    return long.groupBy("model_id", row_id).agg(F.avg(nan_to_null(F.col("proba"))).alias("proba"))
