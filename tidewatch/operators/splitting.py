"""Splits, folds and samples that do not depend on row order or partitioning.

Rows are ordered by a seeded hash of their key. A split is a comparison with
the key found at the wanted rank of each class, so the data itself is scanned,
not sorted or shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.expressions import hash_key, hash_uniform
from tidewatch.operators.ordering import cut_keys, hash_rank, join_null_safe, ordered_index
from tidewatch.session import write_scratch

ALL = "__all"


def _strata(df: DataFrame, label: str | None) -> tuple[DataFrame, list[str]]:
    return (df, [label]) if label else (df.withColumn(ALL, F.lit(0)), [ALL])


def _row_key(row_id: str, seed: int) -> Column:
    return F.struct(hash_key(row_id, seed).alias("h"), F.col(row_id).alias("i"))


def _up_to_cut(df: DataFrame, strata: list[str], row_id: str, seed: int, targets) -> DataFrame:
    """Rows with ``__in``: whether their key is at or before the cut of their stratum."""
    cuts = cut_keys(df, strata, row_id, seed, targets).select(
        *strata, F.struct(F.col("cut_hash").alias("h"), F.col("cut_id").alias("i")).alias("cut")
    )
    joined = join_null_safe(df, write_scratch(cuts), strata, "left")
    return joined.withColumn("__in", F.coalesce(_row_key(row_id, seed) <= F.col("cut"), F.lit(False))).drop("cut")


def stratified_split(df: DataFrame, label: str | None, row_id: str, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Add ``split``: of each class the first ``max(1, floor(n * test))`` rows are test."""
    base, strata = _strata(df, label)
    share = lambda n: F.array(F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(float(test)))))
    marked = _up_to_cut(base, strata, row_id, seed, share)
    return marked.withColumn("split", F.when(F.col("__in"), "test").otherwise("train")).drop("__in", ALL)


def safe_split(df: DataFrame, label: str, row_id: str, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Stratified, or plain when some class has fewer than two rows."""
    fewest = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return stratified_split(df, label if (fewest or 0) >= 2 else None, row_id, test, seed)


def kfold(df: DataFrame, label: str | None, row_id: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Add ``fold`` 0..k-1: equal parts per class, the first ``n mod k`` one row larger."""
    base, strata = _strata(df, label)

    def ends(n: Column) -> Column:
        size, extra = F.floor(n / F.lit(k)), n % F.lit(k)
        return F.array(*[(size * i + F.least(extra, F.lit(i).cast("long"))).cast("long") for i in range(1, k)])

    cuts = cut_keys(base, strata, row_id, seed, ends).groupBy(*strata).agg(
        F.collect_list(F.struct(F.col("cut_hash").alias("h"), F.col("cut_id").alias("i"))).alias("cuts")
    )
    joined = join_null_safe(base, write_scratch(cuts), strata, "left")
    key = _row_key(row_id, seed)
    fold = F.size(F.filter("cuts", lambda c: key > c)).cast("int")
    return joined.withColumn(name, fold).drop("cuts", ALL)


def fold_train(df: DataFrame, i: int, name: str = "fold") -> DataFrame:
    return df.where(F.col(name) != i)


def fold_valid(df: DataFrame, i: int, name: str = "fold") -> DataFrame:
    return df.where(F.col(name) == i)


def sample_quotas(df: DataFrame, label: str, n: int) -> DataFrame:
    """Rows per class for a sample of ``n``: proportional, largest remainders first."""
    counts = write_scratch(df.groupBy(label).agg(F.count(F.lit(1)).alias("n_class")))
    n_all = counts.agg(F.sum("n_class")).first()[0] or 0
    if n_all <= n:
        return counts.select(label, "n_class", F.col("n_class").alias("quota"))
    exact = F.col("n_class").cast("double") * F.lit(float(n)) / F.lit(n_all)
    parts = write_scratch(counts.select("*", F.floor(exact).alias("base"), (exact - F.floor(exact)).alias("rest")))
    left = n - parts.agg(F.sum("base")).first()[0]
    placed = ordered_index(parts, [F.col("rest").desc(), F.col(label)], "place")
    return placed.select(label, "n_class", (F.col("base") + F.when(F.col("place") < left, 1).otherwise(0)).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, label: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows with class shares kept; every row when there are no more."""
    quotas = write_scratch(sample_quotas(df, label, n))
    targets = quotas.where(F.col("quota") > 0).select(label, F.array("quota").alias("ranks"))
    marked = _up_to_cut(df, [label], row_id, seed, targets)
    return marked.where("__in").drop("__in")


def sample_n(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the first in hash order."""
    base, strata = _strata(df, None)
    marked = _up_to_cut(base, strata, row_id, seed, lambda total: F.array(F.least(total, F.lit(n).cast("long"))))
    return marked.where("__in").drop("__in", ALL)


def holdout(df: DataFrame, label: str, row_id: str, part: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    marked = stratified_split(df, label, row_id, part, seed)
    return marked.where(F.col("split") == "train").drop("split"), marked.where(F.col("split") == "test").drop("split")


def bag_rows(df: DataFrame, row_id: str, fraction: float, seed: int) -> DataFrame:
    """Rows of one bag: each row is in with probability ``fraction``, fixed by the seed."""
    return df.where(hash_uniform(row_id, seed) < F.lit(float(fraction)))


def bag_columns(columns: list[str], fraction: float, seed: int) -> list[str]:
    """Columns of one bag: the first ``ceil(fraction * n)`` in hash order of the names."""
    import hashlib
    keep = max(1, math.ceil(fraction * len(columns)))
    order = sorted(columns, key=lambda c: (hashlib.md5(f"{seed}|{c}".encode()).hexdigest(), c))[:keep]
    return [c for c in columns if c in set(order)]


def class_rank(df: DataFrame, label: str, row_id: str, seed: int = 42) -> DataFrame:
    return hash_rank(df, [label], row_id, seed)
