"""Oversampling of the rare class between near rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.operators.neighbours import knn_join
from tidewatch.operators.ordering import ordered_index
from tidewatch.session import write_scratch

def _classes(df: DataFrame, label: str) -> tuple[object, int]:
    """Rare class and how many rows it lacks (smallest value on a tie)."""
    rows = df.groupBy(label).count().orderBy("count", label).limit(3).collect()
    if len(rows) != 2:
        raise ValueError("resampling needs exactly two classes")
    return rows[0][0], rows[1][1] - rows[0][1]


def _uniform(seed: int, *parts: Column) -> Column:
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _between(pairs: DataFrame, rare: DataFrame, row_id: str, vector: str, label: str, value) -> DataFrame:
    """New rows on the line from row ``base`` to row ``other`` at ``step``."""
    vec = lambda n: rare.select(F.col(row_id).alias(n), F.col(vector).cast("array<double>").alias(f"{n}_v"))
    joined = pairs.join(vec("base"), "base").join(vec("other"), "other")
    mixed = F.zip_with("base_v", "other_v", lambda a, b: a + F.col("step") * (b - a))
    return joined.select(F.col("base").alias("source_id"), "copy", mixed.alias(vector), F.lit(value).alias(label))


def adasyn(df: DataFrame, label: str, row_id: str, vector: str, seed: int = 42, neighbours: int = 5, **kw) -> DataFrame:
    """New rare-class rows, more of them where the other class is near."""
    value, lack = _classes(df, label)
    rare = df.where(F.col(label) == value)
    if lack == 0:
        return _between(spark_pairs(df, row_id), rare, row_id, vector, label, value)
    near = write_scratch(knn_join(rare, df, row_id, vector, neighbours, **kw))
    kinds = df.select(F.col(row_id).alias("neighbour"), (F.col(label) != value).cast("double").alias("foreign"))
    share = write_scratch(near.join(kinds, "neighbour").groupBy(row_id).agg((F.sum("foreign") / neighbours).alias("share")))
    total = share.agg(F.sum("share")).first()[0] or 0.0
    if total == 0:
        raise ValueError("no rare row has a neighbour of the other class")
    quota = share.select(F.col(row_id).alias("base"), F.rint(F.col("share") / total * lack).cast("long").alias("quota"))
    inner = knn_join(rare, rare, row_id, vector, neighbours, **kw)
    options = inner.groupBy(F.col(row_id).alias("base")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "neighbour"))), lambda x: x["neighbour"]).alias("near"))
    copies = quota.where(F.col("quota") > 0).select("base", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("copy")).join(options, "base")
    pick = F.floor(_uniform(seed, F.col("base"), F.col("copy"), F.lit("n")) * F.size("near")).cast("int")
    pairs = copies.select("base", "copy", F.col("near")[pick].alias("other"), _uniform(seed, F.col("base"), F.col("copy"), F.lit("s")).alias("step"))
    return _between(pairs, rare, row_id, vector, label, value)


def spark_pairs(df: DataFrame, row_id: str) -> DataFrame:
    kind = df.schema[row_id].dataType.simpleString()
    return df.sparkSession.createDataFrame([], f"base {kind}, copy long, other {kind}, step double")


def borderline_smote(
    df: DataFrame, label: str, row_id: str, vector: str, seed: int = 42, neighbours: int = 5, border: int = 10, **kw
) -> DataFrame:
    """New rare-class rows next to rows in danger: half or more, not all, foreign neighbours."""
    value, lack = _classes(df, label)
    rare = df.where(F.col(label) == value)
    near = knn_join(rare, df, row_id, vector, border, **kw)
    kinds = df.select(F.col(row_id).alias("neighbour"), (F.col(label) != value).cast("int").alias("foreign"))
    # written, since the second join reads its left rows more than once
    danger = write_scratch(near.join(kinds, "neighbour").groupBy(row_id).agg(F.sum("foreign").alias("f")).where(
        (F.col("f") >= border / 2) & (F.col("f") < border)))
    inner = knn_join(rare.join(danger.select(row_id), row_id, "left_semi"), rare, row_id, vector, neighbours, **kw)
    pairs = ordered_index(write_scratch(inner).select(F.col(row_id).alias("base"), F.col("neighbour").alias("other"), "rank"),
                          [F.col("base"), F.col("rank")], "place")
    n_pairs = pairs.count()
    if n_pairs == 0 or lack == 0:
        return _between(spark_pairs(df, row_id), rare, row_id, vector, label, value)
    draws = df.sparkSession.range(lack).select(
        F.col("id").alias("copy"),
        F.floor(_uniform(seed, F.col("id"), F.lit("p")) * n_pairs).alias("place"),
        _uniform(seed, F.col("id"), F.lit("s")).alias("step"))
    return _between(draws.join(pairs, "place").select("base", "copy", "other", "step"), rare, row_id, vector, label, value)


def resample(df: DataFrame, label: str, row_id: str, vector: str, strategy: str = "adasyn", seed: int = 42, **kw) -> DataFrame:
    """The table with its new rows; originals carry ``copy`` null."""
    make = {"adasyn": adasyn, "borderline": borderline_smote}.get(strategy)
    if make is None:
        raise ValueError(f"no resampling called {strategy!r}")
    new = make(df, label, row_id, vector, seed, **kw)
    old = df.select(F.col(row_id).alias("source_id"), F.lit(None).cast("long").alias("copy"), F.col(vector).cast("array<double>").alias(vector), label)
    return old.unionByName(new)
