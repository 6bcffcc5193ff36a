"""Column profiles and class statistics.

Sums come from wide aggregates (one scan, no shuffle of rows). Whatever needs
the values themselves goes through ``value_counts``: columns are stacked to
(feature, value) and counted with map-side combine, so a value holding a third
of all rows costs one row per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.expressions import col, nan_to_null, number, quoted, ratio, text
from tidewatch.session import write_scratch

NEAR_ZERO_VARIANCE = 1e-12
MAX_ZERO_SHARE = 0.9999
COLUMNS_PER_JOB = 16


def _chunks(names: list[str], size: int = COLUMNS_PER_JOB) -> list[list[str]]:
    return [names[i:i + size] for i in range(0, len(names), size)]


def per_column(
    df: DataFrame, names: list[str], stats: dict[str, str], by: list[str] = (), raw: bool = False, shared: list[str] = ()
) -> DataFrame:
    """Aggregates of many columns in one pass per block, result in long form.

    ``stats`` maps output names to SQL aggregates of ``{x}``, the column as a
    number or, with ``raw``, as it is, and of ``{own}``, the column in its own
    type; ``shared`` adds SQL columns the aggregates also need. Blocks keep the generated code small; each reads only
    its own columns, and each column is converted once per row.
    """
    parts = []
    keys = [quoted(k) for k in by]
    for block in _chunks(names):
        own = [f"{quoted(c)} AS __o{i}" for i, c in enumerate(block)] if any("{own}" in e for e in stats.values()) else []
        base = df.selectExpr(*keys, *shared, *[f"{quoted(c) if raw else number(c)} AS __x{i}" for i, c in enumerate(block)], *own)
        wide = base.groupBy(*by).agg(*[
            F.expr("struct(" + ", ".join(f"{e.format(x=f'__x{i}', own=f'__o{i}')} AS {k}" for k, e in stats.items()) + f") AS s{i}")
            for i in range(len(block))
        ])
        rows = ", ".join(f"struct({text(c)} AS feature, s{i} AS s)" for i, c in enumerate(block))
        parts.append(wide.selectExpr(*keys, f"inline(array({rows}))").selectExpr(*keys, "feature", "s.*"))
    return reduce(DataFrame.unionByName, parts)


def stacked(df: DataFrame, names: list[str], keep: list[Column | str] = ()) -> DataFrame:
    """Long form ``(keep..., feature, value)`` of columns as numbers."""
    rows = ", ".join(f"struct({text(c)} AS feature, {number(c)} AS value)" for c in names)
    return df.select(*keep, F.expr(f"inline(array({rows}))"))


def counted_values(df: DataFrame, names: list[str], sums: list[Column], keep: list[Column | str] = ()) -> DataFrame:
    """(feature, value as text, sums...): columns of one type are counted in that type.

    Text is made of the distinct values only. Each part reads its own columns.
    """
    kinds: dict[str, list[str]] = {}
    for c in names:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    parts = []
    for same in kinds.values():
        rows = ", ".join(f"struct({text(c)} AS feature, {quoted(c)} AS value)" for c in same)
        counted = df.select(*keep, F.expr(f"inline(array({rows}))")).groupBy("feature", "value").agg(*sums)
        parts.append(counted.withColumn("value", F.col("value").cast("string")))
    return reduce(DataFrame.unionByName, parts)


def value_counts(df: DataFrame, names: list[str], as_text: bool = True) -> DataFrame:
    n = F.count(F.lit(1)).alias("n")
    return counted_values(df, names, [n]) if as_text else stacked(df, names).groupBy("feature", "value").agg(n)


# Aggregates behind a column profile.
MOMENTS = {
    "rows": "count(1)", "n": "count({x})", "variance": "var_pop({x})", "zeros": "count_if(coalesce({x} = 0, false))",
}


def distinct_counts(counted: DataFrame, names: list[str]) -> DataFrame:
    """Distinct values per column, 0 for columns without any."""
    every = counted.sparkSession.createDataFrame([(n,) for n in names], "feature string")
    return every.join(counted.groupBy("feature").agg(F.count("value").alias("n_unique")), "feature", "left").fillna(0, ["n_unique"])


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Variance, distinct values, share of missing values and of zeros; one row per column.

    Text that is no number is a value like others, so a column's missing values are its nulls, and NaN where it holds numbers.
    """
    floats = {c for c in names if df.schema[c].dataType.typeName() in ("float", "double")}
    m = reduce(DataFrame.unionByName, [
        per_column(df, [c for c in names if (c in floats) == real], {**MOMENTS, "missing": "count_if({own} IS NULL" + (" OR isnan({own}))" if real else ")")})
        for real in (True, False) if any((c in floats) == real for c in names)])
    base = m.select("feature", "variance", ratio(F.col("missing"), F.col("rows")).alias("pct_nan"), ratio(F.col("zeros"), F.col("rows")).alias("pct_zero"))
    # counted in each column's own type; text is only made of the distinct values
    counted = counted_values(df, names, [F.count(F.lit(1)).alias("n")]).where((F.col("value") != "NaN") | ~F.col("feature").isin(*floats, ""))
    distinct = distinct_counts(counted, names)
    return base.join(distinct, "feature").select("feature", "variance", "n_unique", "pct_nan", "pct_zero")


def profile_fast(df: DataFrame, names: list[str]) -> DataFrame:
    m = per_column(df, names, MOMENTS)
    return m.select(
        "feature", "variance", ratio(F.col("rows") - F.col("n"), F.col("rows")).alias("pct_nan"),
        ratio(F.col("zeros"), F.col("rows")).alias("pct_zero"),
    )


def profile_summary(fast: DataFrame, eps: float = NEAR_ZERO_VARIANCE) -> DataFrame:
    hits = lambda c: F.count(F.when(c, 1))
    return fast.agg(
        F.count(F.lit(1)).alias("n_features"), hits(F.col("variance") == 0).alias("n_zero_variance"),
        hits(F.col("variance") <= eps).alias("n_near_zero_variance"), hits(F.col("pct_zero") == 1).alias("n_all_zero"),
    )


def constant_features(profiled: DataFrame) -> DataFrame:
    return profiled.where(F.col("n_unique") <= 1)


def near_constant(profiled: DataFrame, eps: float = NEAR_ZERO_VARIANCE) -> DataFrame:
    return profiled.where(F.col("variance") <= eps)


def low_variance(profiled: DataFrame, eps: float = 0.0, n: int = 200) -> DataFrame:
    return profiled.where(F.col("variance") <= eps).orderBy("feature").limit(n)


def sparsest(profiled: DataFrame, n: int = 50) -> DataFrame:
    return profiled.orderBy(F.col("pct_zero").desc(), "feature").limit(n)


def top_bottom(df: DataFrame, name: str, tie: str, n: int = 10) -> DataFrame:
    top = df.orderBy(F.col(name).desc_nulls_last(), tie).limit(n).withColumn("side", F.lit("top"))
    low = df.orderBy(F.col(name).asc_nulls_last(), tie).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def varying_columns(train: DataFrame, names: list[str], eps: float = NEAR_ZERO_VARIANCE) -> list[str]:
    rows = profile_fast(train, names).where(F.col("variance") > eps).select("feature").collect()
    kept = {r.feature for r in rows}
    return [c for c in names if c in kept]


def drop_constant(train: DataFrame, other: DataFrame, names: list[str], eps: float = NEAR_ZERO_VARIANCE):
    """Drop columns that do not vary on the training rows from both tables."""
    gone = set(names) - set(varying_columns(train, names, eps))
    keep = lambda df: df.select(*[col(c) for c in df.columns if c not in gone])
    return keep(train), keep(other)


def dense_columns(df: DataFrame, names: list[str], max_zero: float = MAX_ZERO_SHARE) -> list[str]:
    rows = profile_fast(df, names).where(F.col("pct_zero") <= max_zero).select("feature").collect()
    kept = {r.feature for r in rows}
    return [c for c in names if c in kept]


def drop_sparse(df: DataFrame, names: list[str], max_zero: float = MAX_ZERO_SHARE) -> DataFrame:
    kept = set(dense_columns(df, names, max_zero))
    return df.select(*[col(c) for c in df.columns if c not in names or c in kept])


# ---- classes ------------------------------------------------------------------------

def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(counts: DataFrame, label: str, form: str = "balanced") -> DataFrame:
    """balanced: N / (K n_c); binary: N / (2 n_c)."""
    total = counts.agg(F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k")).first()
    k = total.k if form == "balanced" else 2
    return counts.select(label, "n", ratio(F.lit(total.n_all), F.lit(k) * F.col("n")).alias("weight"))


def positive_class_scale(counts: DataFrame, label: str) -> DataFrame:
    """n0 / n1, null without positives."""
    part = lambda v: F.sum(F.when(F.col(label) == v, F.col("n")))
    return counts.agg(ratio(part(0), part(1)).alias("scale_pos_weight"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def pred_counts(df: DataFrame, pred: str = "pred") -> DataFrame:
    return df.groupBy(pred).agg(F.count(F.lit(1)).alias("n"))


def proba_stats(df: DataFrame, by: list[str], proba: str = "proba") -> DataFrame:
    p = nan_to_null(proba)
    return df.groupBy(*by).agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"))


def fold_summary(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and population std over folds; undefined folds are left out."""
    v = nan_to_null(value)
    return df.groupBy(*by).agg(F.count(v).alias("n_folds"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def missing(df: DataFrame, names: list[str], n: int = 10) -> DataFrame:
    gone = per_column(df, names, {"n_missing": "count_if({x} IS NULL)", "rows": "count(1)"}, raw=True)
    return gone.select("feature", "n_missing", ratio(F.col("n_missing"), F.col("rows")).alias("pct_missing")).orderBy(
        F.col("n_missing").desc(), "feature"
    ).limit(n)


# ---- histograms ---------------------------------------------------------------------

def _binned(df: DataFrame, names: list[str], bins: int, keep: list[Column] = ()) -> DataFrame:
    limits = write_scratch(per_column(df, names, {"lo": "min({x})", "hi": "max({x})"}))
    flat = F.col("lo") == F.col("hi")
    limits = limits.select(
        "feature", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    at = F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins)))
    long = stacked(df, names, keep).where(F.col("value").isNotNull())
    return long.join(limits, "feature").withColumn("bin", F.least(at, F.lit(bins - 1).cast("long")))


def histogram(df: DataFrame, names: list[str], bins: int = 50) -> DataFrame:
    """Counts in equal-width bins; the last bin includes the maximum."""
    return _binned(df, names, bins).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    ).select(
        "feature", "bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / F.lit(float(bins))).alias("left"), "n"
    )


def evenly_spaced(names: list[str], n: int) -> list[str]:
    """Up to ``n`` column names at even distances, first and last included."""
    if len(names) <= n:
        return list(names)
    picked = sorted({int(i * (len(names) - 1) / (n - 1)) for i in range(n)})
    return [names[i] for i in picked]


def class_histogram(df: DataFrame, names: list[str], label: str, bins: int = 50) -> DataFrame:
    """Density per class: counts over class size and bin width."""
    cells = _binned(df, names, bins, [F.col(label)]).groupBy("feature", label, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    size = Window.partitionBy("feature", label)
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return cells.select(
        "feature", label, "bin", "n", ratio(F.col("n"), F.sum("n").over(size) * width).alias("density")
    )


# ---- values and labels --------------------------------------------------------------

def top_values(df: DataFrame, names: list[str], k: int = 5) -> DataFrame:
    """Most frequent values per column, null included; ties by value.

    The rank filter reaches the window as a group limit, so each task passes on
    at most ``k`` candidates per column.
    """
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    return value_counts(df, names).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_ratio(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct values with null as a value, and their share of the rows."""
    return value_counts(df, names).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_unique"), ratio(F.count(F.lit(1)), F.sum("n")).alias("prop_unique")
    )


def running_best(history: DataFrame, iteration: str = "iteration", score: str = "score", by: list[str] = ()) -> DataFrame:
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(iteration).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_score", F.max(score).over(w))


def cumulative_share(df: DataFrame, value: str, name: str, by: list[str] = ()) -> DataFrame:
    """Rank by value and running share of the total; for per-feature tables."""
    part = list(by) or [F.lit(0)]
    order = Window.partitionBy(*part).orderBy(F.col(value).desc_nulls_last(), name)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "*", F.row_number().over(order).alias("rank"),
        ratio(F.sum(value).over(upto), F.sum(value).over(Window.partitionBy(*part))).alias("cum_share"),
    )
