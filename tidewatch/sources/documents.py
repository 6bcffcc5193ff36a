"""Result documents: nested JSON to metric rows, and one table of all runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Spellings of the same metric in result documents.
SPELLINGS = {
    "accuracy": ["accuracy", "acc", "test_acc", "test_accuracy", "best_accuracy", "test_best_accuracy"],
    "roc_auc": ["roc_auc", "auc", "test_auc", "test_roc_auc"],
    "f1": ["f1", "test_f1", "f1_macro"],
    "precision": ["precision", "test_precision"],
    "recall": ["recall", "test_recall"],
    "threshold": ["threshold", "thr", "best_threshold", "test_best_threshold", "best_val_threshold"],
}


def _leaves(kind: T.DataType, value: Column, name: Column) -> Column | None:
    """Array of (metric, value) for everything numeric below one field."""
    if isinstance(kind, T.NumericType):
        return F.array(F.struct(name.alias("metric"), value.cast("double").alias("value")))
    if isinstance(kind, T.StructType):
        parts = [_leaves(f.dataType, value[f.name], F.concat(name, F.lit("." + f.name))) for f in kind]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        if _leaves(kind.elementType, F.lit(None), name) is None:
            return None
        at = lambda i: F.concat(name, F.lit("["), i.cast("string"), F.lit("]"))
        each = F.transform(value, lambda x, i: _leaves(kind.elementType, x, at(i)))
        return F.coalesce(F.flatten(each), F.array().cast("array<struct<metric:string,value:double>>"))
    return None


def flatten_metrics(df: DataFrame, run: Column) -> DataFrame:
    """Documents to ``(run_id, model_id, metric, value)``.

    A nested object at the top names the model; loose numbers belong to 'all'.
    """
    groups = []
    for f in df.schema:
        nested = isinstance(f.dataType, T.StructType)
        if nested:
            for g in f.dataType:
                part = _leaves(g.dataType, F.col(f"`{f.name}`")[g.name], F.lit(g.name))
                groups += [(f.name, part)] if part is not None else []
        else:
            part = _leaves(f.dataType, F.col(f"`{f.name}`"), F.lit(f.name))
            groups += [("all", part)] if part is not None else []
    if not groups:
        raise ValueError("no numbers in the documents")
    def tag(model: str, part: Column) -> Column:
        return F.transform(part, lambda x: F.struct(
            F.lit(model).alias("model_id"), x["metric"].alias("metric"), x["value"].alias("value")))

    tagged = F.concat(*[tag(m, part) for m, part in groups])
    return df.select(run.alias("run_id"), F.inline(tagged)).where(F.col("value").isNotNull())


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.option("multiLine", True).json(folder)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    tagged = df.select("*", name.alias("__run"))
    return flatten_metrics(tagged, F.col("__run"))


def threshold_from(metrics: DataFrame, default: float = 0.5) -> float:
    """Stored threshold, looked up by its spellings in order, then by run."""
    names = F.array(*[F.lit(n) for n in SPELLINGS["threshold"]])
    rank = F.array_position(names, F.col("metric"))
    found = metrics.where((rank > 0) & F.col("value").isNotNull()).agg(F.min_by("value", F.struct(rank, F.col("run_id"), F.col("value")))).first()[0]
    return default if found is None else found


def compare_runs(metrics: DataFrame) -> DataFrame:
    """One row per run and model, one column per metric, spellings unified."""
    canonical = F.create_map(*[x for k, names in SPELLINGS.items() for n in names for x in (F.lit(n), F.lit(k))])
    spellings = F.array(*[F.lit(n) for names in SPELLINGS.values() for n in names])
    ranked = metrics.withColumn("__rank", F.array_position(spellings, F.col("metric"))).where("value IS NOT NULL")
    named = ranked.withColumn("metric", F.try_element_at(canonical, F.col("metric"))).where("metric IS NOT NULL")
    # of several spellings in one run the first in the list counts
    return named.groupBy("run_id", "model_id").pivot("metric", list(SPELLINGS)).agg(F.min_by("value", F.struct("__rank", "value")))
