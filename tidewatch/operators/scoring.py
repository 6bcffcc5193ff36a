"""Batch scoring jobs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.expressions import margin_to_probability, quoted
from tidewatch.operators import scores as S
from tidewatch.operators.ensembles import compare_metrics
from tidewatch.sources.bundles import Bundle, load_bundle, promote


def positive_probability(df: DataFrame, positive_index: int = 1) -> DataFrame:
    """``proba`` from whatever the model left: a column, a vector, or a margin."""
    if "proba" in df.columns:
        return df
    if "probability" in df.columns:
        return df.withColumn("proba", vector_to_array("probability")[positive_index])
    if "rawPrediction" in df.columns:
        raw = vector_to_array("rawPrediction")
        return df.withColumn("proba", margin_to_probability(raw[positive_index]))
    if "margin" in df.columns:
        return df.withColumn("proba", margin_to_probability("margin"))
    raise ValueError("the model gives neither probability nor margin")


def predict(bundle: Bundle, df: DataFrame) -> DataFrame:
    """Input columns with ``proba`` and ``pred``."""
    missing = [c for c in bundle.columns if c not in df.columns]
    if missing:
        raise ValueError(f"{bundle.name}: columns {missing} are missing")
    scored = positive_probability(bundle.model.transform(df), bundle.positive_index)
    return S.apply_threshold(scored.selectExpr(*map(quoted, df.columns + ["proba"])), bundle.threshold)


def predict_report(bundle: Bundle, df: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Predictions and a one-row summary, with metrics where the label is known."""
    out = predict(bundle, df)
    if label is None or label not in df.columns:
        summary = out.agg(F.count(F.lit(1)).alias("n"))
    else:
        rows = out.select(F.lit(bundle.name).alias("model_id"), "proba", "pred", F.col(label).cast("int").alias("y"))
        flat = S.basic_metrics(rows).join(S.roc_auc(rows).select("model_id", "roc_auc"), "model_id").drop("model_id")
        summary = flat.withColumn("n", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return out, summary.withColumn("model_id", F.lit(bundle.name)).withColumn("threshold", F.lit(float(bundle.threshold)))


def metric_rows(report: DataFrame, names: list[str]) -> DataFrame:
    """One-row report to ``(metric, value)``."""
    return report.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ])))


def reproduce(bundle: Bundle, df: DataFrame, label: str, saved: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Score again and set the metrics against stored ones."""
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    return compare_metrics(saved, metric_rows(predict_report(bundle, df, label)[1], names), tol)


def evaluate_stored(spark, path: str, df: DataFrame, label: str) -> DataFrame:
    """Metrics of a stored bundle of any shape on a table: its own columns are cut out by name or by ``selected_idx``, its threshold
    is looked up by its spellings. What cannot be loaded or score gives an error row."""
    try:
        bundle = load_bundle(spark, path)
    except Exception as e:  # the failure is the result
        return spark.createDataFrame(
            [(path.rstrip("/").rsplit("/", 1)[-1], None, None, None, f"{type(e).__name__}: {str(e).splitlines()[0]}")], EVALUATED)
    return evaluate_bundle(bundle, df, label)


EVALUATED = "model_id string, accuracy double, f1 double, roc_auc double, error string"


def evaluate_bundle(bundle: Bundle, df: DataFrame, label: str) -> DataFrame:
    """Metrics of one bundle; a bundle that cannot score gives an error row."""
    try:
        summary = predict_report(bundle, df, label)[1]
        row = summary.select("model_id", "accuracy", "f1", "roc_auc").first()
        return df.sparkSession.createDataFrame([(*row, None)], EVALUATED)
    except Exception as e:  # the failure is the result
        return df.sparkSession.createDataFrame([(bundle.name, None, None, None, f"{type(e).__name__}: {str(e).splitlines()[0]}")], EVALUATED)


def score_bundles(bundles: list[Bundle], df: DataFrame, row_id: str, label: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """Stack the scores of all usable bundles; unusable ones are listed, never replaced by a constant."""
    scored, rows = None, []
    for b in bundles:
        try:
            keep = [F.lit(b.name).alias("model_id"), F.col(row_id).alias("row_id"), "proba", "pred"]
            part = predict(b, df).select(*keep, *([F.col(label).cast("int").alias("y")] if label else []))
            part.schema  # resolve now, so that a missing column is caught here
            scored = part if scored is None else scored.unionByName(part)
            rows.append((b.name, "ok", None))
        except Exception as e:  # listed below
            rows.append((b.name, "failed", f"{type(e).__name__}: {str(e).splitlines()[0]}"))
    return scored, df.sparkSession.createDataFrame(rows, "model_id string, status string, error string")


def promote_best(spark, folder: str, target: str, evaluated: DataFrame) -> Bundle:
    """Promote the bundle with the best composite; ``evaluated`` has one row per model."""
    ranked = S.arg_best(S.composite(evaluated), "composite", "model_id").first()
    metrics = {k: ranked[k] for k in ("accuracy", "roc_auc", "composite") if ranked[k] is not None}
    return promote(spark, f"{folder}/{ranked.model_id}", target, metrics, "highest mean of AUC and accuracy")
