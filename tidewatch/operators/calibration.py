"""Calibrating probabilities, fitted on rows kept out of training."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.expressions import col
from tidewatch.functions.grids import GRIDS, Grid
from tidewatch.operators import scores as S
from tidewatch.operators.composite import Composite
from tidewatch.session import write_scratch


class Calibrator(Composite):
    """Replaces ``proba``; ``method`` is raw, platt or isotonic."""

    def __init__(self, method: str, model=None):
        super().__init__()
        self.method, self.model = method, model

    def parts(self) -> dict:
        return {"model": self.model}

    def plain(self) -> dict:
        return {"method": self.method}

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.method == "raw":
            return df
        kept = [col(c) for c in df.columns if c != "proba"]
        if self.method == "platt":
            vec = VectorAssembler(inputCols=["proba"], outputCol="__x").transform(df)
            done = self.model.transform(vec).withColumn("__p", vector_to_array("__prob")[1])
        else:
            done = self.model.transform(df)
        return done.select(*kept, F.col("__p").alias("proba"))


def _cells(df: DataFrame) -> DataFrame:
    """Distinct (proba, y) with counts as weights: exact, and far fewer rows than the data."""
    return S._clean(df, []).groupBy("proba", "y").agg(F.count(F.lit(1)).cast("double").alias("w"))


def fit_platt(df: DataFrame, c: float = 1.0) -> Calibrator:
    """Logistic regression on the probability."""
    cells = _cells(df).persist()
    try:
        n = cells.agg(F.sum("w")).first()[0] or 1.0
        vec = VectorAssembler(inputCols=["proba"], outputCol="__x").transform(cells)
        est = LogisticRegression(
            featuresCol="__x", labelCol="y", weightCol="w", probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__pred",
            regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9)
        return Calibrator("platt", est.fit(vec))
    finally:
        cells.unpersist()


def fit_isotonic(df: DataFrame) -> Calibrator:
    """Monotone step curve, linear between steps, constant outside the seen range."""
    est = IsotonicRegression(featuresCol="proba", labelCol="y", weightCol="w", predictionCol="__p")
    return Calibrator("isotonic", est.fit(_cells(df)))


def calibrate(model, valid: DataFrame, label: str) -> Calibrator:
    """Sigmoid calibration of a fitted scoring model on validation rows."""
    return fit_platt(model.transform(valid).select("proba", F.col(label).cast("int").alias("y")))


def compare_calibration(valid: DataFrame, test: DataFrame, grid: Grid = GRIDS["thousandths"]) -> DataFrame:
    """Raw, Platt and isotonic at their own best threshold; the most accurate is chosen.

    Fitted on ``valid``, measured on ``test``; all methods share one pass.
    """
    methods = [Calibrator("raw"), fit_platt(valid), fit_isotonic(valid)]
    long = None
    for m in methods:
        part = m.transform(test.select("proba", "y")).select(F.lit(m.method).alias("model_id"), "proba", "y")
        long = part if long is None else long.unionByName(part)
    report = S.with_metrics(S.sweep_and_auc(long, grid), "precision", "recall", "f1", "specificity")
    order = F.when(F.col("model_id") == "raw", 0).when(F.col("model_id") == "platt", 1).otherwise(2)
    # Three rows: evaluated once, then compared.
    out = write_scratch(report.withColumn("order", order))
    best = S.arg_best(out, "accuracy", "order").first().model_id
    return out.withColumn("chosen", F.col("model_id") == best).withColumnRenamed("model_id", "method").drop("order")


def calibrated_predictions(valid: DataFrame, test: DataFrame, row_id: str, grid: Grid = GRIDS["thousandths"]) -> DataFrame:
    """Test rows with the chosen method's probability, its prediction and the truth."""
    report = compare_calibration(valid, test, grid).where("chosen").select("method", "threshold").first()
    model = {"raw": lambda: Calibrator("raw"), "platt": lambda: fit_platt(valid), "isotonic": lambda: fit_isotonic(valid)}[report.method]()
    scored = S.apply_threshold(model.transform(test), report.threshold)
    return scored.select(row_id, "proba", "pred", F.col("y").alias("true"))
