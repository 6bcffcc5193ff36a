"""Fitting detectors with Spark ML: single models, bags, folds and baselines.

Every fitted model is a ``PipelineModel`` whose own columns carry a tag, so
several models can score the same rows one after the other without a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.expressions import col, quoted
from tidewatch.operators import scores as S
from tidewatch.operators.encoding import fit_target_statistics, ordered_means
from tidewatch.operators.labels import most_frequent
from tidewatch.operators.profiling import class_counts, class_weights
from tidewatch.operators.splitting import bag_columns, bag_rows, fold_train, fold_valid, holdout, kfold
from tidewatch.session import ready_to_checkpoint, write_scratch

PARALLEL_FITS = 4


@dataclass(frozen=True)
class Spec:
    """What to fit: a family, its parameters and the columns it sees."""

    family: str = "boosted"
    params: dict = field(default_factory=dict)
    features: list[str] | None = None
    #: Form of the class weights that rows get, and the part of the training rows that boosting is stopped by.
    weight: str | None = None
    valid_part: float | None = None


# Default settings of each family.
DEFAULTS = {
    "boosted": {"maxIter": 50, "stepSize": 0.1, "maxDepth": 5, "subsamplingRate": 1.0},
    "boosted_deep": {"maxIter": 40, "stepSize": 0.05, "maxDepth": 8, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"},
    "forest": {"numTrees": 100, "maxDepth": 10},
    "logistic": {"C": 1.0, "maxIter": 200},
}


def estimator(family: str, params: dict, label: str, features: str, tag: str, rows: int | None = None, weight: str | None = None, valid: str | None = None):
    p = {**DEFAULTS.get(family, {}), **params}
    shared = dict(featuresCol=features, labelCol=label, predictionCol=f"pred_{tag}")
    if weight:
        shared["weightCol"] = weight
    if family in ("boosted", "boosted_deep"):
        est = GBTClassifier(**shared, **{"seed": 42, **p})
        est = est.setValidationIndicatorCol(valid) if valid else est
    elif family == "forest":
        est = RandomForestClassifier(**shared, **{"seed": 42, **p})
    elif family == "logistic":
        c = p.pop("C")
        if rows is None:
            raise ValueError("the penalty of a logistic model depends on the number of rows")
        est = LogisticRegression(**shared, regParam=1.0 / (c * max(rows, 1)), elasticNetParam=0.0, standardization=False, **p)
    else:
        raise ValueError(f"unknown family {family}")
    return est.setRawPredictionCol(f"raw_{tag}").setProbabilityCol(f"prob_{tag}")


def fit(
    train: DataFrame, label: str, features: list[str], family: str = "boosted", params: dict | None = None,
    tag: str = "model", weight: str | None = None, valid: DataFrame | None = None, tolerance: float = 0.01,
) -> PipelineModel:
    """Fit one binary model; with ``valid`` boosting stops when it no longer improves there."""
    params = dict(params or {})
    rows = train.count() if family == "logistic" else None
    data, flag = train, None
    if valid is not None and family.startswith("boosted"):
        flag = "__valid"
        data = train.withColumn(flag, F.lit(False)).unionByName(valid.withColumn(flag, F.lit(True)))
        params.setdefault("validationTol", tolerance)
    assemble = VectorAssembler(inputCols=features, outputCol=f"x_{tag}", handleInvalid="keep")
    est = estimator(family, params, label, f"x_{tag}", tag, rows, weight, flag)
    return Pipeline(stages=[assemble, est]).fit(data)


def score(model: PipelineModel, df: DataFrame, tag: str = "model", out: str = "proba") -> DataFrame:
    """Input columns with the class-1 probability added."""
    done = model.transform(df).withColumn(out, vector_to_array(f"prob_{tag}")[1])
    return done.selectExpr(*map(quoted, df.columns), quoted(out))


def run_threads(items: list, work: Callable, parallel: int = PARALLEL_FITS) -> list:
    """Run a bounded number of Spark fits at a time; the work itself is in the cluster."""
    if len(items) <= 1:
        return [work(i) for i in items]
    # one wrapper copies the local properties once, and threads that share them end each other's execution ids: so one for each item
    session = SparkSession.active()
    tasks = [inheritable_thread_target(session)(work) for _ in items]
    pool = ThreadPool(min(parallel, len(items)))
    try:
        return pool.starmap(lambda task, item: task(item), zip(tasks, items), chunksize=1)
    finally:
        pool.close()


class ParallelOneVsRest(OneVsRest):
    """One model for each class; fits that run side by side have local properties of their own, which Spark's ``parallelism`` lets them share."""

    def _fit(self, dataset: DataFrame) -> OneVsRestModel:
        label, features, base = self.getLabelCol(), self.getFeaturesCol(), self.getClassifier()
        rows = dataset.select(label, features).persist()
        try:
            classes = int(rows.agg(F.max(label)).first()[0]) + 1

            def one(i: int):
                own = rows.withColumn(f"mc2b${i}", (F.col(label) == i).cast("double"))
                return base.fit(own, {base.labelCol: f"mc2b${i}", base.featuresCol: features, base.predictionCol: self.getPredictionCol()})

            return self._copyValues(OneVsRestModel(models=run_threads(list(range(classes)), one, self.getParallelism())))
        finally:
            rows.unpersist()


# ---- categories inside boosted trees --------------------------------------------------

def fit_with_categories(
    train: DataFrame, label: str, numeric: list[str], categorical: list[str], row_id: str, family: str = "boosted",
    params: dict | None = None, smoothing: float = 10.0, tag: str = "model", seed: int = 42,
) -> PipelineModel:
    """Boosted trees on numbers and smoothed target means of categories, of any number.

    Training rows get means of the rows before them in hash order, so no label helps to predict itself; new rows get the means of all
    training rows. Fit it on training folds only.
    """
    text = [f"coalesce(CAST(`{c}` AS STRING), 'nan') AS `{c}__t`" for c in categorical]
    numbers = [f"coalesce(try_cast(`{c}` AS DOUBLE), -999D) AS `{c}__n`" for c in numeric]
    cleaned = SQLTransformer(statement=f"SELECT *, {', '.join(text + numbers)} FROM __THIS__")
    names = [f"{c}__t" for c in categorical]
    rows = cleaned.transform(train)
    statistics = fit_target_statistics(rows, label, names, smoothing)
    means = ordered_means(rows, label, names, row_id, statistics.prior, smoothing, seed)
    # read once by every round of boosting
    known = write_scratch(means.select(F.col(label).alias(label), *[col(c) for c in means.columns if c.startswith("__m_") or c.endswith("__n")]))
    assemble = VectorAssembler(inputCols=[f"{c}__n" for c in numeric] + [f"__m_{c}" for c in names], outputCol=f"x_{tag}")
    est = estimator(family, params or {}, label, f"x_{tag}", tag, known.count() if family == "logistic" else None)
    return PipelineModel([cleaned, statistics, *Pipeline(stages=[assemble, est]).fit(known).stages])


# ---- several classes, baselines -------------------------------------------------------

def fit_multiclass(train: DataFrame, label: str, features: list[str], family: str = "forest", params: dict | None = None, weight: str | None = None) -> PipelineModel:
    """Text or numeric classes; boosted trees are fitted one class against the rest."""
    index = StringIndexer(inputCol=label, outputCol="__class", stringOrderType="alphabetAsc", handleInvalid="keep")
    assemble = VectorAssembler(inputCols=features, outputCol="x_model", handleInvalid="keep")
    if family == "forest":
        est = estimator("forest", params or {}, "__class", "x_model", "model", weight=weight)
    else:
        base = GBTClassifier(**{**DEFAULTS["boosted"], "seed": 42, **(params or {})})
        est = ParallelOneVsRest(classifier=base, featuresCol="x_model", labelCol="__class", predictionCol="pred_model", parallelism=PARALLEL_FITS)
    return Pipeline(stages=[index, assemble, est]).fit(train)


def predict_class(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """Input columns with ``pred`` in the spelling of the label column."""
    names = F.array(*[F.lit(v) for v in model.stages[0].labels])
    done = model.transform(df).withColumn("pred", F.get(names, F.col("pred_model").cast("int")))
    kind = df.schema[label].dataType
    return done.select(*[col(c) for c in df.columns], F.col("pred").cast(kind).alias("pred"))


def fit_majority(df: DataFrame, label: str):
    return most_frequent(df, col(label))


def predict_constant(df: DataFrame, value) -> DataFrame:
    return df.withColumn("pred", F.lit(value))


def with_balanced_weight(df: DataFrame, label: str, form: str = "balanced") -> DataFrame:
    """Row weights from class weights; use either these or a positive-class scale, not both."""
    from tidewatch.operators.ensembles import with_class_weight
    return with_class_weight(df, label, class_weights(class_counts(df, label), label, form))


# ---- bags, folds ----------------------------------------------------------------------

@dataclass
class Member:
    tag: str
    model: PipelineModel
    features: list[str]


# Ranges the shares of columns and rows of a bag are drawn from.
BAG_COLUMNS, BAG_ROWS = (0.4, 0.8), (0.5, 0.9)


def _share(key: str, limits: tuple[float, float]) -> float:
    """Seeded fraction between the limits."""
    u = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
    return limits[0] + u * (limits[1] - limits[0])


def fit_bag(df: DataFrame, label: str, features: list[str], row_id: str, n: int = 12, seed: int = 1000, family: str = "boosted", params: dict | None = None) -> list[Member]:
    """Models on seeded shares of rows and columns; combine them with ``score_members``."""
    def one(i: int) -> Member:
        s = seed + i
        used = bag_columns(features, _share(f"columns|{s}", BAG_COLUMNS), s)
        rows = bag_rows(df, row_id, _share(f"rows|{s}", BAG_ROWS), s)
        return Member(f"bag{i}", fit(rows, label, used, family, {**(params or {}), "seed": s}, tag=f"bag{i}"), used)

    return run_threads(list(range(n)), one)


def score_members(members: list[Member], df: DataFrame) -> DataFrame:
    """One probability column per member, all on the same pass over the rows."""
    out = df
    for m in members:
        out = score(m.model, out, m.tag, m.tag)
    return out


def fit_spec(df: DataFrame, label: str, features: list[str], row_id: str | None, name: str, spec: Spec, seed: int = 42) -> Member:
    """One model as its spec says: class weights are those of the rows it is fitted on, rows that stop it are kept out of them."""
    used, valid = spec.features or features, None
    if spec.valid_part is not None:
        if row_id is None:
            raise ValueError("a part that stops boosting needs a row key")
        df, valid = holdout(df, label, row_id, spec.valid_part, seed)
    if spec.weight is not None:
        df = with_balanced_weight(df, label, spec.weight)
        valid = valid.withColumn("weight", F.lit(1.0)) if valid is not None else None
    return Member(name, fit(df, label, used, spec.family, spec.params, tag=name, weight="weight" if spec.weight else None, valid=valid), used)


def fit_all(df: DataFrame, label: str, features: list[str], specs: dict[str, Spec], row_id: str | None = None) -> list[Member]:
    """Each base model on all rows."""
    def one(item) -> Member:
        return fit_spec(df, label, features, row_id, *item)

    return run_threads(list(specs.items()), one)


def oof(
    df: DataFrame, label: str, features: list[str], row_id: str, specs: dict[str, Spec], k: int = 3, seed: int = 42, fold: str = "fold"
) -> tuple[DataFrame, dict[int, list[Member]]]:
    """Out-of-fold probabilities, one column per base model, and the fold models.

    Every row is scored once, by models that have not seen its fold. A model
    that cannot be fitted raises: it is never replaced by a constant.
    """
    folded = df if fold in df.columns else kfold(df, label, row_id, k, seed, fold)
    ready_to_checkpoint(df.sparkSession)
    folded = folded.checkpoint()
    jobs = [(i, name) for i in range(k) for name in specs]

    def one(job) -> Member:
        i, name = job
        return fit_spec(fold_train(folded, i, fold), label, features, row_id, name, specs[name], seed)

    fitted = dict(zip(jobs, run_threads(jobs, one)))
    models = {i: [fitted[i, name] for name in specs] for i in range(k)}
    parts = [score_members(models[i], fold_valid(folded, i, fold)) for i in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # scored once: whoever reads the scores does not score again
    return out.select(row_id, F.col(label).cast("int").alias("y"), fold, *specs).checkpoint(), models


def cross_validate(
    df: DataFrame, label: str, features: list[str], row_id: str, specs: dict[str, Spec], k: int = 5, seed: int = 42, threshold: float = 0.5
) -> DataFrame:
    """Accuracy, F1 and AUC per model and fold, measured in one pass over the out-of-fold scores."""
    wide, _ = oof(df, label, features, row_id, specs, k, seed)
    long = wide.unpivot([row_id, "fold", "y"], list(specs), "model_id", "proba")
    by = ["model_id", "fold"]
    metrics = S.evaluate_catalogue(long, threshold, by)
    return metrics.select(*by, (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n_test"), "accuracy", "f1", "roc_auc")


def cross_validate_classes(
    df: DataFrame, label: str, features: list[str], row_id: str, specs: dict[str, Spec], k: int = 5, seed: int = 42
) -> DataFrame:
    """Accuracy and macro F1 per model and fold for labels of any number of classes; each fold's rows are predicted by a model without them."""
    ready_to_checkpoint(df.sparkSession)
    folded = kfold(df, label, row_id, k, seed).checkpoint()

    def one(job) -> DataFrame:
        i, name = job
        spec, train = specs[name], fold_train(folded, i)
        if spec.weight is not None:
            train = with_balanced_weight(train, label, spec.weight)
        model = fit_multiclass(train, label, spec.features or features, spec.family, spec.params, "weight" if spec.weight else None)
        found = predict_class(model, fold_valid(folded, i), label)
        return found.select(F.lit(name).alias("model_id"), "fold", col(label).alias("y"), "pred")

    parts = run_threads([(i, name) for i in range(k) for name in specs], one)
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    by = ["model_id", "fold"]
    return S.macro_f1(long, by).join(long.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test")), by)


def cv_summary(cv: DataFrame) -> DataFrame:
    """Mean and population std over folds; undefined folds are left out."""
    return cv.groupBy("model_id").agg(*[
        e for m in ("accuracy", "f1", "roc_auc") for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))
    ])


def best_by_cv(cv: DataFrame, metric: str = "f1") -> DataFrame:
    return S.arg_best(cv_summary(cv), f"{metric}_mean", "model_id")


def importances(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """Impurity importances with names and ranks."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(features, map(float, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(rows)], "feature string, importance double, rank int")


def refit(train: DataFrame, label: str, bundle, params: dict | None = None, family: str = "boosted"):
    """Fit again on the bundle's columns; the stored threshold stays."""
    from dataclasses import replace
    model = fit(train, label, bundle.columns, family, params)
    return replace(bundle, model=as_scorer(model))


def as_scorer(model: PipelineModel, tag: str = "model") -> PipelineModel:
    """Append a stage that turns the tagged probability into ``probability``."""
    return PipelineModel([*model.stages, SQLTransformer(statement=f"SELECT *, `prob_{tag}` AS probability FROM __THIS__")])
