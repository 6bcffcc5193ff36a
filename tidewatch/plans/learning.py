"""Fitted models: rows-only queries, apart from baselines and rules that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.foreign import proba_udf
from tidewatch.operators import (
    calibration as B, models as M, scores as S, scoring as X, selection as L, stacking as K, tuning as U,
)
from tidewatch.operators.splitting import holdout, stratified_split
from tidewatch.plans.evaluation import M as METRIC_SQL
from tidewatch.plans.frames import WIDE_SQL, embedding_columns, event_scores_wide
from tidewatch.plans.profiling import labelled_documents
from tidewatch.plans.registry import query, shared
from tidewatch.plans.statistics import ANOVA_SQL, DIMS, rnd
from tidewatch.session import scratch_path
from tidewatch.sources import bundles as A, catalogue as G, documents as J
from tidewatch.sources.tables import read_table
from tidewatch.streaming import scoring as Z

SPECS = {"trees": M.Spec("boosted"), "forest": M.Spec("forest"), "linear": M.Spec("logistic")}


def frame(spark, sf):
    """Embeddings as columns with a binary label."""
    return embedding_columns(spark, sf).withColumn("y", (F.col("label") >= 5).cast("int"))


def _parts(spark, sf):
    return holdout(frame(spark, sf), "y", "vec_id", 0.2)


def _measured(scored, name):
    rows = scored.select(F.lit(name).alias("model_id"), "proba", F.col("y").cast("int").alias("y"))
    return S.evaluate_catalogue(rows)


def _family(name, family, params, **kw):
    @query(name)
    def run(spark, sf):
        train, test = _parts(spark, sf)
        return _measured(M.score(M.fit(train, "y", DIMS, family, params, **kw), test), family)
    return run


_family("md1_boosted_trees", "boosted", {})
_family("md2_boosted_trees_deep", "boosted_deep", {})
_family("md5_random_forest", "forest", {})
_family("md6_boosted_few_bins", "boosted", {"maxBins": 16})
_family("md7_logistic", "logistic", {})


@query("md3_boosted_with_categories")
def categories(spark, sf):
    df = labelled_documents(spark, sf).where("toxic IS NOT NULL").withColumnRenamed("quality", "y")
    train, test = holdout(df, "y", "doc_id", 0.2)
    model = M.fit_with_categories(train, "y", ["n_chars"], ["lang", "source"], "doc_id")
    return _measured(M.score(model, test), "categories")


@query("md4_multiclass")
def multiclass(spark, sf):
    train, test = holdout(embedding_columns(spark, sf), "label", "vec_id", 0.2)
    model = M.fit_multiclass(train, "label", DIMS, "forest")
    return S.macro_f1(M.predict_class(model, test, "label").withColumnRenamed("label", "y"), [])


@query("md4_multiclass_one_vs_rest")
def one_vs_rest(spark, sf):
    df = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    train, test = holdout(df, "o_orderstatus", "o_orderkey", 0.2)
    model = M.fit_multiclass(train, "o_orderstatus", ["o_totalprice", "o_custkey"], "boosted")
    return S.macro_f1(M.predict_class(model, test, "o_orderstatus").withColumnRenamed("o_orderstatus", "y"), [])


@query("md8_majority_baseline", """
WITH m AS (SELECT o_orderpriority AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT (SELECT v FROM m) AS pred, count(*) AS n, round(avg(CASE WHEN o_orderpriority = (SELECT v FROM m) THEN 1 ELSE 0 END), 9) AS accuracy FROM orders""")
def majority(spark, sf):
    df = read_table(spark, sf, "orders")
    out = M.predict_constant(df, M.fit_majority(df, "o_orderpriority"))
    hit = (F.col("pred") == F.col("o_orderpriority")).cast("double")
    return out.groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 9).alias("accuracy"))


@query("md9_constant_baseline", f"""
WITH cm AS (SELECT CAST(sum(toxic) AS BIGINT) AS tp, CAST(sum(1 - toxic) AS BIGINT) AS fp, 0::BIGINT AS tn, 0::BIGINT AS fn FROM labels)
SELECT tp, fp, tn, fn, {METRIC_SQL['accuracy']} AS accuracy, {METRIC_SQL['f1']} AS f1 FROM cm""")
def constant(spark, sf):
    df = M.predict_constant(read_table(spark, sf, "labels").withColumnRenamed("toxic", "y"), 1)
    return S.basic_metrics(df, []).select("tp", "fp", "tn", "fn", rnd("accuracy", 9), rnd("f1", 9))


@query("md10_balanced_row_weights")
def weighted(spark, sf):
    train, test = holdout(embedding_columns(spark, sf).withColumn("y", (F.col("label") == 3).cast("int")), "y", "vec_id", 0.2)
    model = M.fit(M.with_balanced_weight(train, "y"), "y", DIMS, "boosted", {}, weight="weight")
    return _measured(M.score(model, test), "weighted")


@query("md11_early_stopping")
def stopping(spark, sf):
    train, test = _parts(spark, sf)
    inner, valid = holdout(train, "y", "vec_id", 0.2, seed=7)
    model = M.fit(inner, "y", DIMS, "boosted", {}, valid=valid)
    return _measured(M.score(model, test), "stopped").withColumn("n_trees", F.lit(model.stages[-1].getNumTrees))


@query("md12_bag")
def bag(spark, sf):
    from tidewatch.operators.ensembles import blend_wide
    train, test = _parts(spark, sf)
    members = M.fit_bag(train, "y", DIMS, "vec_id")
    return _measured(blend_wide(M.score_members(members, test), [m.tag for m in members]), "bag")


@query("md13_cross_validate")
def cross_validate(spark, sf):
    return M.cross_validate(frame(spark, sf), "y", DIMS, "vec_id", SPECS, 3)


@query("md13_cross_validate_classes")
@shared
def cross_validate_classes(spark, sf):
    specs = {"forest": M.Spec("forest"), "weighted": M.Spec("forest", weight="balanced")}
    return M.cross_validate_classes(embedding_columns(spark, sf), "label", DIMS, "vec_id", specs, 3)


@query("md13_weights_and_stopping")
@shared
def weights_and_stopping(spark, sf):
    specs = {"plain": M.Spec("boosted"), "stopped": M.Spec("boosted", weight="balanced", valid_part=0.2)}
    return M.cross_validate(frame(spark, sf), "y", DIMS, "vec_id", specs, 3)


@query("ev19_best_by_cv")
@shared
def best_by_cv(spark, sf):
    return M.best_by_cv(M.cross_validate(frame(spark, sf), "y", DIMS, "vec_id", SPECS, 3))


@query("ev19_best_by_stored_folds", """
WITH f AS (SELECT o_orderpriority AS model_id, o_orderstatus AS fold, round(avg(o_totalprice), 3) AS v FROM orders GROUP BY 1, 2),
m AS (SELECT model_id, avg(v) AS f1_mean FROM f GROUP BY 1) SELECT model_id, round(f1_mean, 3) AS f1_mean FROM m ORDER BY f1_mean DESC, model_id LIMIT 1""")
def best_stored(spark, sf):
    folds = read_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model_id"), "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 3).alias("f1"))
    return M.best_by_cv(folds.withColumns({"accuracy": F.col("f1"), "roc_auc": F.col("f1")})).select("model_id", rnd("f1_mean", 3))


@query("ens4_out_of_fold")
def out_of_fold(spark, sf):
    return M.oof(frame(spark, sf), "y", DIMS, "vec_id", SPECS, 3)[0]


@query("ens4_every_row_once", "SELECT vec_id, CAST(label >= 5 AS INTEGER) AS y, 1::BIGINT AS n FROM embeddings")
def every_row_once(spark, sf):
    wide, _ = M.oof(frame(spark, sf), "y", DIMS, "vec_id", {"linear": SPECS["linear"]}, 3)
    return wide.groupBy("vec_id", "y").agg(F.count("linear").alias("n"))


@query("ens5_fold_model_mean")
def fold_models(spark, sf):
    train, test = _parts(spark, sf)
    _, models = M.oof(train, "y", DIMS, "vec_id", SPECS, 3)
    return K.fold_scores(models, test, "vec_id")


def _stacked(name, **kw):
    @query(name)
    def run(spark, sf):
        train, test = _parts(spark, sf)
        model = K.Stacking(SPECS, DIMS, "y", "vec_id", **kw).fit(train)
        return _measured(model.transform(test), name)
    return run


_stacked("ens7_logistic_meta")
_stacked("ens8_boosted_meta", meta="boosted")
_stacked("ens10_stacking_isotonic", isotonic=True)


@query("ens6_base_models_on_all_rows")
@shared
def full_fit(spark, sf):
    train, test = _parts(spark, sf)
    return M.score_members(M.fit_all(train, "y", DIMS, SPECS), test).select("vec_id", "y", *SPECS)


@query("ens9_meta_on_holdout")
def meta_holdout(spark, sf):
    train, test = _parts(spark, sf)
    return _measured(K.fit_on_holdout(train, "y", DIMS, "vec_id", SPECS).transform(test), "holdout")


def _bundle(name, train, features=DIMS, family="logistic", params=None):
    model = M.as_scorer(M.fit(train, "y", features, family, params))
    return A.Bundle(name, model, 0.5, list(features))


@query("ens11_score_bundles")
@shared
def score_bundles(spark, sf):
    train, test = _parts(spark, sf)
    good, narrow = _bundle("good", train), _bundle("narrow", train, DIMS[:8])
    broken = A.Bundle("broken", good.model, 0.5, ["absent"])
    scored, errors = X.score_bundles([good, narrow, broken], test, "vec_id", "y")
    table = S.evaluate_catalogue(scored)
    return errors.join(table.select("model_id", "accuracy", "roc_auc"), "model_id", "left")


@query("ens12_keep_if_better")
@shared
def keep_better(spark, sf):
    train, test = _parts(spark, sf)
    single = K.fit_on_holdout(train, "y", DIMS, "vec_id", {"linear": SPECS["linear"]})
    stack = K.fit_on_holdout(train, "y", DIMS, "vec_id", SPECS)
    return K.keep_if_better(single, stack, test, "y")[1]


# ---- calibration: events stand for validation and test rows ---------------------------

def _score_parts(spark, sf):
    df = event_scores_wide(spark, sf).select("row_id", F.col("s3").alias("proba"), "y")
    parts = stratified_split(df, "y", "row_id", 0.5)
    return parts.where("split = 'train'").drop("split"), parts.where("split = 'test'").drop("split")


@query("ca1_platt")
def platt(spark, sf):
    valid, test = _score_parts(spark, sf)
    return B.fit_platt(valid).transform(test)


@query("ca2_isotonic")
def isotonic(spark, sf):
    valid, test = _score_parts(spark, sf)
    return B.fit_isotonic(valid).transform(test)


@query("ca3_calibrate_model")
def calibrate(spark, sf):
    train, test = _parts(spark, sf)
    inner, valid = holdout(train, "y", "vec_id", 0.25, seed=7)
    stack = K.fit_on_holdout(inner, "y", DIMS, "vec_id", SPECS)
    return B.calibrate(stack, valid, "y").transform(stack.transform(test)).select("vec_id", "y", "proba")


@query("ca4_compare_calibration")
def compare_calibration(spark, sf):
    return B.compare_calibration(*_score_parts(spark, sf))


@query("ca4_raw_row", f"""WITH {WIDE_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM wide),
t AS (SELECT s3 AS proba, y FROM o WHERE r <= greatest(1, floor(n * 0.5::DOUBLE))),
st AS (SELECT proba, sum(y) AS pos, sum(1 - y) AS neg FROM t GROUP BY 1),
g AS (SELECT CASE WHEN i = 1000 THEN 1 ELSE i * (1::DOUBLE / 1000) END AS threshold FROM range(1001) x(i)),
cm AS (SELECT threshold, CAST(sum(CASE WHEN proba >= threshold THEN pos ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN proba >= threshold THEN neg ELSE 0 END) AS BIGINT) AS fp,
              CAST(sum(CASE WHEN proba < threshold THEN neg ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN proba < threshold THEN pos ELSE 0 END) AS BIGINT) AS fn FROM st, g GROUP BY 1)
SELECT 'raw' AS method, threshold, {METRIC_SQL['accuracy']} AS accuracy, tp, fp, tn, fn FROM cm ORDER BY tp + tn DESC, threshold LIMIT 1""")
def raw_row(spark, sf):
    table = B.compare_calibration(*_score_parts(spark, sf))
    return table.where("method = 'raw'").select("method", "threshold", rnd("accuracy", 9), "tp", "fp", "tn", "fn")


@query("ca4_calibrated_predictions")
@shared
def calibrated(spark, sf):
    valid, test = _score_parts(spark, sf)
    return B.calibrated_predictions(valid, test, "row_id")


# ---- features -------------------------------------------------------------------------

@query("fs1_prefilter", f"WITH {ANOVA_SQL} SELECT feature, f FROM anova ORDER BY f DESC NULLS LAST, feature LIMIT 16")
def prefilter(spark, sf):
    return L.prefilter(embedding_columns(spark, sf), "label", DIMS, 16).select("feature", rnd("f"))


@query("fs1_prefilter_on_sample")
def prefilter_sample(spark, sf):
    return L.prefilter(embedding_columns(spark, sf), "label", DIMS, 16, "vec_id", 300)


def _search(spark, sf, metric="macro_f1"):
    search = L.MaskSearch(seed=1)
    fitness = L.MaskFitness(frame(spark, sf), "y", DIMS, "vec_id", 3, metric=metric)
    try:
        return search.fit(fitness)
    finally:
        fitness.close()


@query("fs2_mask_search")
@shared
def mask_search(spark, sf):
    found = _search(spark, sf)
    return spark.createDataFrame([(f, int(on), found.score) for f, on in zip(DIMS, found.mask)], "feature string, kept int, score double")


@query("fs3_cross_validated_fitness")
def fitness(spark, sf, metric="accuracy"):
    fit_ = L.MaskFitness(frame(spark, sf), "y", DIMS, "vec_id", 3, metric=metric)
    every, half = tuple([1] * 64), tuple([1] * 32 + [0] * 32)
    try:
        return spark.createDataFrame(list(zip(["every", "half"], fit_.score_many([every, half]))), "mask string, score double")
    finally:
        fit_.close()


@query("fs4_prefilter_and_search")
@shared
def select(spark, sf):
    return L.select(frame(spark, sf), "y", DIMS, "vec_id", 16, L.MaskSearch())


@query("fs5_search_history")
@shared
def history(spark, sf):
    return L.history(_search(spark, sf, "accuracy"), spark)


@query("ud1_callable_fitness")
@shared
def callable_fitness(spark, sf):
    df = frame(spark, sf)

    def mean_f(rows, names):
        """Average F of the chosen columns, less a little for each of them."""
        from tidewatch.operators.statistics import anova_f
        return anova_f(rows, names, "y").agg(F.avg("f")).first()[0] - 0.01 * len(names)

    fit_ = L.CallableFitness(df, DIMS, mean_f)
    found = L.MaskSearch(seed=2).fit(fit_)
    return spark.createDataFrame([(f, int(on), found.score) for f, on in zip(DIMS, found.mask)], "feature string, kept int, score double")


@query("fs6_permutation_importance")
@shared
def permutation(spark, sf):
    train, test = _parts(spark, sf)
    model = M.fit(train, "y", DIMS, "logistic")
    return L.permutation_importance(lambda d: M.score(model, d), test, "y", DIMS, "vec_id")


@query("fs7_model_importance")
@shared
def importance(spark, sf):
    return M.importances(M.fit(frame(spark, sf), "y", DIMS, "forest"), DIMS, spark)


@query("tk3_top_importance")
def top_importance(spark, sf):
    return L.top_importance(importance(spark, sf), 20)


@query("md14_refit_selected")
def refit(spark, sf):
    train, test = _parts(spark, sf)
    kept = [r.feature for r in L.prefilter(train, "y", DIMS, 16).collect()]
    again = M.refit(train, "y", A.Bundle("kept", None, 0.45, kept))
    return X.predict_report(again, test, "y")[1]


# ---- parameters -----------------------------------------------------------------------

@query("tu1_random_search")
@shared
def random_search(spark, sf):
    space = {"C": ("log", 0.01, 10.0), "maxIter": ("int", 10, 30)}
    return U.random_search(frame(spark, sf), "y", DIMS, "vec_id", space, k=3, metric="composite", family="logistic")[1]


@query("tu2_trial_study")
def trial_study(spark, sf):
    space = {"C": ("log", 0.01, 10.0), "maxIter": ("choice", [50, 200])}
    goal = U.cv_objective("y", DIMS, "vec_id", "logistic")
    return U.Study(space).run(frame(spark, sf), "vec_id", goal)[1]


@query("tu3_candidate_search")
@shared
def candidates(spark, sf):
    return U.candidate_search(frame(spark, sf), "y", DIMS, "vec_id", SPECS, k=3)


@query("tu4_composite_evaluator", f"""WITH {WIDE_SQL}, st AS (SELECT s3 AS p, sum(y) AS pos, sum(1 - y) AS neg FROM wide GROUP BY 1),
pt AS (SELECT *, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS up FROM st)
SELECT round(((SELECT sum(neg::DOUBLE * (up - pos / 2::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) FROM pt)
  + (SELECT avg(CASE WHEN (s3 >= 0.5) = (y = 1) THEN 1 ELSE 0 END) FROM wide)) / 2, 9) AS composite""")
def evaluator(spark, sf):
    value = U.CompositeEvaluator(label="y").evaluate(event_scores_wide(spark, sf).select(F.col("s3").alias("proba"), "y"))
    return spark.createDataFrame([(value,)], "composite double").select(rnd("composite", 9))


# ---- scoring jobs ---------------------------------------------------------------------

@query("snk8_save_load_promote")
def save_load(spark, sf):
    train, test = _parts(spark, sf)
    source, target = scratch_path(spark, "bundle"), scratch_path(spark, "chosen")
    A.save_bundle(spark, _bundle("linear", train), source)
    A.promote(spark, source, target, {"accuracy": 0.5}, "the only one")
    b = A.load_bundle(spark, target)
    return X.predict(b, test).select("vec_id", "proba", "pred")


@query("sc1_predict")
def predict(spark, sf):
    train, test = _parts(spark, sf)
    return X.predict(_bundle("linear", train), test).select("vec_id", "y", "proba", "pred")


@query("sc2_predict_report")
def predict_report(spark, sf):
    train, test = _parts(spark, sf)
    return X.predict_report(_bundle("linear", train), test, "y")[1]


@query("sc3_reproduce", "SELECT unnest(['accuracy', 'precision', 'recall', 'f1', 'roc_auc']) AS metric, true AS same")
def reproduce(spark, sf):
    train, test = _parts(spark, sf)
    path = scratch_path(spark, "bundle")
    bundle = _bundle("linear", train)
    A.save_bundle(spark, bundle, path)
    saved = X.metric_rows(X.predict_report(bundle, test, "y")[1], ["accuracy", "precision", "recall", "f1", "roc_auc"])
    return X.reproduce(A.load_bundle(spark, path), test, "y", saved).select("metric", "same")


@query("src10_model_catalogue")
@shared
def model_catalogue(spark, sf):
    train, _ = _parts(spark, sf)
    folder = scratch_path(spark, "models")
    _bundle("linear", train).model.write().overwrite().save(f"{folder}/linear")
    return G.model_catalogue(spark, folder, {"absent": f"{folder}/absent"}).select("model_id", "status")


@query("sc4_promote_best")
@shared
def promote_best(spark, sf):
    train, test = _parts(spark, sf)
    folder = scratch_path(spark, "bundles")
    bundles = [_bundle("wide", train), _bundle("narrow", train, DIMS[:8])]
    for b in bundles:
        A.save_bundle(spark, b, f"{folder}/{b.name}")
    table = S.evaluate_catalogue(X.score_bundles(bundles, test, "vec_id", "y")[0])
    chosen = X.promote_best(spark, folder, f"{folder}/chosen", table)
    return spark.createDataFrame([(chosen.name, chosen.reason)], "name string, reason string")


@query("sc5_evaluate_bundle")
@shared
def evaluate_bundle(spark, sf):
    train, test = _parts(spark, sf)
    good = _bundle("good", train)
    path = scratch_path(spark, "bundle")
    A.save_bundle(spark, A.Bundle("wrapper", K.SelectedModel(_bundle("half", train, DIMS[::2]).model, range(0, len(DIMS), 2), DIMS), 0.45, DIMS), path)
    broken = A.Bundle("broken", good.model, 0.5, ["absent"])
    return X.evaluate_bundle(good, test, "y").unionByName(X.evaluate_bundle(broken, test, "y")).unionByName(
        X.evaluate_stored(spark, path, test, "y")).unionByName(X.evaluate_stored(spark, f"{path}_absent", test, "y"))


@query("ud5_foreign_model", """
SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE))), 9) AS proba FROM embeddings""")
def foreign(spark, sf):
    df = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return df.select("vec_id", F.round(proba_udf(_Linear())("x"), 9).alias("proba"))


class _Linear:
    def decision_function(self, x):
        return x[:, 0] + 2 * x[:, 1]


# ---- streams --------------------------------------------------------------------------

def _event_features(df):
    """Numbers from an event, the same on a table and on a stream."""
    return df.select(
        F.col("event_id").alias("row_id"), (F.col("event_type") == "error").cast("int").alias("y"), "value",
        F.regexp_extract("props", r"\d+", 0).try_cast("double").alias("k"))


@query("sm1_stream_score", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_rows, count(*) AS same_as_batch FROM events")
def stream_score(spark, sf):
    table = _event_features(read_table(spark, sf, "events"))
    model = M.as_scorer(M.fit(table, "y", ["value", "k"], "logistic", {"maxIter": 10}))
    threshold = J.threshold_from(spark.createDataFrame([("run", "all", "threshold", 0.2)], "run_id string, model_id string, metric string, value double"))
    bundle = A.Bundle("events", model, threshold, ["value", "k"])
    schema = read_table(spark, sf, "events").schema
    files = scratch_path(spark, "event_files")
    n = spark.sparkContext.defaultParallelism
    read_table(spark, sf, "events").repartition(n, "event_id").write.parquet(files)
    stream = _event_features(spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, n // 2)).parquet(files))
    out = scratch_path(spark, "stream_scores")
    Z.stream_score(bundle, stream, out, f"{out}_checkpoint", ["row_id", "y"]).awaitTermination()
    batch = X.predict(bundle, table).select("row_id", F.col("pred").alias("batch_pred"), F.col("proba").alias("batch_proba"))
    both = spark.read.parquet(out).join(batch, "row_id", "left")
    same = (F.col("pred") == F.col("batch_pred")) & (F.abs(F.col("proba") - F.col("batch_proba")) < 1e-12)
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("n_rows"), F.count(F.when(same, 1)).alias("same_as_batch"))


@query("sm3_threshold_from_metrics", f"""WITH {WIDE_SQL}, t AS (SELECT max(s3) AS t FROM wide WHERE s3 < 0.5)
SELECT row_id, CAST(s3 >= (SELECT t FROM t) AS INTEGER) AS pred FROM wide""")
def threshold_from(spark, sf):
    wide = event_scores_wide(spark, sf)
    stored = wide.where("s3 < 0.5").agg(F.max("s3").alias("value")).select(
        F.lit("run").alias("run_id"), F.lit("all").alias("model_id"), F.lit("best_threshold").alias("metric"), "value")
    scored = S.apply_threshold(wide.select("row_id", F.col("s3").alias("proba")), J.threshold_from(stored))
    return scored.select("row_id", "pred")
