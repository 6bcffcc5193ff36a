import threading

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidewatch.functions.foreign import proba_udf
from tidewatch.operators import ensembles as E, models as M, scores as S, scoring as X, selection as L, stacking as K, tuning as U
from tidewatch.session import scratch_path
from tidewatch.sources import bundles as A
from tidewatch.streaming import scoring as Z

NAMES = [f"x{i}" for i in range(8)]
FAST = {"maxIter": 15}


@pytest.fixture(scope="module")
def data(spark):
    """Only x0 and x1 carry the label."""
    rng = np.random.default_rng(0)
    x = rng.random((240, 8))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.75).astype(int)
    rows = [(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{n} double" for n in NAMES)).cache()


def auc(df):
    return S.roc_auc(df.select(F.lit("m").alias("model_id"), "proba", "y")).first().roc_auc


@pytest.mark.parametrize("family,params", [("logistic", FAST), ("boosted", {"maxIter": 4, "maxDepth": 3}), ("forest", {"numTrees": 10, "maxDepth": 4})])
def test_families_learn(data, family, params):
    assert auc(M.score(M.fit(data, "y", NAMES, family, params), data)) > 0.85


def test_out_of_fold_scores_each_row_once(data):
    wide, models = M.oof(data, "y", NAMES, "id", {"a": M.Spec("logistic", FAST)}, 3)
    assert wide.count() == wide.select("id").distinct().count() == 240 and set(models) == {0, 1, 2}
    assert auc(wide.withColumnRenamed("a", "proba")) > 0.9
    assert K.fold_scores(models, data, "id").count() == 240


def test_fits_side_by_side_have_properties_of_their_own(spark):
    sc, together = spark.sparkContext, threading.Barrier(4)

    def work(i):
        sc.setLocalProperty("own", str(i))
        together.wait(30)
        seen = sc.getLocalProperty("own")
        together.wait(30)
        return seen

    assert M.run_threads(list(range(8)), work, 4) == [str(i) for i in range(8)]
    assert sc.getLocalProperty("own") is None


def test_classes_against_the_rest_are_those_of_spark(data):
    three = data.withColumn("c", (F.col("x0") * 3).cast("int"))
    rows = VectorAssembler(inputCols=NAMES, outputCol="x").transform(three)
    base = GBTClassifier(maxIter=2, maxDepth=2, seed=1)
    own, plain = (kind(classifier=base, featuresCol="x", labelCol="c", predictionCol="p", parallelism=n).fit(rows) for kind, n in ((M.ParallelOneVsRest, 3), (OneVsRest, 1)))
    assert own.transform(rows).select("id", "p").collect() == plain.transform(rows).select("id", "p").collect()


def test_a_model_that_cannot_be_fitted_raises(data):
    with pytest.raises(Exception):
        M.oof(data, "y", NAMES, "id", {"a": M.Spec("logistic", FAST, ["absent"])}, 2)


def test_stacking(data):
    specs = {"a": M.Spec("logistic", FAST), "b": M.Spec("forest", {"numTrees": 5, "maxDepth": 3})}
    model = K.Stacking(specs, NAMES, "y", "id", k=2, meta_params=FAST).fit(data)
    assert auc(model.transform(data)) > 0.9


@pytest.mark.parametrize("isotonic", [False, True])
def test_parts_of_a_stack_learn_from_their_own_rows_even_without_a_signal(spark, isotonic):
    from tidewatch.plans.properties import _beats_constant, _parts_learned
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(2)), *map(float, rng.random(8))) for i in range(240)]
    noise = spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{n} double" for n in NAMES))
    specs = {"forest": M.Spec("forest", {"numTrees": 10, "maxDepth": 8}), "linear": M.Spec("logistic", FAST)}
    model = K.Stacking(specs, NAMES, "y", "id", isotonic=isotonic).fit(noise)
    assert _parts_learned(model)
    # the labels turned round: a model of the opposite is worse than a constant
    assert not _beats_constant(M.score_members(model.members, noise).withColumn("y", 1 - F.col("y")), ["forest"])
    assert not _beats_constant(model.combine(model.meta_rows.withColumn("y", 1 - F.col("y"))), ["proba"])


def test_bags_are_seeded(data):
    run = lambda: M.fit_bag(data, "y", NAMES, "id", n=2, family="forest", params={"numTrees": 3, "maxDepth": 2})
    a, b = run(), run()
    assert [m.features for m in a] == [m.features for m in b]
    score = lambda ms: [tuple(r) for r in M.score_members(ms, data).orderBy("id").select("bag0", "bag1").limit(5).collect()]
    assert score(a) == score(b)


def test_high_cardinality_categories(spark):
    df = spark.range(400).select("id", (F.col("id") % 2).cast("int").alias("y"), F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("c"), F.lit(1.0).alias("n"))
    model = M.fit_with_categories(df, "y", ["n"], ["c"], "id", params={"maxIter": 2, "maxDepth": 2})
    assert auc(M.score(model, df)) > 0.95
    # a category of its own for each row says nothing about its label
    alone = df.withColumn("c", F.col("id").cast("string"))
    model = M.fit_with_categories(alone, "y", ["n"], ["c"], "id", params={"maxIter": 2, "maxDepth": 2})
    assert M.score(model, alone.withColumn("c", F.lit("new"))).select("proba").distinct().count() == 1


def test_multiclass(spark):
    df = spark.range(300).select("id", F.col("id").cast("double").alias("v"), F.expr("CASE WHEN id < 100 THEN 'a' WHEN id < 200 THEN 'b' ELSE 'c' END").alias("label"))
    model = M.fit_multiclass(df, "label", ["v"], "forest", {"numTrees": 5, "maxDepth": 4})
    assert S.macro_f1(M.predict_class(model, df, "label").withColumnRenamed("label", "y"), []).first().macro_f1 > 0.95


def test_mask_search_finds_the_feature(spark):
    x = np.random.default_rng(0).random((100, 20))
    names = [f"f{i}" for i in range(20)]
    rows = [(i, int(r[0] > 0.5), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, y int, " + ", ".join(f"{n} double" for n in names))
    fitness = L.MaskFitness(df, "y", names, "id", 3)
    found = L.MaskSearch(population=6, rounds=4, seed=1).fit(fitness)
    assert found.mask[0] == 1 and found.score > 0.8
    assert found.history == sorted(found.history) and len(found.history) == 5
    only, others = (1,) + (0,) * 19, (0,) + (1,) * 19
    a, b = fitness.score_many([only, others])
    assert a > 0.9 > b and set(fitness.cache) >= {only, others}
    again = L.MaskSearch(population=6, rounds=4, seed=1).fit(fitness)
    assert again.mask == found.mask
    fitness.close()


def test_each_round_of_the_mask_search_looks_at_every_feature():
    class Wanted:
        features = [f"f{i}" for i in range(64)]

        def score_many(self, masks):
            return [float(sum(v == (i % 3 == 0) for i, v in enumerate(m))) for m in masks]

    found = L.MaskSearch(population=2, rounds=1).fit(Wanted())
    assert found.mask == [int(i % 3 == 0) for i in range(64)] and found.score == 64


def test_any_function_can_be_the_fitness(spark):
    def score(df, features):
        if "b" in features:
            raise RuntimeError("no")
        return float(len(features))
    fitness = L.CallableFitness(spark.range(1), ["a", "b", "c"], score)
    assert fitness.score_many([(1, 0, 1), (1, 1, 0)]) == [2.0, float("-inf")]


def test_permutation_importance(data):
    model = M.fit(data, "y", NAMES, "logistic", FAST)
    table = L.permutation_importance(lambda d: M.score(model, d), data, "y", NAMES, "id", repeats=2).collect()
    assert table[0].feature == "x0" and table[0].importance > 0.1 and len(table) == 8
    assert all(abs(r.importance) < 0.05 for r in table[2:])


def test_search_and_trials(data):
    best, table = U.random_search(data, "y", NAMES, "id", {"C": ("log", 0.001, 10.0), "maxIter": ("int", 5, 15)}, n=2, k=2, family="logistic")
    assert table.count() == 2 and set(best) == {"C", "maxIter"}
    goal = lambda params, rows: -abs(params["v"] - 0.3) if params["v"] < 0.8 else 1 / 0
    best, table = U.Study({"v": ("uniform", 0.0, 1.0)}, n=9, rungs=3).run(data, "id", goal)
    rows = table.collect()
    assert [sum(r.rung == i for r in rows) for i in range(3)] == [9, 4, 2]
    assert {r.n_rows for r in rows if r.rung == 2} == {240} and max(r.n_rows for r in rows if r.rung == 0) < 100
    assert all((r.error is None) == (float(r.params["v"]) < 0.8) and (r.error is None) == (r.score is not None) for r in rows)
    assert abs(best["v"] - 0.3) == min(abs(float(r.params["v"]) - 0.3) for r in rows if r.rung == 2)
    again = U.Study({"v": ("uniform", 0.0, 1.0)}, n=9, rungs=3).run(data, "id", goal)[1]
    assert again.collect() == rows
    best, table = U.Study({"C": ("log", 0.01, 10.0)}, n=2, rungs=2).run(data, "id", U.cv_objective("y", NAMES, "id", "logistic", k=2))
    assert all(r.score > 0.7 for r in table.collect() if r.rung == 1) and set(best) == {"C"}


def test_weights_and_stopping_inside_folds(data):
    spec = M.Spec("boosted", {"maxIter": 12, "maxDepth": 3}, weight="balanced", valid_part=0.25)
    wide, models = M.oof(data, "y", NAMES, "id", {"a": spec}, 2)
    assert wide.count() == 240 and auc(wide.withColumnRenamed("a", "proba")) > 0.85
    assert all(m[0].model.stages[-1].getNumTrees <= 12 and m[0].model.stages[-1].getWeightCol() == "weight" for m in models.values())
    with pytest.raises(ValueError):
        M.fit_all(data, "y", NAMES, {"a": spec})


def test_folds_of_several_classes(spark):
    df = spark.range(180).select("id", (F.col("id") % 60).cast("double").alias("v"), F.expr("CASE WHEN id % 60 < 20 THEN 'a' WHEN id % 60 < 40 THEN 'b' ELSE 'c' END").alias("label"))
    specs = {"f": M.Spec("forest", {"numTrees": 5, "maxDepth": 4}), "w": M.Spec("forest", {"numTrees": 5, "maxDepth": 4}, weight="balanced")}
    rows = M.cross_validate_classes(df, "label", ["v"], "id", specs, 3).collect()
    assert len(rows) == 6 and sum(r.n_test for r in rows) == 360 and min(r.macro_f1 for r in rows) > 0.85


def test_evaluator(data):
    scored = M.score(M.fit(data, "y", NAMES, "logistic", FAST), data)
    value = U.CompositeEvaluator(label="y").evaluate(scored)
    assert 0.85 < value <= 1.0 and U.CompositeEvaluator().isLargerBetter()


def bundle(data, name="b", features=NAMES):
    return A.Bundle(name, M.as_scorer(M.fit(data, "y", features, "logistic", FAST)), 0.4, list(features))


def test_bundles(spark, data):
    path = scratch_path(spark, "bundle")
    b = bundle(data)
    A.save_bundle(spark, b, path)
    again = A.load_bundle(spark, path)
    assert (again.name, again.threshold, again.columns) == ("b", 0.4, NAMES)
    assert X.predict(b, data).orderBy("id").collect() == X.predict(again, data).orderBy("id").collect()
    with pytest.raises(ValueError):
        X.predict(b, data.drop("x0"))
    chosen = A.promote(spark, path, scratch_path(spark, "best"), {"accuracy": 0.9}, "why")
    assert chosen.metrics == {"accuracy": 0.9} and chosen.source == path


def test_unusable_bundles_are_listed_not_scored(data):
    good, bad = bundle(data, "good"), A.Bundle("bad", None, 0.5, ["absent"])
    scored, errors = X.score_bundles([good, bad], data, "id", "y")
    assert {r.model_id for r in scored.select("model_id").distinct().collect()} == {"good"}
    assert {r.model_id: r.status for r in errors.collect()} == {"good": "ok", "bad": "failed"}
    row = X.evaluate_bundle(bad, data, "y").first()
    assert row.error and row.accuracy is None


def test_foreign_models(spark):
    class Halves:
        def predict_proba(self, x):
            return np.column_stack([1 - x[:, 0], x[:, 0]])
    df = spark.createDataFrame([([0.25, 9.0],)], "x array<double>")
    assert df.select(proba_udf(Halves())("x").alias("p")).first().p == 0.25


def test_stream_equals_batch(spark, data):
    b = bundle(data)
    files, out, cells = (scratch_path(spark, n) for n in ("files", "out", "cells"))
    for part in (data.where("id < 100"), data.where("id >= 100")):
        part.write.mode("append").parquet(files)
    stream = lambda: spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(files)
    Z.stream_score(b, stream(), out, out + "_c", ["id", "y"]).awaitTermination()
    batch = X.predict(b, data)
    key = lambda d: sorted((r.id, round(r.proba, 12), r.pred) for r in d.collect())
    assert key(spark.read.parquet(out)) == key(batch)
    Z.stream_summary(X.predict(b, stream()), cells, cells + "_c").awaitTermination()
    got = Z.counts_report(Z.latest_counts(spark, cells)).first()
    want = S.evaluate_catalogue(batch.select(F.lit("m").alias("model_id"), "proba", "pred", "y"), None).first()
    assert (got.tp, got.fp, got.tn, got.fn, got.n) == (want.tp, want.fp, want.tn, want.fn, 240)
    assert got.roc_auc == pytest.approx(want.roc_auc, abs=1e-12) and got.n_missing == 0


def test_blends(spark):
    df = spark.createDataFrame([(1, 0.1, 0.5, None), (2, 0.2, 0.4, 0.9), (3, None, None, None)], "id long, a double, b double, c double")
    mean = {r.id: r.proba for r in E.blend_wide(df, ["a", "b", "c"]).collect()}
    mid = {r.id: r.proba for r in E.blend_wide(df, ["a", "b", "c"], "median").collect()}
    assert mean == {1: pytest.approx(0.3), 2: pytest.approx(0.5), 3: None} and mid == {1: pytest.approx(0.3), 2: 0.4, 3: None}


def test_alignment(spark):
    p = spark.createDataFrame([(1, 0.5), (2, 0.5), (2, 0.6), (9, 0.1)], "id long, proba double")
    t = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id long, y int")
    assert tuple(E.align_report(p, t, "id").first()) == (1, 1, 1, 1)


def test_runs_of_a_stream_are_merged_and_survive_a_second_try(spark):
    rows = [(i, None if i % 9 == 0 else (i * 37 % 101) / 101, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, proba double, y int").withColumn("pred", F.coalesce((F.col("proba") >= 0.5).cast("int"), F.lit(0)))
    files, out = scratch_path(spark, "files"), scratch_path(spark, "runs")
    for i in range(11):
        df.where(F.col("id") % 11 == i).coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(files)
    Z.stream_summary(stream, out, out + "_c", fan_in=2).awaitTermination()
    from tidewatch.session import folder_names
    names = folder_names(spark, out)
    assert "run_3_0_7" in names and "run_1_8_9" in names and "run_0_10_10" in names and len([n for n in names if n.startswith("manifest")]) <= 3
    want = sorted(map(str, Z.score_counts(df).collect()))
    assert sorted(map(str, Z.latest_counts(spark, out).select("proba", "pred", "y", "n").collect())) == want
    report = Z.counts_report(Z.latest_counts(spark, out)).first()
    assert (report.n, report.n_missing) == (400, 45)
    assert report.roc_auc == pytest.approx(S.roc_auc(df.withColumn("model_id", F.lit("m"))).first().roc_auc, abs=1e-12)
    # a batch that runs again starts from the manifest before it
    Z._swept(spark, out, 10)
    assert sorted(map(str, Z._merged(spark, out, Z._manifest(spark, out, 9)).select("n").collect()))
    assert Z.counts_report(Z.latest_counts(spark, scratch_path(spark, "none"))).count() == 0


def test_weights_by_updates_are_those_of_each_mask_alone():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 7)), rng.integers(0, 2, 80)
    x[:, 5] = 0  # a column without any variation
    z = np.column_stack([np.ones(80), y, x])
    sums = z.T @ z
    masks = rng.integers(0, 2, (30, 7))
    masks[1] = masks[0]
    masks[2] = 1 - masks[0]
    got = L.solve_masks(sums.copy(), masks, 1e-3)
    for mask, w in zip(masks, got, strict=True):
        cols = np.flatnonzero(mask)
        d = np.column_stack([np.ones(80), x[:, cols]])
        a = d.T @ d
        scale = np.diag(a)[1:]
        a[np.arange(1, len(a)), np.arange(1, len(a))] += 1e-3 * np.where(scale > 0, scale, 1.0)
        assert w[np.append(0, cols + 1)] == pytest.approx(np.linalg.solve(a, d.T @ (2.0 * y - 1)), abs=1e-8)
        assert (w[1:][mask == 0] == 0).all()


@pytest.mark.parametrize("metric", ["macro_f1", "accuracy"])
def test_mask_scores_are_those_of_each_fold(spark, metric):
    rng = np.random.default_rng(4)
    x = rng.random((90, 5))
    rows = [(i, int(r[0] + 0.3 * r[1] > 0.6), *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d double, e double").repartition(4)
    names = list("abcde")
    fitness = L.MaskFitness(df, "y", names, "id", 3, metric=metric)
    masks = [tuple(int(b) for b in rng.integers(0, 2, 5)) for _ in range(6)] + [(1, 1, 1, 1, 1)]
    got = fitness.score_many(masks)
    fold = {r.id: r.fold for r in L.kfold(df, "y", "id", 3, 0).collect()}
    f, y = np.array([fold[i] for i in range(90)]), np.array([r[1] for r in rows])
    for mask, score in zip(masks, got, strict=True):
        values = []
        for k in range(3):
            z = np.column_stack([np.ones(90), y, x])[f != k]
            w = L.solve_masks(z.T @ z, np.array([mask]), 1e-3)[0]
            pred = (np.column_stack([np.ones(90), x]) @ w >= 0)[f == k].astype(int)
            t = y[f == k]
            f1 = [2 * ((pred == c) & (t == c)).sum() / ((pred == c).sum() + (t == c).sum()) for c in (0, 1) if ((pred == c) | (t == c)).any()]
            values.append((pred == t).mean() if metric == "accuracy" else np.mean(f1))
        assert score == pytest.approx(np.mean(values))
    changed, scores = fitness.best_change([1, 0, 0, 1, 0], -1.0)
    singles = [tuple(1 - v if i == j else v for i, v in enumerate((1, 0, 0, 1, 0))) for j in range(5)]
    assert scores[0] == max(fitness.score_many(singles)) and changed[0] in singles
    fitness.close()


def test_text_columns_have_an_importance(spark):
    rows = [(i, i % 2, "yes" if i % 2 else "no", float(i % 5), None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y int, word string, n double, gone string")
    score = lambda d: d.withColumn("proba", F.when(F.col("word") == "yes", 0.9).otherwise(0.1))
    table = {r.feature: r for r in L.permutation_importance(score, df, "y", ["word", "n", "gone"], "id", repeats=4).collect()}
    assert table["word"].importance > 0.2 and table["n"].importance == 0 == table["gone"].importance and table["word"].repeats == 4
    assert L.permutation_importance(score, df.limit(0), "y", ["word"], "id").count() == 0
