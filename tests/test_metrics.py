import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.grids import GRIDS
from tidewatch.operators import calibration as B, scores as S


def frame(spark, rows):
    return spark.createDataFrame([("m", float(p) if p is not None else None, y) for p, y in rows], "model_id string, proba double, y int")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for _ in range(600):
        y = int(rng.random() < 0.3)
        out.append((round(min(1, max(0, 0.4 * y + 0.6 * rng.random())), 2), y))
    # A third of all rows share one score.
    return out + [(0.35, int(rng.random() < 0.5)) for _ in range(300)]


def brute_auc(rows):
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_auc_and_average_precision(spark, rows, ranges):
    df = frame(spark, rows)
    auc = S.roc_auc(df, ranges=ranges).first().roc_auc
    assert auc == pytest.approx(brute_auc(rows), abs=1e-12)
    ap, seen, hits, last = 0.0, 0, 0, 0.0
    for s in sorted({p for p, _ in rows}, reverse=True):
        group = [y for p, y in rows if p == s]
        seen, hits = seen + len(group), hits + sum(group)
        recall = hits / sum(y for _, y in rows)
        ap, last = ap + (recall - last) * hits / seen, recall
    assert S.average_precision(df, ranges=ranges).first().pr_auc == pytest.approx(ap, abs=1e-12)


def test_auc_is_invariant(spark, rows):
    df = frame(spark, rows)
    base = S.roc_auc(df).first().roc_auc
    assert S.roc_auc(df.withColumn("proba", F.exp("proba") * 3)).first().roc_auc == base
    assert S.roc_auc(df.withColumn("proba", 1 - F.col("proba"))).first().roc_auc == pytest.approx(1 - base)
    assert S.roc_auc(df.repartition(9)).first().roc_auc == base


def test_curves_over_ranges(spark, rows):
    df = frame(spark, rows)
    key = lambda d: sorted(map(tuple, d.select(*[F.coalesce(c, F.lit(9.0)) if c == "threshold" else c for c in d.columns]).collect()))
    for fn in (S.roc_curve, S.pr_curve, lambda d, **k: S.roc_curve(d, drop_collinear=True, **k), S.best_f1):
        assert key(fn(df)) == key(fn(df, ranges=7))
    one, many = S.evaluate_catalogue(df, ranges=1).first().asDict(), S.evaluate_catalogue(df, ranges=7).first().asDict()
    # sums of doubles differ in their last digit
    assert many == {k: v if isinstance(v, str) else pytest.approx(v, abs=1e-12) for k, v in one.items()}


@pytest.mark.parametrize("name", list(GRIDS))
def test_sweep_equals_brute_force(spark, rows, name):
    best = max(((sum((p >= t) == bool(y) for p, y in rows) / len(rows), -t) for t in GRIDS[name].values()))
    got = S.sweep(frame(spark, rows), GRIDS[name]).first()
    assert (got.accuracy, got.threshold) == (pytest.approx(best[0]), -best[1])
    assert got.tp + got.fp + got.tn + got.fn == len(rows)
    for ranges in (1, 9):
        both = S.sweep_and_auc(frame(spark, rows), GRIDS[name], ranges=ranges).first()
        assert (both.threshold, both.accuracy, both.tp, both.fp, both.tn, both.fn) == (got.threshold, got.accuracy, got.tp, got.fp, got.tn, got.fn)
        assert both.roc_auc == pytest.approx(brute_auc(rows))


def test_scores_on_grid_points(spark):
    df = frame(spark, [(350 * (1 / 1000), 1), (0.57, 1), (0.1, 0)])
    for t in (0.35, 0.57):
        grid = S.metrics_at_grid(df, GRIDS["thousandths"].values()).collect()
        for r in grid:
            assert r.tp == sum(p >= r.threshold for p in (350 * (1 / 1000), 0.57))


def test_best_f1_and_recall_targets(spark, rows):
    def f1(t):
        tp = sum(p >= t and y for p, y in rows)
        fp, fn = sum(p >= t and not y for p, y in rows), sum(p < t and y for p, y in rows)
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    scores = sorted({p for p, _ in rows} | {0.0, 1.0})
    best = max((f1(t), -t) for t in scores)
    got = S.best_f1(frame(spark, rows)).first()
    assert (got.f1, got.threshold) == (pytest.approx(best[0]), -best[1])
    n = sum(y for _, y in rows)
    recall = lambda t: sum(p >= t and y for p, y in rows) / n
    assert S.threshold_for_recall(frame(spark, rows), 0.9).first().threshold == max(t for t in {p for p, _ in rows} if recall(t) >= 0.9)


def test_best_f1_prefers_the_lower_anchor(spark):
    assert S.best_f1(frame(spark, [(0.4, 1), (0.6, 1)])).first().threshold == 0.0
    assert S.best_f1(frame(spark, [(2.0, 1), (0.5, 0)])).first().threshold == 1.0


def test_one_class_and_empty(spark):
    one = frame(spark, [(0.2, 1), (0.9, 1)])
    assert S.roc_auc(one).first().roc_auc is None
    report = S.evaluate_catalogue(one).first()
    assert report.composite == report.accuracy == 0.5 and report.fpr is None and report.specificity == 0.0
    empty = frame(spark, [(0.2, 1)]).where("proba > 1")
    for fn in (S.roc_auc, S.average_precision, S.roc_curve, S.pr_curve, S.best_f1, S.evaluate_catalogue, lambda d: S.sweep(d, GRIDS["percent"])):
        assert fn(empty).count() == 0


def test_missing_scores_are_left_out(spark):
    df = frame(spark, [(None, 1), (float("nan"), 0), (0.2, 0), (0.7, 1)])
    got = S.evaluate_catalogue(df).first()
    assert (got.tp, got.fp, got.tn, got.fn, got.roc_auc) == (1, 0, 1, 0, 1.0)


def test_undefined_ratios_are_zero(spark):
    df = spark.createDataFrame([("m", 0, 0)], "model_id string, pred int, y int")
    got = S.basic_metrics(df).first()
    assert (got.precision, got.recall, got.f1, got.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_classes_of_truth_and_prediction(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "y string, pred string")
    rows = {r["class"]: (r.support, r.f1) for r in S.class_report(df, []).collect()}
    assert rows == {"a": (2, 0.5), "b": (1, 0.0), "c": (0, 0.0)}
    assert S.macro_f1(df, []).first().macro_f1 == pytest.approx(1 / 6)


def test_ties_of_the_best_go_to_the_first(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "model_id string, s double")
    assert S.arg_best(df, "s", "model_id").first().model_id == "a"


def test_isotonic_is_monotone_and_platt_increases(spark, rows):
    df = frame(spark, rows).drop("model_id")
    grid = spark.createDataFrame([(i / 50,) for i in range(-5, 56)], "proba double").withColumn("x", F.col("proba"))
    for model in (B.fit_isotonic(df), B.fit_platt(df)):
        out = [r.proba for r in model.transform(grid).orderBy("x").collect()]
        assert all(a <= b + 1e-12 for a, b in zip(out, out[1:])) and all(-1e-9 <= p <= 1 + 1e-9 for p in out)


def test_calibration_report_picks_the_most_accurate(spark, rows):
    df = frame(spark, rows).drop("model_id")
    table = B.compare_calibration(df, df).collect()
    best = max(r.accuracy for r in table)
    assert [r.accuracy for r in table if r.chosen] == [best] and {r.method for r in table} == {"raw", "platt", "isotonic"}


def test_grid_of_any_length_counts_like_a_theta_join(spark):
    rows = [(m, (i * 7 % 23) / 22, i % 2) for m in ("a", "b") for i in range(40)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "model_id string, proba double, y int")
    grid = spark.range(12_000).selectExpr("id / 11999D AS threshold").unionByName(spark.createDataFrame([(0.5,), (0.5,), (None,)], "threshold double"))
    got = {(r.model_id, r.threshold): (r.tp, r.fp, r.tn, r.fn) for r in S.grid_confusion(df, grid, ranges=5).collect()}
    points = {i / 11999 for i in range(12_000)} | {0.5}
    assert set(got) == {(m, t) for m in ("a", "b") for t in points}
    for m, t in list(got)[::997] + [("a", 0.0), ("b", 1.0), ("a", 0.5)]:
        own = [(p >= t, y) for k, p, y in rows if k == m and p is not None]
        assert got[m, t] == tuple(own.count(c) for c in ((True, 1), (True, 0), (False, 0), (False, 1)))


def test_f_test_follows_spark_and_keeps_rows_with_other_nulls(spark):
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
    from tidewatch.operators import statistics as T
    random.seed(3)
    names = [f"x{j}" for j in range(8)]
    rows = [(i % 3, *[random.gauss((i % 3) * 0.06 * j, 1) for j in range(8)]) for i in range(300)]
    df = spark.createDataFrame(rows, ["y", *names])
    vec = VectorAssembler(inputCols=names, outputCol="v").transform(df)
    for mode in ("fpr", "fdr", "fwe"):
        picker = UnivariateFeatureSelector(featuresCol="v", labelCol="y", outputCol="o", selectionMode=mode)
        picker.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(0.05)
        wanted = set(picker.fit(vec).selectedFeatures)
        assert {i for i, r in enumerate(T.select_by_p(df, names, "y", mode).collect()) if r.kept} == wanted
    plain = {r.feature: r.p for r in T.f_test(df, names, "y").collect()}
    holes = df.withColumn("x0", F.lit(None).cast("double")).withColumn("x1", F.expr("if(y = 0, null, x1)"))
    found = {r.feature: r.p for r in T.f_test(holes, names, "y").collect()}
    assert found["x0"] is None and all(abs(found[c] - plain[c]) < 1e-12 for c in names[2:])
    # F(1, d) at the square of t: two-sided t test, here with known values
    assert abs(T._incomplete_beta(10 / (10 + 2.228138852 ** 2), 5, 0.5) - 0.05) < 1e-8
    assert abs(T._incomplete_beta(0.3, 1, 1) - 0.3) < 1e-14
