"""Neighbour joins against all pairs, and saved models of every shape against the models that were saved."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import calibration as B, models as M, neighbours as N, preparation as Q, resampling as R, scoring as X, stacking as K
from tidewatch.operators.composite import load_any
from tidewatch.session import scratch_path
from tidewatch.sources import bundles as A, catalogue as G


def clumps(n, dims=6, seed=0):
    """Points around n / 50 centres that are far from each other."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-100, 100, (max(1, n // 50), dims))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.5, (n, dims))


def frame(spark, x, key=int, y=None):
    rows = [(key(i), [float(v) for v in r], int(y[i]) if y is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, f"id {'string' if key is str else 'long'}, v array<double>, y int").repartition(5)


def brute(ids, x, k):
    out = {}
    order_of_ids = {i: p for p, i in enumerate(sorted(ids))}
    for i, own in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        order = sorted(range(len(ids)), key=lambda j: (d[j], order_of_ids[ids[j]]))[:k]
        out[own] = [ids[j] for j in order]
    return out


@pytest.mark.parametrize("key", [int, str])
def test_exact_neighbours_in_many_cells(spark, key):
    x = clumps(600)
    x[100:160] = x[100]
    got = {}
    for r in N.knn_join(frame(spark, x, key), frame(spark, x, key), "id", "v", 4, cell_rows=20, block_rows=16).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute([key(i) for i in range(600)], x, 4)


def test_neighbours_in_another_table_and_of_odd_rows(spark):
    left = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (None, [5.0, 5.0]), (4, [9.0, 9.0]), (5, [9.0, 9.0])], "id long, v array<double>")
    right = spark.createDataFrame([(1, [0.0, 1.0]), (7, [0.0, 2.0]), (8, [float("nan"), 0.0]), (9, [9.0, 9.0])], "id long, v array<double>")
    rows = lambda **kw: sorted((r.id, r.rank, r.neighbour) for r in N.knn_join(left, right, "id", "v", 2, **kw).collect())
    assert rows(exclude_self=False) == [(1, 1, 1), (1, 2, 7), (4, 1, 9), (4, 2, 7), (5, 1, 9), (5, 2, 7)]
    assert rows() == [(1, 1, 7), (1, 2, 9), (4, 1, 9), (4, 2, 7), (5, 1, 9), (5, 2, 7)]
    assert N.knn_join(left, right.limit(0), "id", "v", 2).count() == 0 and N.knn_join(left.limit(0), right, "id", "v", 2).count() == 0
    with pytest.raises(ValueError):
        N.knn_join(left, right, "id", "v", 2, method="other")


def test_compared_pairs_grow_with_the_rows(spark, monkeypatch):
    whole, pairs = N._meet, []

    def counted(lefts, rights, need, block_rows):
        n = lefts.groupBy("target").agg(F.count(F.lit(1)).alias("a")).join(rights.groupBy("target").agg(F.count(F.lit(1)).alias("b")), "target")
        pairs[-1] += n.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
        return whole(lefts, rights, need, block_rows)

    monkeypatch.setattr(N, "_meet", counted)
    for n in (1000, 4000):
        pairs.append(0)
        df = frame(spark, clumps(n))
        N.knn_join(df, df, "id", "v", 5, cell_rows=50).count()
    # four times the rows: all pairs would be sixteen times as many
    assert pairs[1] < 6 * pairs[0] and pairs[1] < 4000 * 4000 / 10


def test_rows_that_meet_many_cells_are_not_written_for_each(spark, monkeypatch):
    """Vectors without structure, some of them very near to each other: every ball meets nearly all cells."""
    whole, sent = N._meet, []

    def counted(lefts, rights, need, block_rows):
        sent.append(lefts.count())
        return whole(lefts, rights, need, block_rows)

    monkeypatch.setattr(N, "_meet", counted)
    x = np.random.default_rng(3).normal(size=(400, 12))
    x[50:60] = x[50] + 1e-9 * x[50:60]
    x[60:64] = x[60]
    df, got = frame(spark, x, str), {}
    for r in N.knn_join(df, df, "id", "v", 4, cell_rows=20, block_rows=16).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute([str(i) for i in range(400)], x, 4)
    assert len(sent) == 2 and sent[1] <= 8 * 400


def test_vectors_of_one_table_are_written_three_times(spark, monkeypatch):
    """As points, with their cells, and with the cells that they meet; rows come back by keys, with no join of vectors."""
    whole, written = N.write_scratch, []

    def counted(df):
        written.append(any(kind.startswith("array") for _, kind in df.dtypes))
        return whole(df)

    monkeypatch.setattr(N, "write_scratch", counted)
    monkeypatch.setattr(N, "SENT_CELLS", 1000, raising=False)
    x = clumps(120)
    x[20:30] = x[20]
    df, got = frame(spark, x), {}
    for r in N.knn_join(df, df, "id", "v", 3, cell_rows=20).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute(list(range(120)), x, 3)
    assert sum(written) <= 3


def test_nearest_by_products_are_those_of_sums():
    """Far from the origin, with ties, and where squares overflow: products must leave nothing out."""
    rng = np.random.default_rng(1)
    for a, b in ((1e7 + rng.normal(size=(50, 5)), 1e7 + rng.normal(size=(300, 5))), (rng.integers(0, 2, (50, 6)), rng.integers(0, 2, (300, 6))),
                 (1e160 * rng.normal(size=(20, 3)), 1e160 * rng.normal(size=(40, 3)))):
        a, b = a.astype(float), b.astype(float)
        near = N.Nearest(a, np.full(len(a), np.inf), 4)
        names = rng.permutation(len(b))
        for part in np.array_split(np.arange(len(b)), 3):
            near.meet(np.arange(len(a)), b[part], names[part])
            near.merge()
        d = N.distances(a, b)
        for i, (row, distance, other) in enumerate(zip(*(x.reshape(len(a), 4) for x in near.found()), strict=True)):
            first = np.lexsort((names, d[i]))[:4]
            assert set(row) == {i} and list(other) == list(names[first]) and list(distance) == list(d[i, first])


def test_projections_find_most_neighbours(spark):
    df = frame(spark, clumps(3000, 16, 3))
    row = N.recall(df, df, "id", "v", 5, share=0.1).first()
    assert row.n_wanted >= 5 * 200 and row.recall >= 0.9
    same = N.knn_join(df, df, "id", "v", 5, method="lsh").where("neighbour = id").count()
    assert same == 0
    equal = frame(spark, np.ones((40, 3)))
    assert N.knn_join(equal, equal, "id", "v", 3, method="lsh").where("distance = 0").count() == 120


def test_resampling_with_text_keys_and_projections(spark):
    x = clumps(300, 4, 1)
    y = (np.arange(300) % 5 == 0).astype(int)
    df = frame(spark, x, str, y)
    for strategy in ("adasyn", "borderline"):
        out = R.resample(df, "y", "id", "v", strategy, method="lsh")
        assert out.where("copy IS NULL").count() == 300 and out.where("copy IS NOT NULL").count() > 0
        assert out.schema["source_id"].dataType.simpleString() == "string"


def test_danger_is_found_once(spark, monkeypatch):
    """The join inside the rare class reads its left rows twice: they must not hold the search before."""
    whole, plans = N.knn_join, []

    def seen(left, *args, **kw):
        plans.append(left._jdf.queryExecution().toString())
        return whole(left, *args, **kw)

    monkeypatch.setattr(R, "knn_join", seen)
    x = np.random.default_rng(0).normal(size=(60, 3))
    out = R.borderline_smote(frame(spark, x, int, (np.arange(60) % 3 == 0).astype(int)), "y", "id", "v")
    assert out.count() == 20 and len(plans) == 2 and not any("CoGroups" in p for p in plans)


# ---- saved models ---------------------------------------------------------------------

NAMES = [f"x{i}" for i in range(6)]
FAST = {"maxIter": 10}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 6))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.75).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))], "id long, y int, " + ", ".join(f"{n} double" for n in NAMES)).cache()


def linear(data, names=NAMES, tag="model"):
    return M.fit(data, "y", names, "logistic", FAST, tag=tag)


def scores(model, data):
    return [(r.id, r.proba) for r in model.transform(data).orderBy("id").collect()]


def stack(data, **kw):
    specs = {"a": M.Spec("logistic", FAST), "b": M.Spec("forest", {"numTrees": 4, "maxDepth": 3}, NAMES[:3])}
    return K.Stacking(specs, NAMES, "y", "id", k=2, meta_params=FAST, **kw).fit(data)


@pytest.mark.parametrize("shape", ["stack", "calibrated", "bag", "wrapper", "nested"])
def test_composites_come_back_whole(spark, data, shape):
    model = {
        "stack": lambda: stack(data), "calibrated": lambda: stack(data, isotonic=True),
        "bag": lambda: K.BagModel(M.fit_bag(data, "y", NAMES, "id", n=2, family="forest", params={"numTrees": 2, "maxDepth": 2})),
        "wrapper": lambda: K.SelectedModel(M.as_scorer(linear(data, ["x1", "x4"])), [1, 4], NAMES),
        "nested": lambda: K.SelectedModel(stack(data), range(6), NAMES)}[shape]()
    path = scratch_path(spark, shape)
    model.write().overwrite().save(path)
    again = load_any(spark, path)
    assert type(again) is type(model) and again.uid == model.uid
    assert scores(again, data) == scores(model, data)
    bundle = A.Bundle(shape, model, 0.3, NAMES)
    A.save_bundle(spark, bundle, f"{path}_bundle")
    assert X.predict(A.load_bundle(spark, f"{path}_bundle"), data).orderBy("id").collect() == X.predict(bundle, data).orderBy("id").collect()


def test_preparation_and_calibration_come_back(spark, data):
    path = scratch_path(spark, "parts")
    holes = data.withColumn("x0", F.when(F.col("id") > 9, F.col("x0")))
    for name, model in {"median": Q.fit_median(holes, NAMES), "scale": Q.fit_scale(holes, NAMES)}.items():
        model.write().save(f"{path}/{name}")
        assert load_any(spark, f"{path}/{name}").transform(holes).orderBy("id").collect() == model.transform(holes).orderBy("id").collect()
    rows = data.select("y", F.col("x0").alias("proba"))
    for calibrator in (B.Calibrator("raw"), B.fit_platt(rows), B.fit_isotonic(rows)):
        calibrator.write().save(f"{path}/{calibrator.method}")
        again = load_any(spark, f"{path}/{calibrator.method}")
        assert sorted(again.transform(rows).collect()) == sorted(calibrator.transform(rows).collect()) and again.method == calibrator.method


def test_stacks_kept_as_folders(spark, data):
    model, path = stack(data), scratch_path(spark, "folders")
    for m in model.members:
        m.model.write().save(f"{path}/base/{m.tag}")
    model.meta.write().save(f"{path}/meta")
    bundle = A.load_bundle(spark, path)
    assert isinstance(bundle.model, K.StackingModel) and bundle.threshold == 0.5
    assert scores(bundle.model, data) == scores(model, data)
    linear(data, tag="c").write().save(f"{path}/base/c")
    with pytest.raises(ValueError):
        A.load_bundle(spark, path)


def test_stored_wrappers_select_by_place_and_look_up_their_threshold(spark, data):
    inner, path = M.as_scorer(linear(data, ["x1", "x4"])), scratch_path(spark, "wrapper")
    inner.write().save(f"{path}/model")
    document = {"selected_idx": [1, 4], "columns": NAMES, "thr": 0.41, "params": {"a": 1}}
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.text(f"{path}/bundle")
    bundle = A.load_bundle(spark, path)
    assert bundle.threshold == 0.41 and bundle.model.columns == NAMES and bundle.model.selected_idx == [1, 4]
    row = X.evaluate_stored(spark, path, data, "y").first()
    want = X.evaluate_bundle(A.Bundle("wrapper", inner, 0.41, ["x1", "x4"]), data, "y").first()
    assert row.error is None and (row.accuracy, row.f1, row.roc_auc) == (want.accuracy, want.f1, want.roc_auc)
    # the same by places of a matrix: another order of all columns outside, the same entries inside
    matrix = data.select("id", "y", F.array(*NAMES).alias("features"))
    of_array = K.SelectedModel(_OfArray(linear(data, ["x1", "x4"])), [1, 4], vector="features")
    assert [p for _, p in scores(of_array, matrix)] == pytest.approx([p for _, p in scores(K.SelectedModel(inner, [1, 4], NAMES), data)])
    assert of_array.transform(matrix).columns == ["id", "y", "features", "proba"]
    with pytest.raises(Exception):
        K.SelectedModel(_OfArray(inner), [1, 9], vector="features").transform(matrix).collect()
    with pytest.raises(ValueError):
        K.SelectedModel(inner, [6], NAMES)
    assert X.evaluate_stored(spark, path + "_absent", data, "y").first().error


class _OfArray:
    """A model that reads its two inputs from an array."""

    def __init__(self, model):
        self.model = model

    def transform(self, df):
        return M.score(self.model, df.withColumn("x1", F.col("features")[0]).withColumn("x4", F.col("features")[1]))


def test_catalogues_hold_every_shape(spark, data):
    folder = scratch_path(spark, "models")
    linear(data).write().save(f"{folder}/plain")
    stack(data).write().save(f"{folder}/stack")
    A.save_bundle(spark, A.Bundle("b", M.as_scorer(linear(data)), 0.5, NAMES), f"{folder}/bundle")
    model = stack(data)
    for m in model.members:
        m.model.write().save(f"{folder}/parts/base/{m.tag}")
    model.meta.write().save(f"{folder}/parts/meta")
    models, table = G.load_models(spark, {**G.model_paths(spark, folder), "absent": f"{folder}/absent"})
    assert {r.model_id: r.status for r in table.collect()} == {"plain": "ok", "stack": "ok", "bundle": "ok", "parts": "ok", "absent": "failed"}
    assert isinstance(models["stack"], K.StackingModel) and isinstance(models["parts"], K.StackingModel)
