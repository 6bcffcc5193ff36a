import hashlib
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import columns as C, leakage as K, preparation as Q, profiling as A, resampling as R, statistics as T
from tidewatch.session import scratch_path
from tidewatch.sources import catalogue as G, delimited as D, documents as J


def test_resolution(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` Label` int, `Label ` int, x int")
    hit = C.resolve(df, "label")
    assert hit.present and hit.ambiguous
    assert C.resolve(df, "X").column == "x" and not C.resolve(df, "nothing").present
    with pytest.raises(ValueError):
        C.clean_names(df)


def test_label_search(spark):
    df = spark.createDataFrame([(3, 1, "a"), (4, 0, "b")], "a int, flag int, z string")
    assert C.find_label(df) == "z"
    assert C.find_label(df, C.LABEL_NAMES_WIDE, "binary") == "flag"
    assert C.find_label(df.withColumnRenamed("a", "target")) == "target"


def test_width_guard(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert C.require_width(df, 2, "x").count() == 1
    with pytest.raises(Exception):
        C.require_width(df, 3, "x").collect()
    with pytest.raises(ValueError):
        C.require_width(df, 2)


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"), "x"), (1.0, None, 2.0, "3")], "same double, none double, nan double, text string")
    rows = {r.feature: r for r in A.profile(df, df.columns).collect()}
    assert rows["same"].variance == 0.0 and rows["same"].n_unique == 1
    assert rows["none"].variance is None and rows["none"].pct_nan == 1.0 and rows["none"].n_unique == 0
    assert rows["nan"].pct_nan == 0.5 and rows["text"].pct_nan == 0.5
    assert A.profile(df.where("same > 5"), df.columns).count() in (0, 4)


def test_constant_columns_have_no_statistics(spark):
    df = spark.createDataFrame([(0.1, float(i), i % 2) for i in range(30)], "same double, x double, y int")
    got = {r.feature: r.correlation for r in T.pearson(df, ["same", "x"], "y").collect()}
    assert got["same"] is None and got["x"] is not None
    assert T.corr_pairs(df, ["same", "x"]).count() == 0
    f = T.anova_f(df, ["same", "x"], "y")
    ranked = [r.feature for r in T.top_features(f, 2).collect()]
    assert ranked == ["x", "same"]


def test_correlation_with_gaps(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=200), rng.normal(size=200)
    rows = [(float(x), None if i % 4 == 0 else float(x + y)) for i, (x, y) in enumerate(zip(a, b))]
    got = T.corr_pairs(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).first().correlation
    keep = [r for r in rows if r[1] is not None]
    assert got == pytest.approx(np.corrcoef(*zip(*keep))[0, 1], abs=1e-10)


def test_planted_leak_is_found(spark):
    rows = [("bad", 1)] * 500 + [(f"one{i}", i % 2) for i in range(50)] + [("mixed", i % 2) for i in range(400)] + [(None, 1)]
    df = spark.createDataFrame(rows, "v string, y int")
    low = K.deterministic_values(df, ["v"], "y").first()
    assert low.deterministic_values == 51 and low.rows_covered == 550
    high = K.deterministic_values(df, ["v"], "y", min_support=10).first()
    assert high.deterministic_values == 1 and high.rows_covered == 500
    scan = K.leakage_scan(df, ["v"], "y").first()
    assert scan.top_values[0] == "bad=500" and scan.correlation is None and scan.mutual_information > 0.1


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    model = Q.fit_onehot(train, ["c"])
    test = spark.createDataFrame([(0, "a"), (1, "z"), (2, None)], "id long, c string")
    assert [tuple(r) for r in Q.onehot_cells(model, test, ["c"], ["id"]).collect()] == [(0, "c", "a")]


def test_categories_of_any_number(spark):
    from tidewatch.operators.composite import load_any
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("c"), F.lit("x").alias("d"))
    model = Q.fit_onehot(df, ["c", "d"])
    order = {str(i): p for p, i in enumerate(sorted(map(str, range(3000))))}
    rows = model.transform(df.unionByName(spark.createDataFrame([(9999, "new", None)], "id long, c string, d string"))).collect()
    for r in rows:
        assert (r["__hot_c"].size, r["__hot_d"].size) == (3000, 1)
        assert list(r["__hot_c"].indices) == ([order[r.c]] if r.id < 3000 else []) and list(r["__hot_d"].indices) == ([0] if r.d else [])
    path = scratch_path(spark, "onehot")
    model.write().save(path)
    again = load_any(spark, path).transform(df).select("id", "__hot_c", "__hot_d")
    assert sorted(again.collect()) == sorted(model.transform(df).select("id", "__hot_c", "__hot_d").collect())


def test_means_of_rows_before(spark):
    from tidewatch.operators import encoding as N
    rng = np.random.default_rng(2)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 11}", int(rng.random() < 0.4)) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, c string, y int").repartition(5)
    order = sorted(rows, key=lambda r: (hashlib.md5(f"42|{r[0]}".encode()).hexdigest(), r[0]))
    seen, want = {}, {}
    for i, c, y in order:
        n, s = seen.get(c, (0, 0))
        want[i] = (s + 0.25 * 4) / (n + 4)
        seen[c] = (n + 1, s + y)
    got = {r.id: r["__m_c"] for r in N.ordered_means(df, "y", ["c"], "id", 0.25, 4.0).collect()}
    assert got == pytest.approx(want)
    model = N.fit_target_statistics(df, "y", ["c"], 4.0)
    new = {r.c: r["__m_c"] for r in model.transform(spark.createDataFrame([("hot",), ("absent",), (None,)], "c string")).collect()}
    assert new["hot"] == pytest.approx((seen["hot"][1] + model.prior * 4) / (seen["hot"][0] + 4)) and new["absent"] == new[None] == model.prior


def test_pca_shares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    df = spark.createDataFrame([(i, float(v), float(2 * v + 0.01 * rng.normal()), float(rng.normal())) for i, v in enumerate(x)], "id long, a double, b double, c double")
    scores, shares = Q.pca(df, ["a", "b", "c"], 2, ["id"])
    assert shares[0] == pytest.approx(2 / 3, abs=0.05) and scores.count() == 300


@pytest.fixture(scope="module")
def points(spark):
    """A third of the points are identical, the rest lie in two clumps."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0, 1.0], 0) for i in range(60)]
    rows += [(60 + i, [float(v) for v in rng.normal(0, 1, 3)], int(i % 6 == 0)) for i in range(70)]
    rows += [(130 + i, [float(v) for v in rng.normal(4, 1, 3)], int(i % 3 == 0)) for i in range(50)]
    return rows, spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(4)


@pytest.mark.parametrize("block", [20, 1000])
def test_neighbours_are_exact(spark, points, block):
    rows, df = points
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = {}
    for r in R.knn_join(df, df, "id", "v", 4, block_rows=block).collect():
        got.setdefault(r.id, {})[r.rank] = (r.neighbour, r.distance)
    for i in range(len(rows)):
        d = np.sqrt(((x[i] - x) ** 2).sum(axis=1))
        d[i] = np.inf
        order = np.lexsort((ids, d))[:4]
        assert [got[ids[i]][k + 1][0] for k in range(4)] == [ids[j] for j in order]
        assert [got[ids[i]][k + 1][1] for k in range(4)] == pytest.approx([d[j] for j in order])


def test_new_rows_lie_between_rare_rows(spark, points):
    rows, df = points
    rare = np.array([r[1] for r in rows if r[2] == 1])
    for strategy in ("adasyn", "borderline"):
        out = R.resample(df, "y", "id", "v", strategy, neighbours=3).collect()
        new = np.array([r.v for r in out if r.copy is not None])
        assert len(out) - len(new) == len(rows) and len(new) > 0
        assert (new >= rare.min(axis=0) - 1e-9).all() and (new <= rare.max(axis=0) + 1e-9).all()
        again = R.resample(df.repartition(3), "y", "id", "v", strategy, neighbours=3).collect()
        assert sorted(map(str, out)) == sorted(map(str, again))
    balanced = R.resample(df, "y", "id", "v", "borderline").groupBy("y").count().collect()
    assert len({r["count"] for r in balanced}) == 1


def test_field_counts(spark, tmp_path):
    names = len(D.FLOW_FIELDS)
    assert names == 43 and len(D.flow_schema()) == 43
    line = lambda n: ",".join(["0", "tcp", " http", "SF"] + ["1"] * (n - 6) + ["normal", "21"][:2])
    good, bad = tmp_path / "good", tmp_path / "bad"
    for folder, sizes in ((good, [43, 43]), (bad, [42, 43, 44])):
        folder.mkdir()
        (folder / "part.txt").write_text("\n".join(line(n) for n in sizes) + "\n")
    D.check_field_count(spark, str(good), D.flow_schema())
    row = D.read_fixed_csv(spark, str(good), D.flow_schema()).first()
    assert row.service == "http" and row.label == "normal" and row.difficulty == 21.0
    with pytest.raises(ValueError):
        D.check_field_count(spark, str(bad), D.flow_schema())


def test_head_of_a_large_table(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = [r.k for r in D.head_sample(df, "k", 20).collect()]
    assert got == list(range(20))


def test_prediction_spellings(spark):
    path = scratch_path(spark, "p")
    spark.createDataFrame([(0.5, 1, 0)], "prob double, pred int, `true` int").write.option("header", True).csv(path)
    assert tuple(D.read_predictions(spark, path).first()) == (None, 0.5, 1, 0)


def test_metric_documents(spark, tmp_path):
    (tmp_path / "run_a.json").write_text('{"test_acc": 0.9, "thr": 0.35, "name": "x", "confusion": [[1, 2], [3, 4]]}')
    (tmp_path / "run_b.json").write_text('{"raw": {"roc_auc": 0.8, "best": {"threshold": 0.2}}, "test_acc": 0.7}')
    rows = {(r.run_id, r.model_id, r.metric): r.value for r in J.read_metrics(spark, str(tmp_path)).collect()}
    assert rows["run_a", "all", "confusion[1][0]"] == 3.0 and rows["run_b", "raw", "best.threshold"] == 0.2
    table = {(r.run_id, r.model_id): r for r in J.compare_runs(J.read_metrics(spark, str(tmp_path))).collect()}
    assert table["run_a", "all"].accuracy == 0.9 and table["run_b", "raw"].roc_auc == 0.8
    assert J.threshold_from(J.read_metrics(spark, str(tmp_path))) == 0.35
    assert J.threshold_from(J.read_metrics(spark, str(tmp_path)).where("value > 5")) == 0.5


def test_fallback_chain(spark):
    missing = scratch_path(spark, "none")
    assert G.first_available(spark, [missing], lambda: spark.range(3)).count() == 3
    with pytest.raises(FileNotFoundError):
        G.first_available(spark, [missing])
    failed = G.model_catalogue(spark, missing, {"gone": missing}).first()
    assert failed.status == "failed" and failed.error


def test_correlations_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 7))
    x[:, 3] = 2 * x[:, 0] + 0.1 * x[:, 3]
    x[:, 5] = 4.0
    holes = rng.random((150, 7)) < 0.2
    holes[:, 0] = False
    names = [f"c{i}" for i in range(7)]
    rows = [tuple(None if h else float(v) for v, h in zip(r, g)) for r, g in zip(x, holes)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(4)
    want = {}
    for i in range(7):
        for j in range(i + 1, 7):
            both = ~holes[:, i] & ~holes[:, j]
            if 5 not in (i, j):
                want[names[i], names[j]] = np.corrcoef(x[both, i], x[both, j])[0, 1]
    for tile in (256, 2):
        monkeypatch.setattr(T, "TILE", tile)
        got = {(r.left, r.right): r.correlation for r in T.corr_pairs(df, names, None).collect()}
        assert got == pytest.approx(want)
        top = [(r.left, r.right) for r in T.corr_pairs(df, names, 4).collect()]
        assert top == sorted(want, key=lambda k: -abs(want[k]))[:4] and top[0] == ("c0", "c3")


def test_records_over_lines_and_splits(spark, tmp_path):
    rng = np.random.default_rng(21)
    want = {}
    for name in ("a.txt", "b.txt"):
        out = []
        for _ in range(400):
            fields = []
            for _ in range(int(rng.integers(1, 6))):
                plain = "".join(rng.choice(list("ab \t"), int(rng.integers(0, 5))))
                fields.append(plain if rng.random() < 0.6 else '"' + plain + "".join(rng.choice([",", "\n", '""', "x"], int(rng.integers(0, 6)))) + '"')
            out.append(",".join(fields))
            want[len(fields)] = want.get(len(fields), 0) + 1
        (tmp_path / name).write_text("\n".join(out) + "\n")
    for size in ("128m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        try:
            assert {r.n_fields: r.lines for r in D.field_counts(spark, str(tmp_path)).collect()} == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    open_ = tmp_path / "open"
    open_.mkdir()
    (open_ / "c.txt").write_text('1,2\n3,"x\n4,5\n')
    assert {r.n_fields: r.lines for r in D.field_counts(spark, str(open_)).collect()} == {2: 2}
