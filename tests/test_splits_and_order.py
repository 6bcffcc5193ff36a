import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import labels as L, ordering as O, preparation as Q, splitting as P


@pytest.fixture(scope="module")
def skewed(spark):
    """One class holds most rows, one holds a single row."""
    return spark.range(3000).select("id", F.when(F.col("id") == 5, "one").when(F.col("id") % 10 < 9, "big").otherwise("small").alias("c")).cache()


def test_split_is_complete_exact_and_independent_of_partitioning(skewed):
    a = P.stratified_split(skewed, "c", "id", 0.15)
    b = P.stratified_split(skewed.repartition(7), "c", "id", 0.15)
    rows = {(r.id, r.split) for r in a.collect()}
    assert rows == {(r.id, r.split) for r in b.collect()}
    assert len(rows) == 3000
    sizes = {(r.c, r.split): r["count"] for r in a.groupBy("c", "split").count().collect()}
    n_big = skewed.where("c = 'big'").count()
    assert sizes["big", "test"] == int(n_big * 0.15)
    assert sizes["one", "test"] == 1 and ("one", "train") not in sizes


def test_split_cells_do_not_change_the_result(skewed):
    for digits in (1, 3):
        cut = O.cut_keys(skewed, ["c"], "id", 42, lambda n: F.array(F.lit(1).cast("long"), n), digits)
        keys = {(r.c, r.part): (r.cut_hash, r.cut_id) for r in cut.collect()}
        hashed = skewed.select("c", F.struct(O.hash_key("id", 42).alias("h"), "id").alias("k")).groupBy("c").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        for r in hashed.collect():
            assert keys[r.c, 0] == tuple(r.lo) and keys[r.c, 1] == tuple(r.hi)


@pytest.mark.parametrize("n,k", [(7, 5), (8, 5), (3, 5), (10, 5)])
def test_fold_sizes(spark, n, k):
    folds = P.kfold(spark.range(n), None, "id", k)
    got = sorted((r.fold, r["count"]) for r in folds.groupBy("fold").count().collect())
    assert got == [(i, n // k + (i < n % k)) for i in range(k) if n // k + (i < n % k)]


def test_sample_is_exact(skewed):
    sample = P.stratified_sample(skewed, "c", "id", 100)
    assert sample.count() == 100
    assert P.stratified_sample(skewed, "c", "id", 10**6).count() == 3000
    assert P.sample_n(skewed, "id", 17).count() == 17


def test_null_class_is_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(40)], "id long, c string")
    got = P.stratified_split(df, "c", "id", 0.25).groupBy("c", "split").count()
    assert {(r.c, r.split): r["count"] for r in got.collect()} == {("a", "test"): 5, ("a", "train"): 15, (None, "test"): 5, (None, "train"): 15}


def test_safe_split_falls_back(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(20)], "id long, c string")
    assert P.safe_split(df, "c", "id", 0.2).where("split = 'test'").count() == 4


def test_running_totals_over_ranges_equal_the_plain_window(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    plain = O.running_totals(df, ["g"], [F.col("k").desc()], ["v"], ranges=1, totals=True, leads=["v"])
    ranged = O.running_totals(df, ["g"], [F.col("k").desc()], ["v"], ranges=13, totals=True, leads=["v"])
    pick = lambda d: sorted(map(tuple, d.select("g", "k", "v", "cum_v", "all_v", F.coalesce("next_v", F.lit(-1))).collect()))
    assert pick(plain) == pick(ranged)


def test_ordered_index_over_ranges(spark):
    df = spark.range(300).select((F.col("id") * 37 % 300).alias("k"))
    for ranges in (None, 6):
        assert all(r.k == r.i for r in O.ordered_index(df, [F.col("k")], "i", ranges=ranges).collect())


def test_hash_rank_is_a_permutation(skewed):
    ranks = O.hash_rank(skewed, ["c"], "id", 1)
    for r in ranks.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect():
        assert r.n == r.d == r.m


def test_order_statistics_are_exact_on_ties_and_gaps(spark):
    rng = random.Random(3)
    # A third of one column is a single value; the other has nulls and NaN.
    rows = [(1.0 if i % 3 == 0 else rng.gauss(0, 5), None if i % 5 == 0 else (float("nan") if i % 7 == 0 else float(rng.randrange(40)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double")
    want = [sorted(r[0] for r in rows), sorted(r[1] for r in rows if r[1] is not None and r[1] == r[1])]
    ranks = lambda n: [1, max(1, n // 3), (n + 1) // 2, n]
    got = Q.values_at_ranks(df, ["a", "b"], ranks)
    assert got == {"a": [want[0][r - 1] for r in ranks(len(want[0]))], "b": [want[1][r - 1] for r in ranks(len(want[1]))]}


def test_a_wrong_sketch_does_not_change_the_result(spark, monkeypatch):
    df = spark.range(2000).select(F.col("id").cast("double").alias("a"))
    monkeypatch.setattr(Q, "_sketched_spans", lambda *a: {"a": [(5.0, 6.0)]})
    assert Q.medians(df, ["a"]) == {"a": 999.5}


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert Q.medians(df, ["a", "b"]) == {"b": 1.0}
    imputer = Q.fit_median(df, ["a", "b"])
    assert imputer.dropped == ["a"] and imputer.transform(df).columns == ["b"]
    assert Q.medians(df.where("b > 5"), ["b"]) == {}


@pytest.mark.parametrize("values,kind,want", [
    (["normal", " Normal.", "neptune"], "string", [0, 0, 1]),
    ([3, 3, 1, 1, 2], "int", [1, 1, 0, 0, 1]),
    (["0.0", "1.5", "-2"], "string", [0, 1, 1]),
    ([-1, 0, 0], "int", [1, 0, 0]),
    ([None, 4, 4, 2], "int", [None, 0, 0, 1]),
])
def test_auto_rule(spark, values, kind, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, c {kind}")
    rule = L.fit_label_rule(df, "c")
    assert [r.y for r in rule.apply(df, "c").orderBy("id").collect()] == want


def test_text_without_the_word_needs_a_decision(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "id long, c string")
    with pytest.raises(ValueError):
        L.fit_label_rule(df, "c")
    assert L.fit_label_rule(df, "c", row_id="id").negative == "a"
    assert L.fit_label_rule(df, "c", negative="b").negative == "b"


def test_the_rule_of_train_holds_on_test(spark):
    train = spark.createDataFrame([(1,), (1,), (2,)], "c int")
    test = spark.createDataFrame([(2,), (2,), (1,)], "c int")
    rule = L.fit_label_rule(train, "c")
    assert sorted(r.y for r in rule.apply(test, "c").collect()) == [0, 1, 1]


def test_stripping_does_not_eat_letters(spark):
    df = spark.createDataFrame([('"normal",',), ("\tnormal\n",), ("'rnt'",)], "c string")
    assert [r.y for r in L.label_contains(df, "c").collect()] == [0, 0, 1]


def test_codes(spark):
    df = spark.createDataFrame([(0, "b"), (1, None), (2, "a"), (3, "b")], "id long, c string")
    assert {r.id: r.code for r in L.factorize(df, "c", "id").collect()} == {0: 0, 1: -1, 2: 1, 3: 0}
    assert {r.id: r.code for r in L.factorize_sorted(df, "c").collect()} == {0: 1, 1: -1, 2: 0, 3: 1}
