"""Imputing, scaling, encoding, projection and oversampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import preparation as Q, resampling as R
from tidewatch.plans.frames import LINEITEM_NUMERIC
from tidewatch.plans.profiling import DOC_SQL, labelled_documents
from tidewatch.plans.registry import query
from tidewatch.sources.tables import read_table

rnd = lambda c, n=6: F.round(c, n).alias(c)


@query("pp1_median_imputation", f"""
SELECT doc_id, coalesce(toxic::DOUBLE, (SELECT median(toxic) FROM {DOC_SQL})) AS toxic,
       coalesce(quality::DOUBLE, (SELECT median(quality) FROM {DOC_SQL})) AS quality, n_chars::DOUBLE AS n_chars FROM {DOC_SQL}""")
def impute(spark, sf):
    df = labelled_documents(spark, sf).select("doc_id", "toxic", "quality", "n_chars").withColumn("empty", F.lit(None).cast("double"))
    return Q.fit_median(df, ["toxic", "quality", "n_chars", "empty"]).transform(df)


@query("pp1_medians", " UNION ALL ".join(f"SELECT '{c}' AS feature, median({c})::DOUBLE AS median FROM lineitem" for c in [*LINEITEM_NUMERIC, "l_partkey"]))
def medians(spark, sf):
    found = Q.medians(read_table(spark, sf, "lineitem"), [*LINEITEM_NUMERIC, "l_partkey"])
    return spark.createDataFrame(list(found.items()), "feature string, median double")


@query("pp2_scale", """
WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS sd, avg(p_size) AS m2, stddev_pop(p_size) AS sd2 FROM part)
SELECT p_partkey, round((p_retailprice - m) / sd, 6) + 0 AS p_retailprice, round((p_size - m2) / sd2, 6) + 0 AS p_size, 0::DOUBLE AS same FROM part, s""")
def scale(spark, sf):
    df = read_table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size").withColumn("same", F.lit(5.0))
    out = Q.fit_scale(df, ["p_retailprice", "p_size", "same"]).transform(df)
    return out.select("p_partkey", rnd("p_retailprice"), rnd("p_size"), "same")


@query("pp3_fill_missing", f"SELECT doc_id, coalesce(CAST(toxic AS VARCHAR), 'missing') AS toxic FROM {DOC_SQL}")
def fill_missing(spark, sf):
    from tidewatch.operators.columns import as_category
    return as_category(labelled_documents(spark, sf).select("doc_id", "toxic"), ["toxic"], "missing")


@query("pp4_onehot", """
SELECT p_partkey, 'p_type' AS feature, p_type AS category FROM part WHERE p_type < 'P'
UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part""")
def onehot(spark, sf):
    df = read_table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
    model = Q.fit_onehot(df.where("p_type < 'P' OR p_type IS NULL").unionByName(
        df.withColumn("p_type", F.lit(None).cast("string"))), ["p_type", "p_brand"])
    return Q.onehot_cells(model, df, ["p_type", "p_brand"], ["p_partkey"])


@query("pp4_onehot_of_many", """
SELECT l_orderkey, l_linenumber, 'order_code' AS feature, md5(CAST(l_orderkey AS VARCHAR)) AS category FROM lineitem WHERE l_orderkey % 3 = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'l_returnflag', l_returnflag FROM lineitem""")
def onehot_of_many(spark, sf):
    """As many categories as orders; those of two thirds of the orders were not seen."""
    df = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.md5(F.col("l_orderkey").cast("string")).alias("order_code"), "l_returnflag")
    indexer = Q.fit_onehot(df.withColumn("order_code", F.when(F.col("l_orderkey") % 3 == 0, F.col("order_code"))), ["order_code", "l_returnflag"])
    return Q.onehot_cells(indexer, df, ["order_code", "l_returnflag"], ["l_orderkey", "l_linenumber"])


@query("pp4_codes", """
SELECT p_partkey, (SELECT count(DISTINCT b.p_type) FROM part b WHERE b.p_type < part.p_type) AS code, 1.0::DOUBLE AS set FROM part""")
def codes(spark, sf):
    from pyspark.ml.functions import vector_to_array
    df = read_table(spark, sf, "part").select("p_partkey", "p_type")
    out = Q.fit_onehot(df, ["p_type"]).transform(df)
    code = F.col("__idx_p_type").cast("long")
    return out.select("p_partkey", code.alias("code"), vector_to_array("__hot_p_type")[code.cast("int")].alias("set"))


def _prepared(spark, sf):
    df = labelled_documents(spark, sf).select("doc_id", "lang", "source", "n_chars", "quality")
    return Q.TabularPreparation(["lang", "source"], ["n_chars", "quality"]).fit(df).transform(df)


@query("pp5_preparation_width", f"""
SELECT doc_id, 2 + (SELECT count(DISTINCT lang) + count(DISTINCT source) FROM documents) AS width,
       round((n_chars - (SELECT avg(n_chars) FROM documents)) / (SELECT stddev_pop(n_chars) FROM documents), 6) + 0 AS first FROM documents""")
def preparation(spark, sf):
    from pyspark.ml.functions import vector_to_array
    v = vector_to_array("features")
    return _prepared(spark, sf).select("doc_id", F.size(v).cast("long").alias("width"), F.round(v[0], 6).alias("first"))


@query("pp6_prepare_job", """
WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS r,
             count(*) OVER (PARTITION BY toxic) AS n, toxic FROM labels)
SELECT doc_id AS row_id, toxic AS label, CASE WHEN r <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM d""")
def prepare(spark, sf):
    from tidewatch.operators.splitting import holdout
    from tidewatch.session import scratch_path
    from tidewatch.sources.tables import read_matrix
    df = labelled_documents(spark, sf).where("toxic IS NOT NULL").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")
    train, test = holdout(df, "toxic", "doc_id", 0.2)
    out = scratch_path(spark, "prepared")
    Q.prepare(train, test, out, ["lang", "source"], "toxic", "doc_id")
    return read_matrix(spark, f"{out}/matrix").select("row_id", "label", "split")


@query("pp7_pca")
def pca(spark, sf):
    scores, _ = Q.pca(read_table(spark, sf, "part"), ["p_size", "p_retailprice", "p_partkey"], 3, ["p_partkey"])
    return scores


KNN_SQL = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (SELECT a.vec_id AS vec_id, b.vec_id AS neighbour, a.label AS label, b.label AS other, list_distance(a.v, b.v) AS distance
          FROM e a, e b WHERE a.vec_id <> b.vec_id),
near AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS INTEGER) AS rank FROM pairs)"""


@query("jn9_knn_join", f"WITH {KNN_SQL} SELECT vec_id, neighbour, round(distance, 6) AS distance, rank FROM near WHERE rank <= 5")
def knn(spark, sf):
    df = read_table(spark, sf, "embeddings")
    return R.knn_join(df, df, "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 6))


def _rare(spark, sf):
    return read_table(spark, sf, "embeddings").withColumn("y", (F.col("label") == 3).cast("int"))


RARE_SQL = KNN_SQL.replace("label, embedding", "CASE WHEN label = 3 THEN 1 ELSE 0 END AS label, embedding") + """,
lack AS (SELECT sum(1 - label) - sum(label) AS n FROM e)"""


@query("pp8_adasyn_quotas", f"""WITH {RARE_SQL},
share AS (SELECT vec_id, sum(1 - other) / 5::DOUBLE AS share FROM near WHERE label = 1 AND rank <= 5 GROUP BY 1),
quota AS (SELECT vec_id AS source_id, CAST(round_even(share / (SELECT sum(share) FROM share) * (SELECT n FROM lack), 0) AS BIGINT) AS n FROM share)
SELECT * FROM quota WHERE n > 0""")
def adasyn_quotas(spark, sf):
    return R.adasyn(_rare(spark, sf), "y", "vec_id", "embedding").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query("pp8_resample_adasyn")
def resample_adasyn(spark, sf):
    return R.resample(_rare(spark, sf), "y", "vec_id", "embedding", "adasyn")


@query("pp9_resample_borderline")
def resample_borderline(spark, sf):
    # Class 3 is spread among the others, so danger is rare: widen the class.
    df = read_table(spark, sf, "embeddings").withColumn("y", (F.col("label") >= 6).cast("int"))
    return R.resample(df, "y", "vec_id", "embedding", "borderline")


@query("pp9_resample_class_sizes", "SELECT CAST(label >= 6 AS INTEGER) AS y, (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label >= 6)) AS n FROM embeddings GROUP BY 1")
def borderline_sizes(spark, sf):
    return resample_borderline(spark, sf).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
