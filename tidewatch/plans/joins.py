"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import ensembles as E, scores as S
from tidewatch.plans.frames import SCORE_NAMES, WIDE_SQL, embedding_columns, event_scores, event_scores_wide
from tidewatch.plans.registry import query
from tidewatch.plans.statistics import ANOVA_SQL, DIMS, rnd
from tidewatch.sources.tables import read_table


@query("jn1_class_weight_lookup", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, o_orderpriority, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 9) AS weight FROM orders JOIN c USING (o_orderpriority)""")
def weights(spark, sf):
    from tidewatch.operators.profiling import class_counts, class_weights
    df = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    table = class_weights(class_counts(df, "o_orderpriority"), "o_orderpriority")
    return E.with_class_weight(df, "o_orderpriority", table).withColumn("weight", F.round("weight", 9))


def _predictions(spark, sf):
    """Predictions that miss some rows and repeat others."""
    p = event_scores_wide(spark, sf).select("row_id", F.col("s3").alias("proba"))
    return p.where("proba >= 0.1").unionByName(p.where("proba >= 0.9"))


@query("jn2_align", f"""WITH {WIDE_SQL}, p AS (SELECT row_id, s3 AS proba FROM wide WHERE s3 >= 0.1 UNION ALL SELECT row_id, s3 FROM wide WHERE s3 >= 0.9)
SELECT p.row_id, proba, y FROM p JOIN wide USING (row_id)""")
def align(spark, sf):
    return E.align(_predictions(spark, sf), event_scores_wide(spark, sf).select("row_id", "y"), "row_id")


@query("jn2_align_report", f"""WITH {WIDE_SQL}
SELECT count(*) FILTER (s3 >= 0.1 AND s3 < 0.9) AS matched, 0::BIGINT AS without_truth,
       count(*) FILTER (s3 < 0.1) AS without_prediction, count(*) FILTER (s3 >= 0.9) AS repeated FROM wide""")
def align_report(spark, sf):
    return E.align_report(_predictions(spark, sf), event_scores_wide(spark, sf).select("row_id", "y"), "row_id")


@query("jn3_stack_probas", f"WITH {WIDE_SQL} SELECT row_id, s1, s2, s3, s4 FROM wide")
def stack(spark, sf):
    return E.stack_probas(event_scores(spark, sf), SCORE_NAMES)


@query("jn6_keep_features", f"""WITH {ANOVA_SQL}, top AS (SELECT feature FROM anova ORDER BY f DESC NULLS LAST, feature LIMIT 8)
SELECT vec_id, 'f' || i AS feature, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(64) t(i) WHERE 'f' || i IN (SELECT feature FROM top)""")
def keep(spark, sf):
    from tidewatch.operators.profiling import stacked
    from tidewatch.operators.statistics import anova_f, top_features
    df = embedding_columns(spark, sf)
    top = top_features(anova_f(df, DIMS, "label").select("feature", rnd("f")), 8)
    return E.keep_features(stacked(df, DIMS, ["vec_id"]), top).select("vec_id", "feature", "value")


@query("jn8_compare_metrics", """
WITH a AS (SELECT o_orderpriority AS metric, round(avg(o_totalprice), 4) AS saved FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS metric, round(avg(o_totalprice), 4) AS recomputed FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' GROUP BY 1
      UNION ALL SELECT 'extra', 1.0)
SELECT metric, saved, recomputed, coalesce(abs(saved - recomputed) <= 500, false) AS same FROM a FULL JOIN b USING (metric)""")
def compare(spark, sf):
    df = read_table(spark, sf, "orders")
    means = lambda d: d.groupBy(F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("value"))
    new = means(df.where("o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW'"))
    extra = spark.createDataFrame([("extra", 1.0)], "metric string, value double")
    return E.compare_metrics(means(df), new.unionByName(extra), 500.0)


@query("set1_concat", "SELECT o_orderkey, o_orderstatus FROM orders")
def concat(spark, sf):
    df = read_table(spark, sf, "orders")
    return E.concat(*[df.where(F.col("o_orderstatus") == s).select(*cols) for s, cols in (
        ("F", ["o_orderkey", "o_orderstatus"]), ("O", ["o_orderstatus", "o_orderkey"]), ("P", ["o_orderkey", "o_orderstatus"]))])


@query("set3_distinct_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(spark, sf):
    return E.distinct_union(
        read_table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")),
        read_table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("set4_complement", f"""WITH {ANOVA_SQL}, top AS (SELECT feature FROM anova ORDER BY f DESC NULLS LAST, feature LIMIT 8)
SELECT feature, f FROM anova WHERE feature NOT IN (SELECT feature FROM top)""")
def complement(spark, sf):
    from tidewatch.operators.statistics import anova_f, top_features
    every = anova_f(embedding_columns(spark, sf), DIMS, "label").select("feature", rnd("f"))
    return E.complement(every, top_features(every, 8))


@query("tk2_top_rows", f"WITH {WIDE_SQL} SELECT row_id, s3 AS proba, y FROM wide ORDER BY s3 DESC, row_id LIMIT 10")
def top_rows(spark, sf):
    df = event_scores_wide(spark, sf).select("row_id", F.col("s3").alias("proba"), "y")
    return S.top_scored(df, "row_id", 10)


@query("tk5_arg_best_per_group", """
SELECT o_orderstatus, o_orderkey, o_totalprice FROM (
  SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def arg_best(spark, sf):
    from tidewatch.operators.scores import arg_best as best
    df = read_table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return best(df, "o_totalprice", "o_orderkey", ["o_orderstatus"])
