"""Correlation, mutual information and ANOVA."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import statistics as T
from tidewatch.plans.frames import LINEITEM_NUMERIC, embedding_columns
from tidewatch.plans.profiling import (
    LEAK_BASE_SQL, LEAK_COLUMNS, LEAK_NUMERIC, bins_sql, leak_frame, mi_sql, pearson_sql,
)
from tidewatch.plans.registry import query
from tidewatch.sources.tables import read_table

rnd = lambda c, n=6: F.round(c, n).alias(c)
DIMS = [f"f{i}" for i in range(64)]


@query("st1_pearson", f"WITH {LEAK_BASE_SQL}, flat AS (SELECT *, 1 AS same FROM base) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {pearson_sql(c, 'y')} AS correlation FROM flat" for c in [*LEAK_NUMERIC, "same"]))
def pearson(spark, sf):
    df = leak_frame(spark, sf).withColumn("same", F.lit(1))
    return T.pearson(df, [*LEAK_NUMERIC, "same"], "y").select("feature", rnd("correlation"))


NUMBERS = LINEITEM_NUMERIC + ["l_linenumber", "l_suppkey", "l_partkey"]


@query("st2_corr_pairs", "WITH p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", {pearson_sql(a, b)} AS correlation FROM lineitem"
    for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1:]) + ") SELECT * FROM p ORDER BY abs(correlation) DESC, \"left\", \"right\" LIMIT 20")
def corr_pairs(spark, sf):
    return T.corr_pairs(read_table(spark, sf, "lineitem"), NUMBERS, 20).select("left", "right", rnd("correlation"))


@query("st2_corr_matrix_embedding", """
WITH long AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),
p AS (SELECT a.i AS i, b.i AS j, round(covar_pop(a.x, b.x) / (stddev_pop(a.x) * stddev_pop(b.x)), 6) + 0 AS correlation
      FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY 1, 2)
SELECT 'f' || i AS "left", 'f' || j AS "right", correlation FROM p""")
def corr_matrix(spark, sf):
    return T.corr_matrix_pairs(embedding_columns(spark, sf), DIMS, None).select("left", "right", rnd("correlation"))


@query("st3_mutual_info_discrete", f"WITH {LEAK_BASE_SQL}, {mi_sql('cells')} SELECT * FROM mi")
def mutual_info(spark, sf):
    return T.mutual_info(leak_frame(spark, sf), LEAK_COLUMNS, "y").select("feature", rnd("mutual_information"))


@query("st4_mutual_info_binned", f"""WITH base AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_partkey,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem), {bins_sql(LINEITEM_NUMERIC + ['l_partkey'], 16)}, {mi_sql('q_cells')} SELECT * FROM mi""")
def mutual_info_binned(spark, sf):
    df = read_table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return T.mutual_info(df, LINEITEM_NUMERIC + ["l_partkey"], "y", bins=16).select("feature", rnd("mutual_information"))


ANOVA_SQL = """
long AS (SELECT 'f' || i AS feature, label, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),
g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
a AS (SELECT feature, avg(x) AS mm FROM long GROUP BY 1),
anova AS (SELECT feature, round((sum(n * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f
          FROM g JOIN a USING (feature) GROUP BY 1)"""


@query("st5_anova_f", f"WITH {ANOVA_SQL} SELECT * FROM anova")
def anova(spark, sf):
    return T.anova_f(embedding_columns(spark, sf), DIMS, "label").select("feature", rnd("f"))


@query("st5_anova_f_lineitem", "WITH long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, l_returnflag AS label, {c}::DOUBLE AS x FROM lineitem" for c in NUMBERS) + """),
g AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY 1, 2),
a AS (SELECT feature, avg(x) AS mm FROM long GROUP BY 1)
SELECT feature, round((sum(n * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f
FROM g JOIN a USING (feature) GROUP BY 1""")
def anova_lineitem(spark, sf):
    return T.anova_f(read_table(spark, sf, "lineitem"), NUMBERS, "l_returnflag").select("feature", rnd("f", 5))


@query("st6_select_by_p")
def select_by_p(spark, sf):
    return T.select_by_p(embedding_columns(spark, sf), DIMS, "label", "fdr")


@query("tk1_top_features", f"WITH {ANOVA_SQL} SELECT feature, f FROM anova ORDER BY f DESC NULLS LAST, feature LIMIT 20")
def top_features(spark, sf):
    return T.top_features(T.anova_f(embedding_columns(spark, sf), DIMS, "label").select("feature", rnd("f")), 20)
