"""Blends of stored scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.grids import GRIDS
from tidewatch.operators import ensembles as E, scores as S
from tidewatch.plans.evaluation import THETA_SQL, M
from tidewatch.plans.frames import SCORE_NAMES, SCORES_SQL, WIDE_SQL, event_scores, event_scores_wide, grid_sql
from tidewatch.plans.registry import query

rnd = lambda c, n=9: F.round(c, n).alias(c)


@query("ens1_soft_vote", f"WITH {WIDE_SQL} SELECT row_id, y, round((s2 + s3) / 2, 9) AS proba FROM wide")
def soft_vote(spark, sf):
    return E.blend_wide(event_scores_wide(spark, sf), ["s2", "s3"]).select("row_id", "y", rnd("proba"))


@query("ens2_mean_blend", f"WITH {SCORES_SQL} SELECT row_id, y, round(avg(proba), 9) AS proba FROM scores GROUP BY 1, 2")
def mean_blend(spark, sf):
    return E.blend(event_scores(spark, sf)).select("row_id", "y", rnd("proba"))


@query("ens3_median_blend", f"WITH {SCORES_SQL} SELECT row_id, y, round(median(proba), 9) AS proba FROM scores GROUP BY 1, 2")
def median_blend(spark, sf):
    return E.blend_wide(event_scores_wide(spark, sf), SCORE_NAMES, "median").select("row_id", "y", rnd("proba"))


@query("ens3_better_blend", f"""WITH {SCORES_SQL},
b AS (SELECT row_id, y, floor(avg(proba) * 1e6::DOUBLE) / 1e6::DOUBLE AS mean, floor(median(proba) * 1e6::DOUBLE) / 1e6::DOUBLE AS median FROM scores GROUP BY 1, 2),
st AS (SELECT 'mean' AS model_id, mean AS proba, sum(y) AS pos, sum(1 - y) AS neg FROM b GROUP BY mean
       UNION ALL SELECT 'median', median, sum(y), sum(1 - y) FROM b GROUP BY median), {grid_sql(501, "0", "(1::DOUBLE / 500)", "1")} {THETA_SQL},
r AS (SELECT model_id, threshold, {M['accuracy']} AS accuracy FROM atgrid)
SELECT * FROM r ORDER BY accuracy DESC, model_id, threshold LIMIT 1""")
def better_blend(spark, sf):
    wide = event_scores_wide(spark, sf)
    cut = lambda c: (F.floor(F.col(c) * F.lit(1e6)) / F.lit(1e6)).alias(c)
    both = E.blend_wide(E.blend_wide(wide, SCORE_NAMES, "mean", "mean"), SCORE_NAMES, "median", "median")
    long = both.select("row_id", "y", cut("mean"), cut("median")).unpivot(["row_id", "y"], ["mean", "median"], "model_id", "proba")
    swept = S.sweep(long, GRIDS["fivehundredths"]).select("model_id", "threshold", rnd("accuracy"))
    return S.arg_best(swept, "accuracy", "model_id")


@query("ens5_fold_mean", f"""WITH {SCORES_SQL}, f AS (SELECT model_id, row_id, proba FROM scores UNION ALL SELECT model_id, row_id, proba * proba FROM scores)
SELECT model_id, row_id, round(avg(proba), 9) AS proba FROM f GROUP BY 1, 2""")
def fold_mean(spark, sf):
    long = event_scores(spark, sf).select("model_id", "row_id", "proba")
    folds = long.unionByName(long.withColumn("proba", F.col("proba") * F.col("proba")))
    return E.fold_mean(folds).select("model_id", "row_id", rnd("proba"))
