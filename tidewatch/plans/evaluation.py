"""Score-table metrics, thresholds and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.grids import FIXED_THRESHOLDS, GRIDS
from tidewatch.operators import scores as S
from tidewatch.plans.frames import (
    CURVE_SQL, SCORE_NAMES, SCORES_SQL, WIDE_SQL, event_scores, event_scores_wide, grid_sql,
)
from tidewatch.plans.registry import query

rnd = lambda c, n=9: F.round(c, n).alias(c)

HALF_SQL = SCORES_SQL + """,
cm AS (SELECT model_id,
         CAST(sum(CASE WHEN proba >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN proba >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN proba < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN proba < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
       FROM scores GROUP BY model_id)"""
M = {
    "accuracy": "round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9)",
    "precision": "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 9)",
    "recall": "round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 9)",
    "f1": "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9)",
    "specificity": "round(CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp)::DOUBLE END, 9)",
    "fpr": "round(CASE WHEN tn + fp = 0 THEN NULL ELSE fp / (tn + fp)::DOUBLE END, 9)",
}


def pick(*names):
    return ", ".join(f"{M[n]} AS {n}" for n in names)


def _half(spark, sf):
    return S.apply_threshold(event_scores(spark, sf), 0.5)


@query("ev1_confusion", f"WITH {HALF_SQL} SELECT * FROM cm")
def confusion(spark, sf):
    return S.confusion(_half(spark, sf))


@query("ev2_basic_metrics", f"WITH {HALF_SQL} SELECT *, {pick('accuracy', 'precision', 'recall', 'f1')} FROM cm")
def basic(spark, sf):
    out = S.basic_metrics(_half(spark, sf))
    return out.select("model_id", "tp", "fp", "tn", "fn", *[rnd(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("ev3_specificity_fpr", f"WITH {HALF_SQL} SELECT model_id, {pick('specificity', 'fpr')} FROM cm")
def specificity(spark, sf):
    return S.specificity_fpr(_half(spark, sf)).select("model_id", rnd("specificity"), rnd("fpr"))


# Three-class prediction: order priority guesses the status by a hash.
ORDER_CLASS_SQL = """
pred AS (SELECT o_orderstatus AS y,
           CASE WHEN substr(md5('3|' || CAST(o_orderkey AS VARCHAR)), 1, 1) < '8' THEN o_orderstatus
                WHEN o_orderpriority < '3' THEN 'F' ELSE 'P' END AS pred FROM orders),
cells AS (SELECT y, pred, count(*) AS n FROM pred GROUP BY 1, 2),
classes AS (SELECT y AS class FROM cells UNION SELECT pred FROM cells),
report AS (
  SELECT class, CAST(coalesce(sum(n) FILTER (y = class), 0) AS BIGINT) AS support,
         coalesce(sum(n) FILTER (pred = class), 0)::DOUBLE AS predicted,
         coalesce(sum(n) FILTER (y = class AND pred = class), 0)::DOUBLE AS hit
  FROM classes, cells GROUP BY class),
scored AS (
  SELECT class, support, CASE WHEN predicted = 0 THEN 0 ELSE hit / predicted END AS p,
         CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r,
         CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * hit / (predicted + support) END AS f FROM report)"""


def _order_classes(spark, sf):
    from tidewatch.functions.expressions import hash_key
    from tidewatch.sources.tables import read_table
    df = read_table(spark, sf, "orders")
    guess = F.when(F.substring(hash_key("o_orderkey", 3), 1, 1) < "8", F.col("o_orderstatus")).when(
        F.col("o_orderpriority") < "3", "F").otherwise("P")
    return df.select(F.col("o_orderstatus").alias("y"), guess.alias("pred"))


@query("ev4_macro_f1", f"""WITH {ORDER_CLASS_SQL}
SELECT round(avg(f), 9) AS macro_f1, round((SELECT sum(n) FILTER (y = pred) / sum(n) FROM cells), 9) AS accuracy,
       count(*) AS n_classes FROM scored""")
def macro(spark, sf):
    return S.macro_f1(_order_classes(spark, sf), []).select(rnd("macro_f1"), rnd("accuracy"), "n_classes")


@query("ev5_class_report", f"""WITH {ORDER_CLASS_SQL}
SELECT class, support, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM scored""")
def report(spark, sf):
    return S.class_report(_order_classes(spark, sf), []).select(
        "class", "support", rnd("precision"), rnd("recall"), rnd("f1"))


AUC_SQL = """sum(neg::DOUBLE * (tp - pos / 2::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0)"""
AP_SQL = """sum(pos * (tp / (tp + fp)::DOUBLE)) / nullif(sum(pos), 0)::DOUBLE"""


@query("ev6_roc_auc", f"""WITH {CURVE_SQL}
SELECT model_id, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round({AUC_SQL}, 9) AS roc_auc
FROM points GROUP BY model_id""")
def auc(spark, sf):
    return S.roc_auc(event_scores(spark, sf)).withColumn("roc_auc", F.round("roc_auc", 9))


@query("ev7_average_precision", f"""WITH {CURVE_SQL}
SELECT model_id, CAST(sum(pos) AS BIGINT) AS n_pos, round({AP_SQL}, 9) AS pr_auc FROM points GROUP BY model_id""")
def ap(spark, sf):
    return S.average_precision(event_scores(spark, sf)).withColumn("pr_auc", F.round("pr_auc", 9))


@query("ev8_roc_curve", f"""WITH {CURVE_SQL}
SELECT model_id, proba AS threshold, round(fp / n_all::DOUBLE, 9) AS fpr, round(tp / p_all::DOUBLE, 9) AS tpr
FROM points JOIN ends USING (model_id)
UNION ALL SELECT model_id, NULL, 0, 0 FROM ends""")
def roc(spark, sf):
    return S.roc_curve(event_scores(spark, sf)).select("model_id", "threshold", rnd("fpr"), rnd("tpr"))


@query("ev8_roc_curve_corners", f"""WITH {CURVE_SQL},
kept AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn FROM points
         WINDOW w AS (PARTITION BY model_id ORDER BY proba DESC))
SELECT model_id, proba AS threshold, round(fp / n_all::DOUBLE, 9) AS fpr, round(tp / p_all::DOUBLE, 9) AS tpr
FROM kept JOIN ends USING (model_id) WHERE rnk = 1 OR np IS NULL OR np <> pos OR nn <> neg
UNION ALL SELECT model_id, NULL, 0, 0 FROM ends""")
def roc_corners(spark, sf):
    return S.roc_curve(event_scores(spark, sf), drop_collinear=True).select("model_id", "threshold", rnd("fpr"), rnd("tpr"))


@query("ev9_pr_curve", f"""WITH {CURVE_SQL}
SELECT model_id, proba AS threshold, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / p_all::DOUBLE, 9) AS recall
FROM points JOIN ends USING (model_id)
UNION ALL SELECT model_id, NULL, 1, 0 FROM ends""")
def pr(spark, sf):
    return S.pr_curve(event_scores(spark, sf)).select("model_id", "threshold", rnd("precision"), rnd("recall"))


@query("ev10_metrics_at", f"""WITH {HALF_SQL}
SELECT *, {pick('precision', 'recall', 'fpr')}, 0.5::DOUBLE AS threshold FROM cm""")
def at_half(spark, sf):
    out = S.metrics_at(event_scores(spark, sf), 0.5)
    return out.select("model_id", "tp", "fp", "tn", "fn", rnd("precision"), rnd("recall"), rnd("fpr"), "threshold")


THETA_SQL = """,
atgrid AS (SELECT model_id, threshold,
             CAST(sum(CASE WHEN proba >= threshold THEN pos ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN proba >= threshold THEN neg ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN proba < threshold THEN neg ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN proba < threshold THEN pos ELSE 0 END) AS BIGINT) AS fn
           FROM st, grid GROUP BY 1, 2)"""
FIXED_SQL = ", grid AS (SELECT unnest([0, 0.01, 0.1, 0.3, 0.5, 0.7]::DOUBLE[]) AS threshold)"


@query("ev11_metrics_at_fixed_list", f"WITH {CURVE_SQL} {FIXED_SQL} {THETA_SQL} SELECT *, {pick('accuracy', 'precision', 'recall', 'f1')} FROM atgrid")
def at_fixed(spark, sf):
    out = S.with_metrics(S.metrics_at_grid(event_scores(spark, sf), FIXED_THRESHOLDS), "accuracy", "precision", "recall", "f1")
    return out.select("model_id", "threshold", "tp", "fp", "tn", "fn", *[rnd(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("jn4_grid_confusion", f"""WITH {CURVE_SQL},
grid AS (SELECT DISTINCT l_discount AS threshold FROM lineitem) {THETA_SQL} SELECT * FROM atgrid""")
def jn4(spark, sf):
    from tidewatch.sources.tables import read_table
    grid = read_table(spark, sf, "lineitem").select(F.col("l_discount").alias("threshold")).distinct()
    return S.grid_confusion(event_scores(spark, sf), grid)


def _sweep_sql(points, start, step, stop, extra=""):
    # The theta join of the SQL runs over the score table, not over the rows.
    return f"""WITH {CURVE_SQL}, {grid_sql(points, start, step, stop)} {THETA_SQL},
ranked AS (SELECT *, {M['accuracy']} AS accuracy,
             row_number() OVER (PARTITION BY model_id ORDER BY (tp + tn) DESC, threshold) AS rn FROM atgrid)
SELECT model_id, threshold, accuracy, tp, fp, tn, fn{extra} FROM ranked r WHERE rn = 1"""


SWEEP_SQL = {
    "thousandths": _sweep_sql(1001, "0", "(1::DOUBLE / 1000)", "1"),
    "fivehundredths": _sweep_sql(501, "0", "(1::DOUBLE / 500)", "1"),
    "percent": _sweep_sql(99, "0.01", "((0.99::DOUBLE - 0.01::DOUBLE) / 98)", "0.99"),
    "tenth_to_nine_tenths": _sweep_sql(81, "0.1", "((0.9::DOUBLE - 0.1::DOUBLE) / 80)", "0.9"),
    "middle": _sweep_sql(41, "0.3", "((0.7::DOUBLE - 0.3::DOUBLE) / 40)", "0.7"),
}


def _sweep_query(name):
    @query(f"ev12_sweep_{name}", SWEEP_SQL[name])
    def run(spark, sf):
        out = S.sweep(event_scores(spark, sf), GRIDS[name])
        return out.withColumn("accuracy", F.round("accuracy", 9))
    return run


for _name in GRIDS:
    _sweep_query(_name)


@query("ev12_sweep_target", _sweep_sql(1001, "0", "(1::DOUBLE / 1000)", "1",
       ", (SELECT min(threshold) FROM ranked q WHERE q.model_id = r.model_id AND q.accuracy >= 0.8) AS target_threshold"))
def sweep_target(spark, sf):
    out = S.sweep(event_scores(spark, sf), GRIDS["thousandths"], target=0.8)
    return out.withColumn("accuracy", F.round("accuracy", 9))


CANDIDATE_SQL = CURVE_SQL + """,
cand AS (SELECT model_id, proba AS threshold FROM st
         UNION SELECT model_id, 0 FROM ends UNION SELECT model_id, 1 FROM ends)"""


@query("ev13_best_f1", f"""WITH {CANDIDATE_SQL},
st2 AS (SELECT c.model_id, c.threshold, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg
        FROM cand c LEFT JOIN st ON st.model_id = c.model_id AND st.proba = c.threshold),
cum AS (SELECT model_id, threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp
        FROM st2 WINDOW w AS (PARTITION BY model_id ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
full_cm AS (SELECT model_id, threshold, tp, fp, n_all - fp AS tn, p_all - tp AS fn FROM cum JOIN ends USING (model_id)),
ranked AS (SELECT *, {M['f1']} AS f1r, row_number() OVER (PARTITION BY model_id
             ORDER BY CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END DESC, threshold) AS rn
           FROM full_cm)
SELECT model_id, threshold, tp, fp, tn, fn, f1r AS f1 FROM ranked WHERE rn = 1""")
def best_f1(spark, sf):
    return S.best_f1(event_scores(spark, sf)).withColumn("f1", F.round("f1", 9))


def _recall_query(target, pick_):
    agg = "max" if pick_ == "highest" else "min"

    @query(f"ev14_threshold_recall_{int(target * 100)}_{pick_}", f"""WITH {CURVE_SQL}
SELECT model_id, {agg}(proba) FILTER (tp / p_all::DOUBLE >= {target}::DOUBLE) AS threshold
FROM points JOIN ends USING (model_id) GROUP BY model_id""")
    def run(spark, sf):
        return S.threshold_for_recall(event_scores(spark, sf), target, pick=pick_)
    return run


for _t in (0.9, 0.95):
    for _p in ("highest", "lowest"):
        _recall_query(_t, _p)


@query("ev15_auc_by_column", f"""WITH {CURVE_SQL}
SELECT model_id, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round({AUC_SQL}, 9) AS roc_auc
FROM points GROUP BY model_id""")
def auc_columns(spark, sf):
    return S.auc_by_column(event_scores_wide(spark, sf), SCORE_NAMES).withColumn("roc_auc", F.round("roc_auc", 9))


CATALOGUE_SQL = f"""{CURVE_SQL},
cm AS (SELECT model_id,
         CAST(coalesce(sum(pos) FILTER (proba >= 0.5), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg) FILTER (proba >= 0.5), 0) AS BIGINT) AS fp,
         CAST(coalesce(sum(neg) FILTER (proba < 0.5), 0) AS BIGINT) AS tn, CAST(coalesce(sum(pos) FILTER (proba < 0.5), 0) AS BIGINT) AS fn,
         {AUC_SQL} AS auc, {AP_SQL} AS ap FROM points GROUP BY model_id),
cat AS (SELECT model_id, tp, fp, tn, fn, round(auc, 9) AS roc_auc, round(ap, 9) AS pr_auc,
          {pick('accuracy', 'precision', 'recall', 'f1', 'specificity', 'fpr')},
          round(coalesce((auc + (tp + tn) / (tp + fp + tn + fn)::DOUBLE) / 2, (tp + tn) / (tp + fp + tn + fn)::DOUBLE), 9) AS composite
        FROM cm)"""
CATALOGUE_COLUMNS = ["roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1", "specificity", "fpr", "composite"]


def _catalogue(spark, sf):
    out = S.evaluate_catalogue(event_scores(spark, sf))
    return out.select("model_id", "tp", "fp", "tn", "fn", *[rnd(c) for c in CATALOGUE_COLUMNS])


@query("ev16_best_composite", f"WITH {CATALOGUE_SQL} SELECT model_id, composite FROM cat ORDER BY composite DESC, model_id LIMIT 1")
def best_composite(spark, sf):
    return S.arg_best(_catalogue(spark, sf).select("model_id", "composite"), "composite", "model_id")


@query("ev17_evaluate_catalogue", f"WITH {CATALOGUE_SQL} SELECT * FROM cat")
def catalogue(spark, sf):
    return _catalogue(spark, sf)


@query("ev18_full_report", f"""WITH {CATALOGUE_SQL}
SELECT tp, fp, tn, fn, accuracy, precision, recall, f1, specificity, roc_auc, pr_auc FROM cat WHERE model_id = 's3'""")
def full_report(spark, sf):
    wide = event_scores_wide(spark, sf)
    predictions = S.apply_threshold(wide.select("row_id", F.col("s3").alias("proba")), 0.5)
    out = S.full_report(predictions, wide.select("row_id", "y"), "row_id")
    return out.select("tp", "fp", "tn", "fn", *[rnd(c) for c in ("accuracy", "precision", "recall", "f1", "specificity", "roc_auc", "pr_auc")])


@query("set5_candidate_thresholds", f"WITH {CANDIDATE_SQL} SELECT model_id, threshold FROM cand")
def candidates(spark, sf):
    return S.candidate_thresholds(event_scores(spark, sf))


@query("wn3_cumulative_counts", f"WITH {CURVE_SQL} SELECT model_id, proba, pos, neg, tp, fp, rnk AS rank FROM points")
def cumulative(spark, sf):
    return S.curve(event_scores(spark, sf)).drop("p_all", "n_all")


@query("wn4_curve_steps", f"""WITH {CURVE_SQL}
SELECT model_id, proba, fp - lag(fp, 1, 0::BIGINT) OVER w AS d_fp, tp - lag(tp, 1, 0::BIGINT) OVER w AS d_tp,
       (tp + lag(tp, 1, 0::BIGINT) OVER w) / 2::DOUBLE AS mid_tp
FROM points WINDOW w AS (PARTITION BY model_id ORDER BY proba DESC)""")
def steps(spark, sf):
    return S.curve_steps(S.curve(event_scores(spark, sf)))


@query("prj12_apply_threshold", f"WITH {WIDE_SQL} SELECT row_id, s3 AS proba, CAST(s3 >= 0.5 AS INTEGER) AS pred FROM wide")
def threshold_rows(spark, sf):
    return S.apply_threshold(event_scores_wide(spark, sf).select("row_id", F.col("s3").alias("proba")), 0.5)


def flagship(spark, sf):
    """Best threshold, confusion counts and AUC of every score on one plan."""
    best = S.sweep_and_auc(event_scores(spark, sf), GRIDS["thousandths"])
    return best.select("model_id", "threshold", rnd("accuracy"), "tp", "fp", "tn", "fn", rnd("roc_auc"))


query("entry_threshold_and_auc", SWEEP_SQL["thousandths"].replace(
    "SELECT model_id, threshold, accuracy, tp, fp, tn, fn FROM ranked r WHERE rn = 1",
    f""", auc AS (SELECT model_id, round({AUC_SQL}, 9) AS roc_auc FROM points GROUP BY model_id)
SELECT model_id, threshold, accuracy, tp, fp, tn, fn, roc_auc FROM ranked r JOIN auc USING (model_id) WHERE rn = 1"""))(flagship)
