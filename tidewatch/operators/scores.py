"""Metrics from score tables.

A score row is ``(by..., proba, y)`` with ``y`` in {0, 1}; ``by`` is usually the
model. Curve metrics first collapse rows to distinct scores with map-side
aggregation, then read prefix sums; sweeps collapse to grid intervals. No task
ever holds more than distinct scores of one range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.expressions import nan_to_null, quoted, ratio, ratio_or_zero, real
from tidewatch.functions.grids import Grid
from tidewatch.operators.ordering import running_totals
from tidewatch.session import write_scratch

MODEL = ["model_id"]


def _clean(df: DataFrame, by: list[str], *extra: Column) -> DataFrame:
    out = df.select(
        *by, nan_to_null(F.col("proba").cast("double")).alias("proba"), F.col("y").cast("long").alias("y"),
        *[e.alias(f"__s{i}") for i, e in enumerate(extra)])
    return out.where(F.col("proba").isNotNull() & F.col("y").isNotNull())


def top_scored(df: DataFrame, row_id: str, n: int = 10) -> DataFrame:
    """The ``n`` rows with the highest probability, ties by key; missing scores come last."""
    return df.orderBy(nan_to_null("proba").desc_nulls_last(), row_id).limit(n)


def apply_threshold(df: DataFrame, threshold: float, proba: str = "proba", name: str = "pred") -> DataFrame:
    return df.withColumn(name, (F.col(proba) >= F.lit(float(threshold))).cast("int"))


# ---- metrics from a confusion table -------------------------------------------------

def metric_columns(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn") -> dict[str, Column]:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in (tp, fp, tn, fn))
    return {
        "accuracy": ratio_or_zero(tp + tn, tp + tn + fp + fn),
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1": ratio_or_zero(2 * tp, 2 * tp + fp + fn),
        "specificity": ratio_or_zero(tn, tn + fp),
        "fpr": ratio(fp, fp + tn),
    }


def with_metrics(df: DataFrame, *names: str) -> DataFrame:
    cols = metric_columns()
    return df.withColumns({n: cols[n] for n in names or cols})


def confusion(df: DataFrame, by: list[str] = MODEL, pred: str = "pred", y: str = "y") -> DataFrame:
    p, t = F.col(pred) == 1, F.col(y) == 1
    cell = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return df.groupBy(*by).agg(
        cell(p & t).alias("tp"), cell(p & ~t).alias("fp"), cell(~p & ~t).alias("tn"), cell(~p & t).alias("fn")
    )


def basic_metrics(df: DataFrame, by: list[str] = MODEL, pred: str = "pred", y: str = "y") -> DataFrame:
    return with_metrics(confusion(df, by, pred, y), "accuracy", "precision", "recall", "f1")


def specificity_fpr(df: DataFrame, by: list[str] = MODEL, pred: str = "pred", y: str = "y") -> DataFrame:
    return with_metrics(confusion(df, by, pred, y), "specificity", "fpr").select(*by, "specificity", "fpr")


def class_report(df: DataFrame, by: list[str], pred: str = "pred", y: str = "y") -> DataFrame:
    """Precision, recall, F1 and support of each class in truth or prediction."""
    cells = df.groupBy(*by, y, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("long")
    sides = cells.select(*by, F.explode(F.array(
        F.struct(F.col(y).alias("class"), F.col("n").alias("support"), zero.alias("predicted"), hit.cast("long").alias("hit")),
        F.struct(F.col(pred).alias("class"), zero.alias("support"), F.col("n").alias("predicted"), zero.alias("hit")),
    )).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    return sums.select(
        *by, "class", "support",
        ratio_or_zero(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio_or_zero(F.col("hit"), F.col("support")).alias("recall"),
        ratio_or_zero(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def macro_f1(df: DataFrame, by: list[str], pred: str = "pred", y: str = "y") -> DataFrame:
    report = class_report(df, by, pred, y)
    return report.groupBy(*by).agg(
        F.avg("f1").alias("macro_f1"),
        ratio(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_classes"),
    )


# ---- score table and curves ---------------------------------------------------------

def score_table(df: DataFrame, by: list[str] = MODEL, **sums: Column) -> DataFrame:
    """Positives and negatives at each distinct score, and further sums if asked."""
    return _clean(df, by, *sums.values()).groupBy(*by, "proba").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"), *[F.sum(f"__s{i}").alias(n) for i, n in enumerate(sums)]
    )


def candidate_thresholds(df: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """Distinct scores together with 0 and 1."""
    values = F.array("proba", F.lit(0.0), F.lit(1.0))
    return _clean(df, by).select(*by, F.explode(values).alias("threshold")).distinct()


def curve(df: DataFrame, by: list[str] = MODEL, leads: list[str] = (), ranges: int | None = None) -> DataFrame:
    """Counts at or above each distinct score: tp, fp, with own pos and neg and the class totals."""
    return curve_of(score_table(df, by), by, leads, ranges)


def curve_of(table: DataFrame, by: list[str], leads: list[str] = (), ranges: int | None = None) -> DataFrame:
    """The curve of a score table ``(by..., proba, pos, neg)``."""
    totals = running_totals(
        table.withColumn("rank", F.lit(1).cast("long")), by, [F.col("proba").desc()], ["pos", "neg", "rank"], totals=True, leads=leads, ranges=ranges)
    made = {"cum_pos", "cum_neg", "cum_rank", "all_pos", "all_neg", "all_rank", "rank"}
    return totals.select(
        *[c for c in totals.columns if c not in made], F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.col("cum_rank").alias("rank"), F.col("all_pos").alias("p_all"), F.col("all_neg").alias("n_all"),
    )


def roc_auc(df: DataFrame, by: list[str] = MODEL, **kw) -> DataFrame:
    return auc_from_curve(curve(df, by, **kw), by)


def _area() -> Column:
    """Pairs of a negative with a higher positive; ties count one half."""
    d = lambda c: F.col(c).cast("double")
    return F.sum(d("neg") * (d("tp") - d("pos") / 2))


def _average_precision() -> Column:
    return F.sum(F.col("pos") * ratio(F.col("tp"), F.col("tp") + F.col("fp")))


def auc_from_curve(points: DataFrame, by: list[str]) -> DataFrame:
    """Ties count one half; null when one class is missing."""
    d = lambda c: F.col(c).cast("double")
    return points.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), _area().alias("area")).select(
        *by, "n_pos", "n_neg", ratio(F.col("area"), d("n_pos") * d("n_neg")).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str] = MODEL, **kw) -> DataFrame:
    return curve(df, by, **kw).groupBy(*by).agg(F.sum("pos").alias("n_pos"), _average_precision().alias("area")).select(
        *by, "n_pos", ratio(F.col("area"), F.col("n_pos")).alias("pr_auc"))


def _with_end(points: DataFrame, by: list[str], x: str, y: str, end: tuple[float, float]) -> DataFrame:
    """Curve points (threshold, x, y) and the end point without a threshold, next to the first row."""
    point = lambda t, a, b: F.struct(t.cast("double").alias("threshold"), a.alias(x), b.alias(y))
    own = point(F.col("proba"), F.col(x), F.col(y))
    extra = point(F.lit(None), F.lit(end[0]), F.lit(end[1]))
    return points.select(*by, F.inline(F.when(F.col("rank") == 1, F.array(extra, own)).otherwise(F.array(own))))


def roc_curve(df: DataFrame, by: list[str] = MODEL, drop_collinear: bool = False, **kw) -> DataFrame:
    """False and true positive rate at each threshold; starts at (0, 0, null).

    ``drop_collinear`` leaves out points on a straight line between neighbours.
    """
    points = curve(df, by, leads=["pos", "neg"] if drop_collinear else [], **kw)
    if drop_collinear:
        points = points.where(
            (F.col("rank") == 1) | F.col("next_pos").isNull()
            | (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg")))
    rates = points.select(
        *by, "proba", "rank", ratio(F.col("fp"), F.col("n_all")).alias("fpr"), ratio(F.col("tp"), F.col("p_all")).alias("tpr"))
    return _with_end(rates, by, "fpr", "tpr", (0.0, 0.0))


def pr_curve(df: DataFrame, by: list[str] = MODEL, **kw) -> DataFrame:
    """Precision and recall at each threshold; ends at (1, 0, null)."""
    rates = curve(df, by, **kw).select(
        *by, "proba", "rank", ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("p_all")).alias("recall"))
    return _with_end(rates, by, "precision", "recall", (1.0, 0.0))


def curve_steps(points: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """Trapezoid of each step: change in false positives and mean true positives."""
    return points.select(
        *by, "proba", F.col("neg").alias("d_fp"), F.col("pos").alias("d_tp"),
        (F.col("tp") - F.col("pos").cast("double") / 2).alias("mid_tp"),
    )


# ---- thresholds ---------------------------------------------------------------------

def _grid_point(grid: Grid, i: str) -> str:
    return f"if({i} >= {grid.points - 1}, {real(grid.stop)}, {real(grid.start)} + {i} * {real(grid.step)})"


def _interval(df: DataFrame, thresholds: Grid | list[float]) -> DataFrame:
    """Add ``k``, the number of thresholds not above the score.

    On an even grid a guess by division is put right by comparing with the grid
    points next to it, so the result is that of the comparison itself.
    """
    if isinstance(thresholds, Grid):
        last = thresholds.points - 1
        guess = f"least({last}, greatest(0, int(floor((proba - {real(thresholds.start)}) / {real(thresholds.step)}))))"
        return df.selectExpr("*", f"if(proba < {real(thresholds.start)}, -1, if(proba >= {real(thresholds.stop)}, {last}, {guess})) AS __g").selectExpr(
            *map(quoted, df.columns),
            f"if(__g >= 0 AND {_grid_point(thresholds, '__g')} > proba, __g, "
            f"if(__g BETWEEN 0 AND {last - 1} AND {_grid_point(thresholds, '(__g + 1)')} <= proba, __g + 2, __g + 1)) AS k")
    cuts = [float("-inf"), *thresholds, float("inf")]
    if len(cuts) < 3 or any(a >= b for a, b in zip(cuts, cuts[1:])):
        raise ValueError("thresholds must be finite and strictly increasing")
    return Bucketizer(splits=cuts, inputCol="proba", outputCol="k").transform(df).withColumn("k", F.col("k").cast("int"))


def _intervals(df: DataFrame, thresholds: Grid | list[float], by: list[str], pos: Column, neg: Column) -> DataFrame:
    return _interval(df, thresholds).groupBy(*by, "k").agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))


def interval_counts(df: DataFrame, thresholds: Grid | list[float], by: list[str] = MODEL) -> DataFrame:
    """Positives and negatives by ``k``, the number of thresholds not above the score."""
    return _intervals(_clean(df, by), thresholds, by, F.col("y"), 1 - F.col("y"))


def metrics_at_grid(df: DataFrame, thresholds: Grid | list[float], by: list[str] = MODEL) -> DataFrame:
    """Confusion counts at every threshold, from one pass over the rows.

    The rows collapse to at most one interval more than there are thresholds
    per model before anything is ordered.
    """
    return _grid_metrics(interval_counts(df, thresholds, by), thresholds, by)


def _grid_metrics(counts: DataFrame, thresholds: Grid | list[float], by: list[str]) -> DataFrame:
    per_model = counts.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct("pos", "neg")))).alias("m"),
        F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"),
    )
    if isinstance(thresholds, Grid):
        grid = F.expr(f"transform(sequence(0, {thresholds.points - 1}), i -> {_grid_point(thresholds, 'i')})")
    else:
        grid = F.expr(f"array({', '.join(map(real, thresholds))})")
    rows = per_model.select(*by, "m", "p_all", "n_all", F.posexplode(grid).alias("i", "threshold"))
    own = F.try_element_at("m", F.col("i") + 1)
    above = Window.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda f: F.sum(F.coalesce(own[f], F.lit(0).cast("long"))).over(above)
    return rows.select(
        *by, "threshold", total("pos").alias("tp"), total("neg").alias("fp"), "p_all", "n_all"
    ).select(
        *by, "threshold", "tp", "fp",
        (F.col("n_all") - F.col("fp")).alias("tn"), (F.col("p_all") - F.col("tp")).alias("fn"),
    )


def metrics_at(df: DataFrame, threshold: float, by: list[str] = MODEL) -> DataFrame:
    flat = with_metrics(confusion(apply_threshold(_clean(df, by), threshold), by), "precision", "recall", "fpr")
    return flat.withColumn("threshold", F.lit(float(threshold)))


def grid_confusion(df: DataFrame, grid: DataFrame, by: list[str] = MODEL, **kw) -> DataFrame:
    """Join scores to a grid table on ``proba >= threshold`` and count, without a theta join.

    Thresholds are put among the distinct scores of each model and prefix sums give the counts; the grid may have any length, and the
    result has a row for each model and threshold.
    """
    scored = write_scratch(score_table(df, by))
    # models and thresholds meet on a constant: all their pairs are the result
    every = F.lit(0).alias("__every")
    models = scored.select(*by, every).distinct()
    zero = F.lit(0).cast("long")
    thresholds = grid.select(F.col("threshold").cast("double").alias("proba"), every).where("proba IS NOT NULL").distinct()
    points = thresholds.join(models, "__every").select(*by, "proba", zero.alias("pos"), zero.alias("neg"), F.lit(1).alias("point"))
    # a score equal to a threshold counts, so it comes first
    both = scored.select(*by, "proba", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"), F.lit(0).alias("point")).unionByName(points)
    placed = running_totals(both, by, [F.col("proba").desc(), F.col("point")], ["pos", "neg"], totals=True, **kw).where("point = 1")
    return placed.select(
        *by, F.col("proba").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        (F.col("all_neg") - F.col("cum_neg")).alias("tn"), (F.col("all_pos") - F.col("cum_pos")).alias("fn"))


def sweep(df: DataFrame, grid: Grid, by: list[str] = MODEL, target: float | None = None) -> DataFrame:
    """Lowest threshold with the best accuracy, with its confusion counts.

    With ``target``, also the lowest threshold whose accuracy reaches it.
    """
    return _best_accuracy(metrics_at_grid(df, grid, by), by, target)


def _best_accuracy(table: DataFrame, by: list[str], target: float | None = None) -> DataFrame:
    table = with_metrics(table, "accuracy")
    best = F.max_by(F.struct("threshold", "accuracy", "tp", "fp", "tn", "fn"), F.struct("accuracy", -F.col("threshold")))
    reached = F.min(F.when(F.col("accuracy") >= target, F.col("threshold"))).alias("target_threshold") if target is not None else None
    extra = [reached] if target is not None else []
    return table.groupBy(*by).agg(best.alias("b"), *extra).select(*by, "b.*", *(["target_threshold"] if extra else []))


def sweep_and_auc(df: DataFrame, grid: Grid, by: list[str] = MODEL, **kw) -> DataFrame:
    """Best threshold of the grid, its confusion counts, and the AUC, in one pass.

    The counts of a curve point hold for all thresholds down to the next lower
    score, so the lowest grid point in that interval is its candidate.
    """
    points = curve_of(_interval(score_table(df, by), grid), by, leads=["k"], **kw)
    d = lambda c: F.col(c).cast("double")
    n = d("p_all") + d("n_all")

    def candidate(i: str, tp: Column, fp: Column) -> Column:
        right = (tp + F.col("n_all") - fp).cast("double")
        return F.struct(ratio(right, n).alias("accuracy"), F.expr(f"-({_grid_point(grid, i)})").alias("down"), tp.alias("tp"), fp.alias("fp"))

    zero = F.lit(0).cast("long")
    sums = points.groupBy(*by).agg(
        F.max(F.when(F.expr("coalesce(next_k, 0) < k"), candidate("coalesce(next_k, 0)", F.col("tp"), F.col("fp")))).alias("inner"),
        F.max(F.when((F.col("rank") == 1) & (F.col("k") < grid.points), candidate("k", zero, zero))).alias("above"),
        F.max("p_all").alias("p_all"), F.max("n_all").alias("n_all"), _area().alias("area"),
    ).withColumn("b", F.greatest("inner", "above"))
    return sums.select(
        *by, F.expr("0D - b.down").alias("threshold"), "b.accuracy", "b.tp", "b.fp",
        (F.col("n_all") - F.col("b.fp")).alias("tn"), (F.col("p_all") - F.col("b.tp")).alias("fn"),
        ratio(F.col("area"), d("p_all") * d("n_all")).alias("roc_auc"))


def best_f1(df: DataFrame, by: list[str] = MODEL, **kw) -> DataFrame:
    """Lowest threshold among the scores, 0 and 1 with the best F1."""
    f1 = metric_columns()["f1"]
    tn, fn = (F.col("n_all") - F.col("fp")).alias("tn"), (F.col("p_all") - F.col("tp")).alias("fn")
    at = lambda c, t: F.coalesce(F.max(F.when(F.col("proba") >= t, F.col(c))), F.lit(0))
    scored = curve(df, by, **kw).select(*by, F.col("proba").alias("proba"), "tp", "fp", "p_all", "n_all", tn, fn)
    point = lambda t, tp, fp: F.struct(t.alias("threshold"), tp.alias("tp"), fp.alias("fp"))
    per_model = scored.groupBy(*by).agg(
        F.max_by(point(F.col("proba"), F.col("tp"), F.col("fp")), F.struct(f1, -F.col("proba"))).alias("top"),
        *[point(F.lit(t), at("tp", t), at("fp", t)).alias(name) for name, t in (("zero", 0.0), ("one", 1.0))],
        F.max("p_all").alias("p_all"), F.max("n_all").alias("n_all"),
    )
    three = per_model.select(*by, "p_all", "n_all", F.inline(F.array("top", "zero", "one"))).select(
        *by, "threshold", "tp", "fp", tn, fn).withColumn("f1", f1)
    best = F.max_by(F.struct("threshold", "tp", "fp", "tn", "fn", "f1"), F.struct("f1", -F.col("threshold")))
    return three.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def threshold_for_recall(df: DataFrame, target: float, by: list[str] = MODEL, pick: str = "highest", **kw) -> DataFrame:
    points = curve(df, by, **kw)
    reached = F.when(ratio(F.col("tp"), F.col("p_all")) >= target, F.col("proba"))
    choose = F.max if pick == "highest" else F.min
    return points.groupBy(*by).agg(choose(reached).alias("threshold"))


# ---- comparing models ---------------------------------------------------------------

def auc_by_column(df: DataFrame, columns: list[str], y: str = "y", **kw) -> DataFrame:
    """AUC of every score column, from one unpivoted pass."""
    stacked = df.select(F.col(y).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("model_id"), F.col(c).cast("double").alias("proba")) for c in columns
    ])).alias("s")).select("s.*", "y")
    return roc_auc(stacked, MODEL, **kw)


def composite(metrics: DataFrame) -> DataFrame:
    """Half the sum of AUC and accuracy; accuracy alone where AUC is undefined."""
    return metrics.withColumn(
        "composite", F.coalesce((F.col("roc_auc") + F.col("accuracy")) / 2, F.col("accuracy"))
    )


def arg_best(df: DataFrame, score: str, tie: str, by: list[str] | None = None) -> DataFrame:
    """Row with the highest score; ties go to the smallest ``tie`` value."""
    lowest = F.min(F.struct(F.col("__neg").alias("a"), F.col(tie).alias("b"), F.struct(*df.columns).alias("row")))
    ranked = df.withColumn("__neg", F.coalesce(-F.col(score), F.lit(float("inf"))))
    return ranked.groupBy(*(by or [])).agg(lowest.alias("m")).select("m.row.*")


def evaluate_catalogue(
    df: DataFrame, threshold: float | None = 0.5, by: list[str] = MODEL, **kw
) -> DataFrame:
    """All headline metrics for all models of a stacked score table, in one pass.

    The confusion counts come from the threshold or, with ``threshold`` None,
    from the ``pred`` column.
    """
    if threshold is None:
        flag = F.col("pred").cast("long")
        table = score_table(df, by, hit_pos=flag * F.col("y").cast("long"), hit_neg=flag * (1 - F.col("y").cast("long")))
    else:
        hit = F.col("proba") >= F.lit(float(threshold))
        table = score_table(df, by).withColumns({
            "hit_pos": F.when(hit, F.col("pos")).otherwise(0), "hit_neg": F.when(hit, F.col("neg")).otherwise(0)})
    points = curve_of(table, by, **kw)
    d = lambda c: F.col(c).cast("double")
    sums = points.groupBy(*by).agg(
        F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"), F.sum("hit_pos").alias("tp"), F.sum("hit_neg").alias("fp"),
        _area().alias("area"), _average_precision().alias("ap"),
    )
    flat = sums.select(
        *by, "tp", "fp", (F.col("n_all") - F.col("fp")).alias("tn"), (F.col("p_all") - F.col("tp")).alias("fn"),
        ratio(F.col("area"), d("p_all") * d("n_all")).alias("roc_auc"), ratio(F.col("ap"), F.col("p_all")).alias("pr_auc"),
    )
    return composite(with_metrics(flat))


def full_report(predictions: DataFrame, truth: DataFrame, row_id: str, **kw) -> DataFrame:
    """Metrics of a predictions table (row_id, proba, pred) against truth (row_id, y).

    Rows of either side without exactly one partner are an error: metrics of the rest would be of another table.
    """
    sides = predictions.select(row_id, F.lit(1).alias("__p"), F.lit(0).alias("__t")).unionByName(
        truth.select(row_id, F.lit(0).alias("__p"), F.lit(1).alias("__t")))
    wrong = sides.groupBy(row_id).agg(F.sum("__p").alias("__p"), F.sum("__t").alias("__t")).where("__p <> 1 OR __t <> 1").first()
    if wrong is not None:
        raise ValueError(f"{row_id} {wrong[0]!r} has {wrong[1]} predictions and {wrong[2]} rows of truth")
    return evaluate_catalogue(predictions.join(truth, row_id), None, [], **kw)
