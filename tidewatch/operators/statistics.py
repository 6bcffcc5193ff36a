"""Association of columns with each other and with the label."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.expressions import count_cuts, number, quoted, ratio, text, xlogx
from tidewatch.operators.profiling import counted_values, per_column

#: Columns a side of a tile of sums.
TILE = 256


def _pearson(x: str, y: str) -> str:
    """Pairwise complete; null for constants, where the built-in function raises under ANSI."""
    a, b = f"if({y} IS NULL, NULL, {x})", f"if({x} IS NULL, NULL, {y})"
    return f"try_divide(covar_pop({a}, {b}), stddev_pop({a}) * stddev_pop({b}))"


def pearson(df: DataFrame, names: list[str], label: str) -> DataFrame:
    return per_column(df, names, {"correlation": _pearson("{x}", "__y")}, shared=[f"{number(label)} AS __y"])


def corr_pairs(df: DataFrame, names: list[str], n: int | None = 20) -> DataFrame:
    """Strongest absolute correlations of column pairs, each pair once; one scan, however many columns.

    Nulls are left out pair by pair. Columns are centred first, after which plain sums of products are exact enough. Tasks add
    up products of their rows as matrices and hand them on in tiles of columns; the tasks that add up a tile turn it into
    correlations and pass on its ``n`` strongest, so neither pairs nor matrices reach the driver.
    """
    facts = {r.feature: r for r in per_column(df, names, {"m": "avg({x})", "w": "max({x}) - min({x})", "gaps": "count_if({x} IS NULL)"}).collect()}
    used = [c for c in names if facts[c].w]
    if len(used) < 2:
        return df.sparkSession.createDataFrame([], "left string, right string, correlation double")
    numbers = df.select(F.expr(f"array({', '.join(map(number, used))})").alias("x"))
    centre, width = np.array([facts[c].m for c in used]), np.array([facts[c].w for c in used])
    tiles = numbers.mapInPandas(_products(centre, any(facts[c].gaps for c in used)), "i int, j int, v binary")
    # partial sums of a tile follow each other, and one of them is held at a time
    rows = tiles.repartition("i", "j").sortWithinPartitions("i", "j").mapInPandas(_correlations(used, width, n), "left string, right string, correlation double")
    ranked = rows.orderBy(F.abs(F.round("correlation", 9)).desc(), "left", "right")
    return ranked if n is None else ranked.limit(n)


def _products(centre: np.ndarray, gaps: bool):
    """Sums of products of centred columns, of each column and its square where the other is known, and of known pairs."""
    p = len(centre)

    def run(batches):
        xy, s, q, known = (np.zeros((p, p)) for _ in range(4)) if gaps else (np.zeros((p, p)), np.zeros(p), np.zeros(p), 0)
        for b in batches:
            if not len(b):
                continue
            x = np.array([[np.nan if v is None else v for v in row] for row in b["x"]], float) - centre
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            xy += x.T @ x
            if gaps:
                s, q, known = s + x.T @ m, q + (x * x).T @ m, known + m.T.astype(float) @ m
            else:
                s, q, known = s + x.sum(axis=0), q + (x * x).sum(axis=0), known + len(x)
        if not gaps:
            s, q, known = np.tile(s[:, None], (1, p)), np.tile(q[:, None], (1, p)), np.full((p, p), float(known))
        for i in range(0, p, TILE):
            for j in range(i, p, TILE):
                a, b = slice(i, i + TILE), slice(j, j + TILE)
                six = [xy[a, b], s[a, b], s[b, a].T, q[a, b], q[b, a].T, known[a, b]]
                yield pd.DataFrame({"i": [i], "j": [j], "v": [np.stack(six).tobytes()]})

    return run


def _correlations(names: list[str], width: np.ndarray, most: int | None):
    def strongest(i: int, j: int, total: np.ndarray) -> pd.DataFrame:
        a, b = names[i:i + TILE], names[j:j + TILE]
        xy, sa, sb, qa, qb, known = total.reshape(6, len(a), len(b))
        with np.errstate(divide="ignore", invalid="ignore"):
            va, vb = qa - sa * sa / known, qb - sb * sb / known
            good = (va > 1e-18 * (width[i:i + TILE] ** 2)[:, None] * known) & (vb > 1e-18 * (width[j:j + TILE] ** 2)[None] * known)
            r = np.where(good, (xy - sa * sb / known) / (np.sqrt(va) * np.sqrt(vb)), np.nan)
        rows, cols = np.nonzero(~np.isnan(r) & (np.arange(i, i + len(a))[:, None] < np.arange(j, j + len(b))[None]))
        out = pd.DataFrame({"left": [a[x] for x in rows], "right": [b[y] for y in cols], "correlation": r[rows, cols]})
        if most is not None:
            out = out.assign(k=-out["correlation"].abs().round(9)).sort_values(["k", "left", "right"]).head(most).drop(columns="k")
        return out

    def run(batches):
        at, total = None, None
        for b in batches:
            for i, j, v in zip(b["i"], b["j"], b["v"], strict=True):
                if (i, j) != at:
                    if at is not None:
                        yield strongest(*at, total)
                    at, total = (i, j), np.zeros(len(v) // 8)
                total = total + np.frombuffer(v)
        if at is not None:
            yield strongest(*at, total)

    return run


def corr_matrix_pairs(df: DataFrame, names: list[str], n: int | None = 20) -> DataFrame:
    """All of a correlation matrix above its diagonal, or its ``n`` strongest entries."""
    return corr_pairs(df, names, n)


def information_sums() -> list[Column]:
    """Aggregates of (pos, neg) cells from which ``information`` is computed."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    return [
        F.sum(xlogx(pos) + xlogx(neg) - xlogx(pos + neg)).alias("__inner"), F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg")]


def information() -> Column:
    """Mutual information in nats. Written with n ln n sums it needs no join to the margins."""
    pos, neg = F.col("__pos").cast("double"), F.col("__neg").cast("double")
    mi = ratio(F.col("__inner") - xlogx(pos) - xlogx(neg) + xlogx(pos + neg), pos + neg)
    return F.greatest(mi, F.lit(0.0))


def label_sums(y: str = "y") -> list[Column]:
    """Positives and negatives of a group."""
    y = F.col(y).cast("long")
    return [F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")]


def mutual_info(df: DataFrame, names: list[str], label: str, bins: int | None = None) -> DataFrame:
    """Mutual information of columns with a 0/1 label; null is a value of its own.

    With ``bins`` numeric columns are first cut at exact quantiles.
    """
    y = F.col(label).cast("long").alias("y")
    if bins is None:
        cells = counted_values(df, names, label_sums(), [y])
    else:
        long = quantile_bins(df, names, bins, [y])
        cells = long.groupBy("feature", "bin").agg(*label_sums())
    return cells.groupBy("feature").agg(*information_sums()).select("feature", information().alias("mutual_information"))


def quantile_bins(df: DataFrame, names: list[str], bins: int, keep: list[Column]) -> DataFrame:
    """Long form with ``bin``: how many quantile cuts of the column are at or below the value."""
    from tidewatch.operators.preparation import values_at_ranks
    cuts = values_at_ranks(df, names, lambda n: [-(-i * n // bins) for i in range(1, bins)])
    x, k = ({c: f"__{v}{i}" for i, c in enumerate(names)} for v in "xk")
    numbers = df.select(*keep, *[F.expr(f"{number(c)} AS {x[c]}") for c in names])
    kept = numbers.columns[:len(keep)]
    cut = count_cuts(numbers, {x[c]: cuts.get(c, []) for c in names}, {x[c]: k[c] for c in names})
    at = lambda c: k[c] if cuts.get(c) else f"int(nullif({x[c]} IS NULL, true))"
    rows = ", ".join(f"struct({text(c)} AS feature, {at(c)} AS bin)" for c in names)
    return cut.selectExpr(*map(quoted, kept), f"inline(array({rows}))")


def _anova(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """``(feature, f, n, k)``: F statistic, rows with a value and classes of each column."""
    per_class = per_column(
        df.where(F.col(label).isNotNull()), names, {"n": "count({x})", "mean": "avg({x})", "var": "var_pop({x})"}, [label],
    ).where(F.col("n") > 0)
    n, mean = F.col("n").cast("double"), F.col("mean")
    together = Window.partitionBy("feature")
    grand = F.sum(n * mean).over(together) / F.sum(n).over(together)
    sums = per_class.withColumn("off", mean - grand).groupBy("feature").agg(
        F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"),
        F.sum(n * F.col("var")).alias("within"), F.sum(n * F.col("off") * F.col("off")).alias("between"),
    )
    f = ratio(ratio(F.col("between"), F.col("k") - 1), ratio(F.col("within"), F.col("n_all") - F.col("k")))
    return sums.select("feature", f.alias("f"), F.col("n_all").alias("n"), "k")


def anova_f(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """F statistic of each column against the classes; null where it is undefined."""
    return _anova(df, names, label).select("feature", "f")


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    upper, lower = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value = lower
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = value
        for term in (even, odd):
            lower, upper = 1 / ((1 + term * lower) or tiny), (1 + term / upper) or tiny
            value *= lower * upper
        if abs(value - before) <= 1e-15 * abs(value):
            break
    return front * value


def f_test(df: DataFrame, names: list[str], label: str) -> DataFrame:
    """``(feature, f, p)``, from the rows in which the column itself has a value; both null where undefined.

    Sums per column and class come from one pass; the table of columns is turned into p-values on the driver.
    """
    found = {r["feature"]: r for r in _anova(df, names, label).collect()}

    def p_value(r) -> float | None:
        if r is None or r["f"] is None:
            return None
        d1, d2 = r["k"] - 1, r["n"] - r["k"]
        return _incomplete_beta(d2 / (d2 + d1 * r["f"]), d2 / 2, d1 / 2)

    rows = [(c, found[c]["f"] if c in found else None, p_value(found.get(c))) for c in names]
    return df.sparkSession.createDataFrame(rows, "feature string, f double, p double")


def select_by_p(df: DataFrame, names: list[str], label: str, mode: str = "fpr", level: float = 0.05) -> DataFrame:
    """Columns whose F test is significant: each by itself (fpr), with its false discovery rate bounded (fdr), or the chance of any error (fwe).

    Missing values count against their own column only; a column without a p-value is not kept.
    """
    if mode not in ("fpr", "fdr", "fwe"):
        raise ValueError(f"unknown mode {mode}")
    rows = f_test(df, names, label).collect()
    known = sorted(r["p"] for r in rows if r["p"] is not None)
    n = len(names)
    if mode == "fdr":
        cut = max((p for i, p in enumerate(known, 1) if p <= level * i / n), default=-1.0)
    else:
        cut = math.nextafter(level / (n if mode == "fwe" else 1), 0)
    kept = [(r["feature"], r["p"] is not None and r["p"] <= cut) for r in rows]
    return df.sparkSession.createDataFrame(kept, "feature string, kept boolean")


def top_features(scores: DataFrame, k: int, score: str = "f") -> DataFrame:
    """The ``k`` best columns; undefined scores come last, ties by name."""
    return scores.orderBy(F.col(score).desc_nulls_last(), "feature").limit(k)
