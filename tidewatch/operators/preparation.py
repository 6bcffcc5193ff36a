"""Imputing, scaling, encoding and projection, fitted on training rows only."""

from __future__ import annotations

import math
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import PCA, OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.expressions import count_cuts, number, quoted, real
from tidewatch.operators.composite import Composite
from tidewatch.operators.encoding import CategoryIndexer, cells_of, fit_categories
from tidewatch.operators.ordering import running_totals
from tidewatch.operators.profiling import _chunks, per_column

SKETCH_ACCURACY = 10_000
SKETCH_MARGIN = 4.0 / SKETCH_ACCURACY


def values_at_ranks(df: DataFrame, names: list[str], ranks) -> dict[str, list[float]]:
    """Exact order statistics of many columns: ``ranks(n)`` lists 1-based ranks.

    A quantile sketch gives an interval around each wanted rank: values inside
    the intervals are counted one by one, the values between two intervals only
    as a group, so little is shuffled. A rank that falls into such a group after all sends its
    column through again as a whole: the result is always exact. Per column a
    handful of numbers reach the driver.
    """
    x = {c: f"__x{i}" for i, c in enumerate(names)}
    numbers = df.selectExpr(*[f"{number(c)} AS {x[c]}" for c in names])
    counts: dict[str, int] = {}
    for block in _chunks(names):
        row = numbers.agg(*[F.count(x[c]) for c in block]).first()
        counts.update({c: row[i] for i, c in enumerate(block)})
    wanted = {c: list(ranks(counts[c])) for c in names if counts[c] > 0}
    todo = [c for c in wanted if wanted[c]]
    spans = _sketched_spans(numbers, x, wanted, counts, todo)
    found: dict[str, list[float]] = {c: [] for c in wanted}
    while todo:
        hits = _place(numbers, x, wanted, counts, {c: spans[c] for c in todo})
        for c in todo:
            if all(hits.get((c, r)) is not None for r in wanted[c]):
                found[c] = [hits[c, r] for r in wanted[c]]
            elif spans[c] == [WHOLE]:
                raise RuntimeError(f"rank not found in {c}: the table changed between passes")
        todo = [c for c in todo if not found[c]]
        spans = {c: [WHOLE] for c in todo}
    return found


WHOLE = (float("-inf"), float("inf"))


def _place(numbers: DataFrame, x: dict, wanted: dict, counts: dict, spans: dict) -> dict:
    """Value at each wanted rank, or none where it lies outside the spans."""
    names, stack = list(spans), []
    # Segment 2k + 1 is span k, even segments are the gaps around them.
    edges = {x[c]: [v for low, high in spans[c] for v in (low, math.nextafter(high, math.inf))] for c in names if spans[c] != [WHOLE]}
    cut = count_cuts(numbers, edges, {e: f"{e}_s" for e in edges})
    for i, c in enumerate(names):
        if x[c] not in edges:
            segment, value = "1", x[c]
        else:
            segment, value = f"{x[c]}_s", f"if({x[c]}_s % 2 = 1, {x[c]}, NULL)"
        stack.append(f"struct({i} AS c, {segment} AS segment, {value} AS value, {x[c]} IS NOT NULL AS known)")
    table = cut.selectExpr(f"inline(array({', '.join(stack)}))").where("known").groupBy("c", "segment", "value").agg(
        F.count(F.lit(1)).alias("n"))
    placed = running_totals(table, ["c"], [F.col("segment"), F.col("value")], ["n"])
    targets = numbers.sparkSession.createDataFrame(
        [(i, r) for i, c in enumerate(names) for r in sorted(set(wanted[c]))], "c int, rank long")
    hit = placed.join(F.broadcast(targets), "c").where(
        (F.col("rank") <= F.col("cum_n")) & (F.col("rank") > F.col("cum_n") - F.col("n")))
    return {(names[r.c], r["rank"]): r.value for r in hit.select("c", "rank", "value").collect()}


def _sketched_spans(numbers: DataFrame, x: dict, wanted: dict, counts: dict, names: list[str]) -> dict:
    """Per column disjoint intervals that should hold the wanted ranks."""
    out = {}
    for block in _chunks(names):
        near = {c: [(max(0.0, r / counts[c] - SKETCH_MARGIN), min(1.0, r / counts[c] + SKETCH_MARGIN)) for r in sorted(wanted[c])] for c in block}
        probs = {c: sorted({q for pair in near[c] for q in pair}) for c in block}
        row = numbers.agg(*[
            F.expr(f"percentile_approx({x[c]}, array({', '.join(map(real, probs[c]))}), {SKETCH_ACCURACY})") for c in block
        ]).first()
        for i, c in enumerate(block):
            value, spans = dict(zip(probs[c], row[i])), []
            for low, high in near[c]:
                if spans and value[low] <= math.nextafter(spans[-1][1], math.inf):
                    spans[-1] = (spans[-1][0], max(spans[-1][1], value[high]))
                else:
                    spans.append((value[low], value[high]))
            out[c] = spans
    return out


def medians(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Exact medians; columns without any number are left out."""
    middle = values_at_ranks(df, names, lambda n: [(n + 1) // 2, n // 2 + 1])
    return {c: (a + b) / 2 for c, (a, b) in middle.items()}


class MedianImputer(Composite):
    """Medians of the training rows; a column without numbers is dropped."""

    def __init__(self, values: dict[str, float], dropped: list[str] | None = None):
        super().__init__()
        self.values, self.dropped = values, dropped or []

    def plain(self) -> dict:
        return {"values": self.values, "dropped": self.dropped}

    def _transform(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({c: F.expr(f"coalesce({number(c)}, {real(v)})") for c, v in self.values.items()})
        return filled.drop(*self.dropped)


def fit_median(df: DataFrame, names: list[str]) -> MedianImputer:
    values = medians(df, names)
    return MedianImputer(values, [c for c in names if c not in values])


class Scaler(Composite):
    """Mean and population deviation; a constant column is only centred."""

    def __init__(self, mean: dict[str, float], std: dict[str, float]):
        super().__init__()
        self.mean, self.std = mean, std

    def plain(self) -> dict:
        return {"mean": self.mean, "std": self.std}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(f"({number(c)} - {real(m)}) / {real(self.std[c] or 1.0)}") for c, m in self.mean.items()})


def fit_scale(df: DataFrame, names: list[str]) -> Scaler:
    rows = per_column(df, names, {"mean": "avg({x})", "std": "stddev_pop({x})"}).collect()
    known = [r for r in rows if r["mean"] is not None]
    return Scaler({r.feature: r["mean"] for r in known}, {r.feature: r["std"] for r in known})


# ---- encoding and the fitted preparation ---------------------------------------------

def _onehot(df: DataFrame, names: list[str], indexer: CategoryIndexer) -> list:
    """The indexer and an encoder that knows the sizes from it; unseen and null become all zeros."""
    encode = OneHotEncoder(
        inputCols=[f"__idx_{c}" for c in names], outputCols=[f"__hot_{c}" for c in names], dropLast=True, handleInvalid="keep")
    return [indexer, encode.fit(indexer.sizes_row(df))]


def fit_onehot(df: DataFrame, names: list[str]) -> PipelineModel:
    """Categories in order, of any number: they are a table, and vectors are sparse."""
    return PipelineModel(_onehot(df, names, fit_categories(df, names)))


def onehot_cells(model: PipelineModel, df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """The encoded matrix in long form: one row per set cell."""
    return cells_of(model.stages[0], df, keep)


class TabularPreparation(Estimator):
    """Estimator: median fill and scaling of numbers, one-hot of categories, assembled.

    The fitted model can be saved, loaded and used on streams. Categories are
    kept as a table, so there may be any number of them. Columns named neither
    way are left out of the feature vector; the vector stays sparse.
    """

    def __init__(self, categorical: list[str], numeric: list[str], output: str = "features"):
        super().__init__()
        self.categorical, self.numeric, self.output = list(categorical), list(numeric), output

    def _fit(self, df: DataFrame) -> PipelineModel:
        imputer = fit_median(df, self.numeric)
        scaler = fit_scale(imputer.transform(df), list(imputer.values))
        used = list(imputer.values)
        cleaned = [
            f"(coalesce({number(c)}, {real(imputer.values[c])}) - {real(scaler.mean[c])}) / {real(scaler.std[c] or 1.0)} AS {quoted('__num_' + c)}"
            for c in used
        ] + [f"coalesce(CAST(`{c}` AS STRING), 'missing') AS `{c}__cat`" for c in self.categorical]
        first = SQLTransformer(statement=f"SELECT *, {', '.join(cleaned)} FROM __THIS__")
        stages: list = [first]
        if self.categorical:
            named = [f"{c}__cat" for c in self.categorical]
            stages += _onehot(df, named, fit_categories(first.transform(df), named))
        inputs = [f"__num_{c}" for c in used] + [f"__hot_{c}__cat" for c in self.categorical]
        stages.append(VectorAssembler(inputCols=inputs, outputCol=self.output))
        return PipelineModel(stages)


def prepare(train: DataFrame, test: DataFrame, out: str, categorical: list[str], label: str, row_id: str) -> PipelineModel:
    """Fit on the training rows, encode both parts, write them and the fitted model."""
    numeric = [c for c in train.columns if c not in categorical and c not in (label, row_id)]
    model = TabularPreparation(categorical, numeric).fit(train)
    parts = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    encoded = model.transform(parts).select(F.col(row_id).alias("row_id"), "features", F.col(label).alias("label"), "split")
    encoded.write.mode("overwrite").partitionBy("split").parquet(f"{out}/matrix")
    model.write().overwrite().save(f"{out}/preparation")
    return model


def pca(df: DataFrame, names: list[str], k: int = 3, keep: list[str] = ()) -> tuple[DataFrame, list[float]]:
    """Scores on the first ``k`` components of the scaled columns, and explained shares.

    The sign of a component makes its largest loading positive. Missing numbers
    are taken as zero before scaling.
    """
    # under names of their own: a column may be kept as it is and projected too
    inner = {c: f"__z{i}" for i, c in enumerate(names)}
    filled = df.withColumns({z: F.expr(f"coalesce({number(c)}, CAST(0 AS DOUBLE))") for c, z in inner.items()})
    scaled = fit_scale(filled, list(inner.values())).transform(filled)
    vec = VectorAssembler(inputCols=list(inner.values()), outputCol="__v").transform(scaled).select(*keep, "__v")
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(vec)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    parts = vector_to_array("__p")
    scores = model.transform(vec).select(*keep, *[(parts[j] * F.lit(signs[j])).alias(f"pc{j + 1}") for j in range(k)])
    return scores, [float(v) for v in model.explainedVariance]
