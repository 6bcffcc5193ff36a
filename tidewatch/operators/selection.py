"""Choosing features: filters, a stepwise search over masks, and importances."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.functions.expressions import col, number
from tidewatch.operators import scores as S
from tidewatch.operators.ordering import hash_rank
from tidewatch.operators.profiling import running_best, varying_columns
from tidewatch.operators.splitting import kfold, stratified_sample
from tidewatch.operators.statistics import anova_f, top_features
from tidewatch.session import remove_folder, write_scratch


def prefilter(df: DataFrame, label: str, features: list[str], k: int, row_id: str | None = None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Top ``k`` varying columns by F, on all rows or on a stratified sample."""
    varying = varying_columns(df, features)
    rows = stratified_sample(df, label, row_id, sample, seed) if sample else df
    return top_features(anova_f(rows, varying, label), k)


#: Bytes of a block of rows, and rows of a band of the sums of products, that tasks hold at once.
BLOCK_BYTES, BAND = 4 << 20, 256


class MaskFitness:
    """Cross-validated score of feature masks with a linear classifier, worked out on the executors.

    The rows are written once as blocks of numbers, and for each fold the sums of squares and products of all other folds, in bands. Masks are
    rows of a table. A task fits some masks of a fold from its sums: one factorisation, then an update or downdate for every column in
    which a mask differs from it. Weights meet the blocks of their fold in a join, and counts of right and wrong rows come back. The
    driver sees scores and the best mask.
    """

    def __init__(self, df: DataFrame, label: str, features: list[str], row_id: str, k: int = 3, seed: int = 0, metric: str = "macro_f1", ridge: float = 1e-3):
        if metric not in ("macro_f1", "accuracy"):
            raise ValueError("metric must be macro_f1 or accuracy")
        self.features, self.k, self.metric, self.ridge = features, k, metric, ridge
        self.spark = df.sparkSession
        folded = kfold(df, label, row_id, k, seed).select(
            "fold", F.col(label).cast("int").alias("y"),
            F.expr("array(" + ", ".join(f"coalesce({number(c)}, CAST(0 AS DOUBLE))" for c in features) + ") AS x"))
        self.blocks = write_scratch(folded.mapInPandas(_blocks(len(features)), "fold int, n int, y binary, x binary"))
        self.sums = write_scratch(_sums(self.blocks, k, len(features)))
        self.cache: dict[tuple, float] = {}

    def close(self) -> None:
        """The written blocks and sums are no longer needed."""
        for table in (self.blocks, self.sums):
            for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
                remove_folder(self.spark, folder)

    def score_many(self, masks: list[tuple[int, ...]]) -> list[float]:
        """Scores of a caller's few masks."""
        new = [m for m in dict.fromkeys(masks) if m not in self.cache]
        if new:
            table = self.spark.createDataFrame([(i, list(m)) for i, m in enumerate(new)], "mask long, bits array<int>")
            for r in self.scores(table).select("mask", "score").collect():
                self.cache[new[r["mask"]]] = r["score"]
        return [self.cache[m] for m in masks]

    def changes(self, mask: list[int]) -> DataFrame:
        """``(mask, bits)``: every mask that differs from the given one in one feature, named by the feature's place; none is empty."""
        now = F.array(*[F.lit(int(v)) for v in mask])
        flipped = self.spark.range(len(mask)).select(F.col("id").alias("mask"), F.transform(now, lambda v, i: F.when(i == F.col("id"), 1 - v).otherwise(v)).alias("bits"))
        return flipped.where(F.exists("bits", lambda v: v == 1))

    def best_change(self, mask: list[int], before: float) -> tuple[list[tuple[int, ...]], list[float]]:
        """The best of all one-feature changes and, if several help, all of these at once; with their scores."""
        scored = write_scratch(self.scores(self.changes(mask)))
        top = scored.orderBy(F.desc("score"), "mask").select("mask", "score").first()
        if top is None:
            return [], []
        flip = lambda places: tuple(1 - v if i in places else v for i, v in enumerate(mask))
        masks, got = [flip({top["mask"]})], [top["score"]]
        helpful = set(scored.where(F.col("score") > before).agg(F.collect_list("mask")).first()[0])
        if len(helpful) > 1 and any(flip(helpful)):
            masks, got = [*masks, flip(helpful)], [*got, *self.score_many([flip(helpful)])]
        return masks, got

    def scores(self, masks: DataFrame) -> DataFrame:
        """``(mask, score)`` of masks (mask, bits): the mean over folds of the metric on rows the fold's weights have not seen."""
        width = len(self.features)
        folds = F.explode(F.sequence(F.lit(0), F.lit(self.k - 1)))
        chunk = F.pmod(F.xxhash64("mask"), F.lit(self.spark.sparkContext.defaultParallelism)).cast("int")
        chunks = masks.select(folds.alias("fold"), chunk.alias("chunk"), "mask", "bits").groupBy("fold", "chunk").agg(
            F.sort_array(F.collect_list(F.struct("mask", "bits"))).alias("masks"))
        whole = self.sums.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("band", "v"))).alias("bands"))
        weights = write_scratch(chunks.join(whole, "fold").mapInPandas(_fitted(width, self.ridge), "fold int, masks array<long>, w binary"))
        counts = self.blocks.join(weights, "fold").mapInPandas(_counted(width), "mask long, fold int, t int, p int, n long")
        cells = counts.groupBy("mask", "fold").agg(*[
            F.coalesce(F.sum(F.when((F.col("t") == t) & (F.col("p") == p), F.col("n"))), F.lit(0)).alias(f"c{t}{p}") for t in (0, 1) for p in (0, 1)])
        return cells.withColumn("value", self._metric()).groupBy("mask").agg((F.sum("value") / self.k).alias("score"))

    def _metric(self) -> Column:
        c = lambda t, p: F.col(f"c{t}{p}").cast("double")
        if self.metric == "accuracy":
            return (c(0, 0) + c(1, 1)) / (c(0, 0) + c(0, 1) + c(1, 0) + c(1, 1))
        sizes = [2 * c(t, t) + c(t, 1 - t) + c(1 - t, t) for t in (0, 1)]
        parts = [F.when(s > 0, 2 * c(t, t) / s).otherwise(0.0) for t, s in enumerate(sizes)]
        return (parts[0] + parts[1]) / sum(((s > 0).cast("int") for s in sizes), F.lit(0))


def _blocks(width: int):
    """Rows of each fold as matrices of bounded size."""
    most = max(1, BLOCK_BYTES // (8 * max(width, 1)))

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for fold, part in b.groupby("fold"):
                rows = held.setdefault(int(fold), [])
                rows.append((part["y"].to_numpy(dtype=float), np.stack(part["x"].to_numpy())))
                while sum(len(y) for y, _ in rows) >= most:
                    y, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
                    yield pd.DataFrame({"fold": [int(fold)], "n": [most], "y": [y[:most].tobytes()], "x": [x[:most].tobytes()]})
                    rows[:] = [(y[most:], x[most:])]
        for fold, rows in held.items():
            y = np.concatenate([r[0] for r in rows])
            if len(y):
                yield pd.DataFrame({"fold": [fold], "n": [len(y)], "y": [y.tobytes()], "x": [np.concatenate([r[1] for r in rows]).tobytes()]})

    return run


def _sums(blocks: DataFrame, k: int, width: int) -> DataFrame:
    """``(fold, band, v)``: bands of Z'Z with Z = [1, y, x] over the rows of all other folds, added up in the tasks first."""
    size = width + 2

    def partial(batches):
        total = np.zeros((k, size, size))
        for b in batches:
            for fold, n, y, x in zip(b["fold"], b["n"], b["y"], b["x"], strict=True):
                z = np.column_stack([np.ones(n), np.frombuffer(y), np.frombuffer(x).reshape(n, width)])
                total[fold] += z.T @ z
        for f in range(k):
            others = total.sum(axis=0) - total[f]
            for band in range(0, size, BAND):
                yield pd.DataFrame({"fold": [f], "band": [band], "v": [others[band:band + BAND].tobytes()]})

    def merged(batches):
        at, total = None, None
        for b in batches:
            for fold, band, v in zip(b["fold"], b["band"], b["v"], strict=True):
                if (fold, band) != at:
                    if at is not None:
                        yield pd.DataFrame({"fold": [at[0]], "band": [at[1]], "v": [total.tobytes()]})
                    at, total = (fold, band), np.zeros(len(v) // 8)
                total = total + np.frombuffer(v)
        if at is not None:
            yield pd.DataFrame({"fold": [at[0]], "band": [at[1]], "v": [total.tobytes()]})

    kind = "fold int, band int, v binary"
    # partial sums of a band follow each other, and one of them is held at a time
    return blocks.mapInPandas(partial, kind).repartition("fold", "band").sortWithinPartitions("fold", "band").mapInPandas(merged, kind)


def solve_masks(sums: np.ndarray, masks: np.ndarray, ridge: float) -> np.ndarray:
    """Weights (intercept first) of the ridge regression of y = +-1 on each mask's columns, from Z'Z.

    The first mask is factorised; its inverse and weights are changed column by column for the others.
    """
    out = np.zeros((len(masks), sums.shape[0] - 1))
    if sums[0, 0] == 0 or not len(masks):
        return out
    a = np.delete(np.delete(sums, 1, axis=0), 1, axis=1)
    b = np.delete(2 * sums[1] - sums[0], 1)
    scale = np.diag(a)[1:]
    a[np.arange(1, len(a)), np.arange(1, len(a))] += ridge * np.where(scale > 0, scale, 1.0)
    first = np.append(True, masks[0].astype(bool))
    base = np.flatnonzero(first)
    inverse = np.linalg.inv(np.linalg.cholesky(a[np.ix_(base, base)]))
    inverse = inverse.T @ inverse
    start = inverse @ b[base]
    for m, mask in enumerate(masks):
        wanted = np.append(True, mask.astype(bool))
        inside, g, w = base, inverse, start
        gone, new = np.flatnonzero(first & ~wanted), np.flatnonzero(wanted & ~first)
        for j in gone:
            i = int(np.flatnonzero(inside == j)[0])
            keep = np.arange(len(inside)) != i
            w = (w - g[:, i] * (w[i] / g[i, i]))[keep]
            if len(gone) + len(new) > 1:
                g = (g - np.outer(g[:, i], g[i]) / g[i, i])[np.ix_(keep, keep)]
            inside = inside[keep]
        for j in new:
            cross = a[inside, j]
            u = g @ cross
            rest = a[j, j] - cross @ u
            last = (b[j] - cross @ w) / rest
            w = np.append(w - u * last, last)
            if len(gone) + len(new) > 1:
                g = np.block([[g + np.outer(u, u) / rest, -u[:, None] / rest], [-u[None] / rest, np.array([[1 / rest]])]])
            inside = np.append(inside, j)
        out[m, inside] = w
    return out


def _fitted(width: int, ridge: float):
    def run(batches):
        for b in batches:
            for fold, masks, bands in zip(b["fold"], b["masks"], b["bands"], strict=True):
                sums = np.frombuffer(b"".join(x["v"] for x in bands)).reshape(width + 2, width + 2).copy()
                bits = np.array([x["bits"] for x in masks])
                yield pd.DataFrame({"fold": [fold], "masks": [[int(x["mask"]) for x in masks]], "w": [solve_masks(sums, bits, ridge).tobytes()]})

    return run


def _counted(width: int):
    def run(batches):
        for b in batches:
            for fold, n, y, x, masks, w in zip(b["fold"], b["n"], b["y"], b["x"], b["masks"], b["w"], strict=True):
                z = np.column_stack([np.ones(n), np.frombuffer(x).reshape(n, width)])
                truth = np.frombuffer(y) > 0
                positive = z @ np.frombuffer(w).reshape(len(masks), width + 1).T >= 0
                for t in (0, 1):
                    rows = positive[truth == bool(t)]
                    hits = rows.sum(axis=0)
                    yield pd.DataFrame({"mask": np.tile(np.asarray(masks, np.int64), 2), "fold": fold, "t": t, "p": np.repeat([0, 1], len(masks)),
                                        "n": np.concatenate([len(rows) - hits, hits]).astype(np.int64)})

    return run


class CallableFitness:
    """Any ``fitness(df, features) -> float``; a mask that fails scores minus infinity, and ``errors`` says why."""

    def __init__(self, df: DataFrame, features: list[str], fitness: Callable[[DataFrame, list[str]], float]):
        self.df, self.features, self.fitness = df, features, fitness
        self.cache: dict[tuple, float] = {}
        self.errors: dict[tuple, str] = {}

    def score_many(self, masks: list[tuple[int, ...]]) -> list[float]:
        for m in dict.fromkeys(masks):
            if m not in self.cache:
                try:
                    self.cache[m] = float(self.fitness(self.df, [c for c, on in zip(self.features, m) if on]))
                except Exception as error:  # a candidate that cannot be scored loses
                    self.cache[m], self.errors[m] = float("-inf"), f"{type(error).__name__}: {error}"
        return [self.cache[m] for m in masks]


@dataclass
class MaskSearch:
    """Stepwise search over sets of features.

    Starts from the best of ``population`` seeded masks: the full set and random halves. Each round scores all masks that differ from
    the current one in one feature in one call, then the mask with all improving changes at once; the best of these is the next
    current mask. After a round without improvement no other can follow, and the rounds that are left repeat its score.
    """

    population: int = 20
    rounds: int = 30
    seed: int | None = 0
    mask: list[int] = field(default_factory=list)
    score: float = float("-inf")
    history: list[float] = field(default_factory=list)

    def fit(self, fitness) -> "MaskSearch":
        """``fitness`` offers ``features`` and ``score_many(masks)``; one with ``best_change`` looks for the best change itself."""
        width = len(fitness.features)
        if self.population < 1 or width < 1:
            raise ValueError("at least one feature and one candidate a round")
        rng = np.random.default_rng(self.seed)
        starts = [(1,) * width]
        for _ in range(self.population - 1):
            half = rng.permutation(width)[:max(1, width // 2)]
            starts.append(tuple(int(i in set(half.tolist())) for i in range(width)))
        self._keep_best(starts, fitness.score_many(starts))
        self.history = [self.score]
        for _ in range(self.rounds):
            before = self.score
            if hasattr(fitness, "best_change"):
                masks, got = fitness.best_change(self.mask, before)
            else:
                masks = [m for i in range(width) if any(m := self._flipped([i]))]
                got = fitness.score_many(masks) if masks else []
                helpful = [self._difference(m) for m, s in zip(masks, got) if s > before]
                joint = self._flipped(helpful)
                if len(helpful) > 1 and any(joint):
                    masks, got = [*masks, joint], [*got, *fitness.score_many([joint])]
            self._keep_best(masks, got)
            self.history.append(self.score)
            if self.score == before:
                self.history += [self.score] * (self.rounds + 1 - len(self.history))
                break
        return self

    def _flipped(self, places) -> tuple[int, ...]:
        chosen = {int(i) for i in places}
        return tuple(1 - v if i in chosen else v for i, v in enumerate(self.mask))

    def _difference(self, mask: tuple[int, ...]) -> int:
        return next(i for i, v in enumerate(mask) if v != self.mask[i])

    def _keep_best(self, masks: list[tuple[int, ...]], scores: list[float]) -> None:
        for m, s in zip(masks, scores):
            if not self.mask or s > self.score:
                self.mask, self.score = list(m), float(s)


def history(search: MaskSearch, spark: SparkSession) -> DataFrame:
    rows = [(i, float(s)) for i, s in enumerate(search.history)]
    return running_best(spark.createDataFrame(rows, "iteration int, score double"))


def select(df: DataFrame, label: str, features: list[str], row_id: str, k: int, search: MaskSearch, metric: str = "macro_f1", seed: int = 0) -> DataFrame:
    """Prefilter, search, and report every feature with rank, F and whether it is kept."""
    top = prefilter(df, label, features, k)
    ranked = [(r.feature, r.f) for r in top.collect()]
    fitness = MaskFitness(df, label, [f for f, _ in ranked], row_id, seed=seed, metric=metric)
    try:
        found = search.fit(fitness)
    finally:
        fitness.close()
    place = {f: (i + 1, s, bool(on)) for i, ((f, s), on) in enumerate(zip(ranked, found.mask))}
    rows = [(i, f, *(place.get(f) or (None, None, False))) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature_idx int, feature string, rank int, f double, kept boolean")


def permutation_importance(
    score: Callable[[DataFrame], DataFrame], df: DataFrame, label: str, features: list[str], row_id: str, repeats: int = 6, seed: int = 42,
    rows: int | None = 50_000,
) -> DataFrame:
    """Mean drop of AUC when a column is taken from another row, for columns of any type.

    ``score`` adds ``proba``. At most ``rows`` rows are looked at, in hash order (the reference size of such reports; None: all). The rows
    are put in one hash order and numbered, once; the donor of a row in a repeat is the row a seeded offset further on, so every column
    keeps its values, and a repeat is one equi-join on the number. Behind the join a row comes back once for each column, with that column
    replaced, in its own type; ``score`` is called once a repeat, and only counts of scores are shuffled on.
    """
    from tidewatch.operators.splitting import sample_n
    chosen = sample_n(df, row_id, rows, seed) if rows is not None else df
    kept = [F.col(row_id).alias("__id"), F.col(label).cast("int").alias("__y"), *[col(c) for c in df.columns]]
    placed = write_scratch(hash_rank(chosen.select(*kept, F.lit(0).alias("__all")), ["__all"], "__id", seed, "__place").drop("__all"))
    n = placed.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "feature string, importance double, std double, repeats int")
    names = {c: f"__new_{i}" for i, c in enumerate(features)}
    offsets = [1 + int(np.random.default_rng([seed, r]).integers(max(1, n - 1))) if n > 1 else 0 for r in range(repeats)]
    measured = score(placed.select(*[col(c) for c in df.columns], "__y")).select(F.lit(-1).alias("repeat"), F.lit("").alias("feature"), "proba", F.col("__y").alias("y"))
    for r, offset in enumerate(offsets):
        donor = placed.select((F.pmod(F.col("__place") - 1 + (n - offset), F.lit(n)) + 1).alias("__place"), *[col(c).alias(names[c]) for c in features])
        both = placed.join(donor, "__place").withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        at = {c: i for i, c in enumerate(features)}
        swapped = both.select("__y", "__j", *[
            F.when(F.col("__j") == at[d], col(names[d])).otherwise(col(d)).alias(d) if d in at else col(d) for d in df.columns])
        feature = F.get(F.array(*[F.lit(c) for c in features]), F.col("__j"))
        measured = measured.unionByName(score(swapped).select(F.lit(r).alias("repeat"), feature.alias("feature"), "proba", F.col("__y").alias("y")))
    aucs = write_scratch(S.roc_auc(measured, ["repeat", "feature"]))
    full = aucs.where("repeat = -1").select(F.col("roc_auc").alias("full")).withColumn("__all", F.lit(0))
    drops = aucs.where("repeat >= 0").withColumn("__all", F.lit(0)).join(full, "__all").select("feature", (F.col("full") - F.col("roc_auc")).alias("drop"))
    return drops.where("drop IS NOT NULL").groupBy("feature").agg(
        F.avg("drop").alias("importance"), F.stddev_pop("drop").alias("std"), F.count(F.lit(1)).cast("int").alias("repeats")).orderBy(F.desc("importance"), "feature")


def top_importance(table: DataFrame, k: int = 20) -> DataFrame:
    return table.orderBy(F.col("importance").desc(), "feature").limit(k)
