"""Searching parameters: random draws, shrinking trials, and candidate lists."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.evaluation import Evaluator
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.expressions import hash_uniform
from tidewatch.functions.grids import GRIDS
from tidewatch.operators import scores as S
from tidewatch.operators.models import Spec, cross_validate, cv_summary, fit, oof, run_threads, score
from tidewatch.operators.splitting import holdout
from tidewatch.session import write_scratch

# A space maps a parameter to ('log' | 'uniform' | 'int', low, high), ('choice', [values]), or ('next', iterator of values in order).
DRAWS_SCHEMA = "draw int, params map<string,string>, score double"


def draw(space: dict, rng: np.random.Generator) -> dict:
    out = {}
    for name, rule in space.items():
        kind = rule[0]
        if kind == "choice":
            out[name] = rule[1][int(rng.integers(len(rule[1])))]
        elif kind == "next":
            out[name] = next(rule[1])
        elif kind == "int":
            out[name] = int(rng.integers(rule[1], rule[2] + 1))
        elif kind == "log":
            out[name] = float(math.exp(rng.uniform(math.log(rule[1]), math.log(rule[2]))))
        elif kind == "uniform":
            out[name] = float(rng.uniform(rule[1], rule[2]))
        else:
            raise ValueError(f"unknown kind {kind}")
    return out


def draws(space: dict, n: int, seed: int = 0) -> list[dict]:
    rng = np.random.default_rng(seed)
    return [draw(space, rng) for _ in range(n)]


def _table(spark: SparkSession, rows: list[tuple[int, dict, float | None]]) -> DataFrame:
    return spark.createDataFrame([(i, {k: str(v) for k, v in p.items()}, s) for i, p, s in rows], DRAWS_SCHEMA)


def random_search(
    df: DataFrame, label: str, features: list[str], row_id: str, space: dict, n: int = 24, k: int = 3, metric: str = "roc_auc",
    family: str = "boosted", seed: int = 0,
) -> tuple[dict, DataFrame]:
    """Best parameters and the table of all draws with their mean fold metric.

    All draws share the folds; their scores are measured in one pass.
    """
    params = draws(space, n, seed)
    specs = {f"d{i}": Spec(family, p) for i, p in enumerate(params)}
    cv = cross_validate(df, label, features, row_id, specs, k, seed)
    scored = S.composite(cv_summary(cv).select("model_id", F.col("accuracy_mean").alias("accuracy"), F.col("f1_mean").alias("f1"), F.col("roc_auc_mean").alias("roc_auc")))
    found = {r.model_id: r[metric] for r in scored.collect()}
    rows = [(i, p, found.get(f"d{i}")) for i, p in enumerate(params)]
    best = max(rows, key=lambda r: (r[2] if r[2] is not None else float("-inf"), -r[0]))
    return best[1], _table(df.sparkSession, rows)


TRIALS = "trial int, rung int, n_rows long, params map<string,string>, score double, error string"


@dataclass
class Study:
    """Trials in rungs: many on few rows, the best of each rung again on more, the last rung on all rows.

    Rung ``r`` of ``rungs`` has the rows whose hash falls below ``keep ** (rungs - 1 - r)``, so each rung's rows are among those of the next. A
    trial goes up as soon as it is among the best ``keep`` of the trials that its rung has seen so far, without waiting for the rung to fill;
    no more than that share of a rung ever goes up. Jobs run ``parallel`` at a time, and what comes next is decided from all results
    before, so a study depends on its seed alone. A trial that cannot be scored keeps its error and does not go up.
    """

    space: dict
    n: int = 20
    keep: float = 0.5
    rungs: int = 3
    seed: int = 0
    parallel: int = 4
    log: list[tuple] = field(default_factory=list)

    def share(self, rung: int) -> float:
        return self.keep ** (self.rungs - 1 - rung)

    def next_jobs(self, waiting: list[int]) -> list[tuple[int, int]]:
        """``(trial, rung)`` of the next jobs: those that can go up, from the highest rung, then new trials."""
        jobs = []
        for rung in range(self.rungs - 2, -1, -1):
            done = sorted((r for r in self.log if r[1] == rung), key=lambda r: (-r[4] if r[4] is not None else math.inf, r[0]))
            up = {r[0] for r in self.log if r[1] == rung + 1}
            places = math.floor(len(done) * self.keep + 1e-9) - len(up)
            best = [r[0] for r in done[:math.floor(len(done) * self.keep + 1e-9)] if r[4] is not None and r[0] not in up]
            jobs += [(t, rung + 1) for t in best[:max(0, places)]]
        return (jobs + [(t, 0) for t in waiting])[:self.parallel]

    def run(self, df: DataFrame, row_id: str, objective: Callable[[dict, DataFrame], float]) -> tuple[dict, DataFrame]:
        """Best parameters, by the highest rung and the score there, and the table of all trials and rungs."""
        params = draws(self.space, self.n, self.seed)
        place = hash_uniform(row_id, self.seed)
        rows = [write_scratch(df.where(place < F.lit(self.share(r))) if r < self.rungs - 1 else df) for r in range(self.rungs)]
        sizes = [part.count() for part in rows]
        waiting = list(range(self.n))

        def one(job: tuple[int, int]) -> tuple:
            trial, rung = job
            try:
                value, error = float(objective(params[trial], rows[rung])), None
                if math.isnan(value):
                    value, error = None, "the score is not a number"
            except Exception as e:  # the failure is the trial's result
                value, error = None, f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"
            return trial, rung, sizes[rung], params[trial], value, error

        while jobs := self.next_jobs(waiting):
            waiting = [t for t in waiting if (t, 0) not in jobs]
            self.log += run_threads(jobs, one, self.parallel)
        scored = [r for r in self.log if r[4] is not None]
        best = max(scored, key=lambda r: (r[1], r[4], -r[0]))[3] if scored else {}
        table = [(t, r, n, {k: str(v) for k, v in p.items()}, s, e) for t, r, n, p, s, e in sorted(self.log, key=lambda r: r[:2])]
        return best, df.sparkSession.createDataFrame(table, TRIALS)


def holdout_objective(label: str, features: list[str], row_id: str, family: str = "boosted", metric: str = "accuracy", part: float = 0.15, seed: int = 42):
    """Objective: fit on one part of the rows, measure on the other."""
    def objective(params: dict, df: DataFrame) -> float:
        train, valid = holdout(df, label, row_id, part, seed)
        scored = score(fit(train, label, features, family, params), valid)
        rows = scored.select(F.lit("m").alias("model_id"), "proba", F.col(label).cast("int").alias("y"))
        return S.evaluate_catalogue(rows).first()[metric]
    return objective


def cv_objective(
    label: str, features: list[str], row_id: str, family: str = "boosted", metric: str = "composite", k: int = 3, seed: int = 42, weight: str | None = "balanced",
    valid_part: float | None = None,
):
    """Objective: mean over folds of AUC, accuracy, F1, or half the sum of AUC and accuracy; row weights and stopping inside each fold."""
    def objective(params: dict, df: DataFrame) -> float:
        spec = Spec(family, params, weight=weight, valid_part=valid_part)
        cv = cross_validate(df, label, features, row_id, {"trial": spec}, k, seed)
        return S.composite(cv.select("fold", "accuracy", "f1", "roc_auc")).agg(F.avg(metric)).first()[0]
    return objective


def candidate_search(
    df: DataFrame, label: str, features: list[str], row_id: str, candidates: dict[str, Spec], k: int = 5, valid_part: float = 0.2,
    seed: int = 42, grid: str = "tenth_to_nine_tenths",
) -> DataFrame:
    """Per candidate: threshold from out-of-fold scores, metrics on rows kept out."""
    train, valid = holdout(df, label, row_id, valid_part, seed)
    wide, _ = oof(train, label, features, row_id, candidates, k, seed)
    long = wide.unpivot([row_id, "y"], list(candidates), "model_id", "proba")
    thresholds = S.sweep(long, GRIDS[grid]).select("model_id", "threshold", F.col("accuracy").alias("oof_accuracy"))
    kept = None
    for name, s in candidates.items():
        model = fit(train, label, s.features or features, s.family, s.params, tag=name)
        part = score(model, valid, name).select(F.lit(name).alias("model_id"), "proba", F.col(label).cast("int").alias("y"))
        kept = part if kept is None else kept.unionByName(part)
    at = kept.join(thresholds, "model_id").withColumn("pred", (F.col("proba") >= F.col("threshold")).cast("int"))
    flat = S.basic_metrics(at).select("model_id", F.col("accuracy").alias("valid_accuracy"), F.col("f1").alias("valid_f1"))
    auc = S.roc_auc(kept).select("model_id", F.col("roc_auc").alias("valid_auc"))
    return thresholds.join(flat, "model_id").join(auc, "model_id")


class CompositeEvaluator(Evaluator):
    """Half the sum of AUC and accuracy at a threshold, for use with Spark ML search."""

    def __init__(self, label: str = "label", proba: str = "proba", threshold: float = 0.5):
        super().__init__()
        self.label, self.proba, self.threshold = label, proba, threshold

    def _evaluate(self, dataset: DataFrame) -> float:
        from tidewatch.operators.scoring import positive_probability
        scored = dataset if self.proba in dataset.columns else positive_probability(dataset)
        rows = scored.select(F.lit("m").alias("model_id"), F.col(self.proba if self.proba in dataset.columns else "proba").alias("proba"), F.col(self.label).cast("int").alias("y"))
        return float(S.evaluate_catalogue(rows, self.threshold).first().composite)

    def isLargerBetter(self) -> bool:
        return True
