"""Stacked models: base models, out-of-fold scores and a meta model."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.expressions import quoted
from tidewatch.functions.grids import GRIDS
from tidewatch.operators import scores as S
from tidewatch.operators.calibration import Calibrator, fit_isotonic
from tidewatch.operators.composite import Composite
from tidewatch.operators.models import Member, Spec, fit, fit_all, oof, score, score_members
from tidewatch.operators.splitting import holdout


def fit_meta(wide: DataFrame, columns: list[str], family: str = "logistic", label: str = "y", params: dict | None = None):
    """Meta model on one probability column per base model."""
    return fit(wide, label, columns, family, params, tag="meta")


class StackingModel(Composite):
    """Scores rows with every base model, then with the meta model, in one pass.

    Right after fitting, ``base_rows`` are the rows the base models were fitted on, and ``meta_rows`` their scores, with ``y``, that the
    meta model was fitted on; neither is saved.
    """

    def __init__(self, members: list[Member], meta, calibrator: Calibrator | None = None, base_rows: DataFrame | None = None, meta_rows: DataFrame | None = None):
        super().__init__()
        self.members, self.meta, self.calibrator = members, meta, calibrator
        self.base_rows, self.meta_rows = base_rows, meta_rows

    def parts(self) -> dict:
        return {**{f"base_{m.tag}": m.model for m in self.members}, "meta": self.meta, "calibrator": self.calibrator}

    def plain(self) -> dict:
        return {"members": [{"tag": m.tag, "features": m.features} for m in self.members]}

    @classmethod
    def rebuilt(cls, parts: dict, plain: dict) -> StackingModel:
        members = [Member(m["tag"], parts[f"base_{m['tag']}"], m["features"]) for m in plain["members"]]
        return cls(members, parts["meta"], parts["calibrator"])

    def combine(self, scored: DataFrame) -> DataFrame:
        """Final probability of rows that hold those of the base models."""
        out = score(self.meta, scored, "meta")
        return out if self.calibrator is None else self.calibrator.transform(out)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.combine(score_members(self.members, df)).selectExpr(*map(quoted, df.columns), "proba")


class BagModel(Composite):
    """Mean or median probability of models that score the same rows."""

    def __init__(self, members: list[Member], how: str = "mean"):
        super().__init__()
        self.members, self.how = members, how

    def parts(self) -> dict:
        return {m.tag: m.model for m in self.members}

    def plain(self) -> dict:
        return {"how": self.how, "members": [{"tag": m.tag, "features": m.features} for m in self.members]}

    @classmethod
    def rebuilt(cls, parts: dict, plain: dict) -> BagModel:
        return cls([Member(m["tag"], parts[m["tag"]], m["features"]) for m in plain["members"]], plain["how"])

    def _transform(self, df: DataFrame) -> DataFrame:
        from tidewatch.operators.ensembles import blend_wide
        scored = blend_wide(score_members(self.members, df), [m.tag for m in self.members], self.how)
        return scored.selectExpr(*map(quoted, df.columns), "proba")


class SelectedModel(Composite):
    """A model of some columns of an ordered table, chosen by place (``selected_idx``).

    The table's columns are either named in ``columns``, or the entries of one array column ``vector``; the inner model then
    gets an array of the chosen entries.
    """

    def __init__(self, model, selected_idx: list[int], columns: list[str] | None = None, vector: str | None = None):
        super().__init__()
        if (columns is None) == (vector is None):
            raise ValueError("either the columns' names or the name of an array column")
        self.model, self.selected_idx, self.columns, self.vector = model, [int(i) for i in selected_idx], columns, vector
        if any(i < 0 or (columns is not None and i >= len(columns)) for i in self.selected_idx):
            raise ValueError("a selected place lies outside the columns")

    def parts(self) -> dict:
        return {"model": self.model}

    def plain(self) -> dict:
        return {"selected_idx": self.selected_idx, "columns": self.columns, "vector": self.vector}

    def _transform(self, df: DataFrame) -> DataFrame:
        from tidewatch.operators.scoring import positive_probability
        names = list(map(quoted, df.columns))
        if self.vector is None:
            missing = [self.columns[i] for i in self.selected_idx if self.columns[i] not in df.columns]
            if missing:
                raise ValueError(f"columns {missing} are missing")
            return positive_probability(self.model.transform(df)).selectExpr(*names, "proba")
        short = F.size(self.vector) <= max(self.selected_idx, default=-1)
        chosen = F.when(short, F.raise_error(F.lit("a row has fewer entries than the model needs"))).otherwise(
            F.array(*[F.col(self.vector)[i] for i in self.selected_idx]))
        sliced = df.withColumn("__whole", F.col(self.vector)).withColumn(self.vector, chosen)
        scored = positive_probability(self.model.transform(sliced))
        return scored.drop(self.vector).withColumnRenamed("__whole", self.vector).selectExpr(*names, "proba")


class Stacking(Estimator):
    """Out-of-fold scores of the base models train the meta model.

    For new rows the base models are fitted again on all rows. With
    ``isotonic`` the meta probability is calibrated on the out-of-fold rows.
    """

    def __init__(self, specs: dict[str, Spec], features: list[str], label: str, row_id: str, meta: str = "logistic", k: int = 3,
                 seed: int = 42, meta_params: dict | None = None, isotonic: bool = False):
        super().__init__()
        self.specs, self.features, self.label, self.row_id = specs, features, label, row_id
        self.meta, self.k, self.seed, self.meta_params, self.isotonic = meta, k, seed, meta_params, isotonic

    def _fit(self, df: DataFrame) -> StackingModel:
        wide, _ = oof(df, self.label, self.features, self.row_id, self.specs, self.k, self.seed)
        wide = wide.persist()
        try:
            meta = fit_meta(wide, list(self.specs), self.meta, params=self.meta_params)
            calibrator = fit_isotonic(score(meta, wide, "meta")) if self.isotonic else None
        finally:
            wide.unpersist()
        return StackingModel(fit_all(df, self.label, self.features, self.specs, self.row_id), meta, calibrator, df, wide)


def fit_on_holdout(df: DataFrame, label: str, features: list[str], row_id: str, specs: dict[str, Spec], part: float = 0.2, seed: int = 42, meta: str = "logistic") -> StackingModel:
    """Base models on one part, the meta model on the other."""
    train, rest = holdout(df, label, row_id, part, seed)
    members = fit_all(train, label, features, specs, row_id)
    wide = score_members(members, rest).withColumn("y", F.col(label).cast("int"))
    return StackingModel(members, fit_meta(wide, list(specs), meta), None, train, wide)


def fold_scores(models: dict[int, list[Member]], df: DataFrame, row_id: str) -> DataFrame:
    """New rows scored by every fold model: mean per base model, without a shuffle."""
    from tidewatch.operators.ensembles import row_mean
    names = [m.tag for m in next(iter(models.values()))]
    out = df
    for i, members in models.items():
        for m in members:
            out = score(m.model, out, m.tag, f"{m.tag}__{i}")
    return out.select(row_id, *[row_mean([F.col(f"{n}__{i}") for i in models]).alias(n) for n in names])


def keep_if_better(a, b, valid: DataFrame, label: str, grid: str = "tenth_to_nine_tenths") -> tuple[str, DataFrame]:
    """Compare two scoring models on rows neither was fitted on; 'a' wins a tie."""
    both = None
    for name, model in (("a", a), ("b", b)):
        part = model.transform(valid).select(F.lit(name).alias("model_id"), "proba", F.col(label).cast("int").alias("y"))
        both = part if both is None else both.unionByName(part)
    table = S.sweep(both, GRIDS[grid])
    return S.arg_best(table.select("model_id", "accuracy"), "accuracy", "model_id").first().model_id, table
