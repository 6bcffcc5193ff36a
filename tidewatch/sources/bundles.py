"""Bundles: a fitted model with its threshold, columns and origin, in any of the shapes models are kept in."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from tidewatch.operators.composite import load_any
from tidewatch.sources.documents import SPELLINGS

BUNDLE_SCHEMA = "name string, threshold double, columns array<string>, positive_index int, metrics map<string,double>, reason string, source string"


@dataclass
class Bundle:
    """``model`` must produce a ``probability`` vector or a ``proba`` column."""

    name: str
    model: object
    threshold: float = 0.5
    columns: list[str] = field(default_factory=list)
    positive_index: int = 1
    metrics: dict[str, float] = field(default_factory=dict)
    reason: str | None = None
    source: str | None = None


def save_bundle(spark: SparkSession, bundle: Bundle, path: str) -> None:
    bundle.model.write().overwrite().save(f"{path}/model")
    row = (bundle.name, float(bundle.threshold), bundle.columns, bundle.positive_index,
           {k: float(v) for k, v in bundle.metrics.items()}, bundle.reason, bundle.source)
    meta = spark.createDataFrame([row], BUNDLE_SCHEMA).withColumn("saved_at", F.current_timestamp())
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/bundle")


# ---- shapes ---------------------------------------------------------------------------

def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.text(path).isEmpty()
    except AnalysisException:
        return False


def _subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of models directly below ``path``, in order."""
    try:
        files = spark.read.text(f"{path}/*/metadata").select(F.col("_metadata.file_path").alias("p")).distinct().collect()
    except AnalysisException:
        return []
    return sorted({r.p.rsplit("/metadata/", 1)[0].rsplit("/", 1)[1] for r in files})


def tag_of(model) -> str:
    """The name in a model's own columns, from where it puts its probability."""
    for stage in reversed(getattr(model, "stages", [model])):
        if hasattr(stage, "getProbabilityCol"):
            return stage.getProbabilityCol().removeprefix("prob_")
    raise ValueError("the model has no probability column")


def _inputs(model) -> list[str]:
    """Columns that a pipeline puts together first."""
    return next((list(s.getInputCols()) for s in model.stages if hasattr(s, "getInputCols")), [])


def _whole(spark: SparkSession, path: str):
    """One saved model: a pipeline, a stack, a bag or a wrapper, as its metadata says."""
    return load_any(spark, f"{path}/model") if _exists(spark, f"{path}/model/metadata") else None


def _bare(spark: SparkSession, path: str):
    """A model without a bundle around it."""
    return load_any(spark, path) if _exists(spark, f"{path}/metadata") else None


def _base_and_meta(spark: SparkSession, path: str):
    """Base models in a folder each, and a meta model that reads one probability of each."""
    from tidewatch.operators.models import Member
    from tidewatch.operators.stacking import StackingModel
    names = _subfolders(spark, f"{path}/base")
    if not names or not _exists(spark, f"{path}/meta/metadata"):
        return None
    bases = {tag_of(m): m for m in (load_any(spark, f"{path}/base/{n}") for n in names)}
    meta = load_any(spark, f"{path}/meta")
    wanted = _inputs(meta) or list(bases)
    if set(wanted) != set(bases):
        raise ValueError(f"the meta model reads {wanted}, the base models are {sorted(bases)}")
    return StackingModel([Member(t, bases[t], _inputs(bases[t])) for t in wanted], meta)


#: Shapes that are looked for, in this order; each gives a model, or none if the folder has another shape.
SHAPES: dict[str, Callable] = {"bundle": _whole, "base and meta": _base_and_meta, "bare": _bare}


def load_model(spark: SparkSession, path: str):
    """The model of a folder in any known shape."""
    for shape in SHAPES.values():
        model = shape(spark, path)
        if model is not None:
            return model
    raise FileNotFoundError(f"no model in {path}")


def stored_document(spark: SparkSession, path: str) -> dict:
    """What is written beside the model; nothing if there is nothing."""
    try:
        row = spark.read.text(f"{path}/bundle").first()
    except AnalysisException:
        return {}
    return json.loads(row.value) if row else {}


def stored_threshold(document: dict) -> float:
    """Threshold of a stored document under its usual spellings, else 0.5."""
    return next((float(document[n]) for n in SPELLINGS["threshold"] if document.get(n) is not None), 0.5)


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """A bundle of any shape; places that its document selects (``selected_idx`` or ``keep_idx``) wrap the model."""
    from tidewatch.operators.stacking import SelectedModel
    d = stored_document(spark, path)
    model, columns = load_model(spark, path), list(d.get("columns") or [])
    places = next((d[n] for n in ("selected_idx", "keep_idx") if d.get(n) is not None), None)
    if places is not None and not isinstance(model, SelectedModel):
        model = SelectedModel(model, places, columns or None, None if columns else d.get("vector", "features"))
    return Bundle(d.get("name") or path.rstrip("/").rsplit("/", 1)[-1], model, stored_threshold(d), columns, int(d.get("positive_index", 1)),
                  dict(d.get("metrics") or {}), d.get("reason"), d.get("source"))


def promote(spark: SparkSession, source: str, target: str, metrics: dict[str, float], reason: str) -> Bundle:
    """Copy a bundle to its canonical place, with what it was chosen for."""
    chosen = replace(load_bundle(spark, source), metrics=metrics, reason=reason, source=source)
    save_bundle(spark, chosen, target)
    return chosen
