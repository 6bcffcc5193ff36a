"""Finding artefacts and models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.sources.bundles import load_model


def first_available(spark: SparkSession, paths: list[str], fallback=None) -> DataFrame:
    """The first readable table of several places; else ``fallback()``."""
    for p in paths:
        try:
            return spark.read.parquet(p)
        except AnalysisException:
            continue
    if fallback is None:
        raise FileNotFoundError(f"none of {paths} can be read")
    return fallback()


def model_paths(spark: SparkSession, folder: str) -> dict[str, str]:
    """Model directories below ``folder``, bare, in a bundle or as a stack's folders, found by their metadata."""
    roots = set()
    for inner in ("", "/model", "/meta"):
        try:
            found = spark.read.text(f"{folder.rstrip('/')}/*{inner}/metadata").select(F.col("_metadata.file_path").alias("p")).distinct().collect()
        except AnalysisException:
            continue
        roots |= {r.p.rsplit(f"{inner}/metadata/", 1)[0] for r in found}
    return {r.rsplit("/", 1)[1]: r for r in sorted(roots)}


def load_models(spark: SparkSession, paths: dict[str, str], load=load_model) -> tuple[dict, DataFrame]:
    """Loaded models of any shape and a catalogue ``(model_id, path, status, error)``; failures are rows."""
    models, rows = {}, []
    for name, path in paths.items():
        try:
            models[name] = load(spark, path)
            rows.append((name, path, "ok", None))
        except Exception as e:  # any unreadable model is a row of the catalogue
            rows.append((name, path, "failed", f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))
    schema = "model_id string, path string, status string, error string"
    return models, spark.createDataFrame(rows, schema)


def model_catalogue(spark: SparkSession, folder: str, listed: dict[str, str] | None = None) -> DataFrame:
    """Models found in the folder together with explicitly listed ones, each once."""
    return load_models(spark, {**model_paths(spark, folder), **(listed or {})})[1]
