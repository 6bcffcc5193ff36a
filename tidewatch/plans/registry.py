"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
SECTIONS = (
    "evaluation", "labelling", "sampling", "profiling", "statistics", "columns",
    "preparation", "joins", "ensembles", "storage", "streams", "learning", "properties",
)


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def shared(fn):
    """Results of costly fits that several queries of a session look at: worked out once for each folder of tables."""
    known: dict[tuple, object] = {}

    @functools.wraps(fn)
    def run(spark, sf_dir):
        key = spark.sparkContext.applicationId, sf_dir
        if key not in known:
            known[key] = fn(spark, sf_dir)
        return known[key]
    return run


def collect() -> tuple[dict[str, Callable], dict[str, str]]:
    for section in SECTIONS:
        importlib.import_module(f"tidewatch.plans.{section}")
    return QUERIES, SQL
