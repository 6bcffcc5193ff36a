"""What ``__spark_entry__`` adds for this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import corpus_pipeline

from tidewatch.llm.registry import QUERIES, SQL

for _name in (
    "language_id", "warc", "jaccard_join", "lm_scoring", "robust_outliers", "bpe", "lattice_dedup", "chat_format", "toxicity", "mixing",
    "divergence", "word_runs", "piece_rounds",
):
    importlib.import_module(f"tidewatch.llm.{_name}")


def queries() -> dict[str, Callable]:
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(SQL) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
