"""Corpus pipeline: quality rules, language ID, near-duplicate groups, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; ``run`` writes each stage's rows to the shared
folder as Parquet and reads them again. All stages but the last return the columns of documents.

Defined results: null and empty texts fall to the quality rules (under 50 words); repeated rows are kept or dropped together,
but for the join, which keeps every row with a group's smallest id; an empty table goes through all stages; further columns
are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm import bpe, jaccard_join, language_id, mixing, robust_outliers
from tidewatch.llm.common import salted_join, shield, shielded, table, written
from tidewatch.session import scratch_path

#: What the stages read; columns besides are carried along and may have any name.
COLUMNS = ("doc_id", "text", "lang", "source")
#: Below this share of letters in one language a text counts as mixed beyond use.
LEAST_LANGUAGE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return shielded(docs, COLUMNS, lambda rows: robust_outliers.quality(rows, "_").where("_kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model is learned from the documents themselves, without the held-out quarter."""
    model = language_id.train(shield(docs, COLUMNS).where(~language_id.held_out()))
    wanted = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)
    return shielded(docs, COLUMNS, lambda rows: language_id.identify(rows, model).where(wanted))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Five words a shingle, similarity from 0.8."""
    groups = jaccard_join.join_components(shield(docs, COLUMNS).select("doc_id", "text"), width=5, percent=80)
    extra = written(groups.where("doc_id <> component_id").select("doc_id").distinct().withColumn("_extra", F.lit(True)))
    return shielded(docs, COLUMNS, lambda rows: salted_join(rows, extra, ["doc_id"], F.col("doc_id")).where("_extra IS NULL"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that meet the target weights, each once."""
    return shielded(docs, COLUMNS, lambda rows: mixing.mix_sources(rows, mixing.PIPELINE_MIX))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode_column(shield(docs, COLUMNS), bpe.tokenizer_path(), ["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture), ("BPE encoding and decoding", encoding),
]

#: Trigram models, robust estimates and BPE are beyond SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
