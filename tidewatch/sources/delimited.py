"""Delimited text: fixed schemas, headers, prediction files, heads and streams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewatch.functions.expressions import col

# The fields of a connection log line, in file order.
FLOW_TEXT = ["protocol_type", "service", "flag", "label"]
FLOW_FIELDS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent", "hot",
    "num_failed_logins", "logged_in", "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count", "srv_count",
    "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty",
]
# Spellings of the columns of prediction files.
ID_NAMES, PROBA_NAMES = ["row_id", "index"], ["proba", "prob_positive", "prob"]
PRED_NAMES, TRUE_NAMES = ["pred", "pred_label"], ["true", "y"]


def flow_schema() -> T.StructType:
    """43 fields: the last one is the difficulty score, so the label keeps its place."""
    return T.StructType([
        T.StructField(n, T.StringType() if n in FLOW_TEXT else T.DoubleType()) for n in FLOW_FIELDS
    ])


def read_fixed_csv(spark: SparkSession, path: str, schema: T.StructType, null: str = "", mode: str = "PERMISSIVE") -> DataFrame:
    """Headerless text with names by position; blanks after the comma are ignored."""
    return spark.read.schema(schema).csv(path, header=False, nullValue=null, ignoreLeadingWhiteSpace=True, mode=mode)


def field_counts(spark: SparkSession, path: str, separator: str = ",", quote: str = '"') -> DataFrame:
    """Records per number of fields: a wrong schema shows here before it shifts columns.

    Separators and line ends inside quotes do not count, and a record may go over many lines and splits of a file. Every split is read
    once, in time linear in its text, for both cases: that it begins outside quotes or inside. What it counts in either case, and in which
    it ends, is one row; these rows are put together along each file. A quote that is never closed makes the rest of its file one record.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = lines.mapInPandas(_split_counts(separator, quote), SPLIT_ROW)
    return splits.groupBy("file").applyInPandas(_along_a_file, "n_fields int, lines long").groupBy("n_fields").agg(F.sum("lines").alias("lines"))


SPLIT_ROW = "file string, block long, inside int, head long, fields array<long>, counts array<long>, tail long, open boolean, ends_inside int"


class _Case:
    """Records of one split if it begins outside quotes (0) or inside (1)."""

    def __init__(self, inside: int):
        self.inside, self.now, self.head, self.tail, self.open = inside, inside, None, 0, False
        self.found: Counter = Counter()

    def add(self, quotes: np.ndarray, even: np.ndarray, odd: np.ndarray) -> None:
        """Lines with their quotes, and their separators in even and odd pieces between quotes."""
        start = (self.now + np.cumsum(quotes) - quotes) % 2
        outside = np.where(start == 0, even, odd)
        ends = np.flatnonzero((start + quotes) % 2 == 0)
        self.now = int((start[-1] + quotes[-1]) % 2)
        if not len(ends):
            self.tail, self.open = self.tail + int(outside.sum()), True
            return
        sums = np.add.reduceat(outside[:ends[-1] + 1], np.append(0, ends[:-1] + 1))
        sums[0] += self.tail
        if self.head is None:
            self.head, sums = int(sums[0]), sums[1:]
        values, n = np.unique(sums, return_counts=True)
        self.found.update(dict(zip(values.tolist(), n.tolist(), strict=True)))
        self.tail, self.open = int(outside[ends[-1] + 1:].sum()), bool(ends[-1] + 1 < len(outside))

    def row(self, file: str, block: int) -> tuple:
        return file, block, self.inside, self.head, list(self.found), list(self.found.values()), self.tail, self.open, self.now


def _split_counts(separator: str, quote: str):
    def run(batches):
        at, cases = None, []
        names = [c.split(" ")[0] for c in SPLIT_ROW.split(", ")]
        for batch in batches:
            if not len(batch):
                continue
            text = batch["value"]
            quotes = text.str.count(re.escape(quote)).to_numpy(np.int64)
            even, odd = text.str.count(re.escape(separator)).to_numpy(np.int64).copy(), np.zeros(len(batch), np.int64)
            for i in np.flatnonzero(quotes):
                pieces = text.iloc[i].split(quote)
                even[i], odd[i] = sum(p.count(separator) for p in pieces[::2]), sum(p.count(separator) for p in pieces[1::2])
            new = np.flatnonzero(((batch["file"] != batch["file"].shift()) | (batch["block"] != batch["block"].shift())).to_numpy())
            for a, b in zip(new, np.append(new[1:], len(batch)), strict=True):
                key = batch["file"].iloc[a], int(batch["block"].iloc[a])
                if key != at:
                    if cases:
                        yield pd.DataFrame([c.row(*at) for c in cases], columns=names)
                    at, cases = key, [_Case(0), _Case(1)]
                for c in cases:
                    c.add(quotes[a:b], even[a:b], odd[a:b])
        if cases:
            yield pd.DataFrame([c.row(*at) for c in cases], columns=names)

    return run


def _along_a_file(splits: pd.DataFrame) -> pd.DataFrame:
    """One file's splits in order, each in the case in which the one before it ends."""
    total, inside, held, waits = Counter(), 0, 0, False
    by_case = {(r.block, r.inside): r for r in splits.itertuples()}
    for block in sorted(set(splits["block"])):
        r = by_case[block, inside]
        if r.head is not None and r.head == r.head:
            total[held + int(r.head) + 1] += 1
            for n, k in zip(r.fields, r.counts, strict=True):
                total[n + 1] += k
            held, waits = int(r.tail), bool(r.open)
        else:
            held, waits = held + int(r.tail), waits or bool(r.open)
        inside = r.ends_inside
    if waits:
        total[held + 1] += 1
    return pd.DataFrame({"n_fields": list(total), "lines": list(total.values())})


def check_field_count(spark: SparkSession, path: str, schema: T.StructType) -> None:
    low, high = field_counts(spark, path).agg(F.min("n_fields"), F.max("n_fields")).first()
    if low is not None and (low, high) != (len(schema), len(schema)):
        raise ValueError(f"schema has {len(schema)} fields, the file has lines with {low} to {high}")


def take_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[col(n) for n in names])


def read_header_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """With a header line; without a schema types are inferred, which costs a scan."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def stream_csv(spark: SparkSession, folder: str, schema: T.StructType, max_files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option(
        "ignoreLeadingWhiteSpace", True).csv(folder)


def head_sample(df: DataFrame, row_id: str, n: int) -> DataFrame:
    """The first ``n`` rows by key, keys of which are unique.

    One pass finds a key that lies safely beyond row ``n``: a quantile sketch is off by at most one row in ``accuracy``. Only the rows
    up to it, about ``n``, are put in order, over ranges.
    """
    from tidewatch.operators.ordering import ordered_index
    accuracy = 10_000
    rows = df.count()
    share = min(1.0, n / rows + 2.0 / accuracy) if rows else 1.0
    cut = df.agg(F.percentile_approx(row_id, share, accuracy)).first()[0]
    near = df.where(F.col(row_id) <= F.lit(cut)) if cut is not None else df.limit(0)
    return ordered_index(near, [F.col(row_id)], "__place").where(F.col("__place") < n).orderBy("__place").drop("__place")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Any known prediction file as ``(row_id, proba, pred, true)``; absent columns are null."""
    df = spark.read.option("header", True).csv(path)

    def find(names: list[str], kind: str):
        for n in names:
            if n in df.columns:
                return col(n).cast(kind)
        return F.lit(None).cast(kind)

    return df.select(
        find(ID_NAMES, "long").alias("row_id"), find(PROBA_NAMES, "double").alias("proba"),
        find(PRED_NAMES, "int").alias("pred"), find(TRUE_NAMES, "int").alias("true"))
