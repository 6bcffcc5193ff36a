"""Turning raw labels into 0/1 and category codes.

A rule is fitted once and applied to every split, so train and test cannot
disagree about which class is negative.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.expressions import col
from tidewatch.operators.ordering import ordered_index
from tidewatch.session import write_scratch

# The word of the negative class and the characters stripped around labels.
NEGATIVE_WORD = "normal"
STRIP_CHARACTERS = " '\"\n\r\t,"


@dataclass(frozen=True)
class LabelRule:
    """``kind`` is contains, integer, zero or value; ``negative`` is the class mapped to 0."""

    kind: str
    negative: object

    def column(self, name: str) -> Column:
        c = col(name)
        if self.kind == "contains":
            is_negative = F.lower(c.cast("string")).contains(str(self.negative))
        elif self.kind == "integer":
            is_negative = c.try_cast("bigint") == F.lit(self.negative)
        elif self.kind == "zero":
            is_negative = c.try_cast("double") == 0.0
        else:
            is_negative = c == F.lit(self.negative)
        return F.when(c.isNull(), F.lit(None)).when(is_negative, 0).otherwise(1).cast("int")

    def apply(self, df: DataFrame, name: str, out: str = "y") -> DataFrame:
        return df.withColumn(out, self.column(name))


def fit_label_rule(df: DataFrame, name: str, rule: str = "auto", negative=None, row_id: str | None = None) -> LabelRule:
    """Choose the rule on the whole column.

    auto: labels naming the negative word, else non-negative integers with the
    most frequent one negative (smallest on a tie), else numbers with zero
    negative, else the given ``negative`` value or the value of the first
    ``row_id``. Without either the last case is refused: row order is no key.
    """
    if rule == "contains":
        return LabelRule("contains", negative or NEGATIVE_WORD)
    if rule == "value":
        return LabelRule("value", negative)
    if rule == "zero":
        return LabelRule("zero", 0)
    c = col(name)
    facts = df.where(c.isNotNull()).agg(
        F.max(F.lower(c.cast("string")).contains(NEGATIVE_WORD)).alias("worded"),
        F.min(c.try_cast("bigint")).alias("low"),
        F.bool_and(c.try_cast("bigint").isNotNull()).alias("whole"),
        F.bool_and(c.try_cast("double").isNotNull()).alias("number"),
    ).first()
    if facts.worded and rule == "auto":
        return LabelRule("contains", NEGATIVE_WORD)
    if rule == "majority" or (facts.whole and facts.low is not None and facts.low >= 0):
        return LabelRule("integer", most_frequent(df, c.try_cast("bigint")))
    if facts.number:
        return LabelRule("zero", 0)
    if negative is None and row_id is not None:
        negative = df.agg(F.min_by(c, col(row_id))).first()[0]
    if negative is None:
        raise ValueError(f"text labels in {name}: name the negative value or a row key")
    return LabelRule("value", negative)


def most_frequent(df: DataFrame, c: Column):
    """Most frequent value, the smallest on a tie."""
    counts = df.select(c.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("b")).first()
    return None if best is None or best.b is None else best.b.v


def label_equals(df: DataFrame, name: str, value: str = NEGATIVE_WORD, out: str = "y") -> DataFrame:
    return df.withColumn(out, (F.lower(col(name)) != F.lit(value)).cast("int"))


def label_contains(df: DataFrame, name: str, word: str = NEGATIVE_WORD, strip: str = STRIP_CHARACTERS, out: str = "y") -> DataFrame:
    cleaned = F.btrim(F.lower(col(name).cast("string")), F.lit(strip))
    return df.withColumn(out, F.when(cleaned.isNotNull(), (~cleaned.contains(word)).cast("int")))


def label_by_type(df: DataFrame, name: str, out: str = "y") -> DataFrame:
    """Text: not the negative word; numbers: not zero."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return label_equals(df, name, out=out)
    return df.withColumn(out, (col(name) != 0).cast("int"))


def _with_codes(df: DataFrame, name: str, values: DataFrame, order: list[Column], out: str) -> DataFrame:
    codes = write_scratch(ordered_index(values, order, out).select(name, out))
    # Null is no value: it takes code -1. Spark broadcasts the codes if they are few, else it splits the tasks of frequent values.
    return df.join(codes, name, "left").select(*[col(c) for c in df.columns], F.coalesce(F.col(out), F.lit(-1)).cast("long").alias(out))


def factorize(df: DataFrame, name: str, row_id: str, out: str = "code") -> DataFrame:
    """Codes 0, 1, ... in order of first appearance; numbers pass unchanged."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return df.withColumn(out, F.col(name))
    first = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(row_id).alias("first"))
    return _with_codes(df, name, first, [F.col("first"), F.col(name)], out)


def factorize_sorted(df: DataFrame, name: str, out: str = "code") -> DataFrame:
    values = df.where(F.col(name).isNotNull()).select(name).distinct()
    return _with_codes(df, name, values, [F.col(name)], out)


def label_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), name)


def label_profile(df: DataFrame, name: str) -> DataFrame:
    """Rows, distinct labels and missing labels of one column."""
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"), F.count(name).alias("n_labels"),
        F.coalesce(F.sum(F.when(F.col(name).isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
    )
