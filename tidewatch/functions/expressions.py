"""Column expressions shared by the operators; all stay inside codegen.

Expressions over many columns are given as SQL text: one call per column to the
JVM instead of one per function keeps planning time small on wide tables.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    """A column by its exact name: dots and blanks in names are taken literally."""
    return c if isinstance(c, Column) else F.col("`" + c.replace("`", "``") + "`")


def quoted(name: str) -> str:
    """A column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def real(value: float) -> str:
    """A double literal as SQL text."""
    name = {float("inf"): "Infinity", float("-inf"): "-Infinity"}.get(value, repr(float(value)))
    return f"CAST('{name}' AS DOUBLE)"


def number(name: str) -> str:
    """Column as SQL text for a number: text that is no number and NaN are null."""
    return f"nullif(try_cast({quoted(name)} AS DOUBLE), CAST('NaN' AS DOUBLE))"


def count_cuts(df: DataFrame, cuts: dict[str, list[float]], out: dict[str, str]) -> DataFrame:
    """Add, for each column, how many of its distinct ``cuts`` are at or below the value.

    A binary search inside the JVM: its generated code does not grow with the
    number of cuts. Columns must be numbers without NaN; null gives null.
    """
    names = [c for c in cuts if cuts[c]]
    if not names:
        return df
    splits = [[float("-inf"), *sorted(set(cuts[c])), float("inf")] for c in names]
    done = Bucketizer(splitsArray=splits, inputCols=names, outputCols=[out[c] for c in names], handleInvalid="keep").transform(df)
    return done.withColumns({out[c]: F.when(col(c).isNotNull(), col(out[c]).cast("int")) for c in names})


def hash_key(row_id: str | Column, seed: int) -> Column:
    """Order key of a row: md5 of ``seed|row_id``, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), col(row_id).cast("string")))


def hash_uniform(row_id: str | Column, seed: int) -> Column:
    """Uniform number in [0, 1) taken from the first 32 bits of the order key."""
    return F.conv(F.substring(hash_key(row_id, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is zero; plain division raises under ANSI."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def nan_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def to_double(c: str | Column) -> Column:
    """Number or null: text that is no number, NaN and blanks become null."""
    return F.expr(number(c)) if isinstance(c, str) else nan_to_null(c.try_cast("double"))


def margin_to_probability(margin: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-col(margin)))


def xlogx(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c > 0, c * F.log(c)).otherwise(F.lit(0.0))
