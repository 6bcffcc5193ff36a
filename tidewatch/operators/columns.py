"""Column resolution, coercion and selection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.expressions import col, margin_to_probability, nan_to_null, number, quoted, to_double
from tidewatch.operators.labels import factorize_sorted

# Label names looked for, in order, and the spellings of 0 and 1.
LABEL_NAMES = ["label", "target", "class", "attack"]
LABEL_NAMES_WIDE = ["Label", "label", "target", "Target", "Class", "class", "is_attack", "attack", "y", "Y"]
BINARY_SPELLINGS = ["0", "1", "True", "False", "true", "false"]


@dataclass(frozen=True)
class Resolved:
    requested: str
    present: bool
    column: str | None
    ambiguous: bool = False


def resolve(df: DataFrame, name: str) -> Resolved:
    """Find a column: exact, then without outer blanks, then ignoring case too."""
    names = df.columns
    if name in names:
        return Resolved(name, True, name, names.count(name) > 1)
    bare = name.strip()
    if bare in names:
        return Resolved(name, True, bare, names.count(bare) > 1)
    hits = [c for c in names if c.strip().lower() == bare.lower()]
    if not hits:
        return Resolved(name, False, None)
    return Resolved(name, True, hits[0], len(hits) > 1)


def resolve_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Select the present columns under the requested, stripped names; a name that fits several columns is an error."""
    found = [resolve(df, n) for n in names]
    unclear = [r.requested for r in found if r.present and r.ambiguous]
    if unclear:
        raise ValueError(f"several columns fit {unclear}")
    return df.select(*[col(r.column).alias(r.requested.strip()) for r in found if r.present])


def clean_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Strip blanks from column names; returns the raw-to-clean map as well."""
    mapping = {c: c.strip() for c in df.columns}
    if len(set(mapping.values())) < len(mapping):
        raise ValueError("column names are equal after stripping blanks")
    return df.toDF(*[c.strip() for c in df.columns]), mapping


def values_within(df: DataFrame, names: list[str], allowed: list[str]) -> DataFrame:
    """Per column: whether at least one value is set and all set values are allowed."""
    text = [col(c).cast("string") for c in names]
    flags = df.agg(*[
        (F.count(t) > 0) & F.coalesce(F.bool_and(t.isin(allowed)), F.lit(False)) for t in text
    ])
    flat = flags.toDF(*[f"c{i}" for i in range(len(names))])
    return flat.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("within")) for i, c in enumerate(names)
    ])))


def find_label(df: DataFrame, names: list[str] = LABEL_NAMES, fallback: str = "last") -> str:
    """Name of the label column: a known name, else the last or the first 0/1 column."""
    for n in names:
        if n in df.columns:
            return n
    if fallback == "last":
        return df.columns[-1]
    within = {r.feature for r in values_within(df, df.columns, BINARY_SPELLINGS).collect() if r.within}
    for c in df.columns:
        if c in within:
            return c
    raise ValueError("no label column found")


def split_label(df: DataFrame, label: str, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Features and label; ``keep`` (the row key) stays on both sides."""
    return df.drop(label), df.select(*keep, label)


def to_numeric(df: DataFrame, except_: list[str] = ()) -> DataFrame:
    return df.selectExpr(*[quoted(c) if c in except_ else f"{number(c)} AS {quoted(c)}" for c in df.columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def numeric_share(df: DataFrame, names: list[str]) -> dict[str, float]:
    row = df.agg(*[F.expr(f"avg(double({number(c)} IS NOT NULL))") for c in names]).first()
    return {c: (row[i] or 0.0) for i, c in enumerate(names)}


def to_numeric_adaptive(df: DataFrame, names: list[str], min_ratio: float = 0.5) -> DataFrame:
    """Numbers where at least ``min_ratio`` of the column is numeric, sorted codes elsewhere.

    What is still missing becomes the exact median of the column, 0 if it has none.
    """
    from tidewatch.operators.preparation import medians
    share = numeric_share(df, names)
    out = df
    for c in names:
        if share[c] >= min_ratio:
            out = out.withColumn(c, to_double(c))
        else:
            text = F.coalesce(col(c).cast("string"), F.lit("nan"))
            out = factorize_sorted(out.withColumn(c, text), c, "__code").withColumn(c, F.col("__code").cast("double")).drop("__code")
    gaps = [c for c in names if share[c] >= min_ratio]
    middle = medians(out, gaps) if gaps else {}
    return out.withColumns({c: F.coalesce(col(c), F.lit(middle.get(c) or 0.0)) for c in gaps}).select(*df.columns)


def as_category(df: DataFrame, names: list[str], null: str = "nan") -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c).cast("string"), F.lit(null)) for c in names if c in df.columns})


def fill(df: DataFrame, names: list[str], value) -> DataFrame:
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns({c: F.coalesce(nan_to_null(c) if c in floating else col(c), F.lit(value)) for c in names})


def distinct_counts(df: DataFrame, names: list[str], count_null: bool = True) -> dict[str, int]:
    """Exact distinct counts, all columns over one shuffle of (column, value)."""
    from tidewatch.operators.profiling import value_counts
    n = F.count(F.lit(1)) if count_null else F.count("value")
    rows = value_counts(df, names).groupBy("feature").agg(n.alias("n")).collect()
    return {r.feature: r.n for r in rows}


def detect_categorical(
    df: DataFrame, max_unique: int = 100, known: list[str] = (), count_null: bool = True
) -> list[str]:
    """Known names, text columns, and columns with at most ``max_unique`` values.

    A sketch settles columns far from the limit; only those within its error
    are counted exactly.
    """
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    rest = [c for c in df.columns if c not in text and c not in known]
    few: set[str] = set()
    if rest:
        row = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"c{i}") for i, c in enumerate(rest)]).first()
        near = [c for i, c in enumerate(rest) if row[i] <= 1.3 * max_unique + 2]
        if near:
            few = {c for c, n in distinct_counts(df, near, count_null).items() if n <= max_unique}
    return [c for c in df.columns if c in known or c in text or c in few]


def select_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, *[col(c) for c in features])


def slice_array(df: DataFrame, array: str, index: list[int], out: str | None = None) -> DataFrame:
    """Keep the given positions of an array column, in the given order."""
    wanted = F.array(*[F.lit(int(i)) for i in index])
    return df.withColumn(out or array, F.transform(wanted, lambda i: F.col(array)[i]))


def non_null(df: DataFrame, name: str) -> DataFrame:
    return df.where(col(name).isNotNull())


def require_width(df: DataFrame, n: int, array: str | None = None) -> DataFrame:
    """Fail on a feature count other than ``n``: at once for columns, per row for arrays."""
    if array is None:
        if len(df.columns) != n:
            raise ValueError(f"expected {n} columns, found {len(df.columns)}")
        return df
    message = F.concat(F.lit(f"expected {n} features, found "), F.size(array).cast("string"))
    checked = F.when(F.size(array) == n, F.col(array)).otherwise(F.raise_error(message).cast(df.schema[array].dataType))
    return df.withColumn(array, checked)


def positive_index(classes: list, n_columns: int | None = None) -> int:
    """Position of class 1 in the class order, else the second column if there is one."""
    for i, c in enumerate(classes or []):
        try:
            if int(float(c)) == 1:
                return i
        except (TypeError, ValueError):
            continue
    width = n_columns if n_columns is not None else len(classes or [])
    return 1 if width > 1 else 0


def positive_proba(probability: str | Column, classes: list, n_columns: int | None = None) -> Column:
    """Class-1 entry of a probability array."""
    return col(probability)[positive_index(classes, n_columns)]


def margin_to_proba(df: DataFrame, margin: str, out: str = "proba") -> DataFrame:
    return df.withColumn(out, margin_to_probability(margin))


def match_ranked(features: DataFrame, columns: DataFrame) -> DataFrame:
    """Left join of ranked names to column names; misses stay with ``present`` false.

    The closest spelling wins: exact, then stripped, then ignoring case.
    """
    key = lambda c: F.lower(F.trim(c))
    wanted = features.withColumn("__key", key(F.col("feature")))
    have = columns.select(F.col("column"), key(F.col("column")).alias("__key"))
    closeness = F.when(F.col("column") == F.col("feature"), 0).when(F.col("column") == F.trim("feature"), 1).otherwise(2)
    joined = wanted.join(have, "__key", "left").withColumn("__c", closeness)
    return joined.groupBy(*features.columns).agg(
        F.min(F.when(F.col("column").isNotNull(), F.struct("__c", "column")))["column"].alias("column")
    ).withColumn("present", F.col("column").isNotNull())
