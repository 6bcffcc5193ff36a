"""Encodings of categories that live in tables: any number of values, nothing of them on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.expressions import col, hash_key
from tidewatch.operators.composite import Composite
from tidewatch.operators.ordering import HASH_DIGITS, join_null_safe, ordered_index
from tidewatch.session import write_scratch


def _category(c: str) -> Column:
    return col(c).cast("string")


def _looked_up(df: DataFrame, table: DataFrame, columns: list[str], value: str, out: dict[str, str]) -> DataFrame:
    """The table's ``value`` for each column's category, null where there is none.

    One join a column: Spark broadcasts the table if it is small, else it splits the tasks of frequent categories.
    """
    for i, c in enumerate(columns):
        one = table.where(F.col("column") == i).select(F.col("category").alias("__category"), F.col(value).alias(out[c]))
        df = df.withColumn("__category", _category(c)).join(one, "__category", "left").drop("__category")
    return df


class CategoryIndexer(Composite):
    """Adds ``__idx_<column>``: the place of the category among its column's sorted ones; unseen and null come last.

    The dictionary is a table (column, category, code).
    """

    def __init__(self, columns: list[str], sizes: list[int], dictionary: DataFrame):
        super().__init__()
        self.columns, self.sizes, self.dictionary = columns, sizes, dictionary

    def plain(self) -> dict:
        return {"columns": self.columns, "sizes": self.sizes}

    def tables(self) -> dict[str, DataFrame]:
        return {"dictionary": self.dictionary}

    def _transform(self, df: DataFrame) -> DataFrame:
        index = {c: f"__idx_{c}" for c in self.columns}
        found = _looked_up(df, self.dictionary, self.columns, "code", index)
        return found.withColumns({index[c]: F.coalesce(col(index[c]), F.lit(n)).cast("double") for c, n in zip(self.columns, self.sizes, strict=True)})

    def sizes_row(self, df: DataFrame) -> DataFrame:
        """One row with the highest place of every column, from which encoders learn the sizes."""
        return df.sparkSession.range(1).select(*[F.lit(float(max(n - 1, 0))).alias(f"__idx_{c}") for c, n in zip(self.columns, self.sizes, strict=True)])


def fit_categories(df: DataFrame, columns: list[str]) -> CategoryIndexer:
    """Distinct categories of every column in their order; each value is counted inside the tasks first."""
    cells = F.array(*[F.struct(F.lit(i).alias("column"), _category(c).alias("category")) for i, c in enumerate(columns)])
    found = write_scratch(df.select(F.inline(cells)).where("category IS NOT NULL").distinct())
    counts = {r["column"]: r["count"] for r in found.groupBy("column").count().collect()}
    sizes = [counts.get(i, 0) for i in range(len(columns))]
    placed = ordered_index(found, [F.col("column"), F.col("category")], "place")
    before = reduce(lambda a, i: F.when(F.col("column") == i, sum(sizes[:i])).otherwise(a), range(len(columns)), F.lit(0))
    return CategoryIndexer(columns, sizes, write_scratch(placed.select("column", "category", (F.col("place") - before).alias("code"))))


class TargetStatistics(Composite):
    """Adds ``__m_<column>``: the smoothed mean label of the column's category; unseen ones and null get the mean of all rows."""

    def __init__(self, columns: list[str], prior: float, smoothing: float, statistics: DataFrame):
        super().__init__()
        self.columns, self.prior, self.smoothing, self.statistics = columns, prior, smoothing, statistics

    def plain(self) -> dict:
        return {"columns": self.columns, "prior": self.prior, "smoothing": self.smoothing}

    def tables(self) -> dict[str, DataFrame]:
        return {"statistics": self.statistics}

    def _transform(self, df: DataFrame) -> DataFrame:
        means = self.statistics.withColumn("mean", _smoothed(F.col("total"), F.col("n"), self.prior, self.smoothing))
        names = {c: f"__m_{c}" for c in self.columns}
        return _looked_up(df, means, self.columns, "mean", names).withColumns({m: F.coalesce(col(m), F.lit(self.prior)) for m in names.values()})


def _smoothed(total: Column, n: Column, prior: float, smoothing: float) -> Column:
    return (total + F.lit(prior * smoothing)) / (n + F.lit(float(smoothing)))


def ordered_means(df: DataFrame, label: str, columns: list[str], row_id: str, prior: float, smoothing: float, seed: int = 42) -> DataFrame:
    """The rows with ``__m_<column>`` from the rows before them in hash order alone, so that no row's label is in its own mean.

    Counts before a row come from two levels: whole cells of the hash before its own, and rows before it inside the cell. A category
    with a third of all rows is spread over as many tasks as there are cells.
    """
    out = df.withColumn("__h", hash_key(row_id, seed)).withColumn("__cell", F.substring("__h", 1, HASH_DIGITS))
    y = col(label).cast("double")
    for c in columns:
        keyed = out.withColumn("__c", _category(c))
        cells = keyed.groupBy("__c", "__cell").agg(F.count(F.lit(1)).alias("__n"), F.sum(y).alias("__s"))
        before = Window.partitionBy("__c").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        bases = cells.select("__c", "__cell", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in ("__n", "__s")])
        inside = Window.partitionBy("__c", "__cell").orderBy("__h", col(row_id)).rowsBetween(Window.unboundedPreceding, -1)
        local = keyed.withColumns({"__n": F.count(F.lit(1)).over(inside), "__s": F.coalesce(F.sum(y).over(inside), F.lit(0.0))})
        mean = _smoothed(F.col("__s") + F.col("__s0"), F.col("__n") + F.col("__n0"), prior, smoothing)
        out = join_null_safe(local, bases, ["__c", "__cell"]).withColumn(f"__m_{c}", mean).drop("__c", "__n", "__s", "__n0", "__s0")
    return out.drop("__h", "__cell")


def fit_target_statistics(df: DataFrame, label: str, columns: list[str], smoothing: float = 10.0) -> TargetStatistics:
    """Counts and sums of the label for every category of every column; exact, whatever the number of categories."""
    y = col(label).cast("double")
    cells = F.array(*[F.struct(F.lit(i).alias("column"), _category(c).alias("category")) for i, c in enumerate(columns)])
    table = df.select(F.inline(cells), y.alias("y")) if columns else df.sparkSession.createDataFrame([], "column int, category string, y double")
    table = write_scratch(table.where("category IS NOT NULL").groupBy("column", "category").agg(F.count("y").alias("n"), F.sum("y").alias("total")))
    return TargetStatistics(columns, float(df.agg(F.avg(y)).first()[0] or 0.0), smoothing, table)


def cells_of(indexer: CategoryIndexer, df: DataFrame, keep: list[str]) -> DataFrame:
    """The encoded matrix in long form: one row per set cell (feature, category)."""
    names = F.array(*[F.lit(c) for c in indexer.columns])
    cells = F.array(*[F.struct(F.lit(i).alias("column"), _category(c).alias("category")) for i, c in enumerate(indexer.columns)])
    long = df.select(*[col(c) for c in keep], F.inline(cells))
    return long.join(indexer.dictionary.select("column", "category"), ["column", "category"], "left_semi").select(
        *[col(c) for c in keep], F.get(names, F.col("column")).alias("feature"), "category")
