"""Global order without a single task: prefix sums, ranks and cut keys.

There is one plan for tables of every size. What is joined back is written
first, so Spark knows its size and broadcasts or shuffles it by that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.expressions import hash_key
from tidewatch.session import write_scratch

#: Hex digits of a hash that name its cell: 65,536 cells a stratum.
HASH_DIGITS = 4


def running_totals(
    df: DataFrame, by: list[str], order: list[Column], sums: list[str], totals: bool = False, leads: list[str] = (), ranges: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>``: the inclusive prefix sum of ``c`` within ``by``.

    ``totals`` also adds ``all_<c>``, the whole sum, and ``leads`` adds
    ``next_<c>``, the value of the next row. ``order`` must be unique within
    ``by``. A scan in two levels: the rows are dealt over ranges that follow the
    table's own distribution (as many as the session's shuffle partitions, fewer
    where these are small, or ``ranges``) and written, so the ranges cannot shift
    between passes; then sums inside each range are put on top of the totals of
    the ranges before it.
    """
    along = [*[F.col(c) for c in by], *order]
    dealt = df.repartitionByRange(ranges, *along) if ranges else df.repartitionByRange(*along)
    ranged = write_scratch(dealt.withColumn("range_id", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "range_id").orderBy(*order)
    across = Window.partitionBy(*by).orderBy("range_id")
    before, whole = across.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select(
        "*", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in sums], *[F.lead(c).over(inside).alias(f"next_{c}") for c in leads])
    # one row for each group and range
    if leads:
        local = local.withColumn("__place", F.row_number().over(inside))
        heads = [F.max(F.when(F.col("__place") == 1, F.struct(*leads))).alias("head")]
    else:
        heads = []
    bases = local.groupBy(*by, "range_id").agg(*[F.sum(c).alias(f"sum_{c}") for c in sums], *heads)
    bases = bases.select(
        *by, "range_id", *[F.coalesce(F.sum(f"sum_{c}").over(before), F.lit(0)).alias(f"base_{c}") for c in sums],
        *[F.lead(f"head.{c}").over(across).alias(f"head_{c}") for c in leads],
        *([F.sum(f"sum_{c}").over(whole).alias(f"all_{c}") for c in sums] if totals else []),
    )
    return join_null_safe(local, bases, [*by, "range_id"]).select(
        *df.columns, *[(F.col(f"cum_{c}") + F.col(f"base_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.coalesce(f"next_{c}", f"head_{c}").alias(f"next_{c}") for c in leads],
        *([F.col(f"all_{c}") for c in sums] if totals else []),
    )


def ordered_index(df: DataFrame, order: list[Column], name: str, start: int = 0, **kw) -> DataFrame:
    """Add a gapless 0-based position in a unique global order."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    ranked = running_totals(one.withColumn("__all", F.lit(0)), ["__all"], order, ["__one"], **kw)
    return ranked.withColumn(name, F.col("cum___one") - 1 + start).drop("__one", "cum___one", "__all")


def cut_keys(
    df: DataFrame,
    strata: list[str],
    row_id: str,
    seed: int,
    targets: Callable[[Column], Column] | DataFrame,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Find the order key at given ranks of every stratum without ranking its rows.

    ``targets`` gives 1-based ranks: a function from the stratum size to an
    array of ranks, or a table ``(strata..., ranks)``. The result has one row
    per (stratum, part): ``total``, ``part`` (position in the array) and the key
    ``cut_hash``, ``cut_id`` of the row holding that rank.

    Rows are only counted per hash cell; the few cells holding a target are
    sorted. No class is ever gathered in one task.
    """
    keyed = df.select(
        *strata, F.col(row_id).alias("cut_id"), hash_key(row_id, seed).alias("cut_hash")
    ).withColumn("cell", F.substring("cut_hash", 1, digits))
    cells = keyed.groupBy(*strata, "cell").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(*strata).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*strata)
    placed = cells.select(
        *strata, "cell", "n", F.sum("n").over(along).alias("upto"), F.sum("n").over(whole).alias("total")
    )
    if isinstance(targets, DataFrame):
        placed = join_null_safe(placed, targets.select(*strata, "ranks"), strata)
    else:
        placed = placed.withColumn("ranks", targets(F.col("total")))
    hit = (
        placed.select("*", F.posexplode("ranks").alias("part", "rank"))
        .where((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
        .select(*strata, "cell", "total", "part", (F.col("rank") - F.col("upto") + F.col("n")).alias("residual"))
    )
    hit = write_scratch(hit)
    wanted = hit.select(*strata, "cell").distinct()
    inside = Window.partitionBy(*strata, "cell").orderBy("cut_hash", "cut_id")
    candidates = join_null_safe(keyed, wanted, [*strata, "cell"], "left_semi").withColumn(
        "residual", F.row_number().over(inside).cast("long")
    )
    keys = [*strata, "cell", "residual"]
    return join_null_safe(candidates, hit, keys).select(*strata, "total", "part", "cut_hash", "cut_id")


def hash_rank(df: DataFrame, strata: list[str], row_id: str, seed: int, name: str = "rank", digits: int = HASH_DIGITS) -> DataFrame:
    """Exact 1-based rank of every row in its stratum, in hash order.

    Ranks are counted inside hash cells and shifted by the size of the cells
    before, so a stratum is spread over up to ``16 ** digits`` tasks.
    """
    keyed = df.withColumn("__hash", hash_key(row_id, seed)).withColumn("__cell", F.substring("__hash", 1, digits))
    cells = keyed.groupBy(*strata, "__cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*strata).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*strata, "__cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*strata, "__cell").orderBy("__hash", row_id)
    local = keyed.withColumn("__inner", F.row_number().over(inside).cast("long"))
    out = join_null_safe(local, offsets, [*strata, "__cell"])
    return out.select(*df.columns, (F.col("__inner") + F.col("__offset")).alias(name))


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join where null keys match; the keys of the left side are kept."""
    a, b = left.alias("a"), right.alias("b")
    condition = F.lit(True)
    for i, k in enumerate(keys):
        part = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        condition = part if i == 0 else condition & part
    joined = a.join(b, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    extra = [F.col(f"b.{c}") for c in right.columns if c not in keys]
    return joined.select(*[F.col(f"a.{c}") for c in left.columns], *extra)
