"""Quality rules by robust multivariate outliers, with Spark expressions only.

Every document gets base statistics and, if it passes the base rules, a vector of four transformed statistics. For every
language and source the minimum covariance determinant (the mean and covariance of the half of documents that lie closest
together) is searched by concentration steps from five starts: distances, the cut that holds half of a group, then mean and
covariance of the documents inside, until no start's determinant falls any more. The fit with the smallest determinant
counts; so a cluster of less than half of a group does not pass for its core. Documents far from their group's estimate by Mahalanobis
distance are rejected.

The starts are medians with quartile ranges, medians with the narrower half of those, lower and upper quartiles with the least spread,
and the mean and covariance of three quarters of the group after ``STEPS`` steps (``fit``).

Groups with fewer than ``LEAST`` documents take the estimate of their language, and languages with fewer that of all
documents; a covariance of so few points says nothing. Quartiles and cuts are read from histograms of fixed resolution, so no group is
sorted or gathered and results do not depend on the partitioning. Every variance has a floor, so constant statistics don't make
a matrix singular.

Defined results: null texts have no words and fail the base rules; null languages and sources are groups of their own; repeated
rows count and are judged one by one; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import SPACE, checkpointed, small_join, table
from tidewatch.llm.registry import query

SYMBOLS = "#*$%&|<>"
LEAST = 100
STEPS = 2
#: Documents that count for a concentration step, in hundredths: of the estimate, and of the start named ``fit``.
HALF, INSIDE = 50, 75
#: chi-square with 4 degrees of freedom: its 0.5 and 0.75 quantiles, and its 0.99999 quantile, the squared distance beyond which a
#: document is rejected.
CHI_HALF, CHI_INSIDE, CHI_REJECT = 3.357, 5.385, 28.473
#: Smallest standard deviation of each transformed statistic; most texts repeat nothing, so that of the repeats decides alone.
FLOORS = {"x_word": 0.05, "x_symbol": 0.05, "x_lines": 0.08, "x_repeat": 0.08}
VECTOR = list(FLOORS)
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
#: Cells per unit of a statistic, and per doubling of a squared distance.
STAT_CELLS, DISTANCE_CELLS = 1024, 32


def with_base(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed, under ``prefix``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [f"{prefix}{n}" for n in ("words", "windows", "starts")]
    words, windows, starts = names
    # the texts' words; hashes of three words with their place, sorted; places of those found again
    split = docs.withColumn(words, F.filter(F.split(text, SPACE), lambda w: w != ""))
    hashed = split.withColumn(windows, F.sort_array(F.transform(
        F.slice(F.col(words), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(F.col(words), i + 1), F.get(F.col(words), i + 2)).alias("h"), i.alias("i")))))
    again = hashed.withColumn(starts, F.sort_array(F.transform(F.filter(
        F.col(windows),
        lambda w, i: F.coalesce(F.get(F.col(windows), i - 1)["h"] == w["h"], F.lit(False))
        | F.coalesce(F.get(F.col(windows), i + 1)["h"] == w["h"], F.lit(False))), lambda w: w["i"])))
    # a window covers three words, or fewer up to the next one
    covered = F.aggregate(
        F.transform(starts, lambda s, i: F.least(F.lit(3), F.coalesce(F.get(F.col(starts), i + 1) - s, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\f\r", "")) > 0)
    n_lines, n_words = f"{prefix}n_lines", f"{prefix}n_words"
    stats = F.struct(
        F.size(words).cast("long").alias(n_words), F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias(f"{prefix}word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias(f"{prefix}n_symbols"),
        F.size(lines).cast("long").alias(n_lines), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(f"{prefix}n_dup_lines"),
        covered.alias(f"{prefix}n_repeat_words"))
    # a generator of one row: filters on the statistics stay above it, so none of them is worked out twice
    out = again.withColumn(f"{prefix}stats", F.explode(F.array(stats))).drop(*names).select("*", f"{prefix}stats.*").drop(f"{prefix}stats")
    repeat = F.col(f"{prefix}n_repeat_words")
    return out.withColumn(f"{prefix}base_failed", (F.col(n_words) < 50) | (100 * repeat > 50 * F.col(n_words)))


def with_vector(stats: DataFrame, prefix: str = "") -> DataFrame:
    """Adds the transformed statistics: log of word length, root of the share of symbols, shares of repeated lines and repeated words."""
    def c(name: str) -> Column:
        return F.col(f"{prefix}{name}").cast("double")

    one = F.lit(1.0)
    return stats.withColumns({
        f"{prefix}x_word": F.log(F.greatest(c("word_chars"), one) / F.greatest(c("n_words"), one)),
        f"{prefix}x_symbol": F.sqrt(c("n_symbols") / F.greatest(c("word_chars"), one)),
        f"{prefix}x_lines": c("n_dup_lines") / F.greatest(c("n_lines"), one),
        f"{prefix}x_repeat": c("n_repeat_words") / F.greatest(c("n_words"), one),
    })


def group_keys() -> Column:
    """The groups a document counts for, from the narrowest; missing values are left out of the text, so they have groups too."""
    return F.array(
        F.concat(F.lit("source "), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("lang "), F.to_json(F.struct("lang"))), F.lit("all"))


def _quantile_cells(cells: DataFrame, by: list[str], cell: str, wanted: dict[str, int]) -> DataFrame:
    """First cell that reaches each wanted share (in hundredths) of its group's counts."""
    order = Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    run = cells.withColumns({"_run": F.sum("count").over(order), "_all": F.sum("count").over(whole)})
    return run.groupBy(*by).agg(
        *[F.min(F.when(F.col("_run") * 100 >= F.col("_all") * q, F.col(cell))).alias(name) for name, q in wanted.items()],
        F.max("_all").alias("n"))


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance: forward substitution with the Cholesky factor in ``l``, columns of which are named by place."""
    z: list[Column] = []
    for i, name in enumerate(VECTOR):
        rest = F.col(f"{prefix}{name}") - F.col("_fit.m")[i]
        for j in range(i):
            rest = rest - F.col("_fit.l")[_PAIRS.index((i, j))] * z[j]
        z.append(rest / F.col("_fit.l")[_PAIRS.index((i, i))])
    return reduce(lambda a, b: a + b, [x * x for x in z])


def _cholesky(covariance: list[Column], least: list[float]) -> list[Column]:
    """Lower factor of a 4 x 4 matrix given by its lower triangle, as expressions; what a statistic varies by beyond those before it is
    at least ``least``, so no narrow direction between two of them passes for a small determinant."""
    low: dict[tuple[int, int], Column] = {}
    for i, j in _PAIRS:
        rest = covariance[_PAIRS.index((i, j))]
        for k in range(j):
            rest = rest - low[i, k] * low[j, k]
        low[i, j] = F.sqrt(F.greatest(rest, F.lit(least[i]))) if i == j else rest / low[j, j]
    return [low[p] for p in _PAIRS]


def _cell_of(distance: Column) -> Column:
    return F.round(F.log2(F.greatest(distance, F.lit(1e-6))) * DISTANCE_CELLS).cast("int")


def _vectors(passed: DataFrame) -> DataFrame:
    return checkpointed(passed.select(F.explode(group_keys()).alias("key"), F.xxhash64("doc_id").alias("_spread"), *VECTOR))


def _spans(rows: DataFrame) -> DataFrame:
    """``(key, n, s)``: quartiles of every statistic, in cells."""
    values = rows.select("key", F.posexplode(F.array(*VECTOR)).alias("axis", "x")).withColumn(
        "cell", F.round(F.col("x") * STAT_CELLS).cast("int"))
    spans = _quantile_cells(values.groupBy("key", "axis", "cell").count(), ["key", "axis"], "cell", {"low": 25, "mid": 50, "high": 75})
    return checkpointed(spans.groupBy("key").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("axis", "low", "mid", "high"))).alias("s")))


def _from_spans(spans: DataFrame, at: str, spread) -> DataFrame:
    """``(key, n, _fit)`` with the centre ``at`` and no correlation; ``spread`` gives a statistic's standard deviation in cells."""
    floors = F.array(*[F.lit(FLOORS[v]) for v in VECTOR])
    start = spans.withColumn("_sd", F.transform("s", lambda s: F.greatest(spread(s) / STAT_CELLS, F.element_at(floors, s["axis"] + 1))))
    low = F.array(*[F.col("_sd")[i] if i == j else F.lit(0.0) for i, j in _PAIRS])
    return start.select("key", "n", F.struct(F.transform("s", lambda s: s[at] / F.lit(float(STAT_CELLS))).alias("m"), low.alias("l")).alias("_fit"))


def _quartile_range(s: Column) -> Column:
    return (s["high"] - s["low"]) / 1.349


def _three_quarters(rows: DataFrame, spans: DataFrame) -> DataFrame:
    fitted = checkpointed(_from_spans(spans, "mid", _quartile_range))
    for _ in range(STEPS):
        fitted = checkpointed(_concentrate(rows, fitted))
    return fitted


def _scaled(rows: DataFrame, fitted: DataFrame, inside: int, chi: float) -> DataFrame:
    """``(key, n, fit: (m, l, scale))``: distances inside tell how much the covariance of the inner part must grow."""
    return checkpointed(fitted.join(_cut(rows, fitted, inside), "key").select("key", "n", F.struct(
        "_fit.m", "_fit.l", F.greatest(F.pow(F.lit(2.0), F.col("cut") / DISTANCE_CELLS) / chi, F.lit(1.0)).alias("scale")).alias("fit")))


def fit(passed: DataFrame) -> DataFrame:
    """``(key, n, fit: (m, l, scale))`` of three quarters of every group after ``STEPS`` steps; a start of ``estimate``."""
    rows = _vectors(passed)
    return _scaled(rows, _three_quarters(rows, _spans(rows)), INSIDE, CHI_INSIDE)


def estimate(passed: DataFrame) -> DataFrame:
    """``(key, n, fit: (m, l, scale))``: minimum covariance determinant of every group of the vectors in ``passed`` (documents that
    passed the base rules)."""
    rows = _vectors(passed)
    spans = _spans(rows)
    starts = [
        _three_quarters(rows, spans), _from_spans(spans, "mid", _quartile_range),
        _from_spans(spans, "mid", lambda s: F.least(s["high"] - s["mid"], s["mid"] - s["low"]) / 0.6745),
        _from_spans(spans, "low", lambda s: F.lit(0.0)), _from_spans(spans, "high", lambda s: F.lit(0.0))]
    named = [x.withColumn("key", F.concat(F.lit(f"{i} "), "key")) for i, x in enumerate(starts)]
    now = checkpointed(reduce(DataFrame.unionByName, named).withColumns({"det": F.lit(float("inf")), "falls": (F.col("n") >= LEAST) | F.col("key").endswith(" all")}))
    several = rows.withColumn("key", F.explode(F.array(*[F.concat(F.lit(f"{i} "), "key") for i in range(len(starts))])))
    # groups that are too small for ``judge`` keep a start; a step is accepted if the determinant falls by more than a millionth, and floors bound it from below
    while not now.where("falls").isEmpty():
        det = reduce(lambda x, y: x * y, [F.pow(F.col("_fit.l")[_PAIRS.index((i, i))], 2) for i in range(4)])
        step = _concentrate(several, now.where("falls").select("key", "n", "_fit"), HALF, sums=False).select(
            "key", F.col("_fit").alias("_next"), det.alias("_det"))
        better = F.coalesce(F.col("_det") < F.col("det") * (1 - 1e-6), F.lit(False))
        now = checkpointed(now.join(step, "key", "left").select(
            "key", "n", F.when(better, F.col("_next")).otherwise(F.col("_fit")).alias("_fit"),
            F.when(better, F.col("_det")).otherwise(F.col("det")).alias("det"), better.alias("falls")))
    best = now.groupBy(F.expr("substring(key, 3)").alias("key")).agg(F.min_by(F.struct("n", "_fit"), F.struct("det", "key")).alias("b"))
    return _scaled(rows, checkpointed(best.select("key", "b.n", "b._fit")), HALF, CHI_HALF)


def _cut(rows: DataFrame, fitted: DataFrame, inside: int) -> DataFrame:
    near = small_join(rows, fitted.select("key", "_fit"), ["key"], F.col("_spread"), "inner")
    cells = near.select("key", _cell_of(_distance()).alias("cell")).groupBy("key", "cell").count()
    return checkpointed(_quantile_cells(cells, ["key"], "cell", {"cut": inside}).select("key", "cut"))


def _concentrate(rows: DataFrame, fitted: DataFrame, inside: int = INSIDE, sums: bool = True) -> DataFrame:
    """One step: mean and covariance of the documents inside the cut of the last fit; variances get their floor added, or are raised to it."""
    near = small_join(rows, checkpointed(fitted.select("key", "n", "_fit")), ["key"], F.col("_spread"), "inner")
    # moments around the last centre, so that sums do not cancel; added up per cell of the distance, so one pass finds the cut and what is inside
    moved = near.select(
        "key", "n", "_fit", _cell_of(_distance()).alias("cell"), *[(F.col(v) - F.col("_fit.m")[i]).alias(f"d{i}") for i, v in enumerate(VECTOR)])
    cells = moved.groupBy("key", "cell").agg(
        F.count("*").alias("count"), F.first("n").alias("n"), F.first("_fit.m").alias("m"), *[F.sum(f"d{i}").alias(f"a{i}") for i in range(4)],
        *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"p{i}{j}") for i, j in _PAIRS])
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    chosen = cells.withColumns({"_run": F.coalesce(F.sum("count").over(before), F.lit(0)), "_all": F.sum("count").over(Window.partitionBy("key"))}).where(
        F.col("_run") * 100 < F.col("_all") * inside)
    found = chosen.groupBy("key").agg(
        F.first("n").alias("n"), F.first("m").alias("m"), *[(F.sum(f"a{i}") / F.sum("count")).alias(f"a{i}") for i in range(4)],
        *[(F.sum(f"p{i}{j}") / F.sum("count")).alias(f"p{i}{j}") for i, j in _PAIRS])
    for i, j in _PAIRS:
        value = F.col(f"p{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")
        if i == j:
            value = value + F.lit(FLOORS[VECTOR[i]] ** 2 if sums else 0.0)
        found = found.withColumn(f"c{i}{j}", value)
    low = _cholesky([F.col(f"c{i}{j}") for i, j in _PAIRS], [1e-12 if sums else FLOORS[v] ** 2 for v in VECTOR])
    return found.select("key", "n", F.struct(
        F.array(*[F.col("m")[i] + F.col(f"a{i}") for i in range(4)]).alias("m"), F.array(*low).alias("l")).alias("_fit"))


def judge(stats: DataFrame, fits: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ``{prefix}distance`` and ``{prefix}kept``; every document is held against the narrowest of its groups that is large enough."""
    # each narrow group gets the fit it uses, so documents are joined once
    levels = fits.withColumn("large", F.col("n") >= LEAST)
    wide = levels.where("key = 'all'").select(F.col("key").alias("all_key"), F.col("fit").alias("of_all"))
    lang = levels.where("key LIKE 'lang %' AND large").select(F.col("key").alias("lang_key"), F.col("fit").alias("of_lang"))
    own = levels.where("key LIKE 'source %'").withColumn("lang_key", F.concat(
        F.lit("lang "), F.to_json(F.struct(F.get_json_object(F.substring("key", 8, 100_000), "$.lang").alias("lang")))))
    used = checkpointed(own.withColumn("all_key", F.lit("all")).join(lang, "lang_key", "left").join(wide, "all_key", "left").select(
        F.col("key").alias("_key"), F.when(F.col("large"), F.col("fit")).otherwise(F.coalesce("of_lang", "of_all")).alias("_fit")))
    joined = small_join(stats.withColumn("_key", group_keys()[0]), used, ["_key"], F.col("doc_id"))
    distance = _distance(prefix) / F.col("_fit.scale")
    verdict = ~F.col(f"{prefix}base_failed") & F.coalesce(distance <= CHI_REJECT, F.lit(True))
    return joined.withColumns({f"{prefix}distance": F.when(~F.col(f"{prefix}base_failed"), distance), f"{prefix}kept": verdict}).drop("_key", "_fit")


def quality(docs: DataFrame, prefix: str = "") -> DataFrame:
    """The documents with base statistics, distance and ``kept``; texts are read twice, vectors in between are written."""
    vectors = with_vector(with_base(docs.select("doc_id", "text", "lang", "source"))).where("NOT base_failed")
    fits = estimate(vectors)
    return judge(with_vector(with_base(docs, prefix), prefix), fits, prefix)


@query("op5_robust_outliers")
def op5_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, distance and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = checkpointed(with_vector(with_base(docs)).drop("text"))
    judged = judge(stats, estimate(stats.where("NOT base_failed")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
