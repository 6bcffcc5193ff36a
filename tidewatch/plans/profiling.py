"""Column profiles, class statistics and the leakage scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import leakage as K, profiling as A
from tidewatch.plans.frames import LINEITEM_NUMERIC, SCORES_SQL, embedding_columns, event_scores
from tidewatch.plans.registry import query
from tidewatch.sources.tables import read_table

rnd = lambda c, n=6: F.round(c, n).alias(c)
# Constant, all-zero and sparse columns are planted next to the real ones.
PLANTED = ["price", "zero", "three", "rare", "gaps"]


def planted():
    return {
        "price": F.col("l_extendedprice") / F.lit(1000.0), "zero": F.lit(0.0), "three": F.lit(3.0), "rare": F.when(F.col("l_orderkey") == 17, 1.0).otherwise(0.0),
        "gaps": F.when(F.col("l_linenumber") > 3, F.col("l_quantity")),
    }


PROFILE_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", *PLANTED]
PROFILE_BASE_SQL = """
base AS (SELECT l_quantity, l_extendedprice / 1000::DOUBLE AS price, l_discount, l_tax, l_linenumber::DOUBLE AS l_linenumber, 0::DOUBLE AS zero, 3::DOUBLE AS three,
           CASE WHEN l_orderkey = 17 THEN 1::DOUBLE ELSE 0 END AS rare, CASE WHEN l_linenumber > 3 THEN l_quantity END AS gaps FROM lineitem),
prof AS (""" + " UNION ALL ".join(f"""
  SELECT '{c}' AS feature, round(var_pop({c}), 4) AS variance, count(DISTINCT {c}) AS n_unique,
         round((count(*) - count({c})) / count(*)::DOUBLE, 9) AS pct_nan,
         round(coalesce(sum(CASE WHEN {c} = 0 THEN 1 ELSE 0 END), 0) / count(*)::DOUBLE, 9) AS pct_zero FROM base""" for c in PROFILE_COLUMNS) + ")"


def _lineitem(spark, sf):
    return read_table(spark, sf, "lineitem").withColumns(planted())


def _profile(spark, sf):
    out = A.profile(_lineitem(spark, sf), PROFILE_COLUMNS)
    return out.select("feature", rnd("variance", 4), "n_unique", rnd("pct_nan", 9), rnd("pct_zero", 9))


@query("ag1_profile", f"WITH {PROFILE_BASE_SQL} SELECT * FROM prof")
def profile(spark, sf):
    return _profile(spark, sf)


@query("ag1_profile_embedding", "WITH base AS (SELECT * FROM embeddings), prof AS (" + " UNION ALL ".join(f"""
  SELECT 'f{i}' AS feature, round(var_pop(embedding[{i + 1}]::DOUBLE), 6) AS variance, count(DISTINCT embedding[{i + 1}]) AS n_unique,
         0::DOUBLE AS pct_nan, round(sum(CASE WHEN embedding[{i + 1}] = 0 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 9) AS pct_zero FROM base"""
  for i in range(64)) + ") SELECT * FROM prof")
def profile_embedding(spark, sf):
    out = A.profile(embedding_columns(spark, sf), [f"f{i}" for i in range(64)])
    return out.select("feature", rnd("variance"), "n_unique", rnd("pct_nan", 9), rnd("pct_zero", 9))


@query("ag1_profile_text", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_unique, round(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE, 9) AS pct_nan
FROM (SELECT lang, source, CASE WHEN doc_id % 5 = 0 THEN 'NaN' WHEN doc_id % 5 > 1 THEN lang END AS word FROM documents)""" for c in ("lang", "source", "word")))
def profile_text(spark, sf):
    word = F.when(F.col("doc_id") % 5 == 0, "NaN").when(F.col("doc_id") % 5 > 1, F.col("lang"))
    df = read_table(spark, sf, "documents").select("lang", "source", word.alias("word"))
    return A.profile(df, df.columns).select("feature", "n_unique", rnd("pct_nan", 9))


@query("ag2_profile_summary", f"""WITH {PROFILE_BASE_SQL}
SELECT count(*) AS n_features, count(*) FILTER (variance = 0) AS n_zero_variance,
       count(*) FILTER (variance <= 1e-12) AS n_near_zero_variance, count(*) FILTER (pct_zero = 1) AS n_all_zero FROM prof""")
def profile_summary(spark, sf):
    return A.profile_summary(A.profile_fast(_lineitem(spark, sf), PROFILE_COLUMNS))


@query("ag3_constant_features", f"WITH {PROFILE_BASE_SQL} SELECT * FROM prof WHERE n_unique <= 1")
def constant(spark, sf):
    return A.constant_features(_profile(spark, sf))


@query("ag3_near_constant", f"WITH {PROFILE_BASE_SQL} SELECT feature FROM prof WHERE variance <= 1e-12")
def near(spark, sf):
    return A.near_constant(A.profile_fast(_lineitem(spark, sf), PROFILE_COLUMNS)).select("feature")


@query("ag4_low_variance", f"WITH {PROFILE_BASE_SQL} SELECT feature, variance, pct_zero FROM prof WHERE variance <= 0 ORDER BY feature LIMIT 200")
def low_variance(spark, sf):
    return A.low_variance(A.profile_fast(_lineitem(spark, sf), PROFILE_COLUMNS)).select("feature", rnd("variance", 4), rnd("pct_zero", 9))


@query("ag5_sparsest", f"WITH {PROFILE_BASE_SQL} SELECT feature, pct_zero FROM prof ORDER BY pct_zero DESC, feature LIMIT 50")
def sparsest(spark, sf):
    return A.sparsest(A.profile_fast(_lineitem(spark, sf), PROFILE_COLUMNS)).select("feature", rnd("pct_zero", 9))


@query("ag6_drop_constant", f"WITH {PROFILE_BASE_SQL} SELECT feature FROM prof WHERE variance > 1e-12")
def drop_constant(spark, sf):
    df = _lineitem(spark, sf).select(*PROFILE_COLUMNS)
    kept, _ = A.drop_constant(df, df, PROFILE_COLUMNS)
    return A.profile_fast(kept, kept.columns).select("feature")


@query("ag7_drop_sparse", f"WITH {PROFILE_BASE_SQL} SELECT feature FROM prof WHERE pct_zero <= 0.9999")
def drop_sparse(spark, sf):
    kept = A.drop_sparse(_lineitem(spark, sf).select(*PROFILE_COLUMNS), PROFILE_COLUMNS)
    return A.profile_fast(kept, kept.columns).select("feature")


@query("ag8_class_counts", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def class_counts(spark, sf):
    return A.class_counts(read_table(spark, sf, "orders"), "o_orderpriority")


@query("ag9_class_weights", """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::DOUBLE, 9) AS weight FROM c""")
def class_weights(spark, sf):
    counts = A.class_counts(read_table(spark, sf, "orders"), "o_orderpriority")
    return A.class_weights(counts, "o_orderpriority").withColumn("weight", F.round("weight", 9))


@query("ag9_class_weights_binary", """
WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)
SELECT toxic, n, round((SELECT sum(n) FROM c) / (2 * n)::DOUBLE, 9) AS weight FROM c""")
def class_weights_binary(spark, sf):
    counts = A.class_counts(read_table(spark, sf, "labels"), "toxic")
    return A.class_weights(counts, "toxic", "binary").withColumn("weight", F.round("weight", 9))


@query("ag9_positive_class_scale", "SELECT round(sum(1 - toxic) / sum(toxic)::DOUBLE, 9) AS scale_pos_weight FROM labels")
def positive_scale(spark, sf):
    counts = A.class_counts(read_table(spark, sf, "labels"), "toxic")
    return A.positive_class_scale(counts, "toxic").select(rnd("scale_pos_weight", 9))


LEAK_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_linestatus", "l_linenumber", "l_suppkey", "ship_year", "hint"]
LEAK_BASE_SQL = """
base AS (SELECT l_quantity, l_discount, l_tax, l_linestatus, l_linenumber, l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS ship_year,
           CASE WHEN l_returnflag = 'R' AND l_suppkey < 40 THEN 'gone' WHEN l_linenumber < 6 THEN l_linestatus END AS hint,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem),
cells AS (""" + " UNION ALL ".join(f"""
  SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg, count(*) AS n
  FROM base GROUP BY {c}""" for c in LEAK_COLUMNS) + """),
det AS (SELECT * FROM cells WHERE value IS NOT NULL AND (pos / n::DOUBLE <= 0.001 OR pos / n::DOUBLE >= 0.999))"""


def leak_frame(spark, sf):
    """Lineitem with a planted leak: ``hint`` is 'gone' for positives only."""
    df = read_table(spark, sf, "lineitem")
    hint = F.when((F.col("l_returnflag") == "R") & (F.col("l_suppkey") < 40), "gone").when(
        F.col("l_linenumber") < 6, F.col("l_linestatus"))
    return df.select(
        "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_linenumber", "l_suppkey",
        F.year("l_shipdate").alias("ship_year"), hint.alias("hint"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query("ag10_top_values", f"""WITH {LEAK_BASE_SQL},
r AS (SELECT feature, value, n, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC NULLS FIRST) AS INTEGER) AS rank FROM cells)
SELECT * FROM r WHERE rank <= 5""")
def top_values(spark, sf):
    return A.top_values(leak_frame(spark, sf), LEAK_COLUMNS, 5)


@query("ag11_distinct_ratio", f"""WITH {LEAK_BASE_SQL}
SELECT feature, count(*) AS n_unique, round(count(*) / sum(n)::DOUBLE, 9) AS prop_unique FROM cells GROUP BY 1""")
def distinct_ratio(spark, sf):
    return A.distinct_ratio(leak_frame(spark, sf), LEAK_COLUMNS).withColumn("prop_unique", F.round("prop_unique", 9))


@query("ag12_label_rate", f"""WITH {LEAK_BASE_SQL}
SELECT feature, value, n, round(pos / n::DOUBLE, 9) AS label_mean FROM cells WHERE value IS NOT NULL""")
def label_rate(spark, sf):
    return K.label_rate(leak_frame(spark, sf), LEAK_COLUMNS, "y").withColumn("label_mean", F.round("label_mean", 9))


def _det_sql(support):
    return f"""WITH {LEAK_BASE_SQL}
SELECT feature, count(d.n) AS deterministic_values, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS rows_covered,
       round(coalesce(sum(d.n), 0) / (SELECT count(*) FROM base)::DOUBLE, 9) AS rows_covered_pct
FROM (SELECT DISTINCT feature FROM cells) LEFT JOIN (SELECT * FROM det WHERE n >= {support}) d USING (feature) GROUP BY 1"""


@query("ag13_deterministic_values", _det_sql(1))
def deterministic(spark, sf):
    return K.deterministic_values(leak_frame(spark, sf), LEAK_COLUMNS, "y").withColumn("rows_covered_pct", F.round("rows_covered_pct", 9))


@query("ag13_deterministic_min_support", _det_sql(50))
def deterministic_support(spark, sf):
    out = K.deterministic_values(leak_frame(spark, sf), LEAK_COLUMNS, "y", min_support=50)
    return out.withColumn("rows_covered_pct", F.round("rows_covered_pct", 9))


@query("ag13_deterministic_examples", f"""WITH {LEAK_BASE_SQL},
r AS (SELECT feature, value, n, round(pos / n::DOUBLE, 9) AS label_mean,
        CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INTEGER) AS rank FROM det)
SELECT * FROM r WHERE rank <= 5""")
def examples(spark, sf):
    return K.deterministic_examples(leak_frame(spark, sf), LEAK_COLUMNS, "y").withColumn("label_mean", F.round("label_mean", 9))


def pearson_sql(x, y):
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN NULL ELSE round(covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})), 6) + 0 END"


def mi_sql(cells):
    """Mutual information per feature from a cell table (feature, value, pos, neg)."""
    return f"""
mi_long AS (SELECT feature, value, 1 AS y, pos AS c FROM {cells} UNION ALL SELECT feature, value, 0, neg FROM {cells}),
mi_m AS (SELECT *, c / sum(c) OVER (PARTITION BY feature)::DOUBLE AS p, sum(c) OVER (PARTITION BY feature, value) / sum(c) OVER (PARTITION BY feature)::DOUBLE AS pv,
           sum(c) OVER (PARTITION BY feature, y) / sum(c) OVER (PARTITION BY feature)::DOUBLE AS py FROM mi_long),
mi AS (SELECT feature, round(greatest(sum(CASE WHEN p > 0 THEN p * ln(p / (pv * py)) ELSE 0 END), 0), 6) + 0 AS mutual_information FROM mi_m GROUP BY 1)"""


def bins_sql(columns, bins, base="base", prefix="q"):
    """Cells of exact quantile bins: cut i is the value at rank ceil(i n / bins)."""
    cuts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, row_number() OVER (ORDER BY {c}) AS r, count(*) OVER () AS n FROM {base} WHERE {c} IS NOT NULL" for c in columns)
    flat = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, y FROM {base}" for c in columns)
    return f"""
{prefix}_rank AS ({cuts}),
{prefix}_cut AS (SELECT feature, value AS cut FROM {prefix}_rank, range(1, {bins}) t(i) WHERE r = (i * n + {bins - 1}) // {bins}),
{prefix}_flat AS ({flat}),
{prefix}_vals AS (SELECT feature, value, sum(y) AS pos, sum(1 - y) AS neg FROM {prefix}_flat GROUP BY 1, 2),
{prefix}_bin AS (SELECT v.feature, v.value, pos, neg, CASE WHEN v.value IS NULL THEN NULL ELSE count(cut) END AS b
                 FROM {prefix}_vals v LEFT JOIN {prefix}_cut c ON c.feature = v.feature AND c.cut <= v.value GROUP BY 1, 2, 3, 4),
{prefix}_cells AS (SELECT feature, CAST(b AS VARCHAR) AS value, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg FROM {prefix}_bin GROUP BY feature, b)"""


LEAK_NUMERIC = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey", "ship_year"]
LEAK_TEXT = ["l_linestatus", "hint"]


@query("ag14_leakage_scan", f"""WITH {LEAK_BASE_SQL}, {bins_sql(LEAK_NUMERIC, 10)},
mixed AS (SELECT feature, value, pos, neg FROM q_cells UNION ALL SELECT feature, value, pos, neg FROM cells WHERE feature IN ('l_linestatus', 'hint')),
{mi_sql('mixed')},
stats AS (SELECT feature, count(*) AS n_unique, round(count(*) / sum(n)::DOUBLE, 9) AS prop_unique FROM cells GROUP BY 1),
dets AS (SELECT feature, count(*) AS k, CAST(sum(n) AS BIGINT) AS covered FROM det GROUP BY 1),
r AS (SELECT feature, value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC NULLS FIRST) AS rank FROM cells),
tops AS (SELECT feature, list(CASE WHEN value IS NULL THEN CAST(n AS VARCHAR) ELSE value || '=' || n END ORDER BY rank) AS top_values FROM r WHERE rank <= 5 GROUP BY 1),
corr AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {pearson_sql(c, 'y')} AS correlation FROM base" for c in LEAK_NUMERIC)})
SELECT feature, n_unique, prop_unique, coalesce(k, 0) AS deterministic_values, coalesce(covered, 0) AS rows_covered,
       round(coalesce(covered, 0) / (SELECT count(*) FROM base)::DOUBLE, 9) AS rows_covered_pct, array_to_string(top_values, '|') AS top_values, mutual_information, correlation
FROM stats LEFT JOIN dets USING (feature) LEFT JOIN tops USING (feature) LEFT JOIN mi USING (feature) LEFT JOIN corr USING (feature)""")
def scan(spark, sf):
    out = K.leakage_scan(leak_frame(spark, sf), LEAK_COLUMNS, "y")
    return out.select(
        "feature", "n_unique", rnd("prop_unique", 9), "deterministic_values", "rows_covered", rnd("rows_covered_pct", 9),
        F.array_join("top_values", "|").alias("top_values"), rnd("mutual_information"), rnd("correlation"))


DOC_SQL = """(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"""


def labelled_documents(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read_table(spark, sf, "labels"), "doc_id", "left")


@query("ag15_missing", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, round((count(*) - count({c})) / count(*)::DOUBLE, 9) AS pct_missing FROM {DOC_SQL}"
    for c in ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]) + ") ORDER BY n_missing DESC, feature LIMIT 10")
def missing(spark, sf):
    df = labelled_documents(spark, sf)
    return A.missing(df, df.columns).select("feature", "n_missing", rnd("pct_missing", 9))


@query("ag16_proba_stats", f"WITH {SCORES_SQL} SELECT model_id, count(*) AS n, round(avg(proba), 9) AS mean, round(stddev_pop(proba), 9) AS std FROM scores GROUP BY 1")
def proba_stats(spark, sf):
    return A.proba_stats(event_scores(spark, sf), ["model_id"]).select("model_id", "n", rnd("mean", 9), rnd("std", 9))


def _hist_sql(columns, table, bins, by=""):
    group = f", {by}" if by else ""
    return " UNION ALL ".join(f"""
SELECT '{c}' AS feature{group}, bin, n, lo, hi FROM (
  SELECT {by + ',' if by else ''} least(CAST(floor(({c} - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1}) AS bin, count(*) AS n, first(lo) AS lo, first(hi) AS hi
  FROM {table}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {table}) GROUP BY bin{group})""" for c in columns)


@query("ag17_histogram", f"WITH h AS ({_hist_sql(LINEITEM_NUMERIC, 'lineitem', 50)}) SELECT feature, bin, n, round(lo + (hi - lo) * bin / 50::DOUBLE, 6) AS \"left\" FROM h")
def histogram(spark, sf):
    names = A.evenly_spaced(LINEITEM_NUMERIC, 8)
    return A.histogram(read_table(spark, sf, "lineitem"), names, 50).select("feature", "bin", "n", rnd("left"))


@query("ag18_class_histogram", f"""WITH h AS ({_hist_sql(['l_quantity', 'l_extendedprice'], 'lineitem', 20, 'l_returnflag')})
SELECT feature, l_returnflag, bin, n, round(n / (sum(n) OVER (PARTITION BY feature, l_returnflag) * (hi - lo) / 20)::DOUBLE, 9) AS density FROM h""")
def class_histogram(spark, sf):
    out = A.class_histogram(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag", 20)
    return out.select("feature", "l_returnflag", "bin", "n", rnd("density", 9))


@query("ag19_fold_summary", """
WITH f AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)
SELECT o_orderstatus, count(value) AS n_folds, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM f GROUP BY 1""")
def fold_summary(spark, sf):
    folds = read_table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.avg("o_totalprice").alias("value"))
    return A.fold_summary(folds, ["o_orderstatus"]).select("o_orderstatus", "n_folds", rnd("mean", 4), rnd("std", 4))


@query("ag20_shape", "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def shape(spark, sf):
    return A.shape(read_table(spark, sf, "lineitem"))


@query("ag21_pred_counts", f"WITH {SCORES_SQL} SELECT CAST(proba >= 0.7 AS INTEGER) AS pred, count(*) AS n FROM scores GROUP BY 1")
def pred_counts(spark, sf):
    from tidewatch.operators.scores import apply_threshold
    return A.pred_counts(apply_threshold(event_scores(spark, sf), 0.7))


@query("tk4_top_bottom_variance", f"""WITH {PROFILE_BASE_SQL}
SELECT * FROM (SELECT feature, variance, 'top' AS side FROM prof ORDER BY variance DESC, feature LIMIT 3)
UNION ALL SELECT * FROM (SELECT feature, variance, 'bottom' AS side FROM prof ORDER BY variance, feature LIMIT 3)""")
def top_bottom(spark, sf):
    profiled = A.profile_fast(_lineitem(spark, sf), PROFILE_COLUMNS).select("feature", rnd("variance", 4))
    return A.top_bottom(profiled, "variance", "feature", 3)


@query("wn5_running_best", """
WITH h AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, round(avg(value), 4) AS score FROM events GROUP BY 1)
SELECT day, score, max(score) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS best_score FROM h""")
def running_best(spark, sf):
    history = read_table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 4).alias("score"))
    return A.running_best(history, "day")


@query("wn6_cumulative_share", f"""WITH {PROFILE_BASE_SQL}
SELECT feature, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(variance) OVER w / sum(variance) OVER (), 9) AS cum_share FROM prof
WINDOW w AS (ORDER BY variance DESC, feature ROWS UNBOUNDED PRECEDING)""")
def cumulative_share(spark, sf):
    profiled = A.profile_fast(_lineitem(spark, sf), PROFILE_COLUMNS).select("feature", rnd("variance", 4))
    return A.cumulative_share(profiled, "variance", "feature").select("feature", "rank", rnd("cum_share", 9))
