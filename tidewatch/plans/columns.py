"""Column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import columns as C
from tidewatch.plans.profiling import DOC_SQL, labelled_documents
from tidewatch.plans.registry import query
from tidewatch.sources.tables import read_table


@query("prj1_resolve_columns", "SELECT event_id, user_id, value FROM events")
def resolve(spark, sf):
    df = read_table(spark, sf, "events").withColumnsRenamed({"user_id": " User_ID ", "value": "Value"})
    return C.resolve_columns(df, ["event_id", "user_id", " value", "absent"])


@query("prj2_find_label", "SELECT toxic AS label, count(*) AS n FROM labels GROUP BY 1")
def find_label(spark, sf):
    df = read_table(spark, sf, "labels").select("doc_id", "toxic")
    name = C.find_label(df, fallback="binary")
    return df.groupBy(F.col(name).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("prj3_split_label", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def split_label(spark, sf):
    return C.split_label(read_table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])[0]


@query("prj4_to_numeric", """
SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS event_type, value, TRY_CAST(regexp_extract(props, '\\d+') AS DOUBLE) AS k, 'x' || user_id AS tag FROM events""")
def to_numeric(spark, sf):
    df = read_table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.regexp_extract("props", r"\d+", 0).alias("k"),
        F.concat(F.lit("x"), F.col("user_id").cast("string")).alias("tag"))
    return C.to_numeric(df, ["event_id", "tag"])


@query("prj5_to_numeric_adaptive", """
WITH b AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS size_text, p_type FROM part),
n AS (SELECT p_partkey, TRY_CAST(size_text AS DOUBLE) AS s, p_type FROM b),
c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey, coalesce(s, (SELECT median(s) FROM n)) AS size_text, code::DOUBLE AS p_type FROM n JOIN c USING (p_type)""")
def adaptive(spark, sf):
    df = read_table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_brand") == "Brand#2", "n/a").otherwise(F.col("p_size").cast("string")).alias("size_text"), "p_type")
    return C.to_numeric_adaptive(df, ["size_text", "p_type"])


@query("prj6_as_category", f"SELECT doc_id, coalesce(CAST(toxic AS VARCHAR), 'nan') AS toxic, coalesce(lang, 'nan') AS lang FROM {DOC_SQL}")
def as_category(spark, sf):
    return C.as_category(labelled_documents(spark, sf).select("doc_id", "toxic", "lang"), ["toxic", "lang", "absent"])


@query("prj7_fill", f"SELECT doc_id, coalesce(toxic, -999) AS toxic, coalesce(quality, 0) AS quality FROM {DOC_SQL}")
def fill(spark, sf):
    df = labelled_documents(spark, sf).select("doc_id", "toxic", "quality")
    return C.fill(C.fill(df, ["toxic"], -999), ["quality"], 0)


def _found(spark, names):
    return spark.createDataFrame([(n,) for n in names], "feature string")


PART_DISTINCT_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) AS n FROM part"
                                       for c in ["p_partkey", "p_size", "p_retailprice"])


@query("prj8_detect_categorical", f"""SELECT feature FROM ({PART_DISTINCT_SQL}) WHERE n <= 100
UNION ALL SELECT unnest(['p_name', 'p_brand', 'p_type'])""")
def detect(spark, sf):
    return _found(spark, C.detect_categorical(read_table(spark, sf, "part"), 100))


@query("prj9_detect_categorical_known", f"""SELECT feature FROM ({PART_DISTINCT_SQL}) WHERE n <= 50 OR feature = 'p_retailprice'
UNION ALL SELECT unnest(['p_name', 'p_brand', 'p_type'])""")
def detect_known(spark, sf):
    return _found(spark, C.detect_categorical(read_table(spark, sf, "part"), 50, ["p_retailprice"], count_null=False))


@query("prj10_numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric(spark, sf):
    df = read_table(spark, sf, "part")
    return C.select_features(df, C.numeric_columns(df))


@query("prj11_slice_features", "SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS b, embedding[6]::DOUBLE AS c FROM embeddings")
def slice_features(spark, sf):
    df = C.slice_array(read_table(spark, sf, "embeddings"), "embedding", [0, 63, 5])
    return df.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("abc")])


@query("prj13_non_null", f"SELECT doc_id, toxic FROM {DOC_SQL} WHERE toxic IS NOT NULL")
def non_null(spark, sf):
    return C.non_null(labelled_documents(spark, sf).select("doc_id", "toxic"), "toxic")


@query("prj14_require_width", "SELECT vec_id, len(embedding) AS width FROM embeddings")
def width(spark, sf):
    df = C.require_width(read_table(spark, sf, "embeddings"), 64, "embedding")
    return df.select("vec_id", F.size("embedding").cast("long").alias("width"))


@query("prj15_positive_proba", "SELECT vec_id, embedding[2]::DOUBLE AS by_class, embedding[1]::DOUBLE AS reversed FROM embeddings")
def positive(spark, sf):
    df = read_table(spark, sf, "embeddings")
    return df.select(
        "vec_id", C.positive_proba("embedding", [0, 1]).cast("double").alias("by_class"),
        C.positive_proba("embedding", ["1", "0"]).cast("double").alias("reversed"))


@query("prj16_margin_to_proba", "SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE))), 9) AS proba FROM embeddings")
def margin(spark, sf):
    df = read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("m"))
    return C.margin_to_proba(df, "m").select("vec_id", F.round("proba", 9).alias("proba"))


@query("set6_values_within", """
SELECT 'toxic' AS feature, true AS within UNION ALL SELECT 'quality', true UNION ALL SELECT 'doc_id', false""")
def within(spark, sf):
    return C.values_within(read_table(spark, sf, "labels"), ["toxic", "quality", "doc_id"], C.BINARY_SPELLINGS)


@query("jn7_match_ranked", """
WITH f AS (SELECT c_custkey AS rank, CASE WHEN c_mktsegment = 'MACHINERY' THEN ' ' || upper(c_name) ELSE c_name END AS feature FROM customer),
h AS (SELECT c_name AS "column" FROM customer WHERE c_nationkey < 20)
SELECT rank, feature, "column", "column" IS NOT NULL AS present FROM f LEFT JOIN h ON lower(trim(f.feature)) = lower(trim(h."column"))""")
def match(spark, sf):
    df = read_table(spark, sf, "customer")
    name = F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.col("c_name"))
    wanted = df.select(F.col("c_custkey").alias("rank"), name.alias("feature"))
    have = df.where("c_nationkey < 20").select(F.col("c_name").alias("column"))
    return C.match_ranked(wanted, have)
