"""Label rules and category codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import labels as L
from tidewatch.plans.registry import query
from tidewatch.sources.tables import read_table


@query("lbl1_majority_integer", """
WITH maj AS (SELECT label AS v FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT vec_id, label, CASE WHEN label = (SELECT v FROM maj) THEN 0 ELSE 1 END AS y FROM embeddings""")
def majority(spark, sf):
    df = read_table(spark, sf, "embeddings").select("vec_id", "label")
    return L.fit_label_rule(df, "label").apply(df, "label")


def _worded(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "O", " Normal.").otherwise(F.concat(F.lit("alert-"), "o_orderstatus")).alias("tag"))


WORDED_SQL = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN ' Normal.' ELSE 'alert-' || o_orderstatus END AS tag FROM orders"""


@query("lbl1_contains_word", f"SELECT o_orderkey, tag, CASE WHEN lower(tag) LIKE '%normal%' THEN 0 ELSE 1 END AS y FROM ({WORDED_SQL})")
def worded(spark, sf):
    df = _worded(spark, sf)
    return L.fit_label_rule(df, "tag").apply(df, "tag")


@query("lbl1_zero_number", """
SELECT l_tax AS tax, CASE WHEN l_tax = 0 THEN 0 ELSE 1 END AS y, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def zero(spark, sf):
    df = read_table(spark, sf, "lineitem").select(F.col("l_tax").alias("tax"))
    text = df.withColumn("t", F.col("tax").cast("string"))
    return L.fit_label_rule(text, "t").apply(text, "t").groupBy("tax", "y").agg(F.count(F.lit(1)).alias("n"))


@query("lbl1_first_value", """
WITH f AS (SELECT event_type AS v FROM events ORDER BY event_id LIMIT 1)
SELECT event_id, event_type, CASE WHEN event_type = (SELECT v FROM f) THEN 0 ELSE 1 END AS y FROM events""")
def first(spark, sf):
    df = read_table(spark, sf, "events").select("event_id", "event_type")
    return L.fit_label_rule(df, "event_type", row_id="event_id").apply(df, "event_type")


@query("lbl2_equals", "SELECT event_id, CASE WHEN lower(event_type) <> 'view' THEN 1 ELSE 0 END AS y FROM events")
def equals(spark, sf):
    return L.label_equals(read_table(spark, sf, "events"), "event_type", "view").select("event_id", "y")


@query("lbl3_contains_stripped", f"""
SELECT o_orderkey, CASE WHEN contains(trim(lower(tag), ' ''",.' || chr(9) || chr(10) || chr(13)), 'normal') THEN 0 ELSE 1 END AS y
FROM ({WORDED_SQL})""")
def contains(spark, sf):
    return L.label_contains(_worded(spark, sf), "tag").select("o_orderkey", "y")


@query("lbl4_by_type", """
SELECT doc_id, CASE WHEN toxic <> 0 THEN 1 ELSE 0 END AS y_number, CASE WHEN lower(lang) <> 'normal' THEN 1 ELSE 0 END AS y_text
FROM labels JOIN documents USING (doc_id)""")
def by_type(spark, sf):
    df = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return L.label_by_type(L.label_by_type(df, "toxic", "y_number"), "lang", "y_text").select("doc_id", "y_number", "y_text")


@query("lbl5_factorize_first_seen", """
WITH f AS (SELECT source, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY 1),
c AS (SELECT source, row_number() OVER (ORDER BY first, source) - 1 AS code FROM f)
SELECT doc_id, source, coalesce(code, -1) AS code FROM documents LEFT JOIN c USING (source)""")
def factorize(spark, sf):
    return L.factorize(read_table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id")


@query("lbl6_factorize_sorted", """
WITH c AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL))
SELECT p_partkey, p_name, coalesce(code, -1) AS code FROM part LEFT JOIN c USING (p_name)""")
def factorize_sorted(spark, sf):
    return L.factorize_sorted(read_table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@query("lbl7_label_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def counts(spark, sf):
    return L.label_counts(read_table(spark, sf, "events"), "event_type")


@query("lbl7_label_profile", """
SELECT count(*) AS rows, count(DISTINCT label) AS n_labels, count(*) - count(label) AS n_missing FROM embeddings""")
def profile(spark, sf):
    return L.label_profile(read_table(spark, sf, "embeddings"), "label")


@query("tk6_most_common", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 3")
def common(spark, sf):
    return L.label_counts(read_table(spark, sf, "part"), "p_type").limit(3)
