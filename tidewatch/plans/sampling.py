"""Splits, folds, samples and ranks in hash order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import splitting as P
from tidewatch.plans.registry import query
from tidewatch.sources.tables import read_table

ORDERS_SQL = """
o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER w AS rank, count(*) OVER (PARTITION BY o_orderstatus) AS n
      FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey))"""


def _orders(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


def split_sql(part):
    return f"""WITH {ORDERS_SQL} SELECT o_orderkey, o_orderstatus,
CASE WHEN rank <= greatest(1, floor(n * {part}::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM o"""


def _split_query(name, part):
    @query(name, split_sql(part))
    def run(spark, sf):
        return P.stratified_split(_orders(spark, sf), "o_orderstatus", "o_orderkey", part)


_split_query("spl1_stratified_split", 0.15)
_split_query("spl2_split_80_20", 0.2)
_split_query("spl2_split_90_10", 0.1)


@query("spl3_stratified_sample", f"""WITH {ORDERS_SQL},
c AS (SELECT o_orderstatus, count(*) AS n_class FROM orders GROUP BY 1),
e AS (SELECT *, n_class::DOUBLE * 5000 / sum(n_class) OVER () AS exact FROM c),
q AS (SELECT o_orderstatus, floor(exact) AS base, 5000 - sum(floor(exact)) OVER () AS lft,
        row_number() OVER (ORDER BY exact - floor(exact) DESC, o_orderstatus) AS place FROM e)
SELECT o_orderkey, o.o_orderstatus FROM o JOIN q USING (o_orderstatus)
WHERE rank <= base + CASE WHEN place <= lft THEN 1 ELSE 0 END""")
def stratified_sample(spark, sf):
    return P.stratified_sample(_orders(spark, sf), "o_orderstatus", "o_orderkey", 5000)


@query("spl3_sample_larger_than_table", "SELECT doc_id, toxic FROM labels")
def sample_all(spark, sf):
    df = read_table(spark, sf, "labels").select("doc_id", "toxic")
    return P.stratified_sample(df, "toxic", "doc_id", 200_000)


@query("spl4_safe_split", """
WITH r AS (SELECT r_regionkey, r_name, row_number() OVER (ORDER BY md5('42|' || CAST(r_regionkey AS VARCHAR)), r_regionkey) AS rank,
             count(*) OVER () AS n FROM region)
SELECT r_regionkey, r_name, CASE WHEN rank <= greatest(1, floor(n * 0.4::DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM r""")
def safe(spark, sf):
    return P.safe_split(read_table(spark, sf, "region").select("r_regionkey", "r_name"), "r_name", "r_regionkey", 0.4)


@query("spl5_kfold", f"""WITH {ORDERS_SQL}
SELECT o_orderkey, o_orderstatus, CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY rank) - 1 AS INTEGER) AS fold FROM o""")
def kfold(spark, sf):
    return P.kfold(_orders(spark, sf), "o_orderstatus", "o_orderkey", 5)


@query("spl6_kfold_three", """
SELECT doc_id, toxic, CAST(ntile(3) OVER (PARTITION BY toxic ORDER BY md5('1|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS INTEGER) AS fold FROM labels""")
def kfold3(spark, sf):
    return P.kfold(read_table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 3, seed=1)


@query("spl7_sample_n", """
SELECT event_id, value FROM events ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id LIMIT 2000""")
def sample_n(spark, sf):
    return P.sample_n(read_table(spark, sf, "events").select("event_id", "value"), "event_id", 2000)


@query("spl8_holdout", f"""WITH {ORDERS_SQL} SELECT o_orderkey, o_orderstatus FROM o WHERE rank > greatest(1, floor(n * 0.2::DOUBLE))""")
def holdout(spark, sf):
    return P.holdout(_orders(spark, sf), "o_orderstatus", "o_orderkey", 0.2)[0]


@query("spl9_bag_rows", """
SELECT o_orderkey FROM orders
WHERE CAST('0x' || substr(md5('1001|' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.7""")
def bag(spark, sf):
    return P.bag_rows(_orders(spark, sf).select("o_orderkey"), "o_orderkey", 0.7, 1001)


@query("wn1_class_rank", f"WITH {ORDERS_SQL} SELECT o_orderkey, o_orderstatus, rank FROM o")
def class_rank(spark, sf):
    return P.class_rank(_orders(spark, sf), "o_orderstatus", "o_orderkey")


@query("wn2_equal_parts", f"""WITH {ORDERS_SQL}
SELECT o_orderstatus, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY rank) - 1 AS part, o_orderkey FROM o""".replace(
    "ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY rank) - 1 AS part",
    "CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY rank) - 1 AS INTEGER) AS part"))
def parts(spark, sf):
    return P.kfold(_orders(spark, sf), "o_orderstatus", "o_orderkey", 4, name="part")


@query("jn5_fold_train", f"""WITH {ORDERS_SQL},
f AS (SELECT o_orderkey, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY rank) - 1 AS fold FROM o)
SELECT o_orderkey FROM orders ANTI JOIN (SELECT o_orderkey FROM f WHERE fold = 2) USING (o_orderkey)""")
def fold_train(spark, sf):
    return P.fold_train(kfold(spark, sf), 2).select("o_orderkey")


@query("set2_other_folds", f"""WITH {ORDERS_SQL},
f AS (SELECT o_orderkey, ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY rank) - 1 AS fold FROM o)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n FROM f WHERE fold <> 0 GROUP BY 1""")
def other_folds(spark, sf):
    return P.fold_train(kfold(spark, sf), 0).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
