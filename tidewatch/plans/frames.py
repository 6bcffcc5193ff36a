"""Frames the queries share, each next to the SQL that builds the same rows.

Scores stand in for models that need no training: ``s1`` has many ties, ``s2``
is uniform, ``s3`` knows the label a little, ``s4`` is constant. Rows are
events, the label is ``event_type = 'error'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.expressions import hash_uniform
from tidewatch.sources.tables import read_table

SCORE_NAMES = ["s1", "s2", "s3", "s4"]


def event_scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    y = (F.col("event_type") == "error").cast("int")
    base = read_table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"), y.alias("y"), "value", hash_uniform("event_id", 7).alias("s2")
    )
    return base.select(
        "row_id", "y", (F.floor(F.col("value") * 2) / F.lit(1000.0)).alias("s1"), "s2",
        (F.floor((F.col("s2") * F.lit(0.7) + F.col("y") * F.lit(0.3)) * F.lit(1000.0)) / F.lit(1000.0)).alias("s3"),
        F.lit(0.5).alias("s4"),
    )


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Stacked ``(model_id, row_id, proba, y)``."""
    return event_scores_wide(spark, sf).unpivot(["row_id", "y"], SCORE_NAMES, "model_id", "proba").select(
        "model_id", "row_id", "proba", "y"
    )


WIDE_SQL = """
wide0 AS (
  SELECT event_id AS row_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, value,
         CAST('0x' || substr(md5('7|' || CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS s2
  FROM events),
wide AS (
  SELECT row_id, y, floor(value * 2::DOUBLE) / 1000.0::DOUBLE AS s1, s2,
         floor((s2 * 0.7::DOUBLE + y * 0.3::DOUBLE) * 1000.0::DOUBLE) / 1000.0::DOUBLE AS s3, 0.5::DOUBLE AS s4
  FROM wide0)"""
SCORES_SQL = WIDE_SQL + """,
scores AS (
  SELECT 's1' AS model_id, row_id, s1 AS proba, y FROM wide
  UNION ALL SELECT 's2', row_id, s2, y FROM wide
  UNION ALL SELECT 's3', row_id, s3, y FROM wide
  UNION ALL SELECT 's4', row_id, s4, y FROM wide)"""
CURVE_SQL = SCORES_SQL + """,
st AS (SELECT model_id, proba, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
       FROM scores GROUP BY 1, 2),
points AS (
  SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
         row_number() OVER w AS rnk
  FROM st WINDOW w AS (PARTITION BY model_id ORDER BY proba DESC ROWS UNBOUNDED PRECEDING)),
ends AS (SELECT model_id, CAST(sum(pos) AS BIGINT) AS p_all, CAST(sum(neg) AS BIGINT) AS n_all
         FROM st GROUP BY 1)"""


def grid_sql(points: int, start: str, step: str, stop: str) -> str:
    """CTE ``grid(i, threshold)`` with the last point set to ``stop``."""
    return f"""
grid AS (SELECT i, CASE WHEN i = {points - 1} THEN {stop}::DOUBLE
                        ELSE {start}::DOUBLE + i * {step} END AS threshold
         FROM range({points}) t(i))"""


def embedding_columns(spark: SparkSession, sf: str, n: int = 64) -> DataFrame:
    """Embeddings as one column per dimension: ``vec_id, label, f0 ... f63``."""
    df = read_table(spark, sf, "embeddings")
    return df.selectExpr("vec_id", "label", *[f"CAST(embedding[{i}] AS DOUBLE) AS f{i}" for i in range(n)])


LINEITEM_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
