"""Streaming scans, scoring and summaries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.expressions import hash_uniform
from tidewatch.operators import scores as S
from tidewatch.plans.evaluation import M
from tidewatch.plans.frames import WIDE_SQL
from tidewatch.plans.profiling import rnd
from tidewatch.plans.registry import query
from tidewatch.session import scratch_path
from tidewatch.sources import delimited as D
from tidewatch.sources.tables import read_table
from tidewatch.streaming import scoring as Z

EVENT_FIELDS = "event_id long, event_type string, value double"


def _event_files(spark, sf):
    path = scratch_path(spark, "event_files")
    files = spark.sparkContext.defaultParallelism
    read_table(spark, sf, "events").select("event_id", "event_type", "value").repartition(files, "event_id").write.csv(path)
    return path, files


def _event_stream(spark, sf):
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(EVENT_FIELDS)
    path, files = _event_files(spark, sf)
    return D.stream_csv(spark, path, schema, max_files=max(1, files // 2))


def _scored(df):
    """The s3 score, its prediction and the label, row by row."""
    y = (F.col("event_type") == "error").cast("int")
    base = df.select(F.col("event_id").alias("row_id"), y.alias("y"), hash_uniform("event_id", 7).alias("u"))
    s3 = F.floor((F.col("u") * F.lit(0.7) + F.col("y") * F.lit(0.3)) * F.lit(1000.0)) / F.lit(1000.0)
    return S.apply_threshold(base.select("row_id", "y", s3.alias("proba")), 0.5)


@query("src5_stream_csv", "SELECT event_id, event_type, value FROM events")
def stream_csv(spark, sf):
    out = scratch_path(spark, "streamed")
    Z.stream_write(_event_stream(spark, sf), out, f"{out}_checkpoint").awaitTermination()
    return spark.read.parquet(out)


@query("snk5_stream_append", f"WITH {WIDE_SQL} SELECT row_id, y, s3 AS proba, CAST(s3 >= 0.5 AS INTEGER) AS pred FROM wide")
def stream_append(spark, sf):
    out = scratch_path(spark, "scored")
    Z.stream_write(_scored(_event_stream(spark, sf)), out, f"{out}_checkpoint").awaitTermination()
    return spark.read.parquet(out)


CELL_SQL = WIDE_SQL + """,
c AS (SELECT s3 AS cell, CAST(s3 >= 0.5 AS INTEGER) AS pred, y FROM wide),
cm AS (SELECT CAST(count(*) FILTER (pred = 1 AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (pred = 1 AND y = 0) AS BIGINT) AS fp,
              CAST(count(*) FILTER (pred = 0 AND y = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (pred = 0 AND y = 1) AS BIGINT) AS fn FROM c),
st AS (SELECT cell, sum(y) AS pos, sum(1 - y) AS neg FROM c GROUP BY 1),
pt AS (SELECT *, sum(pos) OVER (ORDER BY cell DESC ROWS UNBOUNDED PRECEDING) AS up FROM st)"""


@query("sm2_stream_summary", f"""WITH {CELL_SQL}
SELECT tp, fp, tn, fn, {M['accuracy']} AS accuracy, {M['f1']} AS f1, tp + fp + tn + fn AS n,
       (SELECT round(sum(neg::DOUBLE * (up - pos / 2::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 9) FROM pt) AS roc_auc FROM cm""")
def stream_summary(spark, sf):
    out = scratch_path(spark, "summary")
    Z.stream_summary(_scored(_event_stream(spark, sf)), out, f"{out}_checkpoint").awaitTermination()
    report = Z.counts_report(Z.latest_counts(spark, out))
    return report.select("tp", "fp", "tn", "fn", rnd("accuracy", 9), rnd("f1", 9), "n", rnd("roc_auc", 9))


MISSING_SQL = WIDE_SQL + """,
w AS (SELECT row_id, y, CASE WHEN row_id % 7 = 0 THEN NULL ELSE s2 END AS p FROM wide),
c AS (SELECT p, coalesce(CAST(p >= 0.5 AS INTEGER), 0) AS pred, y FROM w),
st AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM c WHERE p IS NOT NULL GROUP BY 1),
pt AS (SELECT *, sum(pos) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS up FROM st)"""


@query("sm2_stream_missing_scores", f"""WITH {MISSING_SQL}
SELECT CAST(count(*) FILTER (pred = y) AS BIGINT) AS n_right, count(*) AS n, count(*) FILTER (p IS NULL) AS n_missing,
       (SELECT round(sum(neg::DOUBLE * (up - pos / 2::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE), 9) FROM pt) AS roc_auc FROM c""")
def stream_missing(spark, sf):
    """As many different scores as rows, a seventh of them missing, over more batches than one level of runs holds."""
    out = scratch_path(spark, "summary")
    stream = _event_stream(spark, sf).select(
        "event_id", (F.col("event_type") == "error").cast("int").alias("y"),
        F.when(F.col("event_id") % 7 != 0, hash_uniform("event_id", 7)).alias("proba"))
    rows = stream.withColumn("pred", F.coalesce((F.col("proba") >= 0.5).cast("int"), F.lit(0)))
    Z.stream_summary(rows, out, f"{out}_checkpoint", fan_in=2).awaitTermination()
    return Z.counts_report(Z.latest_counts(spark, out)).select((F.col("tp") + F.col("tn")).alias("n_right"), "n", "n_missing", rnd("roc_auc", 9))
