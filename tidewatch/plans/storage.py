"""Sources and sinks: written from the given tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidewatch.operators import scores as S
from tidewatch.plans.evaluation import CATALOGUE_SQL, _catalogue
from tidewatch.plans.frames import WIDE_SQL, event_scores_wide
from tidewatch.plans.registry import query
from tidewatch.session import scratch_path
from tidewatch.sources import catalogue as G, delimited as D, documents as J, writers as W
from tidewatch.sources.tables import read_matrix, read_table

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("extra", T.StringType())])


def _event_file(spark, sf, header=False):
    """Events as text; views have an empty type, and a blank follows some commas."""
    path = scratch_path(spark, "events_csv")
    df = read_table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("event_type") != "view", F.concat(F.lit("  "), F.col("event_type"))).alias("event_type"),
        "value", F.lit("x").alias("extra"))
    df.write.option("header", header).option("nullValue", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


EVENT_SQL = "SELECT event_id, user_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type, value{} FROM events"


@query("src1_read_fixed_csv", EVENT_SQL.format(", 'x' AS extra"))
def fixed(spark, sf):
    return D.read_fixed_csv(spark, _event_file(spark, sf), EVENT_SCHEMA)


@query("src1_field_counts", "SELECT 5 AS n_fields, count(*) AS lines FROM events")
def fields(spark, sf):
    return D.field_counts(spark, _event_file(spark, sf))


@query("src1_quoted_records", """
SELECT CAST(CASE WHEN event_id % 4 = 3 THEN 4 ELSE 3 END AS INTEGER) AS n_fields, count(*) AS lines FROM events GROUP BY 1""")
def quoted_records(spark, sf):
    """Commas, quotes and line ends inside quoted fields; a quarter of the records has one field more."""
    path = scratch_path(spark, "quoted")
    inner = F.concat(F.lit('"'), "event_type", F.lit(',\n"" '), F.lit("\n") , F.lit(' ,"'))
    field = F.when(F.col("event_id") % 3 == 0, inner).otherwise(F.col("event_type"))
    more = F.when(F.col("event_id") % 4 == 3, ",x").otherwise("")
    read_table(spark, sf, "events").select(F.concat(F.col("event_id").cast("string"), F.lit(","), field, F.lit(",1"), more).alias("value")).write.text(path)
    return D.field_counts(spark, path)


@query("src2_take_columns", EVENT_SQL.format(""))
def take(spark, sf):
    return D.take_columns(D.read_fixed_csv(spark, _event_file(spark, sf), EVENT_SCHEMA), EVENT_SCHEMA.names[:4])


@query("src3_read_header_csv", "SELECT event_id::INTEGER AS event_id, user_id::INTEGER AS user_id, value FROM events")
def header(spark, sf):
    df = D.read_header_csv(spark, _event_file(spark, sf, True))
    return df.select(F.col("event_id").cast("int").alias("event_id"), F.col("user_id").cast("int").alias("user_id"), "value")


@query("src4_head_sample", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 5000")
def head(spark, sf):
    return D.head_sample(read_table(spark, sf, "events").select("event_id", "value"), "event_id", 5000)


def _matrix(spark, sf):
    path = scratch_path(spark, "matrix")
    part = F.when(F.col("label") < 3, "test").otherwise("train")
    df = read_table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label", part.alias("split"))
    W.write_matrix(df, path)
    return path


@query("src6_read_matrix", "SELECT vec_id AS row_id, label, embedding[1]::DOUBLE AS f0, len(embedding) AS width, 'test' AS split FROM embeddings WHERE label < 3")
def matrix(spark, sf):
    df = read_matrix(spark, _matrix(spark, sf), "test")
    return df.select("row_id", "label", F.col("features")[0].alias("f0"), F.size("features").cast("long").alias("width"), F.col("split").cast("string").alias("split"))


@query("snk1_write_matrix", "SELECT CASE WHEN label < 3 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM embeddings GROUP BY 1")
def write_matrix(spark, sf):
    return read_matrix(spark, _matrix(spark, sf)).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("src7_first_available", "SELECT vec_id AS row_id, label FROM embeddings")
def available(spark, sf):
    missing = scratch_path(spark, "missing")
    return G.first_available(spark, [missing, _matrix(spark, sf)]).select("row_id", "label")


@query("src8_read_metrics", f"WITH {CATALOGUE_SQL} SELECT model_id, metric, value FROM (UNPIVOT (SELECT model_id, accuracy, f1, roc_auc, pr_auc FROM cat) ON accuracy, f1, roc_auc, pr_auc INTO NAME metric VALUE value)")
def metrics(spark, sf):
    path = _metric_documents(spark, sf)
    return J.read_metrics(spark, path).select("model_id", "metric", "value")


def _metric_documents(spark, sf):
    """One document with an object per model."""
    path = scratch_path(spark, "metrics")
    rows = _catalogue(spark, sf).select("model_id", F.struct(
        "accuracy", F.col("f1"), F.col("roc_auc"), F.col("pr_auc")).alias("m"))
    W.write_metrics(rows.groupBy(F.lit(0).alias("g")).pivot("model_id", ["s1", "s2", "s3", "s4"]).agg(F.first("m")).drop("g"), path)
    return path


@query("snk6_write_metrics", f"WITH {CATALOGUE_SQL} SELECT model_id, accuracy, roc_auc FROM cat")
def write_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    W.write_metrics(_catalogue(spark, sf).select("model_id", "accuracy", "roc_auc"), path)
    return spark.read.schema("model_id string, accuracy double, roc_auc double").json(path)


@query("snk9_compare_runs", f"WITH {CATALOGUE_SQL} SELECT model_id, accuracy, roc_auc, f1 FROM cat")
def runs(spark, sf):
    out = J.compare_runs(J.read_metrics(spark, _metric_documents(spark, sf)))
    return out.select("model_id", "accuracy", "roc_auc", "f1")


def _scored(spark, sf):
    df = event_scores_wide(spark, sf).select("row_id", F.col("s3").alias("proba"), F.col("y").alias("true"))
    return S.apply_threshold(df, 0.5)


@query("src9_read_predictions", f"WITH {WIDE_SQL} SELECT row_id, s3 AS proba, CAST(s3 >= 0.5 AS INTEGER) AS pred, CAST(NULL AS INTEGER) AS \"true\" FROM wide")
def read_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    old = _scored(spark, sf).select(F.col("row_id").alias("index"), F.col("proba").alias("prob_positive"), F.col("pred").alias("pred_label"))
    W.write_predictions(old, path, old.columns)
    return D.read_predictions(spark, path)


@query("snk2_write_predictions", f"WITH {WIDE_SQL} SELECT row_id, s3 AS proba, CAST(s3 >= 0.5 AS INTEGER) AS pred FROM wide")
def write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    W.write_predictions(_scored(spark, sf).drop("true"), path, fmt="parquet")
    return spark.read.parquet(path)


@query("snk3_input_with_scores", f"WITH {WIDE_SQL} SELECT event_id AS row_id, event_type, e.value, s3 AS proba, CAST(s3 >= 0.5 AS INTEGER) AS pred FROM events e JOIN wide ON row_id = event_id")
def input_scores(spark, sf):
    df = read_table(spark, sf, "events").select(F.col("event_id").alias("row_id"), "event_type", "value")
    return W.with_scores(df, _scored(spark, sf), "row_id", 0.5)


@query("snk4_predictions_with_truth", f"WITH {WIDE_SQL} SELECT row_id, s3 AS proba, CAST(s3 >= 0.5 AS INTEGER) AS pred, y AS \"true\" FROM wide")
def truth(spark, sf):
    path = scratch_path(spark, "predictions")
    W.write_predictions(_scored(spark, sf), path)
    return D.read_predictions(spark, path)


@query("snk7_write_head", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def write_head(spark, sf):
    path = scratch_path(spark, "head")
    W.write_head(read_table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey", 100, path)
    return spark.read.option("header", True).schema("p_partkey long, p_name string").csv(path)
