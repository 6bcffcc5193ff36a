"""Scoring files as they arrive, with an exact running summary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions.expressions import nan_to_null
from tidewatch.operators import scores as S
from tidewatch.operators.scoring import predict
from tidewatch.session import folder_names, remove_folder
from tidewatch.sources.bundles import Bundle

#: Runs of one level that become one of the next.
FAN_IN = 4
COUNTS = "proba double, pred int, y int, n long"


def stream_write(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Append every batch once; processes what is there and stops."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start()


def stream_score(bundle: Bundle, df: DataFrame, out: str, checkpoint: str, keep: list[str]) -> StreamingQuery:
    return stream_write(predict(bundle, df).select(*keep, "proba", "pred"), out, checkpoint)


def score_counts(df: DataFrame) -> DataFrame:
    """Rows counted by (score, prediction, label): all that exact metrics need. A missing score is a score of its own."""
    return df.groupBy(nan_to_null("proba").alias("proba"), "pred", "y").agg(F.count(F.lit(1)).alias("n"))


def stream_summary(df: DataFrame, path: str, checkpoint: str, fan_in: int = FAN_IN) -> StreamingQuery:
    """Keep exact counts of all scores up to date under ``path``, as runs that are merged like a log.

    Every batch writes one run; when ``fan_in`` runs of one level follow each other they become one of the next, so a row is written again only
    as often as there are levels, and a report reads few runs. A manifest for each batch lists its runs; a batch that is
    run again after a failure starts from the manifest before it and writes the same again.
    """
    def publish(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _swept(spark, path, epoch)
        runs = _manifest(spark, path, epoch - 1)
        score_counts(batch).write.mode("overwrite").parquet(_run(path, [0, epoch, epoch]))
        runs.append([0, epoch, epoch])
        while len(runs) >= fan_in and len({level for level, _, _ in runs[-fan_in:]}) == 1:
            old = runs[-fan_in:]
            new = [old[0][0] + 1, old[0][1], old[-1][2]]
            _merged(spark, path, old).write.mode("overwrite").parquet(_run(path, new))
            runs[-fan_in:] = [new]
        spark.createDataFrame([(json.dumps(runs),)], "runs string").coalesce(1).write.mode("overwrite").text(_manifest_path(path, epoch))

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()


def _run(path: str, run: list[int]) -> str:
    return f"{path}/run_{run[0]}_{run[1]}_{run[2]}"


def _manifest_path(path: str, epoch: int) -> str:
    return f"{path}/manifest_{epoch:012d}"


def _manifest(spark: SparkSession, path: str, epoch: int) -> list[list[int]]:
    if epoch < 0:
        return []
    return json.loads(spark.read.text(_manifest_path(path, epoch)).first()[0])


def _swept(spark: SparkSession, path: str, epoch: int) -> None:
    """Removes what neither the last manifest nor the one before it names; both may still be read."""
    names = folder_names(spark, path)
    manifests = [n for n in names if n.startswith("manifest_") and int(n[9:]) < epoch]
    kept = set(sorted(manifests)[-2:])
    live = {_run(path, r) for n in kept for r in _manifest(spark, path, int(n[9:]))}
    for n in names:
        old = n.startswith("manifest_") and n not in kept and int(n[9:]) < epoch
        if old or (n.startswith("run_") and kept and f"{path}/{n}" not in live):
            remove_folder(spark, f"{path}/{n}")


def _merged(spark: SparkSession, path: str, runs: list[list[int]]) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], COUNTS)
    return spark.read.schema(COUNTS).parquet(*[_run(path, r) for r in runs]).groupBy("proba", "pred", "y").agg(F.sum("n").alias("n"))


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts by (score, prediction, label) over all batches so far."""
    manifests = [n for n in folder_names(spark, path) if n.startswith("manifest_")]
    return _merged(spark, path, _manifest(spark, path, int(max(manifests)[9:])) if manifests else [])


def counts_report(counts: DataFrame) -> DataFrame:
    """n, rows without a score, confusion, accuracy, F1 and AUC, all exact; a row without score counts by its prediction and not in the curve."""
    one = counts.withColumn("model_id", F.lit("stream"))
    hit = lambda p, y: F.coalesce(F.sum(F.when((F.col("pred") == p) & (F.col("y") == y), F.col("n"))), F.lit(0))
    flat = S.with_metrics(one.groupBy("model_id").agg(
        hit(1, 1).alias("tp"), hit(1, 0).alias("fp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fn"), F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("proba").isNull(), F.col("n"))), F.lit(0)).alias("n_missing")), "accuracy", "f1")
    table = one.where("proba IS NOT NULL AND y IS NOT NULL").groupBy("model_id", "proba").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
    auc = S.auc_from_curve(S.curve_of(table, S.MODEL), S.MODEL).select("model_id", "roc_auc")
    return flat.join(auc, "model_id", "left").drop("model_id")
