"""Connected components of links, as joins and aggregates over the links alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import SMALL_BATCH, forgotten, map_batches, written

#: Links that a task looks at together.
TOGETHER = 1 << 20


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node) that tie together what the given links tie together."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    top = np.arange(len(nodes))
    while True:
        left, right = top[x], top[y]
        apart = left != right
        if not apart.any():
            break
        low = np.minimum(left[apart], right[apart])
        np.minimum.at(top, left[apart], low)
        np.minimum.at(top, right[apart], low)
        while True:
            above = top[top]
            if (above == top).all():
                break
            top = above
    tied = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[tied], nodes[top[tied]]


def _forest(links: DataFrame, wrong: Accumulator | None = None) -> DataFrame:
    """What each task's links tie together, as stars: at most one row a node and task. ``wrong`` adds up that column."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left, right, held = [], [], 0
        for batch in batches:
            if wrong is not None:
                wrong.add(int(batch["wrong"].sum()))
            left.append(batch["a"].to_numpy(np.int64))
            right.append(batch["b"].to_numpy(np.int64))
            held += len(batch)
            if held >= TOGETHER:
                a, b = local_stars(np.concatenate(left), np.concatenate(right))
                if 2 * len(a) > held:  # nothing more to join here
                    yield pd.DataFrame({"a": a, "b": b})
                    left, right, held = [], [], 0
                else:
                    left, right, held = [a], [b], len(a)
        if held:
            a, b = local_stars(np.concatenate(left), np.concatenate(right))
            yield pd.DataFrame({"a": a, "b": b})

    return map_batches(links, run, "a long, b long", SMALL_BATCH)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b); the component is its smallest node.

    Each round ties every node and its neighbours to the smallest among them, until all links are stars; before and after, every task
    replaces its links by stars. The number of rounds grows with the logarithm of the longest path. A round is one job, which
    also counts what was wrong with the links that went into it: nodes with two larger ends, or in the middle.
    """
    spark = links.sparkSession
    edges = written(_forest(links.where("a <> b").select("a", "b")), narrow=True)
    while True:
        wrong = spark.sparkContext.accumulator(0)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("b").alias("up")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(None).cast("long").alias("up")))
        least = both.groupBy("u").agg(
            F.least(F.min("v"), F.col("u")).alias("low"), F.min("up").alias("first"), F.max("up").alias("last"), F.count("*").alias("all"), F.count("up").alias("ups"),
        ).select("u", "low", F.coalesce((F.col("first") != F.col("last")) | ((F.col("ups") > 0) & (F.col("ups") < F.col("all"))), F.lit(False)).cast("int").alias("wrong"))
        tied = both.select("u", "v").join(least, "u").select(F.col("v").alias("a"), F.col("low").alias("b"), "wrong").unionByName(
            least.select(F.col("u").alias("a"), F.col("low").alias("b"), F.lit(0).alias("wrong")))
        nearer = written(_forest(tied, wrong), narrow=True)
        if not wrong.value:
            forgotten(nearer)
            edges = edges.distinct()
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        forgotten(edges)
        edges = nearer
