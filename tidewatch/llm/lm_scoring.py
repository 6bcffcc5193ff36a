"""Cross-entropy difference of two language models.

A target model (documents that the caller flags) and a background model (all documents) are bigram models of the same vocabulary with the
same smoothing, and differ in counts alone: p(w | v) = (c(v w) + a) / (c(v) + a V), with c(v) how often v is followed by a word, V the
number of different words in all documents, and a = ``ADDED``. Every document is scored by models of all other documents: its own
words are taken out of the counts first, so no text speaks for itself. A document's score is the mean over its words of the target's loss
minus the background's; the lower, the more it reads like the target.

Counts are whole: every bigram and every context of every document counts, however rare. Keys (bigrams and contexts, as 64-bit hashes)
that are hot are counted first and looked up in the tasks that read the texts; all others are dealt by hash over ``buckets``, whose
number follows the number of words, so a bucket's size does not grow. A bucket has all occurrences of its keys, counts them and
sends back one row for each batch of documents, with the sums of those that have keys there. Texts are never shuffled, and which keys are hot decides the path, not the score.

Defined results: null texts and texts without words have no tokens and a null score; repeated rows count each time and are scored one by
one, each against the other; an empty target, or a corpus of one document, gives all words the same loss; an empty table gives no rows; rows with null
``target`` are not in the target; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.llm.common import BROADCAST_BYTES, SMALL_BATCH, map_batches, mix64, size_of, table, word_hashes, written, written_join
from tidewatch.llm.registry import query

#: What is added to every count.
ADDED = 0.1
#: Keys a task counts together to find hot ones, the share of these that makes a key hot, and the most hot keys (16 bytes of counts each).
TOGETHER, HOT_SHARE, HOT = 1 << 21, 1 / (1 << 17), 1 << 18
#: Keys that a bucket should have at most.
BUCKET_KEYS = 1 << 21
START = np.uint64(0x5851F42D4C957F2D)


def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and bigram key of every word, and where each text's words begin."""
    words, first = word_hashes(texts)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][np.diff(first) > 0]] = START
    context = mix64(before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return context, mix64(context ^ words * np.uint64(0xD6E8FEB86659FD93)), first


def most_frequent(counted: DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` rows of ``(k, n)`` with the highest ``n``, ties to the smaller ``k``.

    Histograms of ever finer cells find the last row wanted, so at most twice ``most`` rows reach the driver however many there are.
    """
    levels = [-F.floor(F.log2("n") * 8), -F.col("n"), *[F.shiftright("k", s) for s in (52, 40, 28, 16, 4, 0)]]
    chosen, border, left = F.lit(False), F.lit(True), most
    for level in levels:
        sizes = counted.where(border).groupBy(level.alias("cell")).count().orderBy("cell").toPandas()
        over = sizes[sizes["count"].cumsum() > left]
        if over.empty:
            break
        cell, rows = int(over["cell"].iloc[0]), int(over["count"].iloc[0])
        chosen = chosen | (border & (level < cell))
        left -= int(sizes.loc[sizes["cell"] < cell, "count"].sum())
        border = border & (level == cell)
        if rows <= most:
            break
    rows = counted.where(chosen | border).select("k", "n").toPandas()
    return rows.sort_values(["n", "k"], ascending=[False, True]).head(most)


def frequent_keys(docs: DataFrame, most: int) -> np.ndarray:
    """Sorted keys that are frequent among ``TOGETHER`` keys of some task, the ``most`` most frequent of them."""
    least = max(2, int(TOGETHER * HOT_SHARE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pd.DataFrame:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"k": k[n >= least].view(np.int64), "n": n[n >= least]})

        for batch in batches:
            context, bigram, _ = keys_of(list(batch["text"]))
            held += [context, bigram]
            size += 2 * len(context)
            if size >= TOGETHER:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    found = written(map_batches(docs.select("text"), run, "k long, n long", SMALL_BATCH).groupBy("k").agg(F.sum("n").alias("n")))
    return np.sort(most_frequent(found, most)["k"].to_numpy(np.int64).view(np.uint64))


def places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index of each key among sorted ones, -1 for others."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def hot_counts(docs: DataFrame, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """Occurrences of each hot key in the target and in all documents, and the number of words: exact, added up inside tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        total = np.zeros((2, len(known) + 1), np.int64)
        for batch in batches:
            context, bigram, first = keys_of(list(batch["text"]))
            inside = np.repeat(batch["target"].to_numpy(bool), np.diff(first))
            for keys in (context, bigram):
                at = places(keys, known)
                total[1] += np.bincount(at[at >= 0], minlength=len(known) + 1)
                at = at[inside]
                total[0] += np.bincount(at[at >= 0], minlength=len(known) + 1)
            total[1, -1] += len(context)
        side, k = np.nonzero(total)
        yield pd.DataFrame({"side": side.astype(np.int32), "k": k, "n": total[side, k]})

    rows = map_batches(docs.select("text", "target"), run, "side int, k long, n long", SMALL_BATCH).groupBy("side", "k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, len(hot) + 1), np.int64)
    out[rows["side"].to_numpy(np.int64), rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out[:, :-1], int(out[1, -1])


def vocabulary_size(docs: DataFrame) -> int:
    """Number of different words in all documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.unique(word_hashes(list(batch["text"]))[0]))
            if sum(map(len, held)) >= TOGETHER:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) >= TOGETHER:
                    yield pd.DataFrame({"word": held.pop().view(np.int64)})
        if held:
            yield pd.DataFrame({"word": np.unique(np.concatenate(held)).view(np.int64)})

    return map_batches(docs.select("text"), run, "word long", SMALL_BATCH).distinct().count()


def losses(is_context: np.ndarray, counts: np.ndarray, own: np.ndarray, flagged: np.ndarray, words: int) -> np.ndarray:
    """What each occurrence of a key adds to the target's and the background's loss, without its document's own occurrences.

    ``counts`` are those of the target and of all documents; a document's own ones are in the target's only if it is ``flagged``.
    """
    added = np.where(is_context, ADDED * max(words, 1), ADDED)
    sign = np.where(is_context, 1.0, -1.0)
    return np.stack([sign * np.log(counts[0] - np.where(flagged, own, 0) + added), sign * np.log(counts[1] - own + added)])


def _grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the columns (the last one first), where groups of equal rows begin in it, and their sizes."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    start = np.flatnonzero(new)
    return order, start, np.diff(start, append=len(order))


DEALT = "bucket int, row long, size int, keys binary, docs binary, ids binary, first binary"


def deal(docs: DataFrame, hot: Broadcast, buckets: int, words: int) -> DataFrame:
    """Rows for buckets: the keys of a batch of documents that are not hot, and, for one bucket of each batch, what is known of its documents.

    A key's lowest bit says whether it is a context; a document's number in its batch has the target flag as its lowest bit.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = hot.value
        for batch in batches:
            if not len(batch):
                continue
            context, bigram, first = keys_of(list(batch["text"]))
            n = np.diff(first)
            target = batch["target"].to_numpy(bool)
            doc = np.repeat(np.arange(len(batch)), n)
            sums = np.zeros((2, len(batch)))
            cold_keys, cold_docs = [], []
            for keys, is_context in ((context, True), (bigram, False)):
                at = places(keys, known)
                there = at >= 0
                code = doc[there] * max(len(known), 1) + at[there]
                code, own = np.unique(code, return_counts=True)
                d, k = code // max(len(known), 1), code % max(len(known), 1)
                for side, part in enumerate(losses(np.full(len(k), is_context), counts[:, k], own, target[d], words)):
                    sums[side] += np.bincount(d, weights=own * part, minlength=len(batch))
                cold_keys.append((keys[~there] & ~np.uint64(1)) | np.uint64(is_context))
                cold_docs.append(doc[~there])
            keys, of = np.concatenate(cold_keys), np.concatenate(cold_docs)
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keys, of = keys[order], (2 * of + target[of])[order].astype(np.uint32)
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            row = int(batch["row"].iloc[0])
            home = row % buckets
            present = np.union1d(np.flatnonzero(np.diff(edge)), [home])
            small = of.astype(np.uint16) if 2 * len(batch) < 1 << 16 else of
            ids = "\n".join("" if i is None else i for i in batch["doc_id"]).encode()
            yield pd.DataFrame({
                "bucket": present.astype(np.int32), "row": row, "size": len(batch), "keys": [keys[edge[b]:edge[b + 1]].tobytes() for b in present],
                "docs": [small[edge[b]:edge[b + 1]].tobytes() for b in present],
                "ids": [ids if b == home else None for b in present], "first": [np.stack([n, *sums]).tobytes() if b == home else None for b in present]})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text", "target")
    return map_batches(rows, run, DEALT, SMALL_BATCH)


PARTS = "row long, size int, docs binary, sums binary, ids binary, first binary"
SCORED = "doc_id string, n_tokens long, target_loss double, background_loss double"


def summed(words: int):
    """What a bucket makes of its rows: for each batch, the documents that have keys here and the sums of their keys' losses."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        sizes = part["size"].to_numpy(np.int64)
        lengths = part["keys"].map(len).to_numpy(np.int64) // 8
        keys = np.frombuffer(b"".join(part["keys"]), np.uint64)
        docs = [np.frombuffer(d, np.uint16 if 2 * s < 1 << 16 else np.uint32) for d, s in zip(part["docs"], sizes, strict=True)]
        doc = np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)
        # documents of all batches here, one after the other
        row, flagged = np.repeat(np.cumsum(sizes) - sizes, lengths) + (doc >> 1), (doc & 1).astype(bool)
        order, start, own = _grouped(row, keys)
        k, r, f = keys[order][start], row[order][start], flagged[order][start]
        # rows of one key follow each other
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        at = np.cumsum(new) - 1
        counts = np.stack([np.bincount(at, weights=own * f, minlength=0), np.bincount(at, weights=own, minlength=0)]) if len(k) else np.zeros((2, 0))
        both = losses((k & np.uint64(1)).astype(bool), counts[:, at], own, f, words) * own
        names, place = np.unique(r, return_inverse=True)
        sums = np.stack([np.bincount(place, weights=side, minlength=len(names)) for side in both], axis=1).astype(np.float32)
        ends = np.cumsum(sizes)
        edge = np.searchsorted(names, np.append(0, ends))
        here = [names[a:b] - (end - size) for a, b, end, size in zip(edge[:-1], edge[1:], ends, sizes, strict=True)]
        return part[["row", "size", "ids", "first"]].assign(
            docs=[x.astype(np.uint32).tobytes() for x in here], sums=[sums[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)])[
            ["row", "size", "docs", "sums", "ids", "first"]]

    return run


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each batch with the sums of all buckets; what belongs to a batch follows each other, and only one batch is held."""
    row, total, known = None, np.zeros((0, 2)), None

    def whole() -> pd.DataFrame:
        ids, (n, target, background) = known
        return pd.DataFrame({
            "doc_id": [i or None for i in ids.decode().split("\n")], "n_tokens": n.astype(np.int64),
            "target_loss": target + total[:, 0], "background_loss": background + total[:, 1]})

    for batch in batches:
        for r, size, docs, sums, ids, first in zip(*[batch[c] for c in ("row", "size", "docs", "sums", "ids", "first")], strict=True):
            if r != row:
                if known is not None:
                    yield whole()
                row, total, known = r, np.zeros((size, 2)), None
            total[np.frombuffer(docs, np.uint32)] += np.frombuffer(sums, np.float32).reshape(-1, 2)
            if first is not None:
                known = ids, np.frombuffer(first, float).reshape(3, -1)
    if known is not None:
        yield whole()


def score(docs: DataFrame, hot: int = HOT, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` of ``docs`` (doc_id, text, target), losses in nats per word."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    known = frequent_keys(docs, hot)
    counts, tokens = hot_counts(docs, known)
    words = vocabulary_size(docs)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * tokens // bucket_keys))
    dealt = deal(docs, spark.sparkContext.broadcast((known, counts)), buckets, words)
    parts = dealt.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(summed(words), PARTS)
    whole = map_batches(parts.repartition("row").sortWithinPartitions("row"), gathered, SCORED, SMALL_BATCH)
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens")).alias(c)
    return whole.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", mean("target_loss"), mean("background_loss")).withColumn("score", F.col("target_loss") - F.col("background_loss"))


def with_target(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(doc_id, text, target)``: whether the document's id is in ``wanted``."""
    ids = written(wanted.where("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("_in", F.lit(True)))
    out = written_join(docs.select("doc_id", "text"), ids, ["doc_id"]).select("doc_id", "text", F.coalesce("_in", F.lit(False)).alias("target"))
    # behind a shuffle a task that runs again must number its rows as before
    return out if 4 * size_of(ids) <= BROADCAST_BYTES else out.sortWithinPartitions("doc_id", "text")


@query("op4_lm_scoring")
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the documents labelled as good ones."""
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return score(with_target(table(spark, sf_dir, "documents"), good))
