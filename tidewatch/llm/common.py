"""Helpers the corpus operators share: reading, checkpoints, joins with small or skewed sides, words as hashes."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.session import ready_to_checkpoint, scratch_path

#: Words of the contracts: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A table may be broadcast when it was written, counted and found below this.
BROADCAST_BYTES = 8 << 20
SALTS = 8
#: Bytes of text that are turned into arrays at once.
CHUNK = 1 << 19
#: Bytes of a batch that Python tasks get at once (a longer row comes alone).
BATCH_BYTES = 8 << 20
#: The same for operators whose tasks hold several arrays for each byte of text.
SMALL_BATCH = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that all executors share."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, narrow: bool = False) -> DataFrame:
    """The rows, written as Parquet to the folder that all executors share: a short plan with pruned columns and a known size.

    Tables of a few ``narrow`` columns get an eighth of the usual number of tasks and files.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(few(spark))
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(spark: SparkSession) -> int:
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)


def in_few_files(df: DataFrame) -> DataFrame:
    """``written`` for the few narrow rows that costly tasks leave over: the tasks stay as many as they are, their rows are dealt to a few that write."""
    return written(df.repartition(few(df.sparkSession)))


def forgotten(*tables: DataFrame) -> None:
    """Removes what ``written`` wrote; nothing may read these tables any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """Bytes of a written table, as the files are."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def written_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join with a table that was written: broadcast if its files are far below ``BROADCAST_BYTES``, else by shuffle, hot keys split by adaptive execution."""
    return left.join(F.broadcast(right) if 4 * size_of(right) <= BROADCAST_BYTES else right, on, how)


def map_batches(df: DataFrame, run, schema: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``mapInPandas`` over batches of bounded bytes, so a task's memory does not depend on the length of texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df.mapInPandas(run, schema)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Equi-join whose keys may be hot on the left: each key is dealt over ``SALTS`` tasks by ``spread``.

    ``right`` has at most one row per key and is copied to every salt.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def small_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Join with a written table that is usually small: broadcast if its measured size allows, else salted."""
    size = right.select(F.sum(F.length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0
    if 4 * size <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on, how)
    return salted_join(left, right, on, spread, how)


def shield(docs: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """The table with all columns but the ``known`` ones renamed by place, so that none can clash with other names, in any case."""
    names, seen = [], set()
    for i, c in enumerate(docs.columns):
        names.append(c if c in known and c not in seen else f"x{i}")
        seen.add(c)
    return docs.toDF(*names)


def shielded(docs: DataFrame, known: tuple[str, ...], stage) -> DataFrame:
    """``stage`` of the shielded table; the result has the columns of ``docs``, under their names."""
    rows = shield(docs, known)
    return stage(rows).select(*rows.columns).toDF(*docs.columns)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null for null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def worker_cache(name: str, make):
    """A value kept in the Python worker between tasks."""
    kept = sys.__dict__.setdefault("_tidewatch_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n``; one table per worker, which a longer word makes grow."""
    kept = worker_cache("powers", dict)
    if len(kept.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            kept[name] = np.cumprod(out, dtype=np.uint64)
    return kept["up"], kept["down"]


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts in order, and where each text's words begin (one more than texts).

    A word's polynomial over its bytes comes from prefix sums modulo 2**64; A-Z count as a-z if ``lower``.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(x) + 1 for x in raw), np.int64, len(raw))
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    firsts = np.cumsum(sizes) - sizes
    hashes, places, at = [], [], 0
    while at < len(joined):
        piece = joined[at:at + CHUNK]
        blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
        end = len(piece)
        if at + end < len(joined):  # end behind white space, so no word is cut
            if blank.any():
                end = end - int(np.argmax(blank[::-1]))
            else:
                rest = joined[at + end:]
                end += int(np.argmax((rest == 32) | ((rest >= 9) & (rest <= 13)))) + 1
                piece = joined[at:at + end]
                blank = (piece == 32) | ((piece >= 9) & (piece <= 13))
            piece, blank = piece[:end], blank[:end]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1, append=1))
        start, stop = edge[0::2], edge[1::2]
        if len(start):
            power, inverse = _powers(end + 1)
            code = piece.astype(np.uint64)
            if lower:
                code[(piece >= 65) & (piece <= 90)] += np.uint64(32)
            sums = np.zeros(end + 1, np.uint64)
            np.cumsum((code + np.uint64(1)) * power[:end], out=sums[1:], dtype=np.uint64)
            value = (sums[stop] - sums[start]) * inverse[start]
            hashes.append(mix64(value + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
            places.append(start + at)
        at += end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    place = np.concatenate(places)
    return np.concatenate(hashes), np.append(np.searchsorted(place, firsts), len(place))
