"""Grouped prefix join for Jaccard similarity of word shingles.

Two sets of sizes n and m can only reach the threshold if they share a token among the first ``n - need + 1`` of each, in any order
that is the same for all sets. Documents with the same prefix and size form one group; only groups are joined. Rare tokens
come first in the order, so the tokens of passages that many documents share are hardly ever in a prefix.

The join finds all links that matter without writing out all pairs of a large family:

1. Groups that share a prefix token are put in the order of their size, and each is held against its neighbour; members of a
   group are held against its first one. Verified pairs link documents to components. This is linear in the prefixes.
2. Groups whose members are still in several components take all their prefix tokens, also those that no other group has. Of each
   token, members outside the largest component are held against one member of it; components that are tied become one. This is
   linear as well.
3. Of each token, members of all components but the largest are paired with the members of other components. Pairs that agree in
   size, parity sketch, position and number of common prefix tokens are expanded and verified. No pair of one component is looked at
   again, no pair of different components is left out, so components are exact.

Documents with equal sets are one node throughout. Sets are never written: they are computed again from the texts of the
documents whose pairs are verified. The order's table of frequent tokens is bounded by ``FREQUENT`` entries and only decides the order, not the result.

Tokens are 64-bit hashes of shingles; sets are compared by them.

Defined results: null texts, and texts without words, have no shingles and are linked with nothing; texts with fewer words than
a shingle have one, the whole sequence; rows that repeat an id come back as often as they stand, and are one node even if their
texts differ; rows without an id come back without component; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import SMALL_BATCH, forgotten, in_few_files, map_batches, mix64, salted_join, table, word_hashes, written, written_join
from tidewatch.llm.graph import components
from tidewatch.llm.registry import query

#: Entries of the table of frequent tokens that every task holds (16 bytes each).
FREQUENT = 1 << 18
CHAINS, CELLS = 8, 128
#: 64-bit words of a set's parity sketch.
PARITY_WORDS = 8
GATHERED = 2 << 20


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, first = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    if n >= width:
        k = np.uint64(0x9FB21C651E98DF25)
        part = hashes[:n - width + 1].copy()
        for i in range(1, width):
            part = part * k + hashes[i:n - width + 1 + i]
        rolled[:n - width + 1] = mix64(part)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(rolled[a:b - width + 1])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = short * np.uint64(0x9FB21C651E98DF25) + hashes[i]
            yield mix64(short)
        else:
            yield np.zeros(0, np.uint64)


def _fingerprint(tokens: np.ndarray, salt: int) -> np.uint64:
    return np.add.reduce(mix64(tokens ^ np.uint64(salt)), dtype=np.uint64) if len(tokens) else np.uint64(0)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def frequent_tokens(docs: DataFrame, width: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent tokens: those found in several sets that a task holds
    at once (``GATHERED`` tokens), summed over all tasks.

    All documents are read. The least count is the smallest for which the table stays below ``most`` entries.
    """
    def summed(seen: dict[tuple, np.ndarray]) -> pd.DataFrame:
        token, n = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        return pd.DataFrame({"token": token[n > 1].view(np.int64), "n": n[n > 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, np.ndarray] = {}
        held = 0
        for batch in batches:
            for tokens in shingle_sets(list(batch["text"]), width):
                key = len(tokens), int(_fingerprint(tokens, 1))
                if key not in seen:
                    seen[key] = tokens
                    held += len(tokens)
                if held >= GATHERED:
                    yield summed(seen)
                    seen, held = {}, 0
        if seen:
            yield summed(seen)

    counted = written(map_batches(docs.select("text"), run, "token long, n long", SMALL_BATCH).groupBy("token").agg(F.sum("n").alias("n")))
    steps = counted.groupBy(F.floor(F.log2("n") * 8).alias("step")).count().orderBy(F.desc("step")).toPandas()
    fits = steps[steps["count"].cumsum() <= most]
    if fits.empty:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = counted.where(F.floor(F.log2("n") * 8) >= F.lit(int(fits["step"].iloc[-1]))).toPandas()
    token = kept["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    forgotten(counted)
    return token[order], kept["n"].to_numpy(np.int64)[order]


def _ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens from rare to frequent (then by hash), and their weights: 0 for those outside the table."""
    known, counts = frequent
    if not len(known):
        return tokens, np.zeros(len(tokens), np.int64)
    place = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    weight = np.where(known[place] == tokens, counts[place], 0)
    order = np.argsort(weight, kind="stable")
    return tokens[order], weight[order]


def _prefix(tokens: np.ndarray, percent: int, frequent) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Prefix of a set, its weights, and the number of the group of sets with this prefix and size."""
    n = len(tokens)
    ordered, weight = _ordered(tokens, frequent)
    length = n - (percent * n + 99) // 100 + 1
    return ordered[:length], weight[:length], mix64(_fingerprint(ordered[:length], 3).reshape(1) + np.uint64(n))[0]


def _parity(tokens: np.ndarray) -> np.ndarray:
    """One bit per cell of the hash's upper half: whether the set has an odd number of tokens there."""
    bits = 64 * PARITY_WORDS
    odd = np.bincount(((tokens >> np.uint64(32)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differing() -> Column:
    """Least number of tokens that only one of two sets has: each changes one bit of the parities ``q1`` and ``q2``."""
    return sum((F.bit_count(F.col("q1")[i].bitwiseXOR(F.col("q2")[i])) for i in range(PARITY_WORDS)), F.lit(0))


SCAN = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("gid", pa.int64()), ("unit", pa.int32()), ("sketch", pa.list_(pa.int8())),
    ("parity", pa.list_(pa.int64())), ("token", pa.int64()), ("chain", pa.int32()), ("pos", pa.int32())])


def scan(docs: DataFrame, width: int, percent: int, frequent, keys: bool = True) -> DataFrame:
    """One pass over the texts that gives two kinds of rows.

    Rows without ``token``, one a document (left out without ``keys``): set size and fingerprint, group, how many tokens fall in each of ``CELLS`` cells (in units of ``unit``),
    and parities. Rows with ``token``: the prefix tokens of groups, once a batch, with ``chain`` and place; frequent tokens are dealt over
    ``CHAINS`` chains, others have one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SMALL_BATCH))

    def rows(length: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(length, f.type)) for f in SCAN], schema=SCAN)

    def lists(flat: list[np.ndarray], size: int, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * size, pa.array(np.concatenate(flat), kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of_docs, units, cells, odd, prefixes, groups = [], [], [], [], [], set()
            for tokens in shingle_sets(batch.column("text").to_pylist(), width):
                held = np.bincount((tokens & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                # in units, rounded up, so that a cell takes one byte
                units.append(max(1, -(-int(held.max()) // 127)))
                cells.append((-(-held // units[-1])).astype(np.int8))
                odd.append(_parity(tokens))
                group = np.uint64(0)
                if len(tokens):
                    prefix, weight, group = _prefix(tokens, percent, shared.value)
                    if int(group) not in groups:
                        groups.add(int(group))
                        chain = np.where(weight > 0, 1 + int(group % np.uint64(CHAINS)), 0).astype(np.int32)
                        prefixes.append((prefix, chain, np.full(len(prefix), group), np.full(len(prefix), len(tokens), np.int32), np.arange(len(prefix), dtype=np.int32)))
                of_docs.append((len(tokens), _fingerprint(tokens, 1), _fingerprint(tokens, 2), group))
            if keys:
                n, f1, f2, gid = (np.array(x) for x in zip(*of_docs, strict=True))
                yield rows(len(n), doc_id=batch.column("doc_id"), n=pa.array(n.astype(np.int32)), f1=pa.array(f1.view(np.int64)), f2=pa.array(f2.view(np.int64)),
                           gid=pa.array(gid.view(np.int64)), unit=pa.array(units, pa.int32()), sketch=lists(cells, CELLS, pa.int8()), parity=lists(odd, PARITY_WORDS, pa.int64()))
            if prefixes:
                token, chain, gid, n, pos = (np.concatenate(x) for x in zip(*prefixes, strict=True))
                yield rows(len(token), token=pa.array(token.view(np.int64)), chain=pa.array(chain), gid=pa.array(gid.view(np.int64)), n=pa.array(n), pos=pa.array(pos))

    schema = "doc_id long, n int, f1 long, f2 long, gid long, unit int, sketch array<tinyint>, parity array<long>, token long, chain int, pos int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def token_lists(prefixes: DataFrame) -> DataFrame:
    """The prefix rows of groups that share a token, once each; tokens outside the frequent table are left out if only one group has them."""
    dealt = prefixes.repartition("token", "chain").distinct()
    here = F.count("*").over(Window.partitionBy("token", "chain"))
    return dealt.withColumn("here", here).where("chain > 0 OR here > 1").drop("here")


def token_members(docs: DataFrame, lists: DataFrame, named: DataFrame, firsts: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """``(token, node, comp, n, pos)`` of every token that members of several components may share.

    ``lists`` is without the tokens of one group alone, which is enough only for a group within one component. Of the others all prefix
    tokens are taken from one member's text.
    """
    split = written(named.groupBy("gid").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").join(
        firsts, "gid").select("gid", F.col("first").alias("doc_id"), F.lit(True).alias("_split")), narrow=True)
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    read = written_join(texts, split.select("doc_id").distinct(), ["doc_id"], "left_semi")
    # an id may stand for several texts, so groups are named by what their texts give
    whole = scan(read, width, percent, frequent, keys=False).select("token", "gid", "n", "pos").distinct()
    marked = written(written_join(named.select("gid", "node", "comp"), split.select("gid", "_split"), ["gid"]))
    of_lists = lists.select("token", "gid", "n", "pos").join(marked.where("_split IS NULL"), "gid")
    return of_lists.unionByName(whole.join(marked.where("_split"), "gid")).select("token", "node", "comp", "n", "pos")


def _reachable(percent: int, bound: Column) -> Column:
    """Whether an overlap of at most ``bound`` can be enough: overlap / (n1 + n2 - overlap) at or above the threshold."""
    return bound * (100 + percent) >= (F.col("n1") + F.col("n2")) * percent


def _alike_sizes(percent: int) -> Column:
    return (F.col("n1") * 100 >= F.col("n2") * percent) & (F.col("n2") * 100 >= F.col("n1") * percent)


def verified(docs: DataFrame, pairs: DataFrame, of_docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose sets reach the threshold; ``of_docs`` has the sketch of every document.

    Two sets cannot share more tokens than the smaller count of each cell of their sketches; what this leaves is held against each
    other token by token.
    """
    pairs = written(pairs.select("a", "b").distinct(), narrow=True)
    named = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), narrow=True)
    # only the sketches of nodes in pairs are dealt out, once each; adaptive execution splits a hot side of these joins
    sketch = written_join(of_docs.select(F.col("doc_id").alias("node"), "n", "f1", "f2", "unit", "sketch"), named, ["node"], "left_semi")
    sketch = sketch.repartition("node").dropDuplicates(["node", "n", "f1", "f2"]).select("node", "n", "unit", "sketch")
    one = pairs.join(sketch.toDF("a", "n1", "u1", "s1"), "a")
    two = one.join(sketch.toDF("b", "n2", "u2", "s2"), "b")
    most = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.least(x * F.col("u1"), y * F.col("u2"))), F.lit(0), lambda x, y: x + y)
    near = in_few_files(two.where(_alike_sizes(percent) & _reachable(percent, most)).select("a", "b"))
    needed = written(near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), narrow=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lists = [tokens.view(np.int64) for tokens in shingle_sets(list(batch["text"]), width)]
            yield pd.DataFrame({"id": batch["doc_id"].to_numpy(), "tokens": pd.Series(lists, dtype=object)})

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    sets = map_batches(written_join(rows, needed, ["doc_id"], "left_semi"), run, "id long, tokens array<long>", SMALL_BATCH)
    left = near.join(sets.toDF("a", "left"), "a")
    both = left.join(sets.toDF("b", "right"), "b")
    common = F.size(F.array_intersect("left", "right"))
    links = in_few_files(both.where(common * 100 >= (F.size("left") + F.size("right") - common) * percent).select("a", "b"))
    forgotten(pairs, named, near, needed)
    return links


def _united(links: DataFrame, ends: DataFrame) -> DataFrame:
    """``(comp, component)`` for components that links of their nodes tie together; found on the components alone."""
    tied = components(links.join(ends.toDF("a", "ca"), "a").join(ends.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return tied.select(F.col("node").alias("comp"), "component")


def _renamed(rows: DataFrame, united: DataFrame) -> DataFrame:
    """The rows with the new names of united components; ``tied``, where there is one, marks nodes with links."""
    out = rows.join(united, "comp", "left")
    if "tied" in rows.columns:
        out = out.withColumn("tied", F.col("tied") | F.col("component").isNotNull())
    return out.withColumn("comp", F.coalesce("component", "comp")).drop("component")


def _mixed(members: DataFrame) -> DataFrame:
    """``(token, main)``: tokens with members of several components, and the component that has most of them."""
    by_comp = members.groupBy("token", "comp").agg(F.count("*").alias("held"))
    return by_comp.groupBy("token").agg(
        F.max_by("comp", F.struct("held", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")


def join_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (doc_id, text)."""
    frequent = frequent_tokens(docs, width)
    scanned = written(scan(docs, width, percent, frequent))
    lists = written(token_lists(scanned.where("token IS NOT NULL").select("token", "chain", "gid", "n", "pos")))
    # the prefixes are most of what was scanned, and nothing reads them again
    of_docs = written(scanned.where("token IS NULL").select("doc_id", "n", "f1", "f2", "gid", "unit", "sketch", "parity"), narrow=True)
    forgotten(scanned)
    # equal sets are one node, named by the smallest id
    nodes = written(of_docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("gid").alias("gid"), F.first("parity").alias("parity")))
    firsts = written(nodes.groupBy("gid").agg(F.min("node").alias("first"), F.count("*").alias("members")))

    # 1. neighbours by size within each token, and members against their group's first
    near = Window.partitionBy("token", "chain").orderBy("n", "gid")
    chained = lists.select(
        "gid", F.col("n").alias("n1"), "pos", F.lag("gid").over(near).alias("gid2"), F.lag("n").over(near).alias("n2"), F.lag("pos").over(near).alias("pos2"))
    bound = F.least("pos", "pos2") + F.least(F.col("n1") - F.col("pos"), F.col("n2") - F.col("pos2"))
    chained = chained.where(F.col("gid2").isNotNull() & _alike_sizes(percent) & _reachable(percent, bound)).select("gid", "gid2").distinct()
    of_group = firsts.select("gid", "first")
    heads = chained.join(of_group.withColumnRenamed("first", "a"), "gid").join(of_group.toDF("gid2", "b"), "gid2").select("a", "b")
    inside = nodes.select("node", "gid").join(firsts.where("members > 1"), "gid").where("node <> first").select(
        F.col("first").alias("a"), F.col("node").alias("b"))
    links = verified(docs, heads.unionByName(inside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), of_docs, width, percent)
    comp = components(links)

    # 2. what is still apart, per token
    named = written(nodes.select("node", "gid", "n", "f1", "f2", "copies").join(comp, "node", "left").select(
        "node", "gid", "n", "f1", "f2", "copies", F.coalesce("component", "node").alias("comp"), F.col("component").isNotNull().alias("tied")))
    members = written(token_members(docs, lists, named, firsts, width, percent, frequent))
    forgotten(lists, firsts)
    apart = written(members.join(_mixed(members), "token").join(nodes.select("node", "parity"), "node"))
    forgotten(members, nodes)
    # members that one of the largest component stands for: of each token, the one with the fewest rarer tokens
    most = (F.col("n1") + F.col("n2") - _differing()) / 2
    hubs = apart.where("comp = main").groupBy("token").agg(F.min_by(F.struct("node", "n", "parity"), F.struct("pos", "node")).alias("hub")).select(
        "token", F.col("hub.node").alias("b"), F.col("hub.n").alias("n2"), F.col("hub.parity").alias("q2"))
    led = apart.where("comp <> main").select("token", F.col("node").alias("a"), F.col("n").alias("n1"), F.col("parity").alias("q1")).join(hubs, "token")
    led = led.where(_alike_sizes(percent) & _reachable(percent, most)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    first_round = written(_united(verified(docs, led, of_docs, width, percent), named.select("node", "comp")), narrow=True)
    named = written(_renamed(named, first_round))
    met_first, apart = apart, _renamed(apart.drop("main"), first_round)
    apart = written(apart.join(_mixed(apart), "token"))
    forgotten(met_first)
    minor = apart.where("comp <> main").select("token", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("parity").alias("q1"))
    others = apart.select("token", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("main"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("parity").alias("q2"))
    # pairs of two minor members are met from either side and kept once
    # the parities bound the overlap, so members of a family that are not alike do not leave the join
    met = minor.join(others, "token").where(
        (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))) & _alike_sizes(percent) & _reachable(percent, most))
    # the last shared token of both prefixes has the highest place in either
    bound = F.col("shared") + F.least(F.col("n1") - F.col("p1") - 1, F.col("n2") - F.col("p2") - 1)
    pairs = met.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.struct("n1", "p1", "n2", "p2")).otherwise(
            F.struct(F.col("n2").alias("n1"), F.col("p2").alias("p1"), F.col("n1").alias("n2"), F.col("p1").alias("p2"))).alias("at"),
    ).groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.first("at.n1").alias("n1"), F.first("at.n2").alias("n2"), F.max("at.p1").alias("p1"), F.max("at.p2").alias("p2"),
    ).where(_reachable(percent, bound))
    more = verified(docs, pairs, of_docs, width, percent)
    forgotten(apart)
    whole = _renamed(named, _united(more, named.select("node", "comp")))
    # documents that are alone need no row here
    result = whole.where("copies > 1 OR tied").select("n", "f1", "f2", F.col("comp").alias("component"))
    out = salted_join(of_docs.select("doc_id", "n", "f1", "f2"), result, ["n", "f1", "f2"], F.col("doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document: four words, at least 85 of 100."""
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
