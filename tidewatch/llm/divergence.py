"""Which terms set a source apart from its language, and how far sources of a language are from each other.

Terms are counted in tasks by length-bucketed packing: a term of up to eight bytes is one unsigned 64-bit word, one of up to sixteen is two,
read straight out of the text's bytes; words are radix-sorted by sixteen bits at a time and equal neighbours counted. Longer terms are
kept in buckets of equal length, sorted as bytes. Rows of a batch are in the order of their group and document, and all sorts are
stable, so the same pass gives occurrences per group and documents per term. Spark adds the counts up.

Of the terms in at least ``LEAST_DOCS`` documents of their language each group (language and source) and each language has a share
in whole billionths, p = 1 + floor(10^9 (count + 1) / (N + V)), and what a term adds to the divergence of shares p from q is
floor((p - q)^2 / q). All arithmetic is on whole numbers.

Part ``term`` are the terms a group has more of than its language, part ``pair`` every two sources of a language, summed over all kept
terms. For the pairs each kept term is one row with the shares of the sources that have it; tasks fill in the others' and
add whole blocks of terms at once, so the rows that leave a task are pairs of sources, not pairs for each term.

Defined results: null texts, languages and sources count as empty strings; a group without terms has count 0 for every kept term; languages without
kept terms have pairs of value 0 and no terms; a language with one source has no pairs; repeated rows count each time; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidewatch.llm.common import checkpointed, map_batches, table
from tidewatch.llm.registry import query

LEAST_DOCS, SHOWN = 3, 200
#: Bytes of texts that are packed at once.
TOGETHER = 4 << 20
#: Cells of the block of terms by sources that is worked on at once.
BLOCK = 1 << 18


def radix_order(words: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Stable order of unsigned 64-bit words by sixteen bits at a time, beginning from ``order``."""
    if order is None:
        order = np.arange(len(words))
    for shift in (0, 16, 32, 48):
        digit = (words >> np.uint64(shift)).astype(np.uint16)
        if len(digit) and digit.min() != digit.max():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def term_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with A-Z as a-z, and start, length and text of every term: runs of letters a-z and of bytes beyond ASCII."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    code = np.frombuffer(b"\0".join(texts) + b"\0" * 17, np.uint8).copy()
    code[(code >= 65) & (code <= 90)] += 32
    inside = ((code >= 97) & (code <= 122)) | (code >= 128)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, length = edge[0::2], edge[1::2] - edge[0::2]
    return code, start, length, np.searchsorted(np.cumsum(sizes), start, side="right")


def _counted(sorted_group: np.ndarray, sorted_doc: np.ndarray, new_term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First place, group, occurrences and documents of every (term, group) of sorted terms."""
    new = new_term.copy()
    new[1:] |= sorted_group[1:] != sorted_group[:-1]
    new_doc = new.copy()
    new_doc[1:] |= sorted_doc[1:] != sorted_doc[:-1]
    at = np.flatnonzero(new)
    return at, sorted_group[at], np.diff(at, append=len(new)), np.add.reduceat(new_doc, at, dtype=np.int64)


def count_terms(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """``(terms, group, occurrences, documents)`` of every term and group, one bucket of lengths after the other; ``groups`` must ascend."""
    code, start, length, doc = term_places(texts)
    group = groups[doc] if len(doc) else doc
    # a word may begin at any byte; the most significant byte is the first, so words sort as text does
    at_byte = np.ndarray(len(code) - 7, ">u8", code.tobytes(), strides=(1,))
    masks = np.array([0] + [(1 << 64) - (1 << (64 - 8 * n)) for n in range(1, 9)], np.uint64)
    for low, high in ((1, 8), (9, 16)):
        some = np.flatnonzero((length >= low) & (length <= high))
        if not len(some):
            continue
        n, at = length[some], start[some]
        words = [at_byte[at].astype(np.uint64) & masks[np.minimum(n, 8)]]
        if high > 8:
            words.append(at_byte[at + 8].astype(np.uint64) & masks[n - 8])
        order = None
        for word in reversed(words):
            order = radix_order(word, order)
        new = np.zeros(len(some), bool)
        new[0] = True
        for word in words:
            w = word[order]
            new[1:] |= w[1:] != w[:-1]
        first, g, times, docs = _counted(group[some][order], doc[some][order], new)
        packed = np.stack([w[order][first] for w in words], axis=1).astype(">u8").tobytes()
        width = 8 * len(words)
        yield [packed[i:i + width].rstrip(b"\0") for i in range(0, len(packed), width)], g, times, docs
    long = np.flatnonzero(length > 16)
    for size in np.unique(length[long]).tolist():
        some = long[length[long] == size]
        # so many at once that a bucket's bytes stay bounded; parts are added up later
        step = max(1, TOGETHER // size)
        for k in range(0, len(some), step):
            part = some[k:k + step]
            rows = code[start[part][:, None] + np.arange(size)].view(f"S{size}").ravel()
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            new = np.ones(len(part), bool)
            new[1:] = rows[1:] != rows[:-1]
            first, g, times, docs = _counted(group[part][order], doc[part][order], new)
            yield rows[first].tolist(), g, times, docs


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of every term in every group, added up over all documents."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = list(zip(batch["lang"], batch["source"], strict=True))
            number = {name: i for i, name in enumerate(sorted(set(names)))}
            of = np.array([number[name] for name in names], np.int64)
            order = np.argsort(of, kind="stable")
            known = list(number)
            raw = [t.encode("utf-8", "surrogatepass") for t in batch["text"].iloc[order]]
            total = np.cumsum([len(t) for t in raw])
            at = 0
            while at < len(raw):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER, side="right")))
                for terms, group, n, docs_of in count_terms(raw[at:end], of[order][at:end]):
                    yield pd.DataFrame({
                        "lang": [known[g][0] for g in group], "source": [known[g][1] for g in group],
                        "term": [t.decode("utf-8", "surrogatepass") for t in terms], "n": n, "docs": docs_of})
                at = end

    counted = map_batches(docs, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str, kept: str) -> F.Column:
    """1 + floor(10^9 (count + 1) / (total + kept)), in decimals wide enough for any corpus."""
    wide = "cast({} AS decimal(20,0))"
    return F.expr(f"1 + cast(1000000000 AS decimal(10,0)) * ({wide.format(count)} + 1) div ({wide.format(total)} + {wide.format(kept)})")


def _pair_sums(rows: DataFrame) -> DataFrame:
    """``(lang, a, b, value)``: sums of what each term adds to the divergence of source ``a`` from source ``b``, by places of sources.

    ``rows`` (lang, missing, at, share): per term the shares of sources that have it, by place, and the share of each source in a term it lacks.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang", sort=False):
                missing = np.asarray(part["missing"].iloc[0], np.int64)
                s = len(missing)
                total = sums.setdefault(lang, np.zeros((s, s), np.int64))
                step = max(1, BLOCK // s)
                for k in range(0, len(part), step):
                    some = part.iloc[k:k + step]
                    p = np.tile(missing, (len(some), 1))
                    width = np.fromiter(map(len, some["at"]), np.int64, len(some))
                    if width.sum():
                        p[np.repeat(np.arange(len(some)), width), np.concatenate(list(some["at"]))] = np.concatenate(list(some["share"]))
                    for a in range(s):
                        far = p[:, a:a + 1] - p
                        total[a] += (far * far // p).sum(axis=0)
        for lang, total in sums.items():
            a, b = np.nonzero(~np.eye(len(total), dtype=bool))
            yield pd.DataFrame({"lang": lang, "a": a.astype(np.int32), "b": b.astype(np.int32), "value": total[a, b]})

    summed = map_batches(rows, run, "lang string, a int, b int, value long")
    return summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, shown: int = SHOWN) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of ``docs`` (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counted = checkpointed(term_counts(docs))
    # one row per kept term of a language, with the groups that have it
    kept = checkpointed(counted.groupBy("lang", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("has")).where(F.col("docs") >= least_docs).drop("docs"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("all"), F.count("*").alias("kept"))
    of_group = kept.select("lang", F.explode("has").alias("h")).groupBy("lang", F.col("h.source").alias("source")).agg(F.sum("h.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    # groups are few beside documents; their place is that of the name among the language's sources
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = checkpointed(groups.select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "all", "kept")], (F.row_number().over(by_name) - 1).alias("at")))

    has = kept.select("lang", "term", F.col("n").alias("of_all"), F.explode("has").alias("h")).select("lang", "term", "of_all", "h.source", "h.n")
    shares = has.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "at", _share("n", "total", "kept").alias("p"), _share("of_all", "all", "kept").alias("q"))
    added = F.expr("(p - q) * (p - q) div q")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), added.alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown)

    # a language without kept terms has no share at all, and its pairs a value of 0
    sources = groups.where("kept > 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", _share("0", "total", "kept").alias("p")))), lambda x: x["p"]).alias("missing"))
    per_term = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("has"))
    sums = _pair_sums(per_term.join(sources, "lang").select("lang", "missing", F.col("has.at").alias("at"), F.col("has.p").alias("share")))
    names = groups.select("lang", "at", "source")
    two = names.join(names.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), "lang").where("at <> b")
    pairs = two.join(sums.withColumnRenamed("a", "at"), ["lang", "at", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT d, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3
), has AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), langs AS (SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY 1
), groups AS (
  SELECT g.lang, g.source, coalesce(sum(h.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN has h USING (lang, source) GROUP BY 1, 2
), shares AS (
  SELECT k.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (g.total + l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM kept k JOIN langs l USING (lang) JOIN groups g USING (lang) LEFT JOIN has h ON h.lang = k.lang AND h.source = g.source AND h.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (
    SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources of each language, and the 200 terms that set each source apart."""
    return audit(table(spark, sf_dir, "documents"))
