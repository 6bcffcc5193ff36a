"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words, their beginnings and letter sequences is fitted on labelled documents. For every training document
that mentions an identity term, copies are made in which the term is swapped for others of its group or left out, and the squared
change of the score's log-odds is penalised, so that a neutral mention of a group does not make a text toxic.

The model is fitted in one task on at most about ``SAMPLE`` labelled documents drawn by a hash of the id (the documented bound),
which come as sets of different words, not as texts; all documents are scored, whole. Features count once per document; those whose frequency does not differ between the labels (chi-square
below ``CHI``) are left out, so the length of a text adds no noise.

Defined results: null and empty texts get the score of a text without features; null labels are not learned from; repeated rows
are scored one by one and repeated labels count as often as they stand; without labels of both kinds every score is the share of
toxic ones (0 if there are none); an empty table gives no rows; further columns are kept by ``score``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import crc_mod, map_batches, table
from tidewatch.llm.registry import query

SAMPLE = 8000
LEAST_DOCS = 3
CHI = 15.0
RIDGE, FAIRNESS = 0.002, 5.0
STEPS, RATE = 400, 0.1
KEPT_WORDS = 300_000

#: Terms that name groups of people, by kind; within a kind one can stand for another.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"), ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"), ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind"), ("old", "young"), ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_WORD = re.compile(r"[^\W_]+")


def features(word: str) -> set[str]:
    """The word itself, its first three to six letters, and its sequences of four letters with borders."""
    bound = f"^{word}$"
    return {f"={word}", *(bound[:n] for n in range(4, 8) if n < len(bound)), *(bound[i:i + 4] for i in range(1, len(bound) - 3))}


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    known: dict[str, tuple] = field(default_factory=dict)

    def margin(self, text: str | None) -> float:
        hits: set[str] = set()
        known = self.known
        for word in words(text):
            found = known.get(word)
            if found is None:
                if len(known) >= KEPT_WORDS:
                    known.clear()
                found = known[word] = tuple(f for f in features(word) if f in self.weights)
            if found:
                hits.update(found)
        return self.bias + sum(self.weights[f] for f in sorted(hits))

    def score(self, text: str | None) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.margin(text), -500, 500))))


def _swaps(found: set[str]) -> Iterator[set[str]]:
    """The words with one identity term swapped for each other of its group, or left out."""
    for group in IDENTITY_GROUPS:
        for term in group:
            if term in found:
                yield found - {term}
                for other in group:
                    if other != term:
                        yield (found - {term}) | {other}


def fit_model(found: list[set[str]], toxic: list[int], fairness: float = FAIRNESS) -> Model:
    """Logistic regression with the counterfactual penalty, by Adam on all rows: the words of each document."""
    y = np.array(toxic, float)
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))), {})
    by_word: dict[str, set[str]] = {}
    plain, bad = Counter(), Counter()
    for ws, label in zip(found, y, strict=True):
        of_doc: set[str] = set()
        for w in ws:
            if w not in by_word:
                by_word[w] = features(w)
            of_doc |= by_word[w]
        (bad if label else plain).update(of_doc)
    n1, n0 = y.sum(), len(y) - y.sum()
    names = sorted(f for f in {*plain, *bad} if plain[f] + bad[f] >= LEAST_DOCS)
    a, b = np.array([bad[f] for f in names], float), np.array([plain[f] for f in names], float)
    c, d = n1 - a, n0 - b
    chi = len(y) * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n1 * n0, 1e-9)
    names = [f for f, x in zip(names, chi, strict=True) if x >= CHI]
    place = {f: i for i, f in enumerate(names)}

    def sparse(sets: list[set[str]]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols = [], []
        for i, ws in enumerate(sets):
            used = {place[f] for w in ws for f in (by_word.get(w) or features(w)) if f in place}
            rows += [i] * len(used)
            cols += used
        return np.array(rows, np.int64), np.array(cols, np.int64)

    rows, cols = sparse(found)
    pairs = [(ws, other) for ws in found for other in _swaps(ws)]
    r1, c1 = sparse([p[0] for p in pairs])
    r2, c2 = sparse([p[1] for p in pairs])
    drows, dcols = np.concatenate([r1, r2]), np.concatenate([c1, c2])
    sign = np.concatenate([np.ones(len(r1)), -np.ones(len(r2))])
    w, bias = np.zeros(len(names)), float(np.log(n1 / n0))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(rows, weights=w[cols], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        grad = np.bincount(cols, weights=error[rows], minlength=len(names)) + RIDGE * w
        if pairs:
            change = np.bincount(drows, weights=sign * w[dcols], minlength=len(pairs))
            grad += 2 * fairness / len(pairs) * np.bincount(dcols, weights=sign * change[drows], minlength=len(names))
        grad = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), {f: float(x) for f, x in zip(names, w, strict=True) if x})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Model from ``(doc_id, toxic)`` and the texts of ``docs``; at most about ``sample`` rows, drawn by a hash of the id."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    n = known.count()
    cut = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity model")), F.lit(1 << 20)) < cut)
    # the drawn ids are bounded by the sample
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "words": [" ".join(sorted(words(t))) for t in batch["text"]], "toxic": batch["_toxic"]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = sorted((row for batch in batches for row in zip(batch["doc_id"], batch["words"], batch["toxic"], strict=True)))
        model = fit_model([set(text.split(" ")) - {""} for _, text, _ in drawn], [toxic for _, _, toxic in drawn])
        yield pd.DataFrame({"feature": ["", *model.weights], "weight": [model.bias, *model.weights.values()]})

    reduced = map_batches(rows, reduce, "doc_id long, words string, toxic int")
    cells = map_batches(reduced.repartition(1), fit, "feature string, weight double").toPandas()
    weights = dict(zip(cells["feature"], cells["weight"], strict=True))
    # no row at all: no labelled document, so the share of toxic ones counts as 0
    return Model(weights.pop("", fit_model([], []).bias), weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``, the probability that a reader would label the text toxic, in place of a column of this name."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = Model(*shared.value)
        for batch in batches:
            yield batch.assign(score=np.array([use.score(t) for t in batch["text"]], float))

    return map_batches(docs, run, ", ".join([*kinds, "score double"]))


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; labels of a fifth of the ids are held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
