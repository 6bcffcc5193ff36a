"""Language identification of whole texts, also mixed ones.

Words are runs of letters. A word's script (by its first letter) narrows the languages that can have written it to those whose
training text uses the script. Character trigrams with word borders give every word a log-probability per language, and a
Viterbi pass over a text's words, with a penalty for each change of language, labels spans. The language with most letters is the
text's, its share of all letters the score.

Trigram counts come from at most about ``PER_LANGUAGE`` labelled documents per language, drawn by a hash of the id; that bound
keeps the model small (``BUCKETS`` cells per language) and is the only sampling. Nothing but the text enters a prediction.

Defined results: null texts and texts without letters are ``und`` with score 0; ties go to the first language by name; a word
in a script no language uses may be of any; without training documents everything is ``und``; repeated rows are judged
one by one; an empty table gives no rows; further columns are kept by ``identify``, but for those named like its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewatch.llm.common import crc_mod, map_batches, table, worker_cache
from tidewatch.llm.registry import query

PER_LANGUAGE = 2000
BUCKETS = 1 << 16
SMOOTH = 0.5
SWITCH = 12.0
#: Share of a language's training letters from which on a script counts as its own.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Characters that are scored at once, and characters of texts that share one Viterbi pass.
CHUNK, PASS = 1 << 19, 6 << 20

# First code points of the ranges in which scripts change, by Unicode block.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3200, "Han"), (0xA000, "Yi"),
    (0xA4D0, "Latin"), (0xAC00, "Hangul"), (0xD800, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE30, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})


def _letters() -> np.ndarray:
    """Lower-case code point of every letter, 0 for everything else."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x32400):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


@dataclass
class Words:
    """Words of a run of texts: trigram buckets per letter, first letter of each word, script, text, letters and place."""

    buckets: np.ndarray
    first: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    start: np.ndarray


def _words(code: np.ndarray) -> Words:
    lower = worker_cache("letters", _letters)[code]
    inside = lower > 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, stop = edge[0::2], edge[1::2]
    place = np.flatnonzero(inside)
    padded = np.concatenate([np.zeros(1, np.uint32), lower, np.zeros(1, np.uint32)]).astype(np.uint64)
    # the letter with its neighbours; borders are 0
    mixed = (padded[place] * np.uint64(0x9E3779B97F4A7C15) + padded[place + 1]) * np.uint64(0xBF58476D1CE4E5B9) + padded[place + 2]
    mixed *= np.uint64(0x94D049BB133111EB)
    letters = stop - start
    begins = np.array([s for s, _ in SCRIPT_STARTS], np.uint32)
    names = np.array([SCRIPTS.index(n) for _, n in SCRIPT_STARTS], np.int64)
    script = names[np.searchsorted(begins, code[start], side="right") - 1]
    return Words((mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1), np.cumsum(letters) - letters, script, letters, start)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Cuts at characters that are no letters, so words stay whole."""
    letters, at = worker_cache("letters", _letters), 0
    while at < len(code):
        end = min(at + CHUNK, len(code))
        while end < len(code) and letters[code[end]] > 0:
            end += 1
        yield at, code[at:end]
        at = end


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray      # bucket x language, log-probabilities
    allowed: np.ndarray     # script x language, 0 or a large negative number

    def word_scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores, letters and first characters of all words, and the number of words per text."""
        code = _codes("\n".join(texts) + "\n")
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        scores, letters, starts = [], [], []
        for at, piece in _pieces(code):
            w = _words(piece)
            if len(w.start):
                total = np.add.reduceat(self.scores[w.buckets], w.first, axis=0) + self.allowed[w.script]
                scores.append(total)
                letters.append(w.letters)
                starts.append(w.start + at)
        n = len(self.languages)
        if not scores:
            return np.zeros((0, n), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        start = np.concatenate(starts)
        ends = np.cumsum(sizes)
        upto = np.searchsorted(start, ends)
        return np.concatenate(scores), np.concatenate(letters), start - np.repeat(ends - sizes, np.diff(upto, prepend=0)), np.diff(upto, prepend=0)

    def label(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Language of every word: Viterbi over all texts at once, longest first, one step per word position."""
        n = len(self.languages)
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        sorted_counts = counts[order]
        longest = int(sorted_counts[0]) if len(counts) else 0
        active = np.searchsorted(-sorted_counts, -np.arange(1, longest + 1), side="right")
        back = np.zeros((len(scores), n), np.uint8 if n < 256 else np.uint16)
        best = np.zeros((len(counts), n), np.float32)
        own = np.arange(n)
        for t in range(longest):
            k = active[t]
            here = best[:k]
            if t:
                top = here.argmax(axis=1)
                change = here[np.arange(k), top] - np.float32(SWITCH)
                stay = here >= change[:, None]
                back[first[:k] + t] = np.where(stay, own, top[:, None])
                here = np.where(stay, here, change[:, None])
            best[:k] = here + scores[first[:k] + t]
        label = np.zeros(len(scores), np.int64)
        now = best.argmax(axis=1)
        for t in range(longest - 1, -1, -1):
            k = active[t]
            place = first[:k] + t
            label[place] = now[:k]
            now[:k] = back[place, now[:k]]
        return label


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Model from ``text`` and non-null ``lang`` of the given documents."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), np.float32))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language model")), F.lit(1 << 20)) < F.try_element_at(share, F.col("lang")) * (1 << 20)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for _, piece in _pieces(_codes(text)):
                    w = _words(piece)
                    total[:BUCKETS] += np.bincount(w.buckets, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(w.script, weights=w.letters, minlength=len(SCRIPTS)).astype(np.int64)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "cell": used, "n": total[used]})

    cells = map_batches(rows.where(drawn), count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    place = {name: i for i, name in enumerate(languages)}
    counted = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    counted[cells["cell"].to_numpy(), cells["lang"].map(place).to_numpy(dtype=int)] = cells["n"].to_numpy()
    grams = counted[:BUCKETS] + SMOOTH
    letters = counted[BUCKETS:]
    own = letters >= np.maximum(SCRIPT_SHARE * letters.sum(axis=0), 1)
    own |= ~own.any(axis=1)[:, None]
    return Model(
        languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), np.where(own, 0.0, -1e6).astype(np.float32))


def _passes(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PASS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, in place of columns of these names; with ``spans`` also the labelled spans as (start, stop, lang), in characters."""
    # arrays and lists, which tasks can read without this package
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.scores, model.allowed))
    docs = docs.drop("lang_pred", "score", *["spans"] * spans)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    extra = ["lang_pred string", "score double", *["spans array<struct<start:long,stop:long,lang:string>>"] * spans]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use = Model(*shared.value)
        names = np.array([*use.languages, UNKNOWN], object)
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            preds, shares, found = [], [], []
            for a, b in _passes(texts):
                scores, letters, starts, counts = use.word_scores(texts[a:b])
                if not use.languages:
                    preds.append(np.full(b - a, UNKNOWN, object))
                    shares.append(np.zeros(b - a))
                    found += [[]] * (b - a)
                    continue
                label = use.label(scores, counts)
                text = np.repeat(np.arange(b - a), counts)
                n = len(use.languages)
                mass = np.bincount(text * n + label, weights=letters, minlength=(b - a) * n).reshape(b - a, n)
                whole = mass.sum(axis=1)
                preds.append(names[np.where(whole > 0, mass.argmax(axis=1), n)])
                shares.append(mass.max(axis=1) / np.maximum(whole, 1))
                if spans:
                    found += _spans(text, label, starts, letters, b - a, use.languages)
            out = batch.assign(lang_pred=np.concatenate(preds) if preds else [], score=np.concatenate(shares) if shares else [])
            yield out.assign(spans=found) if spans else out

    return map_batches(docs, run, ", ".join([*kinds, *extra]))


def _spans(text, label, starts, letters, n: int, languages: list[str]) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(text):
        cut = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
        for a, b in zip(cut, np.append(cut[1:], len(text)), strict=True):
            out[text[a]].append({"start": int(starts[a]), "stop": int(starts[b - 1] + letters[b - 1]), "lang": languages[label[a]]})
    return out


def held_out() -> Column:
    return F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a quarter of them is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
