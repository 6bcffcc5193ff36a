"""Runs of repeated words: every maximal stretch with a period, by the branching-tandem test on an enhanced suffix array.

A text's words become numbers; their suffix array comes from prefix doubling, in which only suffixes that are not alone yet take part, and
its LCP values from the ranks of all rounds. An LCP interval of depth d holds the suffixes that share d words. For every suffix i of all children but the
largest, i + d or i - d inside the same interval (a look at the inverse array, there are no tree nodes) means a square of period
d, and unequal words behind the two mean that it is branching: the last square of its run. Ranks of all rounds also say how far
such a square can be rotated to the left. Squares that end up as the same stretch are one run, with the smallest period.

Texts are worked on in batches of bounded words (a longer text comes alone). A run of at least twelve words, and of two periods, has six words in
a row that occur again: texts without two equal windows of six words have no run and need no suffix array.

Defined results: null texts, empty texts and texts without words have no runs, four nulls and the digests of nothing; repeated rows are judged one
by one; an empty table gives no rows; further columns are ignored; the general ``find_runs`` never alters texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import map_batches, table, word_hashes
from tidewatch.llm.registry import query

LEAST_LENGTH = 12
#: Words whose suffixes are sorted at once.
TOGETHER = 1 << 19
SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def repeats(texts: list[bytes], window: int) -> np.ndarray:
    """Whether each text may have two equal windows of so many words; hashes that collide only say yes too often."""
    out = np.zeros(len(texts), bool)
    hashes, first = word_hashes([t.decode("utf-8", "surrogatepass") for t in texts], lower=False)
    n = len(hashes) - window + 1
    if n < 2:
        return out
    rolled = hashes[:n].copy()
    for i in range(1, window):
        rolled = rolled * np.uint64(0x9FB21C651E98DF25) + hashes[i:n + i]
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a > window:
            own = np.sort(rolled[a:b - window + 1])
            out[i] = bool((own[1:] == own[:-1]).any())
    return out


class Suffixes:
    """Suffix array of several sequences of numbers at once, each ending before the next begins."""

    def __init__(self, values: np.ndarray, first: np.ndarray):
        """``values``: dense numbers; ``first``: where each sequence begins, and the end."""
        self.n = n = len(values)
        self.values = values
        self.owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        self.stop = first[1:][self.owner] if n else np.zeros(0, np.int64)
        # ranks are places in the order: a group of equal prefixes has the place of its first member
        key = self.owner * (int(values.max(initial=0)) + 1) + values
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = self._group_starts(key[order], np.arange(n))
        #: Per round (windows of 1, 2, 4 ... words): places of suffixes that share their window with another one, and the rank they have.
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        active = self._not_alone(order, rank)
        width = 1
        while len(active):
            self.rounds.append((active, rank[active]))
            behind = active + width
            inside = behind < self.stop[active]
            then = np.where(inside, rank[np.minimum(behind, n - 1)] + 1, 0)
            # stable by what follows, then by the group
            sub = np.lexsort((then, rank[active]))
            moved, group, then = active[sub], rank[active][sub], then[sub]
            place = group + np.arange(len(moved)) - self._group_starts(group, np.arange(len(moved)))
            order[place] = moved
            pair = np.empty(len(moved), bool)
            pair[:1] = True
            pair[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
            rank[moved] = np.maximum.accumulate(np.where(pair, place, 0))
            active = self._not_alone(moved, rank)
            width *= 2
        self.order, self.place = order, rank

    @staticmethod
    def _group_starts(sorted_keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        new = np.empty(len(sorted_keys), bool)
        new[:1] = True
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        return np.maximum.accumulate(np.where(new, place, 0))

    @staticmethod
    def _not_alone(ordered: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Suffixes, of those in order, whose rank another one has."""
        r = rank[ordered]
        same = r[1:] == r[:-1]
        shared = np.zeros(len(r), bool)
        shared[1:] |= same
        shared[:-1] |= same
        return ordered[shared]

    def extension(self, i: np.ndarray, j: np.ndarray, backward: bool = False) -> np.ndarray:
        """How many words from ``i`` and ``j`` on (or before them, backwards) are equal, within one sequence."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        known = np.full(self.n, -1, np.int64)
        for level in range(len(self.rounds) - 1, -1, -1):
            at, rank = self.rounds[level]
            known[at] = rank
            width = 1 << level
            a, b = (i - width, j - width) if backward else (i, j)
            good = (a >= 0) & (b >= 0) & (a < self.n) & (b < self.n)
            x, y = known[np.where(good, a, 0)], known[np.where(good, b, 0)]
            # ranks are taken inside one sequence, so equal ones never reach across
            good &= (x >= 0) & (x == y)
            step = np.where(good, width, 0)
            total += step
            i, j = (i - step, j - step) if backward else (i + step, j + step)
            known[at] = -1
        return total

    def lcp(self) -> np.ndarray:
        """Common words of each suffix with the one before it in the order."""
        out = np.zeros(self.n, np.int64)
        if self.n and self.rounds:
            # a suffix that was alone in the first round has nothing in common with its neighbours
            some = np.zeros(self.n, bool)
            some[self.place[self.rounds[0][0]]] = True
            at = np.flatnonzero(some[1:] & some[:-1]) + 1
            out[at] = self.extension(self.order[at], self.order[at - 1])
        return out


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest smaller value to the left (-1) and to the right (n) of each, by minima over blocks of 1, 2, 4 ... values."""
    n = len(values)
    levels = [values]
    while 2 ** len(levels) <= n:
        low, half = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(low[:-half], low[half:]))
    left, right = np.arange(n), np.arange(1, n + 1)
    for level in range(len(levels) - 1, -1, -1):
        block, width = levels[level], 2 ** level
        at = left - width
        left = np.where((at >= 0) & (block[np.maximum(at, 0)] >= values), at, left)
        fits = right + width <= n
        right = np.where(fits & (block[np.minimum(right, len(block) - 1)] >= values), right + width, right)
    return left - 1, right


def branching_squares(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """``(start, period)`` of squares that cannot be moved one word to the right, each period a depth of an LCP interval."""
    lcp = suffixes.lcp()
    # borders between two children of an interval are the places where its depth stands
    border = np.flatnonzero(lcp > 0)
    none = np.zeros(0, np.int64)
    if not len(border):
        return none, none
    lo, hi = nearest_smaller(lcp)
    lo, hi, depth = np.maximum(lo[border], 0), hi[border], lcp[border]
    sub = np.lexsort((border, depth, lo))
    border, lo, hi, depth = border[sub], lo[sub], hi[sub], depth[sub]
    new = np.empty(len(border), bool)
    new[0] = True
    new[1:] = (lo[1:] != lo[:-1]) | (depth[1:] != depth[:-1])
    interval = np.cumsum(new) - 1
    # children of interval k: from lo to its first border, between its borders, from its last border to hi
    begin = np.concatenate([lo[new], border])
    of = np.concatenate([np.arange(interval[-1] + 1), interval])
    sub = np.lexsort((begin, of))
    begin, of = begin[sub], of[sub]
    top, deep, bottom = hi[new], depth[new], lo[new]
    finish = np.append(begin[1:], 0)
    last = np.append(of[1:] != of[:-1], True)
    finish[last] = top
    size = finish - begin
    # the largest child of each interval is left out (the first of equals)
    largest = np.lexsort((begin, -size, of))
    skip = np.zeros(len(begin), bool)
    skip[largest[np.append(True, of[largest][1:] != of[largest][:-1])]] = True
    begin, size, of = begin[~skip], size[~skip], of[~skip]
    starts, periods = [none], [none]
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        # so many children at once that memory stays bounded
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 21), side="right")))
        s = size[at:end]
        place = np.repeat(begin[at:end] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        i, k = suffixes.order[place], np.repeat(of[at:end], s)
        d = deep[k]
        for left in (i, i - d):
            right = left + d
            inside = (left >= 0) & (right < suffixes.n)
            other = suffixes.place[np.where(inside, np.where(left == i, right, left), 0)]
            inside &= (other >= bottom[k]) & (other < top[k])
            x, w, q = left[inside], right[inside], d[inside]
            behind = w + q
            more = behind < suffixes.stop[w]
            same = more & (suffixes.values[np.minimum(behind, suffixes.n - 1)] == suffixes.values[w])
            starts.append(x[~same])
            periods.append(q[~same])
        at = end
    return np.concatenate(starts), np.concatenate(periods)


def find_runs(texts: list[list[bytes]], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """``(start, length, period)`` rows of every run of each list of words, by start, then period."""
    number: dict[bytes, int] = {}
    values = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
    first = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
    if not len(values):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    suffixes = Suffixes(values, first)
    start, period = branching_squares(suffixes)
    end = start + 2 * period
    start = start - suffixes.extension(start, start + period, backward=True)
    keep = end - start >= least
    start, end, period = start[keep], end[keep], period[keep]
    # a stretch of several periods has squares of their multiples too
    sub = np.lexsort((period, end, start))
    start, end, period = start[sub], end[sub], period[sub]
    once = np.ones(len(start), bool)
    once[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[once], end[once], period[once]
    sub = np.lexsort((period, start))
    start, end, period = start[sub], end[sub], period[sub]
    rows = np.stack([start, end - start, period], axis=1)
    owner = suffixes.owner[start] if len(start) else np.zeros(0, np.int64)
    border = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        own = rows[border[i]:border[i + 1]].copy()
        own[:, 0] -= first[i]
        out.append(own)
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not len(runs):
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(depth[:-1]) == 0
    return [w for w, k in zip(words, kept.tolist(), strict=True) if k]


def detect(docs: DataFrame, altered: Callable[[str | None, list[bytes]], list[bytes]] | None = None, least: int = LEAST_LENGTH) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of every row of ``docs`` (doc_id, text).

    ``altered`` may change the words of a text before runs are looked for.
    """
    window = max(1, least - least // 2)  # words that a run of ``least`` words, and of two periods, repeats at least

    def judged(words: list[list[bytes]]) -> Iterator[tuple]:
        joined = [b" ".join(w) for w in words]
        runs = [np.zeros((0, 3), np.int64)] * len(words)
        some = np.flatnonzero(repeats(joined, window))
        for i, found in zip(some, find_runs([words[i] for i in some], least), strict=True):
            runs[i] = found
        for own, text, rows in zip(words, joined, runs, strict=True):
            best: tuple = (None,) * 4
            if len(rows):
                start, length, period = rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))[0]].tolist()
                best = start, length, period, 1000 * length // period
                text = b" ".join(collapsed(own, rows))
            lines = "".join(f"{a},{b},{c}\n" for a, b, c in rows.tolist())
            yield len(rows), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()

    def groups(batch: pd.DataFrame) -> Iterator[list[list[bytes]]]:
        held: list[list[bytes]] = []
        n = 0
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            held.append(altered(doc_id, words) if altered else words)
            n += len(words)
            if n >= TOGETHER:
                yield held
                held, n = [], 0
        yield held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [row for words in groups(batch) for row in judged(words)]
            out = pd.DataFrame(rows, columns=names, index=batch.index)
            whole = {c: out[c].astype("Int64") for c in names[:5]}
            yield pd.DataFrame({"doc_id": batch["doc_id"], **whole, "runs_sha256": out["runs_sha256"], "collapsed_sha256": out["collapsed_sha256"]})

    # ids go as text: with a null among them pandas would make them doubles
    found = map_batches(docs.selectExpr("cast(doc_id as string) AS doc_id", "text"), run, f"doc_id string, {SCHEMA}")
    return found.withColumn("doc_id", found["doc_id"].cast("long"))


def planted(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The query's words: in a tenth of the documents, by crc32 of the id, a period repeats from some word on; without an id nothing changes."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(doc_id.encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a:a + p]
    return words[:a] + (again * (-(-(n - a) // p)))[:n - a]


@query("op12_word_runs")
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least twelve words and two periods in every document, and digests of all runs and of the text without repeats."""
    return detect(table(spark, sf_dir, "documents"), planted)
