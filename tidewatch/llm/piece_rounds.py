"""SentencePiece BPE in vectorised merge rounds, and decoding by an offset table.

Texts are cut into words where no piece can reach across: before a blank that follows something else, and around characters that
stand in no longer piece. Words that a worker has not seen yet are merged together: their symbols lie in one flat array, each pair has the
rank of the piece it makes, a segmented minimum gives every word its best rank, all leftmost pairs of that rank are merged at once,
and the array is compacted, until no word has a pair left.

Merging all pairs of one rank at once is right if no new pair can be better than the pairs still to come. Pieces for which a longer one with
a better or equal score exists (``urgent``) may break that; a word with several pairs of such a piece is merged one pair at a time
from a queue, as the slow algorithm does. Both give the library's ids.

The model file is read on the driver and sent to tasks as bytes (its size is bounded by its vocabulary). What a Python worker has
already encoded is kept, up to ``KEPT_WORDS`` words. Supported are BPE models with byte fallback and without normalisation.

Defined results: a null text counts as empty and gives no ids; texts of any length are taken whole, in slices that end between words;
repeated rows are encoded one by one; an empty table gives no rows; further columns are kept by ``encode_column`` if named.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import map_batches, table, worker_cache
from tidewatch.llm.registry import query

KEPT_WORDS = 400_000
#: Characters that are split into words at once, and words that are merged at once.
SLICE, TOGETHER = 1 << 20, 1 << 18
BLANK = "▁"
#: Rank of pairs that make no piece.
NEVER = np.int32(2**31 - 1)
# Kinds of pieces and the model kind in the file format.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE_MODEL = 1, 2, 3, 6, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of each field of a protocol buffer message: integers, and the bytes of everything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at:at + size]
        at += size


def _is_utf8(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


class Pieces:
    """Pieces, pairs and tables of one model file."""

    def __init__(self, model: bytes):
        strings, scores, kinds = [], [], []
        trainer, normalizer = {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                strings.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1
        if trainer.get(3, 1) != BPE_MODEL or not trainer.get(35) or trainer.get(24) or not plain or not {*kinds} <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("this kind of model file is not supported")
        self.bytes = {int(s[3:5], 16): i for i, (s, k) in enumerate(zip(strings, kinds, strict=True)) if k == BYTE}
        self.ids = {s: i for i, (s, k) in enumerate(zip(strings, kinds, strict=True)) if k == NORMAL}
        normal = sorted({scores[i] for i in self.ids.values()}, reverse=True)
        place = {score: rank for rank, score in enumerate(normal)}
        rank = {s: place[scores[i]] for s, i in self.ids.items()}
        # a character may only occur inside pieces; it has a symbol of its own behind the ids then
        self.symbols = dict(self.ids)
        for c in sorted({c for s in self.ids for c in s} - {*self.ids}):
            self.symbols[c] = len(strings) + len(self.symbols)
        self.inner = {i: c for c, i in self.symbols.items() if i >= len(strings)}
        self.size = max(self.symbols.values(), default=0) + 2
        pairs, urgent = {}, set()
        shared = {r for r, n in zip(*np.unique([r for s, r in rank.items() if len(s) > 1], return_counts=True), strict=True) if n > 1}
        for whole, r in rank.items():
            for cut in range(1, len(whole)):
                left, right = whole[:cut], whole[cut:]
                if left in self.symbols and right in self.symbols:
                    pairs[self.symbols[left] * self.size + self.symbols[right]] = (r, self.ids[whole])
                    urgent.update(rank[x] for x in (left, right) if len(x) > 1 and rank[x] >= r)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.makes = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.urgent = np.zeros(len(normal) + 1, bool)
        self.urgent[[*urgent, *shared]] = True
        self.pairs = pairs
        longer = [s for s in self.ids if len(s) > 1]
        if any(BLANK in s.lstrip(BLANK) for s in longer):
            raise ValueError("pieces with a blank behind other characters are not supported")
        inside = {c for s in longer for c in s}
        alone = "".join(re.escape(c) for c in "\n\t\v\f" if c not in inside)
        self.words = re.compile(f"{BLANK}*[^{BLANK}{alone}]+|[{alone}]|{BLANK}+" if alone else f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        # code point -> symbol, -1 if there is none
        self.of_code = np.full(0x110000, -1, np.int64)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_code[ord(s)] = i
        surface = trainer.get(44, " ⁇ ".encode())
        texts = [s.replace(BLANK, " ").encode() if k == NORMAL else surface if k == UNKNOWN else b"" if k == CONTROL else bytes([int(s[3:5], 16)])
                 for s, k in zip(strings, kinds, strict=True)]
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.is_control = np.array([k == CONTROL for k in kinds])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the piece that each pair makes, and the piece."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        if not len(self.keys):
            return np.full(len(key), NEVER), key
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[place] == key
        return np.where(hit, self.ranks[place], NEVER), self.makes[place]

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(word, size, symbol)``: words in the order in which they were done, their numbers of symbols, and all final symbols.

        A character without symbol is minus its code point, less one.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        symbol = self.of_code[code]
        symbol = np.where(symbol < 0, -1 - code, symbol)
        ready: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        word = np.arange(len(words))
        first = np.cumsum(sizes) - sizes
        rank, makes = np.full(len(symbol), NEVER), np.zeros(len(symbol), np.int64)
        rank[:-1], makes[:-1] = self.rank_of(symbol[:-1], symbol[1:])
        rank[first[1:] - 1] = NEVER
        while len(word):
            best = np.minimum.reduceat(rank, first)
            size = np.diff(first, append=len(symbol))
            hit = (rank == np.repeat(best, size)) & (rank < NEVER)
            several = np.add.reduceat(hit, first, dtype=np.int64) > 1
            queued = several & self.urgent[np.minimum(best, len(self.urgent) - 1)]
            done = (best == NEVER) | queued
            if done.any():
                for i in np.flatnonzero(queued):
                    rest = self.one_by_one(symbol[first[i]:first[i] + size[i]])
                    ready.append((word[i:i + 1], np.array([len(rest)]), rest))
                whole = best == NEVER
                ready.append((word[whole], size[whole], symbol[np.repeat(whole, size)]))
                keep = np.repeat(~done, size)
                symbol, rank, makes, hit = symbol[keep], rank[keep], makes[keep], hit[keep]
                word, size = word[~done], size[~done]
                first = np.cumsum(size) - size
                if not len(word):
                    break
            # of pairs that overlap, every other one from the left
            place = np.arange(len(hit))
            begun = np.maximum.accumulate(np.where(hit, -1, place))
            merge = hit & ((place - begun) % 2 == 1)
            symbol = np.where(merge, makes, symbol)
            gone = np.zeros(len(hit), bool)
            gone[1:] = merge[:-1]
            size = size - np.add.reduceat(gone, first, dtype=np.int64)
            symbol, rank, makes, merge = symbol[~gone], rank[~gone], makes[~gone], merge[~gone]
            first = np.cumsum(size) - size
            last = np.zeros(len(symbol), bool)
            last[first + size - 1] = True
            # only pairs with a new symbol have a new rank
            changed = merge.copy()
            changed[:-1] |= merge[1:]
            rank[changed] = NEVER
            at = np.flatnonzero(changed & ~last)
            rank[at], makes[at] = self.rank_of(symbol[at], symbol[at + 1])
            rank[last] = NEVER
        return tuple(np.concatenate(part) for part in zip(*ready, strict=True))  # type: ignore[return-value]

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one word, with a queue of its pairs by rank and place."""
        symbol = symbols.tolist()
        n, size, pairs = len(symbol), self.size, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and symbol[i] >= 0 and symbol[j] >= 0:
                found = pairs.get(symbol[i] * size + symbol[j])
                if found:
                    heapq.heappush(queue, (found[0], i, symbol[i], symbol[j], found[1]))

        for i in range(n):
            offer(i)
        gone = [False] * n
        while queue:
            _, i, left, right, whole = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or symbol[i] != left or symbol[j] != right:
                continue
            symbol[i], gone[j], after[i] = whole, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([s for s, g in zip(symbol, gone, strict=True) if not g], np.int64)

    def to_ids(self, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of final symbols: characters that are no piece become their bytes."""
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.is_byte)))
        if not len(odd):
            return size, symbol.astype("<i4")
        spelled = [[self.bytes[b] for b in (self.inner[s] if s >= 0 else chr(-1 - s)).encode("utf-8", "surrogatepass")] for s in symbol[odd].tolist()]
        width = np.ones(len(symbol), np.int64)
        width[odd] = [len(x) for x in spelled]
        ids = np.repeat(symbol, width)
        starts = np.cumsum(width) - width
        ids[np.repeat(starts[odd], width[odd]) + np.concatenate([np.arange(len(x)) for x in spelled])] = np.concatenate(spelled)
        return np.add.reduceat(width, np.cumsum(size) - size), ids.astype("<i4")

    def decode(self, ids: np.ndarray, start: bool = True) -> bytes:
        """Text of ids in UTF-8; at the ``start`` of a text the first piece loses one blank."""
        if not len(ids):
            return b""
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        end = np.cumsum(size)
        text = self.buffer[np.repeat(first - (end - size), size) + np.arange(end[-1])].tobytes()
        cut = 0
        if start:
            spoken = np.flatnonzero(~self.is_control[ids])
            lead = int(spoken[0]) if len(spoken) else -1
            # the sign of an unknown piece begins with a blank that stays
            cut = int(lead >= 0 and not self.is_byte[ids[lead]] and int(ids[lead]) in self._blank_first())
        if self.is_byte[ids].any():
            # pieces without text part runs of bytes
            if self.is_control[ids].any() or not _is_utf8(text):
                text = self._with_replacements(ids)
        return text[cut:]

    def _blank_first(self) -> set[int]:
        if not hasattr(self, "_blanks"):
            self._blanks = {i for s, i in self.ids.items() if s.startswith(BLANK)}
        return self._blanks

    def _with_replacements(self, ids: np.ndarray) -> bytes:
        """Runs of byte pieces, with a replacement character for each byte that belongs to no character."""
        out = []
        edge = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        for part in np.split(ids, edge):
            text = b"".join(self.buffer[self.offsets[i]:self.offsets[i + 1]].tobytes() for i in part)
            while self.is_byte[part[0]] and text:
                for n in range(1, 5):
                    try:
                        out.append(text[:n].decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    n = 1
                text = text[n:]
            out.append(text)
        return b"".join(out)


class Encoder:
    """Whole texts to ids, with the words a worker has already seen: their ids as 32-bit integers and in decimal."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.codes: dict[str, bytes] = {}
        self.decimals: dict[str, str] = {}
        self.spelled = list(map(str, range(len(self.pieces.is_byte))))

    def slices(self, text: str | None) -> Iterator[list[str]]:
        """The text's words, a slice at a time; slices end between words."""
        if not text:
            return
        text = BLANK + text.replace(" ", BLANK)
        at = 0
        while at < len(text):
            end = at + SLICE
            if end < len(text):
                while end < len(text) and not (text[end] == BLANK and text[end - 1] != BLANK):
                    end += 1
            yield self.pieces.words.findall(text[at:end])
            at = end

    def learn(self, lists: list[list[str]]) -> None:
        """Encodes all words that were not seen yet, together."""
        new: set[str] = set()
        for words in lists:
            new.update(words)
        if len(self.codes) > KEPT_WORDS:
            self.codes = {w: self.codes[w] for w in new if w in self.codes}
            self.decimals = {w: self.decimals[w] for w in self.codes}
        # words of like length need a like number of rounds
        fresh = sorted(new - self.codes.keys(), key=len)
        for at in range(0, len(fresh), TOGETHER):
            some = fresh[at:at + TOGETHER]
            word, size, symbol = self.pieces.merged(some)
            size, ids = self.pieces.to_ids(size, symbol)
            code, spelled, end = ids.tobytes(), list(map(self.spelled.__getitem__, ids.tolist())), 0
            for i, n in zip(word.tolist(), size.tolist(), strict=True):
                start, end = end, end + n
                self.codes[some[i]] = code[4 * start:4 * end]
                self.decimals[some[i]] = ",".join(spelled[start:end])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, bytes, str]]:
        """``(text, ids, decimal ids)`` of every slice in order."""
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for number, text in enumerate(texts):
            for words in self.slices(text):
                waiting.append((number, words))
                held += len(words)
                if held >= TOGETHER:
                    yield from self._encoded(waiting)
                    waiting, held = [], 0
        yield from self._encoded(waiting)

    def _encoded(self, waiting: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes, str]]:
        self.learn([words for _, words in waiting])
        for number, words in waiting:
            yield number, b"".join(map(self.codes.__getitem__, words)), ",".join(map(self.decimals.__getitem__, words))


def encoder_for(model: bytes) -> Encoder:
    return worker_cache("pieces " + hashlib.sha256(model).hexdigest(), lambda: Encoder(model))


def encode_column(docs: DataFrame, path: str, keep: list[str], ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of every row's ``text``; with ``ids`` also the ids themselves."""
    with open(path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    chosen = docs.select(*keep, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name in keep]
    schema = ", ".join([*kinds, "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<long>"] * ids])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(model.value)
        for batch in batches:
            texts = list(batch.pop("text"))
            counts = [0] * len(texts)
            first, second = [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
            lists: list[list[np.ndarray]] = [[] for _ in texts]
            for number, code, decimal in encoder.encode(texts):
                start = not counts[number]
                token = np.frombuffer(code, "<i4")
                first[number].update((decimal if start else "," + decimal).encode())
                second[number].update(encoder.pieces.decode(token, start))
                counts[number] += len(token)
                if ids:
                    lists[number].append(token.astype(np.int64))
            out = batch.assign(n_tokens=np.array(counts, np.int64), ids_sha256=[h.hexdigest() for h in first], decoded_sha256=[h.hexdigest() for h in second])
            if ids:
                out = out.assign(ids=pd.Series([np.concatenate([np.zeros(0, np.int64), *x]) for x in lists], index=out.index, dtype=object))
            yield out

    return map_batches(chosen, run, schema)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op13_sentencepiece")
def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return encode_column(table(spark, sf_dir, "documents"), model_path(), ["doc_id"])
