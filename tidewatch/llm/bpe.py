"""Exact BPE encoding in linear time, and decoding by an offset table.

A pre-token's merges are found without merging. An Aho-Corasick automaton over the vocabulary gives the longest token at every
place; tokens are taken from the left, each checked against the one before: a pair is compatible if merging their joint text
gives exactly the two of them, and in an encoding in which all neighbours are compatible all merges are as in the slow algorithm.
If the longest token does not fit, the next shorter one (the longest token that begins it) is tried, and if none is left the last
token is taken back; places that were given up are marked, so each is visited once. Verdicts on pairs are kept in a table.

The tokenizer file is read on the driver and sent to tasks (its size is bounded by its vocabulary); what each Python worker has
already encoded is kept, up to ``KEPT_WORDS`` pre-tokens. Ids are decoded from one byte buffer of all token strings and the offsets
in it, joined as the file asks for.

Supported are files of the kind the query uses: byte-level BPE with an end-of-word suffix, a pattern split, NFC and
lower case, special tokens that are found in raw text, no decoder (token strings with blanks between).

Defined results: a null text counts as empty and gives no ids; texts of any length are taken whole, pre-token by pre-token;
repeated rows are encoded one by one; an empty table gives no rows; further columns are kept by ``encode_column``.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.common import map_batches, table, worker_cache
from tidewatch.llm.registry import query

KEPT_WORDS = 200_000
#: Stands for the end-of-word suffix behind a pre-token; byte-level symbols never contain it.
_STOP = "\ue000"
#: Texts below this letter are split by a pattern with short classes.
_LATIN = "\u0250"
#: What the tokenizer library knows beyond Unicode 15.1 (ranges inside a character class): letters and numbers of Unicode 16, and the lower case
#: of capitals of Unicode 16 and 17.
_LETTERS_16 = (r"\u1c89\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4"
               r"\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa"
               r"\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0")
_NUMBERS_16 = (r"\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9"
               r"\U0001e5f1-\U0001e5fa")
_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
          **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
#: Combining marks that the library's older composition tables do not know: there they stay where they are, and nothing is moved over or joined to them.
_STILL = re.compile(
    "(["
    r"\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c\U00010d24-\U00010d27"
    r"\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e\U00011839-\U0001183a"
    r"\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97"
    r"\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
    "])")


def byte_symbols() -> list[str]:
    """Printable character for every byte: itself where printable, else the next free code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(free)) for b in range(256)]


def code_points(group: str, below: int = 0x110000) -> str:
    """Ranges, as inside a character class, of all code points (or those ``below`` one) whose general category begins with ``group``."""
    inside = np.array([unicodedata.category(chr(c))[0] == group for c in range(below)])
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0)).tolist()
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edge[::2], edge[1::2], strict=True))


class Vocabulary:
    """Tokens, merges and tables of one tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        pre = spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
            raise ValueError("this kind of tokenizer file is not supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that reach beyond their own string are not supported")
        # the file's \s is Unicode White_Space; its letters and numbers are those of Unicode 16, not of the pattern library's version
        spaces = r"\t-\r\x20\x85\xa0  -     　"
        spelled = lambda letters, numbers: pre[0]["pattern"]["Regex"].replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", spaces)
        self.pattern = spelled(code_points("L") + _LETTERS_16, code_points("N") + _NUMBERS_16)
        # the same for texts below ``_LATIN``: long classes are slow
        self.latin = spelled(code_points("L", ord(_LATIN)), code_points("N", ord(_LATIN)))
        suffix = model["end_of_word_suffix"]
        ids = model["vocab"]
        self.strings: list[str] = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for string, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = string
        spell = {i: s[:-len(suffix)] + _STOP if s.endswith(suffix) and s != suffix else s for s, i in ids.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[left + right]
            self.merge[ids[left], ids[right]] = (rank, whole)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (ids[left], ids[right]), rank
        # tokens that merging can reach: symbols, and merges whose own text encodes to themselves
        symbols = set(byte_symbols())
        self.symbol = {s: i for i, s in spell.items() if s in symbols or (s[-1] == _STOP and s[:-1] in symbols)}
        self.length = {i: len(s) for i, s in spell.items() if s in self.symbol or i in self.parts}
        self.trie = ahocorasick.Automaton()
        by_string = {spell[i]: i for i in self.length}
        for string, i in by_string.items():
            self.trie.add_word(string, i)
        self.trie.make_automaton()
        self.shorter: dict[int, int] = {}
        for string, i in by_string.items():
            self.shorter[i] = next((by_string[string[:n]] for n in range(len(string) - 1, 0, -1) if string[:n] in by_string), -1)
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint text of two tokens leaves exactly these two."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self._no_merge_across(left, right)
        return known

    def _no_merge_across(self, left: int, right: int) -> bool:
        # Going back in time, the later of both tokens' last merges is undone; a merge across the border would have won at any
        # moment at which it was ranked before the merges still to come on either side.
        soonest = 1 << 60
        while True:
            across = self.merge.get((left, right))
            if across is not None and across[0] < soonest:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                soonest, left = a, self.parts[left][1]
            else:
                # on the same rank the left one is merged first, so here it still wins
                soonest, right = b + 1, self.parts[right][0]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token given in byte symbols."""
        text = word + _STOP
        n = len(text)
        longest = [-1] * n
        size, shorter, fits = self.length, self.shorter, self.fits
        for end, token in self.trie.iter(text):
            # matches come by growing end, so a later one from the same place is longer
            longest[end + 1 - size[token]] = token
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                after = at + size[token]
                if after >= n or (longest[after] >= 0 and after not in dead):
                    if last < 0:
                        break
                    fit = fits.get((last, token))
                    if fit or (fit is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                starts.append(at)
                at, last = after, token
                if at < n:
                    token = longest[at]
            else:
                dead.add(at)
                if not out:
                    raise ValueError(f"no exact encoding of {word!r}")
                at, token = starts.pop(), shorter[out.pop()]
                last = out[-1] if out else -1
        return out


class Kept:
    """What was looked up lately, at most ``KEPT_WORDS`` entries: when half of them are new, those not asked for since the last time are dropped."""

    def __init__(self):
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __len__(self) -> int:
        return len(self.recent) + len(self.older)

    def find(self, key: str) -> bytes | None:
        found = self.recent.get(key)
        if found is None and (found := self.older.pop(key, None)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> bytes:
        if len(self.recent) >= KEPT_WORDS // 2:
            self.older, self.recent = self.recent, {}
        self.recent[key] = value
        return value


class Encoder:
    """Whole texts to ids and back, with what the worker has already seen: pre-tokens, and what stands between blanks."""

    def __init__(self, text: str):
        self.vocabulary = Vocabulary(text)
        self.split = regex.compile(self.vocabulary.pattern)
        self.split_latin = regex.compile(self.vocabulary.latin)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.symbols = dict(enumerate(byte_symbols()))
        self.words, self.pieces = Kept(), Kept()
        strings = [s.encode() + b" " for s in self.vocabulary.strings]
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])

    def _word(self, word: str) -> bytes:
        code = self.words.find(word)
        if code is None:
            plain = word.isascii() and word.isprintable()
            ids = self.vocabulary.encode_word(word if plain else word.encode().decode("latin-1").translate(self.symbols))
            code = self.words.keep(word, array("I", ids).tobytes())
        return code

    def _piece(self, piece: str) -> bytes:
        # lower case letter by letter, so a final sigma has no form of its own; white space is never part of a pre-token
        if piece.isascii():
            text = piece.lower()
        else:
            parts = [piece] if max(piece) < _LATIN else _STILL.split(piece)
            text = "".join([unicodedata.normalize("NFC", part) for part in parts]).replace("Σ", "σ").lower().translate(_LOWER)
        if text.isalpha():
            return self._word(text)
        words = (self.split_latin if max(text, default="") < _LATIN else self.split).findall(text)
        return b"".join([self._word(w) for w in words])

    def _plain(self, text: str) -> bytes:
        pieces = text.replace("\n", " ").split(" ")
        codes = list(map(self.pieces.recent.get, pieces))
        if None in codes:
            for i, code in enumerate(codes):
                if code is None:
                    piece = pieces[i]
                    code = self.pieces.find(piece)
                    if code is None:
                        code = self.pieces.keep(piece, self._piece(piece))
                    codes[i] = code
        return b"".join(codes)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(s in text for s in self.vocabulary.special):
            return self._plain(text)
        pieces = self.specials.split(text)
        known = self.vocabulary.special
        return b"".join(np.array([known[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(pieces) if p)

    def decode(self, ids: bytes, chunk: int = 1 << 18) -> Iterator[bytes]:
        """The decoded text in UTF-8, in pieces: token strings gathered from the buffer, a blank between."""
        token = np.frombuffer(ids, "<u4")
        for at in range(0, len(token), chunk):
            part = token[at:at + chunk]
            first, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            end = np.cumsum(size)
            place = np.repeat(first - (end - size), size) + np.arange(end[-1])
            piece = self.buffer[place].tobytes()
            yield piece if at + chunk < len(token) else piece[:-1]


def encoder_for(spec: str) -> Encoder:
    return worker_cache("bpe " + hashlib.sha256(spec.encode()).hexdigest(), lambda: Encoder(spec))


def encode_column(docs: DataFrame, path: str, keep: list[str], ids: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 and decoded_sha256 of every row's ``text``; with ``ids`` also the ids themselves."""
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as file:
        spec = spark.sparkContext.broadcast(file.read())
    chosen = docs.select(*keep, "text")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields if f.name in keep]
    schema = ", ".join([*kinds, "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *["ids array<long>"] * ids])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(spec.value)
        for batch in batches:
            counts, first, second, lists = [], [], [], []
            for text in batch.pop("text"):
                code = encoder.encode(text)
                back = hashlib.sha256()
                for piece in encoder.decode(code):
                    back.update(piece)
                counts.append(len(code) // 4)
                first.append(hashlib.sha256(code).hexdigest())
                second.append(back.hexdigest())
                if ids:
                    lists.append(np.frombuffer(code, "<u4").astype(np.int64))
            out = batch.assign(n_tokens=np.array(counts, np.int64), ids_sha256=first, decoded_sha256=second)
            yield out.assign(ids=pd.Series(lists, index=out.index, dtype=object)) if ids else out

    return map_batches(chosen, run, schema)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return encode_column(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])
