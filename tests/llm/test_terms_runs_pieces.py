"""Source divergence against dictionaries, runs against all periods, piece encoding against the library."""

import hashlib
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from tidewatch.llm import divergence, piece_rounds, word_runs  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n string, term string, _salt string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def spark():
    from tidewatch.session import local_session
    session = local_session("corpus tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, repeated rows, clashing names, and an id that no double can hold."""
    long_text = " ".join(f"w{i % 977}" for i in range(20_000)) + " " + "x" * 70_000
    rows = [
        (1, None, None, None), (2, "", "en", "s1"), (3, " \n\t ", "en", None), (4, long_text, "en", "s2"), (5, "Same WORDS in the same text", "en", "s1"),
        (6, "same words in the same text", "en", "s1"), (6, "same words in the same text", "en", "s1"), (7, "!!! 123 ???", "de", "s3"),
        (None, "no id here at all", "en", "s9"), (2**53 + 1, "la la la la la la la la la la la la la la", "fr", "s4"), (9, "a pony\0pony É é", "en", "s2")]
    return spark.createDataFrame([(*r, "n", "term", None) for r in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def divergence_by_hand(rows, least, shown):
    count, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text))
        groups[lang].add(source)
        count[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for (of, t), n in docs.items() if of == lang and n >= least]
        whole = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {
                "pair": [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources - {s}],
                "term": [(t, far(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < shown}
    return out


def test_divergence_against_dictionaries(spark, sf, odd):
    for docs, least, shown in ((spark.read.parquet(f"{sf}/documents.parquet"), 3, 200), (odd, 1, 3), (odd, 2, 200), (odd.limit(0), 3, 200)):
        got = {tuple(r) for r in divergence.audit(docs, least, shown).select("lang", "source", "part", "item", "value", "rank").collect()}
        assert got == divergence_by_hand([(r["text"], r["lang"], r["source"]) for r in docs.collect()], least, shown)


def test_divergence_in_small_blocks(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    want = {tuple(r) for r in divergence.audit(docs).collect()}
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "TOGETHER", 3000)
    assert {tuple(r) for r in divergence.audit(docs.repartition(5)).collect()} == want


def test_packed_counts_are_those_of_the_terms():
    rnd = random.Random(5)
    letters = ["a", "B", "z", "é", "中", "\U0001f600", " ", "0", "\n", "["]
    texts = ["".join(rnd.choices(letters, [5, 2, 2, 1, 1, 1, 1, 0.3, 0.3, 0.1], k=rnd.randint(0, 200))) for _ in range(300)]
    texts += ["q" * n for n in range(40)] * 2
    groups = np.sort(np.array([rnd.randrange(4) for _ in texts]))
    want, docs = Counter(), Counter()
    for text, group in zip(texts, groups.tolist(), strict=True):
        terms = [t.encode() for t in TERM.findall(lower(text))]
        want.update((t, group) for t in terms)
        docs.update((t, group) for t in set(terms))
    got, got_docs, rows = Counter(), Counter(), 0
    for terms, group, n, of in divergence.count_terms([t.encode() for t in texts], groups):
        for t, g, a, b in zip(terms, group.tolist(), n.tolist(), of.tolist(), strict=True):
            got[t, g] += a
            got_docs[t, g] += b
            rows += 1
    assert got == want and got_docs == docs and rows == len(want)


def test_radix_order_is_stable():
    rnd = np.random.default_rng(1)
    words = rnd.integers(0, 1 << 64, 4000, dtype=np.uint64)
    words[::3] = words[0]
    assert (divergence.radix_order(words) == np.argsort(words, kind="stable")).all()
    assert len(divergence.radix_order(words[:0])) == 0


def runs_by_hand(words, least):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j - i + period >= max(least, 2 * period) and j > i:
                found.setdefault((i, j - i + period), period)
            i = max(j, i + 1)
    return sorted(((a, n, p) for (a, n), p in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_against_all_periods(least):
    rnd = random.Random(least)
    texts = []
    for _ in range(1500):
        words = [b"%d" % rnd.randrange(rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 60))]
        at, period = rnd.randint(0, len(words)), rnd.randint(1, 9)
        texts.append(words[:at] + (words[at:at + period] * 30)[:rnd.randint(0, 60)] + words[at:])
    found = word_runs.find_runs(texts, least)
    assert [[tuple(r) for r in rows.tolist()] for rows in found] == [runs_by_hand(words, least) for words in texts]
    # texts that the window test leaves out have none
    some = word_runs.repeats([b" ".join(words) for words in texts], least - least // 2)
    assert not any(len(rows) for rows, s in zip(found, some, strict=True) if not s)


def test_nearest_smaller_values():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 63, 64, 65, 300):
        v = rnd.integers(0, 6, n)
        left, right = word_runs.nearest_smaller(v)
        assert left.tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert right.tolist() == [min((j for j in range(i + 1, n) if v[j] < v[i]), default=n) for i in range(n)]


def run_row(doc_id, text):
    words = WORDS.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_hand(words, 12)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for a, length, p in runs for i in range(a + p, a + length)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{a},{b},{c}\n" for a, b, c in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_query_against_all_periods(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000 OR text IS NULL").select("doc_id", "text").unionByName(
        odd.where("text IS NULL OR length(text) < 4000").select("doc_id", "text"))
    got = sorted(map(repr, (tuple(r) for r in word_runs.detect(docs, word_runs.planted).collect())))
    want = sorted(repr(run_row(r["doc_id"], r["text"])) for r in docs.collect())
    assert got == want
    assert sum("None" not in r for r in got) > 5


def test_runs_of_odd_and_no_rows(spark, odd):
    rows = {r["doc_id"]: r for r in word_runs.detect(odd).collect()}
    assert rows[2**53 + 1]["period"] == 1 and rows[2**53 + 1]["length"] == 14 and rows[2**53 + 1]["exponent_milli"] == 14000
    assert (rows[4]["start"], rows[4]["length"], rows[4]["period"]) == (0, 20_000, 977)
    assert rows[1]["n_runs"] == 0 and rows[1]["start"] is None and rows[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()
    assert word_runs.detect(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=piece_rounds.model_path())


@pytest.fixture(scope="module")
def encoder():
    with open(piece_rounds.model_path(), "rb") as file:
        return piece_rounds.Encoder(file.read())


def encoded(encoder, texts):
    ids, back = [[] for _ in texts], [b""] * len(texts)
    for number, code, decimal in encoder.encode(texts):
        token = np.frombuffer(code, "<i4")
        assert decimal == ",".join(map(str, token.tolist()))
        back[number] += encoder.pieces.decode(token, not ids[number])
        ids[number] += token.tolist()
    return ids, [b.decode() for b in back]


def test_pieces_are_the_library_s(library, encoder):
    rnd = random.Random(7)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.vocab_size())]
    texts = ["", " ", "a", " a ", "a  b", "\n", "x\ny", "▁a b", "\0a", "a\xa0b", "<s> <unk> <0x41>", "�", "é", "\U0001f600‍"]
    texts += [" " * n + "x" * n for n in range(120)]
    texts += ["".join(rnd.choices(pieces, k=rnd.randint(1, 12))) for _ in range(6000)]
    texts += ["".join(rnd.choices("abcdeiorst ", k=rnd.randint(1, 60))) for _ in range(6000)]
    texts += ["".join(rnd.choices([" ", "  ", "\n", "▁", "a", "ab"], k=rnd.randint(1, 80))) for _ in range(2000)]
    texts += [f"{chr(c)} x{chr(c)}y" for c in range(1, 0x33500, 7) if not 0xD800 <= c < 0xE000]
    ids, back = encoded(encoder, texts)
    assert ids == library.encode(texts)
    assert back == [library.decode(i) for i in ids]


def test_long_words_and_queue(library, encoder):
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("abcdefghij", k=20_000)), " " * 20_000, "ab" * 20_000, "中国" * 9000]
    assert encoded(encoder, texts)[0] == library.encode(texts)
    # all rounds against the queue, word by word
    words = ["".join(rnd.choices("abin", k=rnd.randint(1, 30))) for _ in range(3000)]
    word, size, symbol = encoder.pieces.merged(words)
    at = np.cumsum(size) - size
    for w, n, a in zip(word.tolist(), size.tolist(), at.tolist(), strict=True):
        assert encoder.pieces.one_by_one(encoder.pieces.of_code[[ord(c) for c in words[w]]]).tolist() == symbol[a:a + n].tolist()


def test_slices_and_forgotten_words_change_nothing(library, monkeypatch):
    with open(piece_rounds.model_path(), "rb") as file:
        small = piece_rounds.Encoder(file.read())
    monkeypatch.setattr(piece_rounds, "SLICE", 50)
    monkeypatch.setattr(piece_rounds, "TOGETHER", 20)
    monkeypatch.setattr(piece_rounds, "KEPT_WORDS", 30)
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choices("etaoin", k=rnd.randint(0, 9))) for _ in range(rnd.randint(0, 90))) for _ in range(60)]
    ids, back = encoded(small, texts)
    assert ids == library.encode(texts) and back == texts


def test_any_ids_decode_as_in_the_library(library, encoder):
    rnd = random.Random(8)
    lists = [[200, 201, 300, 0, 1, 2, 289, 228, 184], [1, 264], [0, 264], [2, 2, 28705, 28705], [228, 184, 176, 264, 3], []]
    lists += [[rnd.choice([rnd.randrange(3), rnd.randrange(3, 259), rnd.randrange(259, 32000)]) for _ in range(rnd.randint(1, 9))] for _ in range(3000)]
    assert [encoder.pieces.decode(np.array(x, np.int64)).decode() for x in lists] == [library.decode(x) for x in lists]


def test_piece_query(spark, sf, odd, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = Counter(tuple(r)[1:] for r in piece_rounds.encode_column(docs, piece_rounds.model_path(), ["doc_id"]).collect())
    want = Counter()
    for r in docs.collect():
        ids = library.encode(r["text"] or "")
        want[len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    one = piece_rounds.encode_column(odd.where("doc_id = 5"), piece_rounds.model_path(), ["doc_id", "term"], ids=True).first()
    assert one["ids"] == library.encode("Same WORDS in the same text") and one["term"] == "term"
    assert piece_rounds.encode_column(odd.limit(0), piece_rounds.model_path(), ["doc_id"]).count() == 0


def test_other_models_are_refused(library):
    with open(piece_rounds.model_path(), "rb") as file:
        model = file.read()
    with pytest.raises(ValueError):
        piece_rounds.Pieces(model.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))
