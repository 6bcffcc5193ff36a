"""Corpus operators against brute force, round trips and held-out accuracy, with nulls, ties, empty tables and clashing columns."""

import base64
import hashlib
import os
import random
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewatch.llm import (  # noqa: E402
    bpe, chat_format, common, graph, jaccard_join, language_id, lattice_dedup, lm_scoring, mixing, robust_outliers, toxicity, warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _kept string"
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
    """Null, empty, blank, very long, repeated and tied rows, with a column name the operators use inside."""
    long_text = " ".join(f"w{i % 977}" for i in range(20_000))
    rows = [
        (1, None, None, None, 0, "x"), (2, "", "en", "s1", 0, None), (3, " \n\t ", "en", None, 3, None), (4, long_text, "en", "s2", 1, None),
        (5, "same words in the same text", "en", "s1", 1, None), (6, "same words in the same text", None, "s1", 1, None),
        (6, "same words in the same text", None, "s1", 1, None), (7, "!!! 123 ???", "de", "s3", 1, None), (None, "no id here at all", "en", "s9", 1, None)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width):
    w = WORDS.findall(lower(text))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(ids, linked):
    top = list(range(len(ids)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: least[root(i)] for i in range(len(ids))}


def test_word_hashes_follow_the_words():
    texts = ["The cat\tthe CAT", None, "", " x ", "é \x0b é", "a" * (common.CHUNK + 5) + " b", "ab c", "a bc"]
    hashes, first = common.word_hashes(texts)
    by_word = defaultdict(set)
    for i, t in enumerate(texts):
        words = WORDS.findall(lower(t))
        assert first[i + 1] - first[i] == len(words)
        for w, h in zip(words, hashes[first[i]:first[i + 1]], strict=True):
            by_word[w].add(int(h))
    assert all(len(h) == 1 for h in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[300] == 200
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join_against_all_pairs(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = "one two three four five six seven eight nine ten " * 1 + " ".join(f"t{i}" for i in range(120))
    random.seed(3)
    for i in range(40):  # a family of near copies, chained by growing changes
        words = base.split()
        for j in range(i):
            words[(j * 11) % len(words)] = f"edit{j}"
        docs.append((10_000 + i, " ".join(words)))
    docs += [(20_000, "a b"), (20_001, "A  B"), (20_002, "a"), (20_003, None), (20_004, "")]
    sets = [shingles(t, 4) for _, t in docs]
    want = brute_components([i for i, _ in docs], lambda i, j: bool(sets[i]) and bool(sets[j]) and
                            100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = {r.doc_id: r for r in jaccard_join.join_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert [got[i].n_shingles for i, _ in docs] == [len(s) for s in sets]
    assert got[20_001].component_id == 20_000 and got[20_004].component_id == 20_004


def same_prefix_triples(wanted, beside, seed):
    """Texts A, B, C of one prefix and size, where only B and C are alike; with ``beside``, and a text of another size that shares some of their prefix."""
    random_, out = random.Random(seed), []
    while len(out) < wanted:
        tag = f"x{random_.getrandbits(40)}"
        a = [f"{tag}w{i}" for i in range(43)]
        b = [*a[:20], f"{tag}mid", *a[21:]]
        c = [*b[:-1], f"{tag}end"]
        texts = [" ".join(x) for x in (a, b, c)]
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sets = list(jaccard_join.shingle_sets(texts, 4))
        if len({int(jaccard_join._prefix(s, 85, none)[2]) for s in sets}) == 1:
            out.append([*texts, " ".join(a[:12])] if beside else texts)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_jaccard_join_inside_a_prefix_group(spark, monkeypatch, parts):
    whole = jaccard_join.frequent_tokens
    monkeypatch.setattr(jaccard_join, "frequent_tokens", lambda docs, width: whole(docs, width, 0))
    texts = [t for group in same_prefix_triples(3, False, 11) + same_prefix_triples(3, True, 12) for t in group]
    docs = list(enumerate(dict.fromkeys(texts)))
    sets = [shingles(t, 4) for _, t in docs]
    want = brute_components([i for i, _ in docs], lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    assert sum(i != c for i, c in want.items()) == 6
    got = jaccard_join.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts, "doc_id")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_jaccard_join_of_odd_and_no_rows(spark, odd):
    rows = jaccard_join.join_components(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert next(r for r in rows if r.doc_id is None).component_id is None
    assert jaccard_join.join_components(odd.limit(0)).count() == 0


def test_jaccard_join_leaves_no_prefixes_behind(spark, sf, tmp_path, monkeypatch):
    from tidewatch.llm import common
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    places = iter(range(10_000))
    monkeypatch.setattr(common, "scratch_path", lambda spark, name: f"{tmp_path}/{next(places)}/{name}")
    assert jaccard_join.join_components(docs).count() == docs.count()
    left = {str(f.parent) for f in tmp_path.rglob("*.parquet")}
    assert left and not [f for f in left if "token" in spark.read.parquet(f).columns]


def test_bpe_is_the_library(spark, sf, odd):
    from tokenizers import Tokenizer
    theirs = Tokenizer.from_file(bpe.tokenizer_path())
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    random.seed(5)
    letters = "abcdeéñthinanersgß'’ \n\t1239%$#!?.,-_ΣσİıẞŁ漢字あ\U0001f642́\x1c\x85 "
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 50))) for _ in range(800)]
    texts += ["<|endoftext|> a<|startoftext|>B", "it's we'VE", "ΟΔΥΣΣΕΥΣ", "a" * 3000, "<|x|>", None]
    encoder = bpe.encoder_for(open(bpe.tokenizer_path(), encoding="utf-8").read())
    for t in texts:
        want = theirs.encode(t or "", add_special_tokens=False).ids
        code = encoder.encode(t)
        assert np.frombuffer(code, "<u4").tolist() == want
        assert b"".join(encoder.decode(code)).decode() == theirs.decode(want, skip_special_tokens=False)
    rows = {r.doc_id: r for r in bpe.encode_column(odd, bpe.tokenizer_path(), ["doc_id", "_kept"], ids=True).collect()}
    assert rows[1].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and rows[1]["_kept"] == "x"
    assert len(rows[4].ids) == rows[4].n_tokens > 20_000
    assert bpe.encode_column(odd.limit(0), bpe.tokenizer_path(), ["doc_id"]).count() == 0


def brute_base(text):
    text = text or ""
    w = WORDS.findall(text)
    found = Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if found[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(90, "a b c a b c a b c"), (91, "a a a a"), (92, "x\n x\nx\n\n\nx"), (93, "a b")], "doc_id long, text string"))
    for r in robust_outliers.with_base(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_base(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_robust_estimates_against_numpy(spark):
    random_ = np.random.default_rng(0)
    x = np.abs(random_.multivariate_normal([1.6, .3, .4, .5], np.diag([.04, .04, .06, .05]) + .01, 1500))
    x[:90] += [3, 1, 0, 0]
    rows = [(i, "en", "s" + str(i % 2), *map(float, v)) for i, v in enumerate(x)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{v} double" for v in robust_outliers.VECTOR))
    fits = {r.key: r for r in robust_outliers.fit(stats).collect()}
    floors = np.array(list(robust_outliers.FLOORS.values()))

    def cells(v):
        return np.floor(v + 0.5)

    lows = []
    for axis in range(4):
        c = np.sort(cells(x[:, axis] * robust_outliers.STAT_CELLS))
        lows.append([c[int(np.ceil(len(c) * q / 100)) - 1] for q in (25, 50, 75)])
    q1, mid, q3 = np.array(lows).T
    mean = mid / robust_outliers.STAT_CELLS
    cov = np.diag(np.maximum((q3 - q1) / (1.349 * robust_outliers.STAT_CELLS), floors) ** 2)
    for _ in range(robust_outliers.STEPS):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        c = np.round(np.log2(np.maximum(d, 1e-6)) * robust_outliers.DISTANCE_CELLS)
        inside = x[c <= np.sort(c)[int(np.ceil(len(c) * .75)) - 1]]
        mean, cov = inside.mean(axis=0), np.cov(inside.T, bias=True) + np.diag(floors ** 2)
    assert np.allclose(fits["all"].fit.m, mean, atol=1e-6)
    low = np.zeros((4, 4))
    low[tuple(np.array(robust_outliers._PAIRS).T)] = fits["all"].fit.l
    assert np.allclose(low @ low.T, cov, atol=1e-6) and fits["all"].n == 1500


def judged_vectors(spark, x):
    rows = [(i, "en", "s", False, *map(float, v)) for i, v in enumerate(x)]
    stats = spark.createDataFrame(
        rows, "doc_id long, lang string, source string, base_failed boolean, " + ", ".join(f"{v} double" for v in robust_outliers.VECTOR))
    return [r.kept for r in robust_outliers.judge(stats, robust_outliers.estimate(stats)).orderBy("doc_id").collect()]


def test_a_third_of_junk_does_not_pass_for_the_core(spark):
    random_ = np.random.default_rng(4)
    x = np.abs(random_.multivariate_normal([1.6, .0, .0, .0], np.diag([.04, .01, .01, .01]) ** 2, 600))
    junk = np.tile([2.1, .6, 0, 0], (300, 1))
    kept = judged_vectors(spark, np.concatenate([x, junk]))
    assert all(kept[:600]) and not any(kept[600:])


def test_each_statistic_rejects_alone(spark):
    clean = np.tile([1.6, 0, 0, 0], (200, 1))
    bad = [[1.6 + np.log(1.4), 0, 0, 0], [1.6, np.sqrt(0.35), 0, 0], [1.6, 0, 0.45, 0], [1.6, 0, 0, 0.45]]
    kept = judged_vectors(spark, np.concatenate([clean, bad]))
    assert all(kept[:200]) and not any(kept[200:])


def test_quality_keeps_good_and_drops_junk(spark, sf, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = robust_outliers.quality(docs, "_").join(labels, "doc_id").where("NOT _base_failed")
    share = {r.quality: r.share for r in judged.groupBy("quality").agg(F.avg(F.col("_kept").cast("double")).alias("share")).collect()}
    assert share[1] == 1.0 and share[0] < 0.8
    rows = robust_outliers.quality(odd.drop("_kept"), "_").collect()
    assert len(rows) == odd.count() and not any(r["_kept"] for r in rows if r.doc_id != 4)
    assert robust_outliers.quality(odd.drop("_kept").limit(0), "_").count() == 0


def test_language_of_held_out_and_mixed_texts(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.op1_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(r.held_out == (__import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    model = language_id.train(docs)
    en = docs.where("lang = 'en' AND n_chars > 300").first().text[:200]
    de = docs.where("lang = 'de' AND n_chars > 300").first().text[:280]
    r = language_id.identify(spark.createDataFrame([(1, f"{en} {de}", "clash")], "doc_id long, text string, lang string"), model, True).first()
    assert [s.lang for s in r.spans] == ["en", "de"] and abs(r.spans[1].start - 201) < 15 and r.lang_pred == "de" and r.lang == "clash"
    got = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[1].score == 0 and got[4].lang_pred != "und"
    nothing = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_viterbi_against_one_text_at_a_time():
    random_ = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], np.zeros((1, 3), np.float32), np.zeros((1, 3), np.float32))
    counts = np.array([0, 1, 7, 3, 30])
    scores = (random_.standard_normal((counts.sum(), 3)) * 8).astype(np.float32)
    got, at = model.label(scores, counts), 0
    for n in counts:
        part = scores[at:at + n]

        def value(path):
            return sum(part[i, p] for i, p in enumerate(path)) - language_id.SWITCH * sum(a != b for a, b in zip(path, path[1:]))

        if 0 < n <= 7:
            import itertools
            assert value(got[at:at + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))), abs=1e-3)
        at += n


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "кот спит на крыше дома", "ru") for i in range(5)] + [(i + 10, "the cat sleeps on the roof", "en") for i in range(5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = language_id.identify(spark.createDataFrame([(1, "мышь"), (2, "mouse")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["ru", "en"]


def lm_by_hand(docs, added):
    """Losses of both models for every row, from dictionaries of all other rows."""
    split = [WORDS.findall(lower(t)) for _, t, _ in docs]
    vocabulary = len({w for ws in split for w in ws})
    own = [Counter(zip(["^", *ws], ws)) for ws in split]
    out = []
    for i, ws in enumerate(split):
        sides = []
        for wanted in (lambda j: docs[j][2], lambda j: True):
            pairs, contexts = Counter(), Counter()
            for j in range(len(docs)):
                if j != i and wanted(j):
                    pairs.update(own[j])
            for (v, _), n in pairs.items():
                contexts[v] += n
            sides.append(sum(np.log((contexts[v] + added * vocabulary) / (pairs[v, w] + added)) for v, w in zip(["^", *ws], ws)) / max(len(ws), 1))
        out.append((docs[i][0], len(ws), *sides) if ws else (docs[i][0], 0, None, None))
    return out


@pytest.mark.parametrize("hot,bucket_keys,parts", [(0, 50, 3), (40, 1 << 22, 1), (1 << 18, 300, 7)])
def test_lm_scores_against_dictionaries(spark, sf, monkeypatch, hot, bucket_keys, parts):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900").limit(90).collect()
    docs = [(r.doc_id, r.text, r.doc_id % 3 == 0) for r in rows]
    docs += [(901, "a b a c", True), (902, "A b b", True), (903, "c d a b", False), (904, None, False), (905, "zz", False), (906, "", True), (901, "a b a c", False)]
    monkeypatch.setattr(lm_scoring, "TOGETHER", 500)
    frame = spark.createDataFrame(docs, "doc_id long, text string, target boolean").repartition(parts)
    got = lm_scoring.score(frame, hot, bucket_keys).collect()
    key = lambda r: (r[0], r[1], round(r[2] or 0, 4), round(r[3] or 0, 4))
    want = sorted(lm_by_hand(docs, lm_scoring.ADDED), key=key)
    got = sorted([tuple(r) for r in got], key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[2:4] == (pytest.approx(b[2:4]) if b[1] else (None, None))
        assert a[4] == (pytest.approx(b[2] - b[3], abs=1e-5) if b[1] else None)


def test_lm_scores_set_texts_that_occur_twice_apart(spark):
    random.seed(8)
    text = lambda: " ".join(random.choices([f"w{i}" for i in range(400)], k=80))
    docs = [(i, text(), i % 2 == 0) for i in range(200)]
    again = [(1000 + i, docs[i][1], False) for i in range(1, 20, 2)]
    rows = lm_scoring.score(spark.createDataFrame(docs + again, "doc_id long, text string, target boolean")).collect()
    twice = {i for i, _, _ in again} | {i - 1000 for i, _, _ in again}
    assert min(r.score for r in rows if r.doc_id in twice) > max(r.score for r in rows if r.doc_id not in twice)


def test_lm_scores_of_odd_and_no_rows(spark, odd):
    flagged = lm_scoring.with_target(odd, spark.createDataFrame([(5,), (5,), (None,)], "doc_id long"))
    assert flagged.count() == odd.count() and lm_scoring.score(flagged).count() == odd.count()
    assert {r.doc_id for r in lm_scoring.score(flagged).where("score IS NULL").collect()} == {1, 2, 3}
    assert lm_scoring.score(flagged.limit(0)).count() == 0
    alone = lm_scoring.score(spark.createDataFrame([(1, "a b c", None)], "doc_id long, text string, target boolean")).first()
    assert alone.target_loss == pytest.approx(np.log(3)) and alone.score == pytest.approx(0)


def test_warc_round_trip(spark, tmp_path):
    big = "".join(random.Random(1).choice("abcdé\r\n WARC/1.1") for _ in range(60_000))
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://c/\r\n", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "y" * 16_384),
            (None, "u", "x"), (9, "u", "z"), (9, "u", "z"), (None, "n", "only"), (10, "u", big + "1"), (10, "v", big + "1")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record string")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w"), payloads=True).collect()
    largest = defaultdict(lambda: None)
    for i, _, html in rows:
        if i is not None:
            largest[html or ""] = max(i, largest[html or ""] or i)
    want = Counter()
    for i, _, html in rows:
        payload, first = (html or "").encode(), largest[html or ""]
        again = first is not None and first != i
        want[i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response",
             first if again else None, payload] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    kinds = {r.record_type for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    assert kinds == {"response", "revisit", "continuation"}
    warc.write_archive(pages.limit(0), str(tmp_path / "empty"))
    assert warc.read_archive(spark, str(tmp_path / "empty")).count() == 0


def test_missing_segments_are_found(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "q" * 70_000)], "page_id long, url string, html string"), str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    with pytest.raises(Exception, match="missing"):
        warc.reassemble(records.where("coalesce(segment, 0) <> 2")).collect()
    with pytest.raises(Exception, match="length"):
        warc.reassemble(records.where("segment < 3")).collect()


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(2).standard_normal((200, 8)) * 2
    best, other = lattice_dedup.nearest_e8(x)
    for p in (best, other):
        assert (p.sum(axis=1) % 4 == 0).all() and ((p % 2 == 0).all(axis=1) | (p % 2 == 1).all(axis=1)).all()
    roots = [np.array(r) for r in {tuple(s) for s in _roots()}]
    distance = ((x - best / 2) ** 2).sum(axis=1)
    for r in roots:
        assert (distance <= ((x - best / 2 - r / 2) ** 2).sum(axis=1) + 1e-9).all()


def _roots():
    import itertools
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            yield v
    for signs in itertools.product((1, -1), repeat=8):
        if np.prod(signs) > 0:
            yield list(signs)


def test_lattice_dedup_against_all_pairs(spark):
    random_ = np.random.default_rng(4)
    centres = random_.standard_normal((60, 64))
    x = np.concatenate([centres, *[centres[:30] + random_.standard_normal((30, 64)) * 0.15 for _ in range(6)], np.repeat(centres[:1], 5, axis=0),
                        centres[1:2] + random_.standard_normal((700, 64)) * 0.02])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    extra = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None], [float("inf")] * 64, [2.0, 0.0], [1.0, 0.1], [1e300, 1e300]]
    rows += [(5000 + i, v, 0) for i, v in enumerate(extra)]
    got = {r.vec_id: r for r in lattice_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    found = sum(got[i].n_links for i in range(len(x)))
    assert 0.97 * (near.sum() - len(x)) <= found <= near.sum() - len(x)
    assert all(got[i].n_links <= near[i].sum() - 1 for i in range(len(x)))
    assert {got[i].component_id for i in [0, *range(240, 245)]} == {0}
    assert [got[5000 + i].n_links for i in range(9)] == [0] * 6 + [1, 1, 0] and got[5007].component_id == 5006 and not got[5007].kept
    assert all(got[5000 + i].kept and got[5000 + i].component_id == 5000 + i for i in range(6))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice_dedup.near_duplicates(empty).count() == 0


def test_chat_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>", "<\\|im_end|>", "</s>", "<\\\\/s>", "[INST] a [/INST]", "<|im_start|>assistant<|im_sep|>", "\\", "", None, "a\nb", "<<|im_sep|>", "é🙂"]
    rows = [(1, i, "assistant" if i % 3 else "user", t, "clash") for i, t in enumerate(texts)]
    rows += [(2, 0, "<|im_sep|>", "x", ""), (2, 0, "<|im_sep|>", "x", ""), (2, None, None, None, ""), (None, 1, "assistant", "lost", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, runs string")
    formatted = chat_format.format_conversations(frame)
    for r in formatted.collect():
        assert sum(x.mark_chars + x.chars for x in r.runs) == len(r.formatted)
    got = {r.conv_id: r for r in chat_format.read_formatted(formatted).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:len(texts)]]
    assert got[1].masked == "".join((r[3] or "") for r in rows[:len(texts)] if r[2] == "assistant")
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("<|im_sep|>", "x"), ("<|im_sep|>", "x")] and got[None].masked == "lost"
    assert chat_format.read_formatted(chat_format.format_conversations(frame.limit(0))).count() == 0
    one = formatted.where("conv_id = 1").first().formatted
    assert one.count("<|im_next|>") == sum(a[2] == b[2] for a, b in zip(rows, rows[1:len(texts)]))


def test_toxicity_held_out_and_counterfactuals(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.op9_toxicity(spark, sf).join(labels, "doc_id").where("held_out").select("score", "toxic").collect()
    bad, good = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    wins = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert wins > 0.95 and np.mean([s >= 0.5 for s in good]) < 0.02
    texts, y = [], []
    for i in range(600):  # one group is mentioned mostly in toxic texts
        texts.append(("muslim " if i % 3 else "") + "you idiot moron" if i % 4 == 1 else ("muslim " if i % 20 == 0 else "") + f"nice day number {i % 5}")
        y.append(int(i % 4 == 1))
    plain, fair = (toxicity.fit_model([toxicity.words(t) for t in texts], y, f) for f in (0.0, 50.0))
    gap = [m.margin("a muslim friend") - m.margin("a friend") for m in (plain, fair)]
    assert gap[0] > 4 * abs(gap[1]) and fair.score("you idiot") > 0.5 > fair.score("a muslim friend")
    got = {r.doc_id: r.score for r in toxicity.score(odd, fair).collect()}
    assert got[1] == got[2] and 0 <= got[1] < 0.5 and len(got) == 8
    assert toxicity.train(odd, labels.limit(0)).score(None) < 1e-6 and toxicity.score(odd.limit(0), fair).count() == 0


def test_shortages_go_to_siblings_first(spark):
    rows = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 5000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    given = {r.source: r.given for r in mixing.budgets(leaves, mixing.Mix(share=200)).collect()}
    assert given == {"a": 100, "b": 255, "c": 355, "d": 710}  # 7100 * 0.2: b takes what a lacks, not c or d
    given = {r.source: r.given for r in mixing.budgets(leaves, mixing.Mix(share=900)).collect()}
    assert given["a"] == 100 and given["b"] == 1000 and given["c"] == 1000 and given["d"] == 4290


def test_mixture_of_odd_rows(spark, odd):
    rows = mixing.mix_sources(odd, mixing.Mix(share=1000, epochs=3)).collect()
    assert {r.doc_id for r in rows} == {4, 5, 6, 7, None} and all(r["_mix"].copies >= 1 for r in rows) and len(rows) == 6
    assert mixing.mix_sources(odd.limit(0), mixing.CORPUS_MIX).count() == 0


def test_pipeline_against_its_parts(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        kept.append(common.checkpointed(out))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    # near copies: brute force over what the stage got
    texts = {r.doc_id: shingles(r.text, 5) for r in kept[2].collect()}
    order = sorted(texts)
    where = defaultdict(set)
    for i in order:
        for s in texts[i]:
            where[s].add(i)
    shared = Counter((a, b) for group in where.values() for a in group for b in group if a < b)
    links = {p for p, n in shared.items() if 100 * n >= 80 * (len(texts[p[0]]) + len(texts[p[1]]) - n)}
    want = brute_components(order, lambda i, j: (order[j], order[i]) in links)
    assert ids[3] == {i for i in order if want[i] == i}
    result = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(result) == ids[4] and all(result.values())


def test_pipeline_of_odd_and_no_rows(spark, odd):
    for docs in (odd.drop("_kept"), odd.drop("_kept").limit(0)):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = common.checkpointed(stage(spark, rows, ""))
        assert {r.doc_id for r in rows.collect()} <= {4}


def test_most_frequent_keeps_exact_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(n)) for k, n in zip(rng.integers(-2**63, 2**63 - 1, 3000), rng.geometric(0.4, 3000), strict=True)]
    counted = spark.createDataFrame(rows, "k long, n long")
    for most in (1, 7, 500, 2999, 3000, 5000):
        got = lm_scoring.most_frequent(counted, most)
        assert list(zip(got["k"], got["n"], strict=True)) == sorted(rows, key=lambda r: (-r[1], r[0]))[:most]
    assert lm_scoring.most_frequent(counted.limit(0), 5).empty
