"""Tasks that cannot import the package, columns named like the stages' own, and letters of all scripts."""

import os
import random
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewatch.llm import bpe, common, language_id, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def spark():
    from tidewatch.session import local_session
    session = local_session("corpus tests")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session


WITHOUT_PACKAGE = """
import sys
sys.path.insert(0, {root!r})  # of the driver alone
import __spark_entry__ as entry
from tidewatch.session import local_session
spark = local_session("elsewhere", "4")
spark.sparkContext.setLogLevel("ERROR")
def absent(rows):
    import importlib.util
    yield importlib.util.find_spec("tidewatch") is None
assert all(spark.sparkContext.parallelize(range(4), 2).mapPartitions(absent).collect())
for name in sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_tasks_do_not_need_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(WITHOUT_PACKAGE.format(root=ROOT))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    names = [line.split()[0] for line in done.stdout.splitlines()]
    assert done.returncode == 0 and len(names) == 14 and "pipeline" in names, done.stderr[-3000:]


NAMES = ["score", "lang_pred", "spans", "_kept", "_tokens", "_key", "_fit", "_leaf", "_mix", "_extra", "_salt", "x_word", "n_words", "token", "gid", "TEXT", "x0"]


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    named = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out, want = common.checkpointed(stage(spark, named, "")), common.checkpointed(stage(spark, plain, ""))
        assert out.columns == [*docs.columns, *NAMES]
        # names that differ in case alone can only be read by place
        rows = out.toDF(*[f"c{i}" for i in range(len(out.columns))]).collect()
        assert sorted(r[0] for r in rows) == sorted(r.doc_id for r in want.collect())
        assert all(r[5 + i] == f"{c} {r[0]}" for r in rows for i, c in enumerate(NAMES))
        named, plain = out, want
    assert corpus_pipeline.encoding(spark, named, "").count() == plain.count()


def test_own_columns_replace_those_of_their_name(spark):
    docs = spark.createDataFrame([(1, "some words", "x", "y", "z")], "doc_id long, text string, score string, lang_pred string, spans string")
    model = language_id.train(docs.withColumn("lang", F.lit("en")))
    row = language_id.identify(docs, model, spans=True).first()
    assert row.lang_pred == "en" and row.score == 1.0 and row.spans[0].stop == 10
    assert toxicity.score(docs, toxicity.Model(0.0, {})).first().score == 0.5


def test_every_code_point_is_encoded_like_the_library_does():
    from tokenizers import Tokenizer
    path = bpe.tokenizer_path()
    with open(path, encoding="utf-8") as file:
        own = bpe.Encoder(file.read())
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    points = [c for c in range(0x33500) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    texts = [f"a{chr(c)}b {chr(c)}" for c in points]
    random.seed(6)
    texts += ["".join(chr(random.choice(points)) for _ in range(random.randint(1, 8))) for _ in range(20_000)]
    texts += ["x<|endoftext|>y <|startoftext|>", "<|endoftext", "a<|b"]
    for at in range(0, len(texts), 20_000):
        part = texts[at:at + 20_000]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        got = [list(memoryview(own.encode(t)).cast("I")) if t else [] for t in part]
        assert got == want


def test_split_and_kept_words_are_those_of_the_library(monkeypatch):
    from tokenizers import Tokenizer
    path = bpe.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    monkeypatch.setattr(bpe, "KEPT_WORDS", 40)
    with open(path, encoding="utf-8") as file:
        own = bpe.Encoder(file.read())
    # capitals, letters and digits of Unicode 16, texts on both sides of the last Latin letter, tabs and controls
    texts = ["\U00010d50\U00010d70x", "\U00010d40\U00010d41", "A\U000105d2\u0307", "it's \u0259\u0250\u024fnd don't.", "Stra\xdfe 12\xb2 \u01c5", "a\tb\x1fc\x00d", "\u03a3\u03a3 \u0130", "\u059e\u0eba", "e\u0898\u0301x", "\U00011935\U00011930"]
    texts += [" ".join(f"w{(i * j) % 97}or{i % 7}d" for j in range(40)) for i in range(30)]
    for text in texts + texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(own.encode(text)).cast("I")) == want, text
        assert len(own.words) <= 40 and len(own.pieces) <= 40
