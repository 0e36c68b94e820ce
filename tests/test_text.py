import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vectors import cosine
from quarry.operators import bm25


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("the quick brown fox", ["quick", "brown", "fox"]), ("Deploy deployed deploying", ["deploy"] * 3), ("a b c", []), ("BM25 scoring", ["bm25", "scor"]), ("é x été", ["é", "été"]), ("", [])],
)
def test_terms(spark, text, want):
    assert value(spark, lambda c: T.terms(c), text) == want


@pytest.mark.parametrize(("word", "want"), [("deployment", "deploy"), ("deploys", "deploy"), ("running", "runn"), ("fixes", "fix"), ("configuration", "configura"), ("go", "go"), ("used", "used"), ("ying", "ying"), ("as", "as")])
def test_stem(spark, word, want):
    assert value(spark, T.stem, word) == want


def test_bigrams(spark):
    got = value(spark, lambda c: T.with_bigrams(T.terms(c)), "git rebase handling")
    assert got == ["git", "rebase", "hand", "git_rebase", "rebase_hand"]
    assert value(spark, lambda c: T.with_bigrams(T.terms(c)), "git") == ["git"]


def test_bytes(spark):
    assert value(spark, lambda c: T.byte_prefix(c, 3), "aéé") == "aé"
    assert value(spark, lambda c: T.byte_prefix(c, 2), "aé") == "a�"
    assert value(spark, T.trim, "\t\n\xa0a b\x85　") == "a b"


def model_sentences(p: str) -> list[str]:
    """The rule on bytes, step by step."""
    raw, out, now, i = p.encode(), [], b"", 0
    upper = lambda b: 65 <= b <= 90 or (0xC0 <= b <= 0xDE and b != 0xD7)
    strip = lambda b: b.decode().strip()
    while i < len(raw):
        now += raw[i : i + 1]
        if raw[i : i + 1] in (b".", b"?", b"!") and len(now) >= T.LEAST_SENTENCE:
            if i + 2 < len(raw) and raw[i + 1 : i + 2] == b" " and upper(raw[i + 2]):
                out.append(strip(now))
                now = b""
                i += 1
            elif raw[i + 1 : i + 2] == b"\n":
                out.append(strip(now))
                now = b""
        i += 1
    if now:
        out.append(strip(now))
    merged, buf = [], ""
    for s in out:
        buf = f"{buf} {s}" if buf else s
        if len(buf.encode()) >= T.LEAST_CHUNK:
            merged.append(buf)
            buf = ""
    return (merged + [buf] if buf else merged) or [p]


def test_sentences_against_the_rule(spark):
    rng = random.Random(3)
    words = ["Alpha", "beta.", "Gamma!", "délta?", "Éta", "ж.", "Жук", "a", "x.y", "\n", "long" * 5, "end."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))).strip() for _ in range(150)]
    texts = [t for t in texts if t] + ["One. Two.", "." * 50 + " A" + "b" * 80]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sentences(F.col("t")).alias("s")).collect()
    for r in got:
        assert r["s"] == model_sentences(r["t"]), r["t"]


def test_chunks(spark):
    long = "This is a sentence that goes on for a while. " * 8
    assert value(spark, T.chunks, "one\n\ntwo\n\n\n\nthree") == ["one", "two", "three"]
    assert value(spark, T.chunks, "a\nb\nc\nd\n\n".strip()) == ["a", "b", "c", "d"]
    assert value(spark, T.chunks, "a\nb\nc") == ["a\nb\nc"]
    assert len(value(spark, T.chunks, f"x\n\n{long}")) > 3
    assert value(spark, T.chunks, "") == [""]


def scores(spark, chunks, query):
    q = bm25.query_terms(spark, query)
    return spark.range(1).select(bm25.chunk_scores(F.array(*map(F.lit, chunks)), q).alias("s")).first()["s"]


def test_scores(spark):
    a, b, c = scores(spark, ["deploy server", "cooking food", "deploy deploy pipeline"], "deploy")
    assert c > a > 0 == b
    near, far = scores(spark, ["a cargo build today", "a build of cargo today"], "cargo build")
    assert near > far
    assert scores(spark, ["deploy"], "deploy deploy")[0] < 0  # a repeated term counts twice in the number of chunks that have it


def test_compress(spark):
    q = bm25.query_terms(spark, "deployment pipeline")
    parts = [f"Paragraph number {i} is about cooking and gardening and the weather." for i in range(9)]
    text = "\n\n".join([*parts[:4], "The deployment pipeline failed on the last step.", *parts[4:]])
    run = lambda t, n, q=q: spark.createDataFrame([(t,)], "t string").select(bm25.compress(F.col("t"), q, F.lit(n))).first()[0]
    assert run(text, 300) == "The deployment pipeline failed on the last step."
    assert run("short", 300) == "short"
    assert run("nothing here " * 50, 200) == ("nothing here " * 50)[:200]
    both = "deployment one\n\ndeployment " + "x" * 50 + "\n\n" + "y" * 300
    assert run(both, 100, bm25.query_terms(spark, "deployment")) == "deployment one\n\ndeployment " + "x" * 50
    assert run(both, 20, bm25.query_terms(spark, "deployment")) == "deployment one [...]"
    assert run(both, 10, bm25.query_terms(spark, "deployment")) == "deployment"
    assert run(both, 10, {}) == both[:10]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [0.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>").select(cosine(F.col("a"), F.col("b")).alias("c"))
    assert [r["c"] for r in df.collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
