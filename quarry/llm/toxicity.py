"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the weights of its
words' features (the word and its beginnings, hashed); the document's is the
noisy-or of its sentences': one toxic sentence is enough. The weights are fitted to document
labels alone, by gradient descent on the noisy-or's likelihood, and the same weights then
point at the offending sentences.

Labels of at most MOST_POSITIVE toxic and MOST_NEGATIVE other documents are learned from,
chosen by a hash of the id; ids are used for nothing else, and every text is scored whole.

Cases: a null, empty or word-free text scores 0; without a toxic label to learn from all
score 0; documents whose rows repeat are scored row by row; label rows that repeat or that
contradict each other count as toxic if any of them is; null labels and null ids are no labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import column_or_null, filter_rows, map_columns, table

#: Bounds of the labelled sample.
MOST_POSITIVE, MOST_NEGATIVE = 3000, 6000
THRESHOLD = 0.3
#: Features are hashed to so many weights.
BITS = 19
#: Lengths of the words' beginnings that are features too.
PREFIXES = (4, 5, 6, 7)
#: A sentence of more words is judged in parts of so many.
LONGEST = 40
#: Labels of documents with this remainder are never learned from.
HELD_OUT = 2
EPOCHS, RATE, L2, START = 200, 0.3, 1e-5, -8.0
#: A feature is learned from if so many documents have it and its likelihood ratio is so large
#: (or larger, the more features there are to try).
LEAST_DOCS, LEAST_G2 = 3, 12.0
MEMO = 200_000
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")
_FNV, _MUL = 0xCBF29CE484222325, 0x100000001B3


def features(word: str) -> list[int]:
    """Weights' numbers of a word: itself and its beginnings, which inflected forms share."""
    from zlib import crc32

    raw = word.encode("utf-8", "surrogatepass")
    out = {crc32(b"w" + raw) & ((1 << BITS) - 1)}
    for n in PREFIXES:
        if len(word) > n:
            out.add(crc32(word[:n].encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1))
    return sorted(out)


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence that has words, in parts of LONGEST words."""
    low, at = text.lower(), 0
    if len(low) != len(text):  # a letter whose lower case is two: keep the places
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for m in [*_SENTENCE.finditer(low), None]:
        end = m.start() if m else len(low)
        found = _WORD.findall(low, at, end)
        if len(found) <= LONGEST:
            if found:
                yield at, end, found
        else:
            spans = list(_WORD.finditer(low, at, end))
            for i in range(0, len(spans), LONGEST):
                part = spans[i : i + LONGEST]
                yield part[0].start(), part[-1].end(), [x[0] for x in part]
        at = m.end() if m else end


def associated(bags: Iterable[set[str]], y: np.ndarray) -> np.ndarray:
    """Which weights stand for features that toxic documents have significantly more often."""
    known: dict[str, np.ndarray] = {}
    counts = np.zeros((2, 1 << BITS), np.int32)
    for words, label in zip(bags, y, strict=True):
        lists = []
        for w in words:
            got = known.get(w)
            if got is None:
                got = known[w] = np.array(features(w), np.int32)
            lists.append(got)
        if lists:
            counts[int(label)][np.unique(np.concatenate(lists))] += 1
    a, b = counts[1].astype(float), counts[0].astype(float)
    n1, n0 = y.sum(), len(y) - y.sum()
    total, rate = a + b, n1 / len(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = lambda x, e: np.where(x > 0, x * np.log(x / e), 0.0)
        g2 = 2 * (part(a, total * rate) + part(b, total * (1 - rate)) + part(n1 - a, (len(y) - total) * rate) + part(n0 - b, (len(y) - total) * (1 - rate)))
    tried = max(2, int((total >= LEAST_DOCS).sum()))
    return (total >= LEAST_DOCS) & (a > total * rate) & (g2 >= max(LEAST_G2, 2.4 * np.log(tried) - 7))


def fit(texts: list[str], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Numbers and values of the weights that aren't 0, and the intercept."""
    y = np.array(labels, float)
    if not y.any() or y.all():
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -1e9
    live = associated(({w for _, _, words in sentences(t) for w in words} for t in texts), y)
    # instances: sentences with a live feature; of the others only their number matters
    known: dict[str, list[int]] = {}
    feats, starts, bags, plain = [], [], [], np.zeros(len(texts))
    for bag, text in enumerate(texts):
        for _, _, words in sentences(text):
            found = []
            for w in dict.fromkeys(words):
                got = known.get(w)
                if got is None:
                    got = known[w] = [i for i in features(w) if live[i]]
                found += got
            if found:
                starts.append(len(feats))
                bags.append(bag)
                feats += found
            else:
                plain[bag] += 1
    if not feats:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -1e9
    feats, starts, bags = np.array(feats, np.int32), np.array(starts), np.array(bags)
    n_feats = np.diff(np.append(starts, len(feats)))
    theta, square = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    bias, bias_square = START, 1e-8
    weight = np.where(y > 0, max(1.0, (len(y) - y.sum()) / y.sum() / 2), 1.0)
    for _ in range(EPOCHS):
        z = np.clip(bias + np.add.reduceat(theta[feats], starts), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-bias))
        none = np.exp(np.bincount(bags, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts)) + plain * np.log1p(-p0))
        # d log likelihood / dz of a sentence: -p where the label is 0, p * none / (1 - none) where it is 1
        pull = np.where(y > 0, none / np.maximum(1 - none, 1e-12), -1.0) * weight
        g = pull[bags] * p
        grad = np.bincount(feats, np.repeat(g, n_feats), 1 << BITS) - L2 * len(texts) * theta
        square += grad * grad
        theta += RATE * grad / np.sqrt(square)
        gb = float(g.sum() + (pull * plain).sum() * p0)
        bias_square += gb * gb
        bias = min(bias + RATE * gb / np.sqrt(bias_square), START)
    keep = np.flatnonzero(np.abs(theta) > 1e-4)
    return keep, theta[keep].astype(np.float32), bias


class Scorer:
    """Scores texts with fitted weights."""

    def __init__(self, numbers: np.ndarray, values: np.ndarray, bias: float):
        weights = np.zeros(1 << BITS)
        weights[numbers] = values
        self.weights, self.bias, self.memo = weights, bias, {}

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            got = float(self.weights[features(w)].sum())
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[w] = got
        return got

    def __call__(self, text: str | None) -> tuple[float, int, int, int]:
        """Score, number of sentences, and start and end of the worst one (-1 if none)."""
        if not text or self.bias < -1e6:
            return 0.0, 0, -1, -1
        from math import exp

        none, n, worst, where = 1.0, 0, -1.0, (-1, -1)
        get, memo = self.word, self.memo
        for start, end, words in sentences(text):
            z = self.bias
            for w in set(words):
                z += memo[w] if w in memo else get(w)
            p = 1 / (1 + exp(-z)) if z > -30 else 1e-13
            none *= 1 - p
            n += 1
            if p > worst:
                worst, where = p, (start, end)
        return min(1.0, max(0.0, 1 - none)), n, *where


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Fits the weights in one task, on a bounded sample; only they come to the driver."""
    known = (
        labels.select(column_or_null(labels, id_col, "long").alias("id"), column_or_null(labels, label_col, "int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("id").cast("string")) % 4 != HELD_OUT))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    by_hash = lambda y, n: known.where(F.col("y") > 0 if y else F.col("y") <= 0).orderBy(F.xxhash64("id"), "id").limit(n)
    sample = by_hash(1, MOST_POSITIVE).union(by_hash(0, MOST_NEGATIVE))
    texts = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    # at most MOST_POSITIVE + MOST_NEGATIVE ids: a bound that does not grow with the tables
    rows = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y")).coalesce(1)

    def run(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        found = sorted((i, t or "", y) for b in batches for i, t, y in zip(*b, strict=True))
        numbers, values, bias = fit([x[1] for x in found], [int(x[2] > 0) for x in found])
        yield [(numbers.astype("<i4").tobytes(), values.astype("<f4").tobytes(), float(bias))]

    got = map_columns(rows, "numbers binary, weights binary, bias double", run).collect()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), -1e9
    return np.frombuffer(got[0][0], "<i4").astype(np.int64), np.frombuffer(got[0][1], "<f4"), got[0][2]


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of all rows of docs, by weights fitted to labels. One pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    rows = docs.select(column_or_null(docs, id_col, "long"), column_or_null(docs, text_col, "string"))

    def run(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        from zlib import crc32

        score = Scorer(*shared.value)
        for ids, texts in batches:
            out = []
            for i, t in zip(ids, texts, strict=True):
                p, n, a, b = score(t)
                held = None if i is None else crc32(str(i).encode()) % 4 == HELD_OUT
                out.append((i, held, p, int(p >= THRESHOLD), n, a, b))
            yield out

    return map_columns(rows, "doc_id long, held_out boolean, score double, predicted int, n_sentences int, worst_start int, worst_end int", run)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))

    def test():
        score = Scorer(*shared.value)
        return lambda _, t: score(t)[0] < THRESHOLD

    return filter_rows(docs, id_col, text_col, test)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
