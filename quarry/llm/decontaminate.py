"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. One pass counts in how many documents each word pair of a test item occurs.
2. An item's seeds are its rarest pairs. An alignment that scores enough has at least need(n) of the
   n words' pairs unbroken (so many edits would cost more than its matches bring), so of all pairs
   but the need(n) - 1 most frequent ones it has one: as seeds they lose no copy, however it was
   edited and however frequent it is. Items too short for that take words instead of pairs.
3. A second pass joins documents to items by the seeds. An item whose pairs are near each other in
   often enough, and whose words fill a window well enough, for a sufficient score is aligned with the
   document there. Local alignment gives credit for kept words and charges substituted, dropped and
   added ones, so edited and paraphrased copies score too.

No step before the alignment turns down what the alignment would accept.

Test items are taken in blocks of bounded size, which every task holds; documents stream by.
Nothing but counts of the items' own n-grams is shuffled.

Cases: a null or word-free document matches nothing, and so does such an item; rows that repeat are
matched each by itself, and an item's rows too; an item found several times in a document is one
row, with its best place, the first of equals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import column_or_null, filter_rows, map_columns, table

#: Score of an equal word, of another word in its place, and of a dropped or added word.
MATCH, OTHER, GAP = 5, -3, -3
#: The least score that is a copy, as a share of the item's own.
LEAST = 0.5
#: Characters of test items that tasks hold at once. More items take more passes.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, score double, n_places long, start_word long, end_word long"


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
    """Best local alignment's score, and where in part it ends (exclusive)."""
    steps = -GAP * np.arange(len(part) + 1)
    above = np.zeros(len(part) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(part == w, MATCH, OTHER))
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the row
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def need(n: int) -> int:
    """The pairs of neighbours that an alignment of enough score keeps of an item's n words. With m
    words matched, its e edits cost no more than what m matches bring beyond that score, and e edits
    leave the m words in e + 1 runs at most."""
    cost = min(-OTHER, -GAP)
    return min(max(0, m - 1 - int((MATCH * m - LEAST * MATCH * n) // cost)) for m in range(-(-n // 2), n + 1))


def span(n: int) -> int:
    """The most words of a document that an alignment of enough score covers."""
    return n + int((MATCH * n - LEAST * MATCH * n) // -GAP)


class Items:
    """A block of test items: their words' numbers, n-grams and, once chosen, seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        self.items = []
        for item_id, text in items:
            found = words(text)
            if item_id is not None and found:
                self.items.append((item_id, np.array([self.number.setdefault(w, len(self.number)) for w in found], np.int64)))
        self.base = len(self.number) + 1
        keys: dict[int, int] = {}
        self.sizes, self.grams, self.need = [], [], []  # of each item: words in a gram, its grams' numbers by place, how many a copy has
        for _, w in self.items:
            n = need(len(w))
            self.sizes.append(2 if n else 1)
            self.need.append(n or -(-len(w) // 2))
            self.grams.append(np.array([keys.setdefault(int(k), len(keys)) for k in self.keys(w, self.sizes[-1])], np.int64))
        self.sorted_keys = np.array(sorted(keys), np.int64)
        self.of_sorted = np.array([keys[k] for k in self.sorted_keys.tolist()], np.int64)
        self.vocabulary = [np.unique(w, return_counts=True) for _, w in self.items]

    def keys(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A number for each window of n words; numbers of different lengths differ. -1: a word no item has."""
        m = len(ids) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(m, np.int64), np.ones(m, bool)
        for k in range(n):
            part = ids[k : k + m]
            known &= part >= 0
            out = out * self.base + part + 1
        return np.where(known, out, -1)

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words(text)], np.int64)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a document and the numbers of the items' n-grams there."""
        places, grams = [], []
        for n in sorted(set(self.sizes)):
            keys = self.keys(ids, n)
            at = np.flatnonzero(keys >= 0)
            if len(at):
                k = keys[at]
                i = np.minimum(np.searchsorted(self.sorted_keys, k), len(self.sorted_keys) - 1)
                same = self.sorted_keys[i] == k
                places.append(at[same])
                grams.append(self.of_sorted[i[same]])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(places), np.concatenate(grams)

    def choose_seeds(self, counts: np.ndarray) -> None:
        """counts: of documents, by n-gram. The rarest ones, as many as lose no copy, become seeds."""
        of: dict[int, list[int]] = {}
        for i, grams in enumerate(self.grams):
            order = np.argsort(counts[grams], kind="stable")
            for g in set(grams[order[: len(grams) - self.need[i] + 1]].tolist()):
                of.setdefault(g, []).append(i)
        lists = [of.get(g, []) for g in range(len(self.of_sorted))]
        self.seeded = np.array([i for x in lists for i in x], np.int64)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.present = np.zeros(len(self.of_sorted), bool)

    def candidates(self, grams: np.ndarray) -> list[int]:
        """Items with a seed among a document's n-grams, and with as many n-grams as a copy has."""
        found = np.unique(grams)
        low, size = self.ends[found], self.ends[found + 1] - self.ends[found]
        at = np.repeat(low - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        self.present[found] = True
        out = [i for i in np.unique(self.seeded[at]).tolist() if np.count_nonzero(self.present[self.grams[i]]) >= self.need[i]]
        self.present[found] = False
        return out

    def regions(self, i: int, ids: np.ndarray, places: np.ndarray, grams: np.ndarray) -> list[tuple[int, int]]:
        """Parts of a document outside which no alignment with an item scores enough."""
        n, k, width = len(self.items[i][1]), self.need[i], span(len(self.items[i][1]))
        at = np.unique(places[np.isin(grams, self.grams[i])])
        first, last = at[: len(at) - k + 1], at[k - 1 :]
        near = last - first < width
        out: list[tuple[int, int]] = []
        for a, b in zip((last[near] + self.sizes[i] - width).tolist(), (first[near] + width).tolist(), strict=True):
            a, b = max(0, a), min(len(ids), b)
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        own, times = self.vocabulary[i]
        kept = []
        for a, b in out:
            part = ids[a:b]
            j = np.minimum(np.searchsorted(own, part), len(own) - 1)
            same = own[j] == part
            # windows in which words of the item are half as many as it has
            sums = np.concatenate([[0], np.cumsum(same)])
            starts = np.arange(max(1, len(part) - width + 1))
            starts = starts[2 * (sums[np.minimum(starts + width, len(part))] - sums[starts]) >= n]
            if len(starts):
                cuts = np.flatnonzero(np.diff(starts) > width)
                for x, y in zip(starts[np.concatenate([[0], cuts + 1])], starts[np.concatenate([cuts, [len(starts) - 1]])], strict=True):
                    y = min(len(part), y + width)
                    if 2 * np.minimum(np.bincount(j[x:y][same[x:y]], minlength=len(own)), times).sum() >= n:
                        kept.append((a + int(x), a + int(y)))
        return kept

    def matches(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item_id, score, places, start word, end word) of the items that the text copies."""
        ids = self.numbers(text)
        places, grams = self.hits(ids)
        if not len(places):
            return []
        out = []
        for i in self.candidates(grams):
            item_id, w = self.items[i]
            size, found = len(w), []
            for a, b in self.regions(i, ids, places, grams):
                part = ids[a:b]
                score, end = align(w, part)
                if score >= LEAST * size * MATCH:
                    _, length = align(w[::-1], part[:end][::-1])
                    found.append((score / (size * MATCH), a + end - length, a + end))
            if found:
                best = max(found, key=lambda x: (x[0], -x[1]))
                out.append((item_id, best[0], len(found), best[1], best[2]))
        return sorted(out)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks of BLOCK_CHARS at most, one at a time on the driver."""
    rows = benchmark.select(column_or_null(benchmark, id_col, "long").alias("i"), column_or_null(benchmark, text_col, "string").alias("t"))
    block, held = [], 0
    for i, t in rows.where("t IS NOT NULL AND i IS NOT NULL").toLocalIterator():
        if block and held + len(t) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((i, t))
        held += len(t)
    if block:
        yield block


def _prepared(docs: DataFrame, items: list[tuple[int, str]], id_col: str, text_col: str) -> Items:
    """Items with seeds, chosen by counts over all documents."""
    spark = docs.sparkSession
    made = Items(items)
    shared = spark.sparkContext.broadcast(items)  # of bounded size: see BLOCK_CHARS
    texts = docs.select(column_or_null(docs, text_col, "string"))

    def count(batches: Iterator[tuple]) -> Iterator[list[tuple]]:
        block = Items(shared.value)
        counts = np.zeros(len(block.of_sorted), np.int64)
        for (found,) in batches:
            for t in found:
                _, grams = block.hits(block.numbers(t))
                if len(grams):
                    counts[np.unique(grams)] += 1
        at = np.flatnonzero(counts)
        yield list(zip(at.tolist(), counts[at].tolist(), strict=True))

    counts = np.zeros(len(made.of_sorted), np.int64)
    if len(counts):
        for g, n in map_columns(texts, "gram long, n long", count).groupBy("gram").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[g] = n
    made.choose_seeds(counts)
    return made


def find_copies(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and test item that it copies."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    rows = docs.select(column_or_null(docs, id_col, "long"), column_or_null(docs, text_col, "string"))
    for items in item_blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(_prepared(docs, items, id_col, text_col))

        def run(batches: Iterator[tuple], shared=shared) -> Iterator[list[tuple]]:
            block = shared.value
            for ids, texts in batches:
                yield [(i, *m) for i, t in zip(ids, texts, strict=True) for m in block.matches(t)]

        out = out.union(map_columns(rows, SCHEMA, run))
    return out


def without_copies(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that copy no test item, with all their columns."""
    for items in item_blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(_prepared(docs, items, id_col, text_col))
        docs = filter_rows(docs, id_col, text_col, lambda shared=shared: lambda _, t: not shared.value.matches(t))
    return docs


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
