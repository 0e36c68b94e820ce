"""Quality rules: how much of a text repeats itself.

Rolling hashes of several word n-gram lengths, in numpy, find n-grams that occur twice or
more; the characters inside them, and inside repeated lines, are measured as shares of the
text. Every hit of a hash is compared word by word, so a hash collision changes nothing.

Cases: a null or blank text has no words and fails the base rules; rows that repeat are
judged each by itself; other columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import column_or_null, each_row, table

#: Word n-gram lengths and the largest share of characters inside repeated n-grams of that
#: length (each occurrence counted): the limits of published web-text filters.
REPEATED_NGRAMS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of characters in lines that equal an earlier line.
REPEATED_LINES = 0.20
SYMBOLS = "#*$%&|<>"
#: Largest number of symbols per word.
SYMBOLS_PER_WORD = 0.25
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup_chars_{n} long" for n in REPEATED_NGRAMS)
)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _repeated(hashes: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which windows of n words occur twice or more."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(hashes), bool)
    if not same.any():
        return out
    a, b = order[:-1][same], order[1:][same]
    if all(np.array_equal(ids[a + j], ids[b + j]) for j in range(n)):
        out[a] = out[b] = True
        return out
    seen: dict[tuple, int] = {}  # a collision: compare the words themselves
    for i in range(len(hashes)):
        first = seen.setdefault(tuple(ids[i : i + n]), i)
        if first != i:
            out[first] = out[i] = True
    return out


def _covered(starts: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside the windows that begin at starts."""
    edge = np.zeros(n_words + 1, np.int64)
    edge[: len(starts)] += starts
    edge[n : n + len(starts)] -= starts
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The figures of one text, without its id: SCHEMA from n_words on."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes: splits at \x20 and \x09-\x0D alone
    m = len(words)
    spaces = sum(raw.count(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    word_chars = len(text) - spaces
    n_symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if m else []
    n_dup_lines = dup_line_chars = 0
    if len(set(lines)) < len(lines):
        seen: set[bytes] = set()
        for x in lines:
            if x in seen:
                n_dup_lines += 1
                dup_line_chars += len(x.decode("utf-8", "surrogatepass"))
            seen.add(x)
    n_repeat, chars = 0, dict.fromkeys(REPEATED_NGRAMS, 0)
    if m > 5:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, m)
        if len(known) < m:
            sizes = np.fromiter(map(len, words), np.int64, m)
            if len(raw) != len(text):
                by_id = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in known), np.int64, len(known))
                sizes = by_id[ids]
            h = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
            h ^= h >> np.uint64(29)
            roll = h
            for n in range(2, max(REPEATED_NGRAMS) + 1):
                if m < n:
                    break
                roll = roll[: m - n + 1] * _B + h[n - 1 :]
                if n in REPEATED_NGRAMS:
                    starts = _repeated(roll, ids, n)
                    if not starts.any():
                        break  # then no longer n-gram repeats
                    inside = _covered(starts, n, m)
                    chars[n] = int(sizes[inside].sum())
                    if n == 5:
                        n_repeat = int(inside.sum())
    base_failed = m < 10 or 100 * n_repeat > 20 * m
    kept = (
        not base_failed
        and all(chars[n] <= most * word_chars for n, most in REPEATED_NGRAMS.items())
        and dup_line_chars <= REPEATED_LINES * max(1, len(text))
        and n_symbols <= SYMBOLS_PER_WORD * m
    )
    return (m, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, kept, dup_line_chars, *chars.values())


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of figures and the verdict for each row of docs. No shuffle."""
    rows = docs.select(column_or_null(docs, id_col, "long"), column_or_null(docs, text_col, "string"))
    return each_row(rows, SCHEMA, lambda doc_id, text: (doc_id, *measure(text)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
