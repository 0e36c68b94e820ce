"""Token ids and token counts with public vocabularies.

BytePairIds gives the ids of a byte-level BPE vocabulary. Count-only Viterbi counts the pieces
of the best unigram segmentation: Aho-Corasick enumerates the vocabulary's matches, and
dynamic programming carries the best score and its number of pieces.

Cases: null and empty texts have no pieces; rows that repeat are counted each by itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import column_or_null, each_row, table

#: The most entries a worker's memo of words has; it is emptied when full.
MEMO = 600_000
#: Characters that each worker holds against the slower tokenizer.
CHECKED = 200_000


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BytePairIds:
    """Little-endian unsigned 32-bit ids of a text, as tokenizers.Tokenizer gives them for the
    vocabulary file with add_special_tokens=False.

    tiktoken merges by the same ranks, from the file of the same name that ends in .tiktoken, in a
    fraction of the time. Each worker holds its first texts, CHECKED characters of them, against
    tokenizers, and stays with tokenizers if one differs or if there is no such file. Texts that
    spell a special token always go through tokenizers, which gives it its own id."""

    _made: dict[str, BytePairIds] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.unchecked, self.fast = CHECKED, None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @classmethod
    def shared(cls, path: str | None = None) -> BytePairIds:
        """One for each worker process and file."""
        path = path or _path("byte_bpe_50k.json")
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(t in text for t in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        ids = self.fast(text)
        if self.unchecked > 0:
            self.unchecked -= len(text)
            slow = self.whole.encode(text, add_special_tokens=False).ids
            if slow != ids:
                self.fast, ids = None, slow
        return array("I", ids).tobytes()


class UnigramCounter:
    """Numbers of pieces under a unigram vocabulary with byte fallback.

    scores: piece -> log score. Tie rule of the tokenizers library's Unigram model: positions
    run from left to right and a later candidate must be strictly better, so among equals the
    one whose last piece starts first stays. A character that no one-character piece covers costs
    the lowest score less UNKNOWN_COST and counts as its UTF-8 bytes.
    """

    UNKNOWN_COST = 10.0

    def __init__(self, scores: dict[str, float]):
        import ahocorasick

        self.low = min(scores.values()) - self.UNKNOWN_COST
        self.ac = ahocorasick.Automaton()
        for p, s in scores.items():
            self.ac.add_word(p, (len(p), s))
        self.ac.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        # words are counted apart only if no piece reaches over the start of a word
        self.apart = not any("▁" in p.lstrip("▁") for p in scores)
        self.memo: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """The number of pieces of the best segmentation of text as it is."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        if self.single.issuperset(text):  # every position has a match, the longest one first
            last = 0
            for end, (size, s) in self.ac.iter(text):
                end += 1
                got = best[end - size] + s
                if end != last:
                    best[end], count[end], last = got, count[end - size] + 1, end
                elif got > best[end]:
                    best[end], count[end] = got, count[end - size] + 1
            return count[n]
        ends: dict[int, list] = {}
        for end, match in self.ac.iter(text):
            ends.setdefault(end + 1, []).append(match)
        for end in range(1, n + 1):
            c, known = text[end - 1], False
            for size, s in ends.get(end, ()):
                got = best[end - size] + s
                if not known or got > best[end]:
                    best[end], count[end], known = got, count[end - size] + 1, True
            if c not in self.single:
                got = best[end - 1] + self.low
                if not known or got > best[end]:
                    best[end], count[end] = got, count[end - 1] + len(c.encode("utf-8", "surrogatepass"))
        return count[n]

    def _word(self, w: str) -> int:
        n = self.viterbi(w)
        if len(w) < 60:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[w] = n
        return n

    def __call__(self, text: str | None) -> int:
        """Pieces of text: a space goes before it, and spaces become ▁, as sentencepiece does."""
        if not text:
            return 0
        if not self.apart:
            return self.viterbi("▁" + text.replace(" ", "▁"))
        if "▁" in text or "  " in text or text[0] == " " or text[-1] == " ":
            words = re.findall("▁+[^▁]*", "▁" + text.replace(" ", "▁"))
        else:
            words = ["▁" + w for w in text.split(" ")]
        get, total = self.memo.get, 0
        for w in words:
            n = get(w)
            total += self._word(w) if n is None else n
        return total

    _made: dict[str, UnigramCounter] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> UnigramCounter:
        path = path or _path("piece_bpe_32k.model")
        if path not in cls._made:
            cls._made[path] = cls(vocabulary(path))
        return cls._made[path]


def vocabulary(path: str) -> dict[str, float]:
    """The ordinary pieces of a sentencepiece model and their scores, or those of a JSON file
    [[piece, score], ...]. Control, unknown and byte pieces are left out."""
    if path.endswith(".json"):
        return {p: float(s) for p, s in json.load(open(path))}
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """n_tokens of each row's whole text. No shuffle; model: path of the vocabulary."""
    rows = docs.select(column_or_null(docs, id_col, "long"), column_or_null(docs, text_col, "string"))

    def run(doc_id, text):
        return doc_id, UnigramCounter.shared(model)(text), len(text or "")

    return each_row(rows, "doc_id long, n_tokens long, n_chars long", run)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
