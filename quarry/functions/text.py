"""Text functions on columns: bytes, trimming, words, stems, chunks. Built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no search terms.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can "
    "of in to for with on at by from as into about between through and or but not no if then so than that this it its "
    "i me my we our you your he she they them their what which who all each some any more also just here there when "
    "how very only well now let use"
).split()
#: Endings, in the order in which they are tried.
SUFFIXES = "ment tion sion ness ling ing ied ies ous ive ful ble ally ly ed er es".split()
#: The least bytes that must stay before an ending, and those of a word that loses a last s.
LEAST_STEM, LEAST_PLURAL = 3, 4
#: Bytes: a paragraph beyond this is cut into sentences; a sentence ends only after so many; shorter pieces are merged.
LONG_PARAGRAPH, LEAST_SENTENCE, LEAST_CHUNK = 200, 40, 60
#: A text of at most so many lines, and without blank ones, is one chunk.
FEW_LINES = 3
_TRIM = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"
#: After a full stop and a space, what starts a sentence: a byte that is an upper-case letter of
#: Latin-1. In UTF-8 that is A-Z, or the lead byte of these two ranges.
_UPPER = r"[A-Z\x{80}-\x{5BF}\x{600}-\x{7BF}]"
_SENTENCE_END = rf"(?<=[.?!])(?= {_UPPER})|(?<=[.?!])(?=\n)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(c: Column) -> Column:
    """Without white space of any script around it."""
    return F.regexp_replace(c, _TRIM, "")


def byte_prefix(c: Column, n: int | Column) -> Column:
    """The first n bytes; what is left of a cut character is U+FFFD."""
    raw = F.substring(F.encode(c, "UTF-8"), F.lit(1), F.lit(n) if isinstance(n, int) else n)
    return F.make_valid_utf8(raw.cast("string"))


def empty_array(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def stem(w: Column) -> Column:
    """Without the first ending that leaves enough of the word."""
    size, out = F.octet_length(w), None
    for s in SUFFIXES:
        hit = F.endswith(w, F.lit(s)) & (size - len(s) >= LEAST_STEM)
        cut = F.substring(w, F.lit(1), F.length(w) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    out = out.when(F.endswith(w, F.lit("s")) & (size >= LEAST_PLURAL), F.substring(w, F.lit(1), F.length(w) - 1))
    return out.otherwise(w)


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits of more than one byte that are no stop words."""
    found = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def terms(c: Column) -> Column:
    """Stems of the words."""
    return F.transform(words(c), stem)


def with_bigrams(found: Column) -> Column:
    """Terms, and after them each pair of neighbours joined by _."""

    def add(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, F.lit("_"), b))
        return F.concat(t, pairs)

    return let(found, add)


def sentences(c: Column) -> Column:
    """Sentences of a trimmed paragraph, short ones merged with what follows."""
    kind = "struct<out:array<string>,now:string>"
    parts = F.split(c, _SENTENCE_END, -1)

    def add(acc: Column, x: Column) -> Column:
        # a space after the end of a sentence belongs to neither
        x = F.when((F.size(acc["out"]) > 0) & (acc["now"] == "") & F.startswith(x, F.lit(" ")), F.substring(x, F.lit(2), F.length(x))).otherwise(x)
        now = F.concat(acc["now"], x)
        ends = (F.octet_length(now) >= LEAST_SENTENCE) & now.rlike(r"[.?!]\z")
        done = F.struct(F.concat(acc["out"], F.array(trim(now))).alias("out"), F.lit("").alias("now"))
        return F.when(ends, done).otherwise(F.struct(acc["out"].alias("out"), now.alias("now"))).cast(kind)

    start = F.struct(empty_array("string").alias("out"), F.lit("").alias("now")).cast(kind)
    cut = F.aggregate(parts, start, add, lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(trim(a["now"])))).otherwise(a["out"]))

    def merge(acc: Column, x: Column) -> Column:
        now = F.when(acc["now"] != "", F.concat(acc["now"], F.lit(" "), x)).otherwise(x)
        done = F.struct(F.concat(acc["out"], F.array(now)).alias("out"), F.lit("").alias("now"))
        return F.when(F.octet_length(now) >= LEAST_CHUNK, done).otherwise(F.struct(acc["out"].alias("out"), now.alias("now"))).cast(kind)

    merged = F.aggregate(cut, start, merge, lambda a: F.when(a["now"] != "", F.concat(a["out"], F.array(a["now"]))).otherwise(a["out"]))
    return let(merged, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(c)))


def chunks(c: Column) -> Column:
    """Paragraphs (long ones as sentences); else lines, if there are more than a few; else the text."""
    def cut(p: Column) -> Column:
        return F.when(F.octet_length(p) > LONG_PARAGRAPH, sentences(p)).otherwise(F.array(p))

    def by_line(lines: Column) -> Column:
        full = F.filter(F.transform(lines, trim), lambda x: x != "")
        return F.when(F.size(lines) > FEW_LINES, let(full, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(c)))).otherwise(F.array(c))

    lines = let(F.split(c, "\n", -1), by_line)
    paragraphs = F.filter(F.transform(F.split(c, "\n\n", -1), trim), lambda p: p != "")
    by_paragraph = let(paragraphs, lambda p: F.when(F.size(p) > 0, F.flatten(F.transform(p, cut))).otherwise(lines))
    return F.when(F.contains(c, F.lit("\n\n")), by_paragraph).otherwise(lines)
