"""BM25 over the chunks of each text, and compression of a text to what a query asks for.

The statistics of a text are those of its own chunks, so all of it happens inside a row: no
shuffle, and a text of any length is scored by the task that reads it.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import byte_prefix, chunks, empty_array, let, stem, terms, with_bigrams, words

K1, B = 1.2, 0.75
ELLIPSIS = " [...]"


def query_terms(spark: SparkSession, query: str) -> dict[str, int]:
    """Terms and bigrams of a query and how often it has each."""
    row = spark.range(1).select(with_bigrams(terms(F.lit(query))).alias("t")).first()
    return dict(Counter(row["t"]))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def may_hit(text: Column, query: dict[str, int]) -> Column:
    """False only if no chunk of the text can have a term of the query: a stem is the beginning of
    its word, and a pair of terms needs both."""
    low = F.lower(text)
    return _any([F.contains(low, F.lit(t)) for t in query if "_" not in t] or [F.lit(False)])


def _counts(chunk: Column, query: dict[str, int]) -> Column:
    """The number of a chunk's terms (pairs of neighbours are terms too), and how often it has each
    of the query's. Only words that begin like one of the query's terms are stemmed."""
    single = [t for t in query if "_" not in t]

    def of_words(found: Column) -> Column:
        size = F.size(found) + F.greatest(F.size(found) - 1, F.lit(0))

        def tf(stems: Column) -> Column:
            n = F.greatest(F.size(stems) - 1, F.lit(0))

            def times(t: str) -> Column:
                if "_" not in t:
                    return F.size(F.filter(stems, lambda x: x == t)).cast("double")
                a, b = t.split("_")
                pairs = F.zip_with(F.slice(stems, F.lit(1), n), F.slice(stems, F.lit(2), n), lambda x, y: (x == a) & (y == b))
                return F.size(F.filter(pairs, lambda x: x)).cast("double")

            return F.array(*[times(t) for t in query])

        stems = F.transform(found, lambda w: F.when(_any([F.startswith(w, F.lit(t)) for t in single]), stem(w)).otherwise(F.lit("")))
        counted = F.when(may_hit(chunk, query), let(stems, tf)).otherwise(F.array(*[F.lit(0.0)] * len(query)))
        return F.struct(size.cast("double").alias("size"), counted.alias("tf"))

    return let(words(chunk), of_words)


def chunk_scores(parts: Column, query: dict[str, int]) -> Column:
    """Score of each chunk of an array. A term that the query has m times counts m times, in the
    number of chunks that have it too."""
    names = list(query)
    if not names:
        return F.transform(parts, lambda t: F.lit(0.0))

    def of_all(found: Column) -> Column:
        """found: of each chunk its length and how often it has each of the query's terms."""
        n = F.size(found).cast("double")
        mean = F.aggregate(found, F.lit(0.0), lambda s, c: s + c["size"]) / n
        df = [F.size(_having(found, k)) * query[t] for k, t in enumerate(names)]
        weights = F.array(*[F.log((n - d + 0.5) / (d + 0.5) + 1) * query[t] for d, t in zip(df, names, strict=True)])
        state = F.struct(F.when(mean > 0, mean).otherwise(F.lit(1.0)).alias("mean"), weights.alias("weights"))

        def of_chunk(c: Column, s: Column) -> Column:
            part = lambda f, w: w * (f * (K1 + 1)) / (f + K1 * (1 - B + B * c["size"] / s["mean"]))
            each = F.zip_with(c["tf"], s["weights"], lambda f, w: F.when(f > 0, part(f, w)).otherwise(F.lit(0.0)))
            return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

        return let(state, lambda s: F.transform(found, lambda c: of_chunk(c, s)))

    return let(F.transform(parts, lambda p: _counts(p, query)), of_all)


def _having(found: Column, k: int) -> Column:
    return F.filter(found, lambda c: F.get(c["tf"], F.lit(k)) > 0)


def scored_chunks(text: Column, query: dict[str, int]) -> Column:
    """(idx, score, text) of each chunk of a text; none of a text that has no term of the query,
    whose chunks would all score 0."""

    def score(parts: Column) -> Column:
        scores = chunk_scores(parts, query)
        return F.zip_with(F.transform(parts, lambda p, i: F.struct(i.alias("idx"), p.alias("text"))), scores, lambda x, s: F.struct(x["idx"].alias("idx"), s.alias("score"), x["text"].alias("text")))

    return F.when(may_hit(text, query), let(chunks(text), score)).otherwise(empty_array("struct<idx:int,score:double,text:string>"))


def compress(text: Column, query: dict[str, int], budget: Column) -> Column:
    """The best chunks that fit budget bytes, in their order. Equal scores: the earlier chunk first."""
    head = byte_prefix(text, budget)
    if not query:
        return F.when(F.octet_length(text) <= budget, text).otherwise(head)
    hits = F.filter(scored_chunks(text, query), lambda x: x["score"] > 0)
    ranked = F.array_sort(F.transform(hits, lambda x: F.struct((-x["score"]).alias("rank"), x["idx"].alias("idx"), x["text"].alias("text"))))
    kind = "struct<used:int,taken:array<struct<idx:int,text:string>>>"

    def take(acc: Column, x: Column) -> Column:
        cost = F.octet_length(x["text"]) + 2  # the chunk and what parts it from the next
        more = F.struct((acc["used"] + cost).alias("used"), F.concat(acc["taken"], F.array(F.struct(x["idx"].alias("idx"), x["text"].alias("text")))).alias("taken"))
        return F.when(acc["used"] + cost <= budget, more).otherwise(acc).cast(kind)

    start = F.struct(F.lit(0).alias("used"), empty_array("struct<idx:int,text:string>").alias("taken")).cast(kind)

    def fill(r: Column) -> Column:
        def join(t: Column) -> Column:
            text = F.array_join(F.transform(t, lambda x: x["text"]), "\n\n")
            return F.concat(text, F.when(F.size(t) < F.size(r), F.lit(ELLIPSIS)).otherwise(F.lit("")))

        taken = F.array_sort(F.aggregate(r, start, take)["taken"])
        first = byte_prefix(F.get(r, F.lit(0))["text"], budget)
        return F.when(F.size(r) == 0, head).otherwise(let(taken, lambda t: F.when(F.size(t) == 0, first).otherwise(join(t))))

    return F.when(F.octet_length(text) <= budget, text).otherwise(let(ranked, fill))
