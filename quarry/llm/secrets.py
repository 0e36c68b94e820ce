"""Secret scans by a trigram inverted index, with DataFrame functions alone.

From each rule's regex a Boolean query over trigrams is derived (what must be in a text for the
regex to match). One pass over a text finds which of the queries' trigrams it has: that is the
row's part of every posting list. A query intersects and unites these lists, and only rows that
satisfy it are verified by the regex. Rules without a mandatory trigram scan every row. The parts
of the lists are kept beside their rows, so nothing is shuffled and no list is gathered in one place.

Spans count in code points. Java's regexes give no positions: a text's matches and the gaps
between them are cut apart, and their lengths summed up.

Cases: a null text counts as empty and has no spans; rows that repeat are scanned each by
itself; other columns are not looked at.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import let
from quarry.llm.common import column_or_null, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. If value_group is not 0, that group must have least code points."""

    kind: str
    pattern: str
    value_group: int = 0
    least: int = 0
    base: bool = False
    #: The same for Java's engine if set: its loops over groups take stack unless possessive.
    java: str = ""


#: What may stand between a private key's lines (also as in quoted strings), and a line's end mark.
_KEY_MARK = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_KEY_GAP = r"""(?:[\x20\t\r\n"'>,]|\\r|\\n)"""


def private_key(end: str = "$", own: str = "") -> str:
    """From BEGIN to END with no other mark between; if there is no END, over the armour's headers,
    the base64 lines that follow, a last short one and a checksum. own makes loops possessive:
    nothing after them could match what they give back."""
    closed = rf"[^-]*{own}(?:-{{1,4}}[^-]+)*{own}-----END {_KEY_MARK}"
    headers = rf"(?:{_KEY_GAP}+{own}(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID):[^\r\n\\]*)*{own}"
    lines = rf"(?:{_KEY_GAP}*{own}[A-Za-z0-9+/]{{16,}}={{0,2}})+{own}"
    last = rf"(?:{_KEY_GAP}+{own}[A-Za-z0-9+/]{{1,15}}(?:={{1,2}}|[\r\n]|{end}))?(?:{_KEY_GAP}*{own}=[A-Za-z0-9+/]{{4}})?"
    return rf"-----BEGIN {_KEY_MARK}(?:{closed}|{headers}(?:{lines}{last})?)"


#: The order is that of kinds at the same start. {n,} stands where a greedy + and a dropped
#: shorter match would give the same spans; in assign it would not. A longer scheme than that of
#: url_password only has its first letters outside the span.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", private_key(), java=private_key(r"\z", "+")),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9_.%-]*:[A-Za-z0-9_.%+~-]{3,}@"),
)
#: The most strings that a part of a regex is spelt out to.
MOST_STRINGS = 16


def trigram_query(pattern: str):
    """None (anything may match), a trigram, or ("and" | "or", [queries]); all in lower case."""

    def of_strings(strings: set[str]):
        if not strings or any(len(s) < 3 for s in strings):
            return None
        return join("or", [join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])

    def join(how: str, parts: list):
        parts = [p for p in parts if how == "or" or p is not None]
        if not parts or None in parts:
            return None
        flat = list(dict.fromkeys(repr(p) for p in parts))
        if len(flat) == 1:
            return parts[0]
        return how, [next(p for p in parts if repr(p) == x) for x in flat]

    def sequence(items) -> tuple[set[str] | None, object]:
        """The strings it matches if they are few, and else what it needs."""
        now, needs, exact = {""}, [], True
        for op, arg in items:
            strings, query = one(op, arg)
            if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
                now = {a + b for a in now for b in strings}
                continue
            needs += [of_strings(now), query if strings is None else of_strings(strings)]
            now, exact = {""}, False
        return (now, None) if exact else (None, join("and", [*needs, of_strings(now)]))

    def one(op, arg) -> tuple[set[str] | None, object]:
        if op is K.LITERAL:
            return {chr(arg).lower()}, None
        if op is K.AT:
            return {""}, None
        if op is K.IN:
            if all(k is K.LITERAL for k, _ in arg) and len(arg) <= MOST_STRINGS:
                return {chr(c).lower() for _, c in arg}, None
            return None, None
        if op is K.SUBPATTERN:
            return sequence(arg[-1])
        if op is K.BRANCH:
            found = [sequence(x) for x in arg[1]]
            if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
                return set().union(*(s for s, _ in found)), None
            return None, join("or", [q if s is None else of_strings(s) for s, q in found])
        if op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            strings, query = sequence(inner)
            if strings is not None and (low, high) == (0, 1):
                return strings | {""}, None
            if strings is not None and low == high == 1:
                return strings, None
            if low == 0:
                return None, None
            return None, query if strings is None else of_strings(strings)
        return None, None  # any character, look-arounds, references: nothing is needed

    strings, query = sequence(re._parser.parse(pattern))
    return query if strings is None else of_strings(strings)


def trigrams(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def any_of(strings: list[str]) -> str:
    """A pattern that matches any of the strings, common beginnings once."""
    heads: dict[str, list[str]] = {}
    for x in strings:
        heads.setdefault(x[0], []).append(x[1:])
    rest = lambda xs: "" if xs == [""] else any_of(xs)
    parts = [re.escape(c) + rest(xs) for c, xs in sorted(heads.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


class TrigramIndex:
    """Posting lists of the trigrams that rules' queries name."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.trigrams = sorted(set().union(*map(trigrams, self.queries.values())))

    def postings(self, lower_text: Column) -> Column:
        """Those of the index's trigrams whose lists a row is on; they may overlap in the text."""
        if not self.trigrams:
            return F.expr("cast(array() as array<string>)")
        return F.array_distinct(F.regexp_extract_all(lower_text, F.lit(f"(?=({any_of(self.trigrams)}))"), F.lit(1)))

    def candidate(self, kind: str, postings: Column) -> Column:
        """Whether a row's postings satisfy the query of a rule."""

        def test(q) -> Column:
            if isinstance(q, str):
                return F.array_contains(postings, F.lit(q))
            how, parts = q
            out = None
            for p in parts:
                c = test(p)
                out = c if out is None else (out & c if how == "and" else out | c)
            return out

        q = self.queries[kind]
        return F.lit(True) if q is None else test(q)


def _prefix_sums(sizes: Column) -> Column:
    """Sums of an array of numbers before each place, in blocks, so long arrays aren't copied for each."""
    block = 64

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def add_block(acc: Column, i: Column) -> Column:
        inner = F.aggregate(F.slice(sizes, i * block + 1, F.lit(block)), F.struct(acc["sum"].alias("sum"), F.expr("cast(array() as array<int>)").alias("out")), add)
        return F.aggregate(
            F.array(inner), acc, lambda a, x: F.struct(x["sum"].alias("sum"), F.concat(a["out"], x["out"]).alias("out"))
        )

    start = F.struct(F.lit(0).alias("sum"), F.expr("cast(array() as array<int>)").alias("out"))
    blocks = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), ((F.size(sizes) - 1) / block).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(blocks, start, add_block)["out"]


_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans_of(rule: Rule, rank: int, text: Column, candidate: Column) -> Column:
    """Spans of a rule's matches: empty unless the row is a candidate."""
    pattern = rule.java or rule.pattern
    p = F.lit(pattern)
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    parts = F.struct(
        lengths(F.regexp_extract_all(text, p, F.lit(0))).alias("size"),
        lengths(F.split(text, pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, p, F.lit(rule.value_group))).alias("value"),
    )

    def place(s: Column) -> Column:
        # what ends before match i: the gaps up to it and the matches before it
        both = F.transform(s["size"], lambda x, i: x + F.get(s["gap"], i))
        rows = F.transform(
            F.arrays_zip(let(both, _prefix_sums).alias("before"), s["size"].alias("size"), F.slice(s["gap"], F.lit(1), F.size(s["size"])).alias("gap"), s["value"].alias("value")),
            lambda x: F.struct(
                (x["before"] + x["gap"]).cast("int").alias("start"),
                F.lit(rank).alias("rank"),
                F.lit(rule.kind).alias("kind"),
                (x["before"] + x["gap"] + x["size"]).cast("int").alias("end"),
                x["value"].alias("value"),
            ),
        )
        long = F.filter(rows, lambda x: x["value"] >= rule.least)
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")))

    kept = let(parts, place)
    return F.when(candidate & text.rlike(pattern), kept).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs' id and text, the columns named in keep, and secret_spans (start, rank, kind, end),
    sorted. Names that keep shares with these columns are taken from keep under its own name."""
    index = TrigramIndex(rules)
    rows = docs.select(
        column_or_null(docs, id_col, "long").alias("__id"),
        F.coalesce(column_or_null(docs, text_col, "string"), F.lit("")).alias("__text"),
        *[F.col(f"`{c}`") for c in keep],
    )
    rows = rows.withColumn("__low", F.lower("__text"))
    rows = rows.withColumn("__postings", index.postings(F.col("__low"))).drop("__low")
    rows = rows.withColumns({f"__s{i}": spans_of(r, i, F.col("__text"), index.candidate(r.kind, F.col("__postings"))) for i, r in enumerate(rules)})
    spans = F.array_sort(F.concat(*[F.col(f"__s{i}") for i in range(len(rules))]))
    return rows.select("__id", "__text", *[F.col(f"`{c}`") for c in keep], spans.alias("__spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and spans of secrets of each row."""
    base = [r for r in rules if r.base]
    found = scan(docs, id_col, text_col, rules)
    of = lambda kind: F.size(F.filter("__spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        F.col("__id").alias(id_col),
        *[of(r.kind).alias(f"n_{r.kind}") for r in base],
        F.sha2(joined(F.filter("__spans", lambda x: x["rank"] < len(base))), 256).alias("base_sha256"),
        joined(F.col("__spans")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs, with the same columns, each secret in the text replaced by mark. Overlapping spans
    are one secret. A null text stays null, and a text without secrets stays as it is."""
    found = scan(docs, id_col, text_col, keep=tuple(docs.columns))
    # fold over the sorted spans: what is written so far and up to where the text is used up
    step = lambda acc, x: F.when(
        x["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), x["start"].alias("to")))).alias("out"), x["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))
    start = F.struct(F.expr("cast(array() as array<struct<from:int,to:int>>)").alias("out"), F.lit(0).alias("at"))
    folded = F.aggregate("__spans", start, step)
    found = found.withColumn("__fold", folded)
    between = F.transform(F.col("__fold.out"), lambda x: F.substr(F.col("__text"), x["from"] + 1, x["to"] - x["from"]))
    text = F.concat(F.array_join(between, mark), F.lit(mark), F.substr(F.col("__text"), F.col("__fold.at") + 1))
    out = F.when(F.size("__spans") > 0, text).otherwise(F.col(f"`{text_col}`"))
    return found.select(*[(out if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same spans in DuckDB's SQL."""
    parts = []
    for i, r in enumerate(RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {i} AS rank, '{r.kind}' AS kind, unnest(regexp_extract_all(t, {p}, 0)) AS m, unnest(regexp_extract_all(t, {p}, {r.value_group})) AS v, "
            f"unnest(list_slice(string_split_regex(t, {p}), 1, len(regexp_extract_all(t, {p}, 0)))) AS g, "
            f"unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS n, {r.least} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(parts)}),
s AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY n) AS e FROM m),
f AS (SELECT doc_id, rank, kind, CAST(e - length(m) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM s WHERE length(v) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (WHERE rank < 3), '') AS base,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


ORACLE = {"op6_secret_scan": _oracle()}
