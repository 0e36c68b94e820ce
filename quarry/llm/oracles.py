"""DuckDB equivalents of queries whose operators work in Python: plain definitions, no method.

Rows are numbered, since nothing says that an id is unique. Word windows are rows with their
next words beside them, so a long text costs no more than its length. Each is meant for small tables:
op10 compares all pairs of texts that share a shingle.
"""

from __future__ import annotations

from quarry.llm import quality

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
#: A row for each word of each text of d (r, words), with the words after it.
_NEXT = "t AS (SELECT r, unnest(words) AS w0, unnest(range(len(words))) AS i FROM d), l AS (SELECT *, {} FROM t WINDOW o AS (PARTITION BY r ORDER BY i))"


def _next(n: int) -> str:
    return _NEXT.format(", ".join(f"lead(w0, {k}) OVER o AS w{k}" for k in range(1, n)))


def _gram(n: int) -> str:
    """n words, null where the text ends before."""
    return " || ' ' || ".join(f"w{k}" for k in range(n))


def _quality() -> str:
    lengths = quality.REPEATED_NGRAMS
    steps = [f"""a{n} AS (SELECT r, i, w0, g IS NOT NULL AND count(*) OVER (PARTITION BY r, g) > 1 AS again FROM (SELECT r, i, w0, {_gram(n)} AS g FROM l)),
b{n} AS (SELECT r, sum(length(w0)) FILTER (WHERE inside) AS chars, count(*) FILTER (WHERE inside) AS n FROM (
  SELECT r, w0, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS {n - 1} PRECEDING) AS inside FROM a{n}) GROUP BY r)""" for n in lengths]  # fmt: skip
    chars = ", ".join(f"CAST(coalesce(b{n}.chars, 0) AS BIGINT) AS dup_chars_{n}" for n in lengths)
    joins = " ".join(f"LEFT JOIN b{n} ON b{n}.r = d.r" for n in lengths)
    limits = " AND ".join(f"dup_chars_{n} <= CAST({most} AS DOUBLE) * word_chars" for n, most in lengths.items())
    shown = ", ".join(f"dup_chars_{n}" for n in lengths)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, x AS text, {_WORDS.format('x')} AS words FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
{_next(max(lengths))}, {", ".join(steps)},
s AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
e AS (SELECT r, count(*) AS n_dup_lines, sum(length(line)) AS chars FROM (
  SELECT *, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k FROM s WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) WHERE k > 1 GROUP BY r),
f AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^{quality.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(b5.n, 0) AS n_repeat_words,
  CAST(coalesce(e.chars, 0) AS BIGINT) AS dup_line_chars, {chars} FROM d LEFT JOIN e ON e.r = d.r {joins}),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {limits}
  AND dup_line_chars <= CAST({quality.REPEATED_LINES} AS DOUBLE) * greatest(1, length(text)) AND n_symbols <= CAST({quality.SYMBOLS_PER_WORD} AS DOUBLE) * n_words AS kept,
  dup_line_chars, {shown} FROM g"""


def _warc() -> str:
    # five hexadecimal digits are twenty bits, which are four digits of base 32
    digits = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {shift}) & 31), 1)" for k in range(8) for shift in (15, 10, 5, 0)
    )
    return f"""WITH p AS (SELECT page_id, strlen(x) AS payload_bytes, sha1(x) AS h, page_id <> min(page_id) OVER (PARTITION BY x) AS again, min(page_id) OVER (PARTITION BY x) AS f
  FROM (SELECT page_id, coalesce(html, '') AS x FROM pages))
SELECT page_id, payload_bytes, {digits} AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to FROM p"""


def _near(words: int, percent: int) -> str:
    """Equal sets are one class, whose shingles and links are those of its smallest id."""
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
{_next(words)},
s AS (SELECT DISTINCT r, {_gram(words)} AS g FROM l WHERE w{words - 1} IS NOT NULL UNION ALL SELECT r, array_to_string(words, ' ') FROM d WHERE len(words) BETWEEN 1 AND {words - 1}),
k AS (SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS class FROM s GROUP BY r),
c AS (SELECT class, min(doc_id) AS id, arg_min(r, doc_id) AS r, any_value(n) AS n FROM k JOIN d USING (r) GROUP BY class),
m AS (SELECT id, n, g FROM c JOIN s USING (r)),
both_ AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM m a JOIN m b ON a.g = b.g AND a.id < b.id
  AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM both_ WHERE 100 * shared >= {percent} * (na + nb - shared)),
x AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT id, id AS other FROM c UNION SELECT reach.id, x.b FROM reach JOIN x ON reach.other = x.a),
o AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_shingles, coalesce(o.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(o.component_id, d.doc_id) AS kept
FROM d LEFT JOIN k ON k.r = d.r LEFT JOIN c ON c.class = k.class LEFT JOIN o ON o.id = c.id"""


ORACLE = {"op4_quality_rules": _quality(), "op8_warc": _warc(), "op10_near_duplicates": _near(4, 80)}
