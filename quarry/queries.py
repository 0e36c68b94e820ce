"""Queries of the library's own operators on the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import bm25, search, semantic, usage
from quarry.operators.index import human_size, incremental_plan, index_stats
from quarry.plans import display
from quarry.sources.sessions import collapse_runs, from_conversations, messages, renumber, without_current
from quarry.sources.shared import scratch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

PATTERN, BRANCHES, WORDS_QUERY = "th(e|at)re", "ÉR|the(rou|se)", "the hatred of that hatred licensed version"
THRESHOLD = 0.3


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_conversations(_table(spark, sf_dir, "conversations"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.from_events(_table(spark, sf_dir, "events"))


# The same messages in SQL.
M = r"""m AS (SELECT conv_id, turn, role, t AS text, strftime(to_timestamp(1704067200 + conv_id * 3600 + turn * 30) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS timestamp,
  'project-' || (conv_id % 7) AS project, CAST(conv_id AS VARCHAR) AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS msg_index
  FROM (SELECT *, regexp_replace(text, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g') AS t FROM conversations WHERE role IN ('user', 'assistant')) WHERE t <> '')"""
#: Stop words, words, stems and terms in DuckDB's SQL.
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
STEM = "CASE " + " ".join(f"WHEN suffix(w, '{s}') AND strlen(w) - {len(s)} >= 3 THEN left(w, length(w) - {len(s)})" for s in T.SUFFIXES) + " WHEN suffix(w, 's') AND strlen(w) >= 4 THEN left(w, length(w) - 1) ELSE w END"


def _words_sql(c: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{Nd}}]+'), lambda w: strlen(w) > 1 AND NOT list_contains({STOP}, w))"


def _terms_sql(c: str) -> str:
    return f"list_transform({_words_sql(c)}, lambda w: {STEM})"


def _bigrams_sql(c: str) -> str:
    return f"CASE WHEN len({c}) > 1 THEN list_concat({c}, list_transform(range(1, len({c})), lambda i: {c}[i] || '_' || {c}[i + 1])) ELSE {c} END"


def _prefix_sql(c: str, n: str) -> str:
    """The first n bytes of a text, a cut character being U+FFFD: its longest beginning of so many bytes at most."""
    k = f"list_max(list_filter(range(0, {n} + 1), lambda i: strlen(left({c}, CAST(i AS INT))) <= {n}))"
    return f"left({c}, CAST({k} AS INT)) || CASE WHEN strlen({c}) > {n} AND strlen(left({c}, CAST({k} AS INT))) < {n} THEN chr(65533) ELSE '' END"


# ---- regex search

@query(f"WITH {M} SELECT conv_id, msg_index, role, text FROM m WHERE regexp_matches(text, '{PATTERN}', 'i')")
def regex_match(spark, sf_dir):
    return search.matching(_messages(spark, sf_dir), PATTERN).select("conv_id", "msg_index", "role", "text")


@query(f"WITH {M} SELECT conv_id, msg_index, role FROM m WHERE role = 'user' AND regexp_matches(text, '{PATTERN}', 'i')")
def regex_role(spark, sf_dir):
    return search.matching(_messages(spark, sf_dir), PATTERN, search.SearchOptions(role="user")).select("conv_id", "msg_index", "role")


@query(f"WITH {M} SELECT conv_id, msg_index, text FROM m WHERE regexp_matches(text, '{BRANCHES}', 'i')")
def regex_alternation(spark, sf_dir):
    return search.matching(_messages(spark, sf_dir), BRANCHES).select("conv_id", "msg_index", "text")


@query(f"WITH {M} SELECT conv_id, msg_index, timestamp FROM m WHERE regexp_matches(text, 'the', 'i') ORDER BY timestamp DESC, session_id, msg_index LIMIT 20")
def regex_topk_cut(spark, sf_dir):
    """More messages match than the limit lets through."""
    return search.search(_messages(spark, sf_dir), "the", search.SearchOptions(max_results=20)).select("conv_id", "msg_index", "timestamp")


@query(f"WITH {M} SELECT conv_id, msg_index, timestamp FROM m WHERE regexp_matches(text, '{BRANCHES}', 'i') ORDER BY timestamp DESC, session_id, msg_index LIMIT 100")
def regex_topk(spark, sf_dir):
    return search.search(_messages(spark, sf_dir), BRANCHES).select("conv_id", "msg_index", "timestamp")


_CTX = "coalesce(array_to_string(array_agg(role || ':' || msg_index || ':' || text) OVER (PARTITION BY conv_id ORDER BY msg_index ROWS BETWEEN {}), '|'), '')"


@query(f"""WITH {M}, c AS (SELECT *, {_CTX.format('2 PRECEDING AND 1 PRECEDING')} AS before, {_CTX.format('1 FOLLOWING AND 2 FOLLOWING')} AS after FROM m)
SELECT conv_id, msg_index, before, after FROM c WHERE regexp_matches(text, '{BRANCHES}', 'i')""")
def regex_context(spark, sf_dir):
    found = search.matching(_messages(spark, sf_dir), BRANCHES, search.SearchOptions(context=2))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["role"], x["msg_index"].cast("string"), x["text"])), "|")
    return found.select("conv_id", "msg_index", flat("context_before").alias("before"), flat("context_after").alias("after"))


@query("""WITH e AS (SELECT event_id, user_id, date_trunc('hour', ts) AS hour, event_type, lead(event_id) OVER w AS nid, lead(date_trunc('hour', ts)) OVER w AS nh, lead(event_type) OVER w AS nt
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS msg_index FROM e WHERE nid IS NULL OR nh <> hour OR nt <> event_type""")
def consecutive_dedup(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts")).select("event_id", "user_id", "hour", "event_type")
    kept = collapse_runs(rows, ["user_id"], ["hour", "event_type"], "event_id")
    return renumber(kept, ["user_id"], "event_id").select("event_id", "user_id", "msg_index")


@query(f"WITH {M} SELECT conv_id, turn, msg_index FROM m")
def renumber_messages(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).withColumn("text", T.trim(F.col("text"))).where("text <> ''")
    return renumber(rows, ["conv_id"], "turn").select("conv_id", "turn", "msg_index")


_FILES = "f AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS value FROM conversations GROUP BY conv_id)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as the raw text of a file."""
    lines = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return lines.select("conv_id", F.array_join("x.text", "\n").alias("value"))


#: One literal of each branch of BRANCHES: the longest run without special characters, the first of equals.
_LITERALS = "contains(lower(value), 'ér') OR contains(lower(value), 'the')"


@query(f"WITH {_FILES} SELECT count(*) AS files_total, count(*) FILTER (WHERE NOT ({_LITERALS})) AS prefilter_skipped, count(*) FILTER (WHERE {_LITERALS}) AS regex_searched FROM f")
def prefilter_stats(spark, sf_dir):
    return search.search_stats(_files(spark, sf_dir), BRANCHES)


@query(f"WITH {_FILES} SELECT 'thatre' AS literal, CAST(least(3, count(*)) AS BIGINT) AS files FROM f WHERE contains(lower(value), 'thatre')")
def near_miss(spark, sf_dir):
    found = search.near_miss(_files(spark, sf_dir), "thatre[0-9]+zz")
    return spark.createDataFrame([("thatre", found[1] if found else 0)], "literal string, files long")


#: Patterns that Java's engine and RE2 would read in different ways.
DIALECT = (r"\bth", r"ing$", r"[[:upper:]][[:lower:]]+\.", r"[a-c&&[b]", r"(?P<x>er)\s+\w", r"É", r"\Bth\b", r"^.{40}.*[^\S]", r"s\z|t\.$", r"[\d\pL]+ç")


@query(f"WITH {M} " + " UNION ALL ".join("SELECT {} AS n, conv_id, msg_index FROM m WHERE regexp_matches(text, '{}', 'i')".format(i, p.replace("'", "''")) for i, p in enumerate(DIALECT)))
def regex_dialect(spark, sf_dir):
    m = _messages(spark, sf_dir)
    each = [search.matching(m, p).select(F.lit(i).alias("n"), "conv_id", "msg_index") for i, p in enumerate(DIALECT)]
    out = each[0]
    for x in each[1:]:
        out = out.unionAll(x)
    return out


@query(rf"""WITH c AS (SELECT conv_id, turn, role, regexp_replace(text, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g') AS t FROM conversations WHERE role IN ('user', 'assistant'))
SELECT role, CASE WHEN turn % 3 = 1 THEN t || ' and more' ELSE t END AS text, strftime(to_timestamp(1704067200 + turn * 30) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') AS timestamp,
  left('session-' || conv_id || '-of-many', 12) AS session_id, '-p-' || (conv_id % 7) AS project, CAST(conv_id AS VARCHAR) AS conv,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS msg_index FROM c WHERE t <> ''""")
def session_messages(spark, sf_dir):
    """Session files made of the conversations: content as a string, as blocks or in data; a draft of
    the same second before each message; broken lines; records of other types."""
    t = F.col("text")
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("turn") * 30), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    head = lambda: [F.col("role").alias("type"), at.alias("timestamp")]
    block = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    plain = lambda x: F.to_json(F.struct(*head(), F.struct(x.alias("content")).alias("message")))
    blocks = F.array(block("text", t), block("tool_use", F.lit("no")), block("text", F.lit("and more")))
    of_blocks = F.to_json(F.struct(*head(), F.struct(blocks.alias("content")).alias("message")))
    of_data = F.to_json(F.struct(*head(), F.lit("x").alias("message"), F.struct(F.struct(t.alias("content")).alias("message")).alias("data")))
    line = F.when(F.col("turn") % 3 == 0, plain(t)).when(F.col("turn") % 3 == 1, of_blocks).otherwise(of_data)
    text = F.concat_ws("\n", plain(F.concat(t, F.lit(" (draft)"))), F.lit('{"type":'), F.lit(""), line, F.lit("[1]"))
    rows = _table(spark, sf_dir, "conversations").where(T.trim(t) != "").select("conv_id", "turn", text.alias("lines"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "lines"))).alias("x"))
    path = F.concat(F.lit("/sessions/-p-"), F.col("conv_id") % 7, F.lit("/session-"), F.col("conv_id"), F.lit("-of-many.jsonl"))
    got = messages(rows.select(path.alias("file_path"), F.array_join("x.lines", "\n").alias("value")))
    return got.select("role", "text", "timestamp", "session_id", "project", F.regexp_extract("file_path", r"session-(\d+)-", 1).alias("conv"), "msg_index")


@query("""WITH f AS (SELECT CAST(user_id AS VARCHAR) AS file_path, max(ts) AS modified FROM events GROUP BY 1), n AS (SELECT arg_max(file_path, (modified, file_path)) AS p FROM f)
SELECT file_path FROM f WHERE file_path <> (SELECT p FROM n)""")
def without_current_file(spark, sf_dir):
    """Files without the one that was written last, 59 seconds ago."""
    files = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("file_path")).agg(F.max("ts").alias("modified"))
    newest = files.agg(F.max("modified")).first()[0]
    return without_current(files, newest + timedelta(seconds=59)).select("file_path")


# ---- display

@query(f"""WITH {M}, t AS (SELECT * FROM m WHERE regexp_matches(text, '{BRANCHES}', 'i') ORDER BY timestamp DESC, session_id, msg_index LIMIT 100)
SELECT conv_id, msg_index, CAST(greatest(300, least(2000, 30000 // count(*) OVER ())) AS INT) AS budget FROM t""")
def adaptive_budget(spark, sf_dir):
    return display.grouped(search.search(_messages(spark, sf_dir), BRANCHES)).select("conv_id", "msg_index", "budget")


@query(f"""WITH {M}, t AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, session_id, msg_index) AS out_pos FROM m WHERE regexp_matches(text, '{BRANCHES}', 'i') ORDER BY out_pos LIMIT 100)
SELECT CAST(out_pos AS INT) AS out_pos, CAST(min(out_pos) OVER (PARTITION BY project, session_id) AS INT) AS group_pos, session_id || '  ' || timestamp AS line FROM t""")
def session_groups(spark, sf_dir):
    return display.list_rows(search.search(_messages(spark, sf_dir), BRANCHES))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def first_seen_dedup(spark, sf_dir):
    return display.first_seen(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])


_SHORT = f"{M}, q AS (SELECT * FROM m WHERE strlen(text) <= 300)"


@query(f"""WITH {_SHORT}, t AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, session_id, msg_index) AS out_pos FROM q WHERE regexp_matches(text, '{BRANCHES}', 'i') ORDER BY out_pos LIMIT 100),
g AS (SELECT *, min(out_pos) OVER (PARTITION BY project, session_id) AS group_pos FROM t),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replace(text, chr(10), ' ') ORDER BY group_pos, out_pos) AS seen FROM g) WHERE seen = 1),
n AS (SELECT *, lag(msg_index) OVER w AS li, lag(role) OVER w AS lr, lag(timestamp) OVER w AS lt, lag(text) OVER w AS lx, lead(msg_index) OVER w AS ai, lead(role) OVER w AS ar, lead(timestamp) OVER w AS an, lead(text) OVER w AS ax
  FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY msg_index)),
p AS (SELECT group_pos, out_pos, 0 AS part, s.project, s.session_id, li AS msg_index, ' ' AS mark, lr AS role, lt AS timestamp, lx AS text FROM s JOIN n USING (conv_id, msg_index) WHERE li IS NOT NULL
  UNION ALL SELECT group_pos, out_pos, 1, project, session_id, msg_index, '>', role, timestamp, text FROM s
  UNION ALL SELECT group_pos, out_pos, 2, s.project, s.session_id, ai, ' ', ar, an, ax FROM s JOIN n USING (conv_id, msg_index) WHERE ai IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY project, session_id, msg_index ORDER BY out_pos, part) AS once FROM p)
SELECT CAST(group_pos AS INT) AS group_pos, session_id, msg_index, '  ' || mark || ' ' || timestamp || CASE WHEN role = 'assistant' THEN ' [AI ] ' ELSE ' [YOU] ' END
  || replace(CASE WHEN mark = ' ' AND strlen(text) > 200 THEN {_prefix_sql('text', '200')} || '...' ELSE text END, chr(10), ' ') AS line FROM o WHERE once = 1""")
def terminal_lines(spark, sf_dir):
    """Lines of messages that fit the budget; bm25_compress has those that don't."""
    short = _messages(spark, sf_dir).where(F.octet_length("text") <= 300)
    found = search.search(short, BRANCHES, search.SearchOptions(context=1))
    return display.display_rows(found, bm25.query_terms(spark, BRANCHES)).select("group_pos", "session_id", "msg_index", "line")


_CTX_JSON = "array_agg({{'timestamp': timestamp, 'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY msg_index ROWS BETWEEN {0} AND {0})"


@query(f"""WITH {M}, c AS (SELECT *, {_CTX_JSON.format('1 PRECEDING')} AS b, {_CTX_JSON.format('1 FOLLOWING')} AS a FROM m),
t AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, session_id, msg_index) AS n FROM c WHERE regexp_matches(text, '{BRANCHES}', 'i') ORDER BY n LIMIT 100)
SELECT CAST(n AS INT) AS out_pos, '{{"session":' || to_json(session_id) || ',"project":' || to_json(project) || ',"timestamp":' || to_json(timestamp) || ',"role":' || to_json(role) || ',"text":' || to_json(text)
  || CASE WHEN b IS NULL THEN '' ELSE ',"context_before":' || to_json(b) END || CASE WHEN a IS NULL THEN '' ELSE ',"context_after":' || to_json(a) END || '}}' AS json FROM t""")
def json_lines(spark, sf_dir):
    return display.json_rows(search.search(_messages(spark, sf_dir), BRANCHES, search.SearchOptions(context=1)))


# ---- text

@query(f"SELECT doc_id, array_to_string({_terms_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.terms(F.col("text")), " ").alias("tokens"))


@query(f"WITH w AS (SELECT DISTINCT unnest({_words_sql('text')}) AS w FROM documents) SELECT w AS word, {STEM} AS stem FROM w")
def stem(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@query(f"WITH t AS (SELECT doc_id, {_terms_sql('text')} AS t FROM documents) SELECT doc_id, array_to_string({_bigrams_sql('t')}, ' ') AS tokens FROM t")
def bigrams(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.with_bigrams(T.terms(F.col("text"))), " ").alias("tokens"))


#: Chunks of texts without blank lines, as all of the driver's are.
_CHUNKS = r"""l AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS all_lines,
  len(string_split(text, chr(10))) AS n_lines FROM documents),
c AS (SELECT doc_id, unnest(CASE WHEN n_lines > 3 AND len(all_lines) > 0 THEN all_lines ELSE [text] END) AS chunk, unnest(range(0, CASE WHEN n_lines > 3 AND len(all_lines) > 0 THEN len(all_lines) ELSE 1 END)) AS idx FROM l)"""


@query(f"WITH {_CHUNKS} SELECT doc_id, CAST(idx AS INT) AS idx, chunk FROM c")
def chunk_lines(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("idx", "chunk"))


#: Texts with paragraphs: in both engines each comma and space becomes a blank line.
_BROKEN = "replace(text, ', ', ',' || chr(10) || chr(10))"
#: As the sentences of functions.text: ends of sentences, the pieces between them folded into
#: sentences of 40 bytes at least, and these into chunks of 60.
_CUT = chr(1)


def _paragraphs_sql() -> str:
    trim = lambda c: rf"regexp_replace({c}, '^[\s\x{{85}}\p{{Z}}]+|[\s\x{{85}}\p{{Z}}]+$', '', 'g')"
    upper = r"[A-Z\x{80}-\x{5BF}\x{600}-\x{7BF}]"
    marked = rf"regexp_replace(regexp_replace(p, '([.?!])( {upper})', '\1' || chr(1) || '\2', 'g'), '([.?!])(\n)', '\1' || chr(1) || '\2', 'g')"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, {_BROKEN} AS text FROM documents),
ps AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS ps FROM d WHERE contains(text, chr(10) || chr(10))),
p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(0, len(ps))) AS k FROM ps),
parts AS (SELECT doc_id, k, string_split({marked}, chr(1)) AS parts FROM p WHERE strlen(p) > 200),
f AS (SELECT doc_id, k, 0 AS i, []::VARCHAR[] AS done, '' AS now FROM parts
  UNION ALL
  SELECT f.doc_id, f.k, i + 1, CASE WHEN ends THEN list_append(done, {trim('nxt')}) ELSE done END, CASE WHEN ends THEN '' ELSE nxt END
  FROM (SELECT f.*, f.now || CASE WHEN len(f.done) > 0 AND f.now = '' AND starts_with(parts[i + 1], ' ') THEN substr(parts[i + 1], 2) ELSE parts[i + 1] END AS nxt,
    strlen(f.now || CASE WHEN len(f.done) > 0 AND f.now = '' AND starts_with(parts[i + 1], ' ') THEN substr(parts[i + 1], 2) ELSE parts[i + 1] END) >= 40 AND regexp_matches(parts[i + 1], '[.?!]$') AS ends
    FROM f JOIN parts USING (doc_id, k) WHERE i < len(parts)) f),
s AS (SELECT doc_id, k, CASE WHEN now <> '' THEN list_append(done, {trim('now')}) ELSE done END AS s FROM f JOIN parts USING (doc_id, k) WHERE i = len(parts)),
g AS (SELECT doc_id, k, 0 AS i, []::VARCHAR[] AS done, '' AS now FROM s
  UNION ALL
  SELECT doc_id, k, i + 1, CASE WHEN strlen(nxt) >= 60 THEN list_append(done, nxt) ELSE done END, CASE WHEN strlen(nxt) >= 60 THEN '' ELSE nxt END
  FROM (SELECT g.*, CASE WHEN now <> '' THEN now || ' ' || s[i + 1] ELSE s[i + 1] END AS nxt FROM g JOIN s USING (doc_id, k) WHERE i < len(s))),
m AS (SELECT doc_id, k, CASE WHEN now <> '' THEN list_append(done, now) ELSE done END AS c FROM g JOIN s USING (doc_id, k) WHERE i = len(s)),
a AS (SELECT doc_id, k, [p] AS c FROM p WHERE strlen(p) <= 200 UNION ALL SELECT doc_id, k, c FROM m),
o AS (SELECT doc_id, flatten(list(c ORDER BY k)) AS c FROM a GROUP BY doc_id)
SELECT doc_id, CAST(unnest(range(0, len(c))) AS INT) AS idx, unnest(c) AS chunk FROM o"""


@query(_paragraphs_sql())
def paragraph_chunks(spark, sf_dir):
    """Chunks of texts with blank lines: paragraphs, long ones cut into sentences."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(", "), F.lit(",\n\n")).alias("text")).where(F.contains("text", F.lit("\n\n")))
    return rows.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("idx", "chunk"))


def _scores_sql() -> str:
    from collections import Counter

    # the query's terms, as bm25.query_terms gives them; a test holds them against it
    found = ["hatr", "hatr", "licens", "ver"]
    pairs = [f"{a}_{b}" for a, b in zip(found, found[1:])]
    q = ", ".join(f"('{t}', {n})" for t, n in Counter(found + pairs).items())
    return f"""WITH {_CHUNKS}, q(t, m) AS (VALUES {q}),
u AS (SELECT doc_id, idx, {_terms_sql('chunk')} AS t FROM c), d AS (SELECT doc_id, idx, {_bigrams_sql('t')} AS terms FROM u),
s AS (SELECT doc_id, count(*) AS n, CASE WHEN sum(len(terms)) > 0 THEN sum(len(terms)) / count(*) ELSE 1 END AS avgdl FROM d GROUP BY doc_id),
e AS (SELECT doc_id, idx, len(terms) AS dl, unnest(terms) AS t FROM d),
tf AS (SELECT doc_id, idx, dl, t, m, count(*) AS f FROM e JOIN q USING (t) GROUP BY ALL),
df AS (SELECT doc_id, t, max(m) * count(*) AS df FROM tf GROUP BY doc_id, t),
r AS (SELECT doc_id, idx, sum(m * ln((n - df + 0.5) / (df + 0.5) + 1) * (f * 2.2) / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (doc_id, t) JOIN s USING (doc_id) GROUP BY doc_id, idx)"""


@query(_scores_sql() + " SELECT doc_id, CAST(idx AS INT) AS idx, round(score, 6) AS score FROM r")
def bm25_scores(spark, sf_dir):
    q = bm25.query_terms(spark, WORDS_QUERY)
    hits = F.filter(bm25.scored_chunks(F.col("text"), q), lambda x: x["score"] != 0)
    # outer: else the optimizer adds a filter on the array's size, and it is computed twice
    each = _table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(hits).alias("c")).where("c IS NOT NULL")
    return each.select("doc_id", F.col("c.idx").alias("idx"), F.round("c.score", 6).alias("score"))


@query(_scores_sql() + " SELECT doc_id, CAST(first(idx ORDER BY round(score, 6) DESC, idx) AS INT) AS idx, max(round(score, 6)) AS score FROM r WHERE score > 0 GROUP BY doc_id")
def bm25_top_chunk(spark, sf_dir):
    q = bm25.query_terms(spark, WORDS_QUERY)
    hits = F.filter(bm25.scored_chunks(F.col("text"), q), lambda x: x["score"] > 0)
    best = F.get(F.array_sort(F.transform(hits, lambda x: F.struct((-F.round(x["score"], 6)).alias("rank"), x["idx"].alias("idx")))), F.lit(0))
    return _table(spark, sf_dir, "documents").select("doc_id", best.alias("b")).where("b IS NOT NULL").select("doc_id", F.col("b.idx").alias("idx"), (-F.col("b.rank")).alias("score"))


BUDGET = 500


def _compress_sql() -> str:
    """Hits of each text in order of score are taken while they fit; what was taken is joined in order."""
    return _scores_sql().replace("WITH", "WITH RECURSIVE", 1) + f""",
h AS (SELECT r.doc_id, r.idx, c.chunk, row_number() OVER (PARTITION BY r.doc_id ORDER BY round(score, 9) DESC, r.idx) AS n FROM r JOIN c ON r.doc_id = c.doc_id AND r.idx = c.idx WHERE score > 0),
f AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, []::BIGINT[] AS taken FROM h
  UNION ALL
  SELECT f.doc_id, h.n, CASE WHEN used + strlen(chunk) + 2 <= {BUDGET} THEN used + strlen(chunk) + 2 ELSE used END, CASE WHEN used + strlen(chunk) + 2 <= {BUDGET} THEN list_append(taken, h.n) ELSE taken END
  FROM f JOIN h ON h.doc_id = f.doc_id AND h.n = f.n + 1),
e2 AS (SELECT doc_id, max(n) AS hits, arg_max(taken, n) AS taken FROM f GROUP BY doc_id),
j AS (SELECT h.doc_id, any_value(hits) AS hits, count(*) FILTER (WHERE list_contains(taken, n)) AS n_taken, string_agg(chunk, chr(10) || chr(10) ORDER BY idx) FILTER (WHERE list_contains(taken, n)) AS joined,
  any_value(chunk) FILTER (WHERE n = 1) AS best FROM h JOIN e2 USING (doc_id) GROUP BY h.doc_id)
SELECT d.doc_id, CASE WHEN strlen(d.text) <= {BUDGET} THEN d.text WHEN hits IS NULL THEN {_prefix_sql('d.text', str(BUDGET))} WHEN n_taken = 0 THEN {_prefix_sql('best', str(BUDGET))}
  ELSE joined || CASE WHEN n_taken < hits THEN ' [...]' ELSE '' END END AS compressed FROM documents d LEFT JOIN j USING (doc_id)"""


@query(_compress_sql())
def bm25_compress(spark, sf_dir):
    q = bm25.query_terms(spark, WORDS_QUERY)
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", bm25.compress(F.col("text"), q, F.lit(BUDGET)).alias("compressed"))


@query(f"SELECT doc_id, {_prefix_sql('text', '200')} AS preview FROM documents")
def byte_preview(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.byte_prefix(F.col("text"), 200).alias("preview"))


@query("""SELECT doc_id, CASE WHEN n >= 1048576 THEN format('{:.1f} MB', n / 1048576) WHEN n >= 1024 THEN format('{:.1f} KB', n / 1024) ELSE n || ' B' END AS size
FROM (SELECT doc_id, CAST(strlen(text) AS BIGINT) * (doc_id % 997) AS n FROM documents WHERE strlen(text) * (doc_id % 997) < 1073741824)""")
def human_sizes(spark, sf_dir):
    n = F.octet_length("text").cast("long") * (F.col("doc_id") % 997)
    return _table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).where(F.col("n") < 1 << 30).select("doc_id", human_size(F.col("n")).alias("size"))


# ---- vectors

_COS = "CAST(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS FLOAT)"


def _probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    e = _table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id = 0").select("embedding").first()[0]


@query(f"SELECT a.vec_id, round({_COS}, 5) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 ORDER BY {_COS} DESC, a.vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    e, q = _probe(spark, sf_dir)
    rows = semantic.nearest(semantic.similar(e, q, -2.0, "embedding"), 10, "vec_id")
    return rows.select("vec_id", F.round("similarity", 5).alias("similarity"))


@query(f"SELECT a.vec_id, a.label FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND {_COS} > CAST({THRESHOLD} AS FLOAT)")
def cosine_threshold(spark, sf_dir):
    e, q = _probe(spark, sf_dir)
    return semantic.similar(e, q, THRESHOLD, "embedding").select("vec_id", "label")


_NEAR = "CAST(list_cosine_similarity(a.embedding::DOUBLE[], q.v) AS FLOAT)"


@query(f"""WITH q AS (SELECT list_transform(list_zip(x.embedding, y.embedding), lambda z: CAST(z[1] + z[2] AS DOUBLE)) AS v FROM embeddings x, embeddings y WHERE x.vec_id = 3 AND y.vec_id = 5)
SELECT a.vec_id, round({_NEAR}, 4) AS similarity FROM embeddings a, q WHERE {_NEAR} > CAST(0.55 AS FLOAT)""")
def cosine_default_threshold(spark, sf_dir):
    """What is near the sum of two vectors, by the threshold that searches use."""
    e = _table(spark, sf_dir, "embeddings")
    two = [r["embedding"] for r in e.where("vec_id IN (3, 5)").orderBy("vec_id").collect()]
    return semantic.similar(e, [float(np.float32(x) + np.float32(y)) for x, y in zip(*two, strict=True)], vector="embedding").select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(f"""WITH s AS (SELECT a.vec_id, {_COS} AS similarity, 'p' || (a.label % 25) AS project, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * a.vec_id, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'f' || (a.vec_id // 10) AS file_path
  FROM embeddings a, embeddings b WHERE b.vec_id = 0)
SELECT vec_id, CAST(round(similarity, 4) AS FLOAT) AS similarity FROM s WHERE starts_with(project, 'p1') AND file_path <> 'f1' AND (vec_id % 9 = 0 OR timestamp >= '2024-01-08T12:00:00') AND similarity > CAST(0.05 AS FLOAT)
ORDER BY similarity DESC, file_path, vec_id LIMIT 10""")
def semantic_filters(spark, sf_dir):
    """Prefix of the project, the current file, messages' age (without a readable time they pass)."""
    e, q = _probe(spark, sf_dir)
    at = F.date_format(F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, vec_id)"), "yyyy-MM-dd'T'HH:mm:ss")
    entries = e.select(
        "vec_id", F.concat(F.lit("f"), F.floor(F.col("vec_id") / 10)).alias("file_path"), F.col("vec_id").cast("int").alias("msg_index"), F.lit("user").alias("role"),
        F.when(F.col("vec_id") % 9 == 0, F.lit("no time")).otherwise(at).alias("timestamp"), F.lit("x").alias("preview"), F.col("embedding").alias("vector"), F.concat(F.lit("p"), F.col("label") % 25).alias("project"),
    )
    found = semantic.semantic_search(entries, None, q, search.SearchOptions(max_results=10, max_days=7), datetime(2024, 1, 15, 12), "p1", "f1", threshold=0.05)
    return found.select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(f"""WITH {M}, s AS (SELECT a.vec_id, {_COS} AS similarity FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND {_COS} > CAST({THRESHOLD} AS FLOAT) ORDER BY {_COS} DESC, a.vec_id LIMIT 10),
c AS (SELECT *, {_CTX.format('1 PRECEDING AND 1 PRECEDING')} AS before FROM m)
SELECT s.vec_id, c.text, c.before FROM s LEFT JOIN c ON c.conv_id = s.vec_id AND c.msg_index = 1""")
def semantic_context(spark, sf_dir):
    e, q = _probe(spark, sf_dir)
    # a vector stands for the second message of the conversation of its number
    entries = e.select(
        "vec_id", F.col("vec_id").cast("string").alias("file_path"), F.lit(1).alias("msg_index"), F.lit("user").alias("role"), F.lit("").alias("timestamp"),
        F.lit(None).cast("string").alias("preview"), F.col("embedding").alias("vector"), F.lit("p").alias("project"),
    )
    found = semantic.semantic_search(entries, _messages(spark, sf_dir), q, search.SearchOptions(max_results=10, max_days=0, before=1), datetime(2024, 6, 1), threshold=THRESHOLD)
    flat = F.array_join(F.transform("context_before", lambda x: F.concat_ws(":", x["role"], x["msg_index"].cast("string"), x["text"])), "|")
    return found.select("vec_id", "text", flat.alias("before"))


_INDEXED = "i AS (SELECT vec_id, 'p' || (label % 5) AS project, 'f' || (vec_id // 10) AS file_path FROM embeddings)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("p"), F.col("label") % 5).alias("project"), F.concat(F.lit("f"), F.floor(F.col("vec_id") / 10)).alias("file_path"))


@query(f"WITH {_INDEXED} SELECT count(DISTINCT project) AS projects, count(DISTINCT file_path) AS files, count(*) AS vectors FROM i")
def index_stats_query(spark, sf_dir):
    i = _index(spark, sf_dir)
    return index_stats(i, i.select("project", "file_path"))


@query("""WITH f AS (SELECT user_id AS file_path, max(ts) AS modified FROM events GROUP BY 1), k AS (SELECT user_id AS file_path, max(ts) AS last_modified FROM events WHERE event_id % 10 < 8 GROUP BY 1)
SELECT count(*) FILTER (WHERE last_modified IS NULL OR modified > last_modified) AS indexed, count(*) FILTER (WHERE NOT (last_modified IS NULL OR modified > last_modified)) AS skipped FROM f LEFT JOIN k USING (file_path)""")
def incremental_plan_query(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    by = lambda rows, name: rows.groupBy(F.col("user_id").alias("file_path")).agg(F.max("ts").alias(name))
    return incremental_plan(by(e, "modified"), by(e.where("event_id % 10 < 8"), "last_modified"))


# ---- usage

E_ = "e AS (" + usage.ADAPTER.format(at="ts_at", k="CAST(json_extract_string(props, '$.k') AS BIGINT)") + ")"


@query(f"""WITH {E_}, s AS (SELECT count(*) AS total, count(*) FILTER (WHERE results > 0) AS found, count(*) FILTER (WHERE results <= 0) AS empty, CAST(sum(ms) AS BIGINT) AS sum_ms,
  count(*) FILTER (WHERE bre) AS bre, count(*) FILTER (WHERE extra_args) AS extra_args, count(*) FILTER (WHERE capped) AS capped FROM e)
SELECT total, found, empty, found * 100 // total AS hit_rate, sum_ms // total AS avg_ms, bre, extra_args, capped, capped * 100 // total AS capped_pct FROM s""")
def usage_summary(spark, sf_dir):
    return usage.summary(_events(spark, sf_dir))


@query(f"WITH {E_} SELECT mode, count(*) AS n, count(*) * 100 // (SELECT count(*) FROM e) AS pct FROM e GROUP BY mode")
def usage_modes(spark, sf_dir):
    return usage.modes(_events(spark, sf_dir))


@query(f"WITH {E_}, x AS (SELECT unnest(regexp_extract_all(flags, '\\S+')) AS flag FROM e) SELECT flag, count(*) AS n, count(*) * 100 // (SELECT count(*) FROM e) AS pct FROM x GROUP BY flag ORDER BY n DESC, flag LIMIT 8")
def usage_flags(spark, sf_dir):
    return usage.flags(_events(spark, sf_dir))


@query(f"WITH {E_} SELECT pattern, count(*) AS n, CASE WHEN count(*) > 1 THEN pattern || ' (' || count(*) || 'x)' ELSE pattern END AS label FROM e WHERE results = 0 GROUP BY pattern ORDER BY n DESC, pattern LIMIT 10")
def empty_patterns(spark, sf_dir):
    return usage.empty_patterns(_events(spark, sf_dir))


@query(f"WITH {E_} SELECT pattern, min(seq) AS first_seq, count(*) AS n FROM e WHERE results = 0 AND pf_skip > 0 AND pf_skip = files GROUP BY pattern")
def prefilter_rejected_all(spark, sf_dir):
    return usage.prefilter_rejected_all(_events(spark, sf_dir))


_STEPS = """l AS (SELECT *, lag(ts_at) OVER (ORDER BY seq) AS p FROM {source}),
f AS (SELECT *, CASE WHEN p IS NULL OR ts_at - p >= INTERVAL '90' SECOND THEN 1 ELSE 0 END AS new FROM l), g AS (SELECT *, sum(new) OVER (ORDER BY seq) AS c FROM f),
h AS (SELECT *, lag(scope) OVER (PARTITION BY c ORDER BY seq) AS before FROM g),
r AS (SELECT min(seq) AS chain, count(*) AS n, CAST(sum(CASE WHEN results = 0 THEN ms ELSE 0 END) AS BIGINT) AS wasted_ms, count(*) FILTER (WHERE before = 'project' AND scope = 'all') AS escalations FROM h GROUP BY c HAVING count(*) > 1)"""
_CHAINS = f"WITH {E_}, {_STEPS.format(source='e')}"


@query(_CHAINS + " SELECT chain, n, wasted_ms, escalations FROM r")
def retry_chains(spark, sf_dir):
    return usage.retry_chains(_events(spark, sf_dir))


@query(_CHAINS + """ SELECT count(*) AS chains, round(avg(n), 1) AS avg_length, CAST(sum(wasted_ms) AS BIGINT) AS wasted_ms, CAST(sum(escalations) AS BIGINT) AS escalations, max(n) AS longest,
  first(chain ORDER BY n DESC, chain) AS longest_first FROM r""")
def chain_stats(spark, sf_dir):
    return usage.chain_stats(_events(spark, sf_dir))


@query(_CHAINS + " SELECT chain, escalations FROM r WHERE escalations > 0")
def scope_escalations(spark, sf_dir):
    return usage.retry_chains(_events(spark, sf_dir)).where("escalations > 0").select("chain", "escalations")


@query(_CHAINS + " SELECT h.seq, h.pattern, h.scope, h.results FROM h WHERE c = (SELECT c FROM h GROUP BY c HAVING count(*) > 1 ORDER BY count(*) DESC, min(seq) LIMIT 1)")
def longest_chain(spark, sf_dir):
    return usage.longest_chain_patterns(_events(spark, sf_dir))


@query(f"WITH {E_} SELECT pattern, scope, count(*) AS n FROM e GROUP BY pattern, scope HAVING count(*) > 1")
def duplicates(spark, sf_dir):
    return usage.duplicates(_events(spark, sf_dir))



_LINES = "x AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, date_trunc('second', ts_at) AS ts_at, results, ms, scope FROM e)"


@query(f"WITH {E_}, {_LINES}, {_STEPS.format(source='x')} SELECT chain, n, wasted_ms, escalations FROM r")
def log_chains(spark, sf_dir):
    """Chains of a log that was written line by line and whose files lie in another order."""
    e = _events(spark, sf_dir)
    line = e.select(
        F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "pattern", "mode", "flags", "scope", "results", "files", "ms", "bre", "extra_args", "capped", "pf_skip",
        (F.lit(1704067200 * 10**9) + F.col("seq") * 10**9).alias("written_ns"), F.lit("w").alias("writer"),
    )
    path = scratch(spark, "log")
    line.repartition(12, F.xxhash64("written_ns")).write.json(path)
    return usage.retry_chains(usage.read_log(spark, path).withColumn("at", F.try_to_timestamp("ts")))


@query(f"""WITH {E_}, w AS (SELECT * FROM e WHERE strftime(ts_at, '%Y-%m-%dT%H:%M:%SZ') >= '2024-01-11T12:00:00Z')
SELECT pattern, scope, count(*) AS n FROM w GROUP BY pattern, scope""")
def recent_usage(spark, sf_dir):
    """Searches of the last 30 days."""
    e = _events(spark, sf_dir).withColumn("ts", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return usage.last_days(e, datetime(2024, 2, 10, 12)).groupBy("pattern", "scope").agg(F.count("*").alias("n"))
