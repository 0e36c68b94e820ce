"""Analytics of the search log.

Events: seq (log order), ts, pattern, mode, flags, results, files, days, scope, ms, bre,
extra_args, capped, pf_skip, pf_pass.
"""

from __future__ import annotations

import time
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LOG_SCHEMA = (
    "ts string, pattern string, mode string, flags string, results int, files int, days int, scope string, ms bigint, "
    "bre boolean, extra_args boolean, capped boolean, pf_skip int, pf_pass int"
)
WINDOW_DAYS = 30
#: Searches less than so many seconds apart, one after the other, are retries.
RETRY_SECONDS = 90
TOP_EMPTY, TOP_FLAGS, TOP_DUPLICATES = 10, 8, 5
#: Consecutive numbers of the log that one task puts in order.
BUCKET = 65_536
#: Besides the event, a line has when it was written and by whom: the order of the log.
ORDER_SCHEMA = "written_ns bigint, writer string"
HOUR_NS = 3600 * 10**9
_WRITER = uuid.uuid4().hex


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines, numbered in the order of the log; unreadable lines are left out, absent
    fields are 0, false or empty.

    Order is when a line was written, as the line says, and then its writer. Lines without that
    come in the order of their files' times and of the lines in a file, after those of the same
    hour that have it. The lines of an hour, or of a block of a file, are put in order by one task;
    a window over one row for each of these numbers them through."""
    file = F.col("_metadata")
    lines = spark.read.text(path).select(
        "value", F.unix_micros(file["file_modification_time"]).alias("__file_us"), file["file_path"].alias("__path"), file["file_block_start"].alias("__block"), F.monotonically_increasing_id().alias("__line")
    )
    got = F.from_json("value", f"{LOG_SCHEMA}, {ORDER_SCHEMA}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    rows = lines.where("trim(value) <> ''").withColumn("e", got).where("e IS NOT NULL AND e.__bad IS NULL")
    own = F.col("e.written_ns").isNotNull()
    ns = F.coalesce("e.written_ns", F.col("__file_us") * 1000)
    rows = rows.withColumns({
        "__hour": F.floor(ns / HOUR_NS), "__path": F.when(own, "").otherwise(F.col("__path")), "__block": F.when(own, 0).otherwise(F.col("__block")),
        "__ns": ns, "__writer": F.coalesce("e.writer", F.lit("")),
    })
    part = ["__hour", "__path", "__block"]
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*part).orderBy("__ns", "__writer", "__line")))
    before = F.sum("__size").over(Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy(*part).agg(F.count("*").alias("__size")).select(*part, F.coalesce(before, F.lit(0)).alias("__before"))
    rows = rows.join(sizes, part).select((F.col("__before") + F.col("__n") - 1).alias("seq"), "e.*").drop("__bad", "written_ns", "writer")
    return rows.fillna("").fillna(0).fillna(False)


def append_event(spark: SparkSession, path: str, ts: datetime, **event) -> None:
    """Adds one event to the log, as a file of its own; the event says when it was written."""
    row = {"ts": ts.strftime("%Y-%m-%dT%H:%M:%SZ"), **event}
    row = {"written_ns": time.time_ns(), "writer": _WRITER} | row
    spark.createDataFrame([row], f"{LOG_SCHEMA}, {ORDER_SCHEMA}").write.mode("append").json(path)


def last_days(events: DataFrame, now: datetime, days: int = WINDOW_DAYS) -> DataFrame:
    """Events whose RFC 3339 time is, as a string, not before the cutoff."""
    return events.where(F.col("ts") >= (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%SZ"))


def summary(events: DataFrame) -> DataFrame:
    """Totals in one row; shares are whole per cents and the latency whole milliseconds."""
    e = events.agg(
        F.count("*").alias("total"), F.count_if(F.col("results") > 0).alias("found"), F.count_if(F.col("results") <= 0).alias("empty"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("sum_ms"), F.count_if("bre").alias("bre"), F.count_if("extra_args").alias("extra_args"), F.count_if("capped").alias("capped"),
    )
    share = lambda c: F.when(F.col("total") > 0, F.expr(f"({c} * 100) div total")).otherwise(F.lit(0))
    return e.select(
        "total", "found", "empty", share("found").cast("long").alias("hit_rate"), F.when(F.col("total") > 0, F.expr("sum_ms div total")).otherwise(F.lit(0)).cast("long").alias("avg_ms"),
        "bre", "extra_args", "capped", share("capped").cast("long").alias("capped_pct"),
    )


def modes(events: DataFrame) -> DataFrame:
    """Searches of each mode, and their share in whole per cents."""
    total = events.agg(F.count("*").alias("total"))
    by = events.groupBy("mode").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(total)).select("mode", "n", F.expr("(n * 100) div total").cast("long").alias("pct"))  # total is one row


def flags(events: DataFrame, top: int = TOP_FLAGS) -> DataFrame:
    """The flags used most, how often, and in what share of the searches."""
    total = events.agg(F.count("*").alias("total"))
    each = events.select(F.explode(F.regexp_extract_all("flags", F.lit(r"(\S+)"), F.lit(1))).alias("flag"))
    by = each.groupBy("flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "flag").limit(top)
    return by.crossJoin(F.broadcast(total)).select("flag", "n", F.expr("(n * 100) div total").cast("long").alias("pct"))  # total is one row


def empty_patterns(events: DataFrame, top: int = TOP_EMPTY) -> DataFrame:
    """Patterns that found nothing, the most frequent first."""
    by = events.where("results = 0").groupBy("pattern").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(top)
    return by.withColumn("label", F.when(F.col("n") > 1, F.concat("pattern", F.lit(" ("), F.col("n").cast("string"), F.lit("x)"))).otherwise(F.col("pattern")))


def prefilter_rejected_all(events: DataFrame) -> DataFrame:
    """Patterns of searches whose files the pre-filter turned all down, as first seen, with counts."""
    hit = events.where("results = 0 AND pf_skip > 0 AND pf_skip = files")
    return hit.groupBy("pattern").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


def duplicates(events: DataFrame) -> DataFrame:
    """Searches made more than once: pattern, scope and how often. The report shows TOP_DUPLICATES."""
    return events.groupBy("pattern", "scope").agg(F.count("*").alias("n")).where("n > 1")


def chained(events: DataFrame, gap: int = RETRY_SECONDS, at: str = "at") -> DataFrame:
    """events with chain, the seq of the first event of its run, and scope_before, the scope of the
    event before it in its run. A run goes on while the next event, in log order, is less than
    gap seconds later (or earlier); an unreadable time breaks it.

    The log is put in order bucket by bucket of its numbers, and a window over one row a bucket
    stitches the edges, so no task orders the whole log, however long a run is."""
    rows = events.withColumn("__bucket", F.floor(F.col("seq") / BUCKET))
    w = Window.partitionBy("__bucket").orderBy("seq")
    goes_on = lambda now, before: F.coalesce(now < before + F.expr(f"INTERVAL {gap} SECONDS"), F.lit(False))
    rows = rows.withColumns({"__before": F.lag(F.struct(F.col(at).alias("at"), "scope")).over(w), "__first": F.row_number().over(w) == 1})
    rows = rows.withColumn("__new", ~F.col("__first") & ~goes_on(F.col(at), F.col("__before.at")))
    start = F.when(F.col("__new"), F.col("seq"))
    rows = rows.withColumn("__start", F.last(start, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    edge = F.struct("seq", F.col(at).alias("at"), "scope")
    edges = rows.groupBy("__bucket").agg(F.min_by(edge, "seq").alias("first"), F.max_by(edge, "seq").alias("last"), F.max(start).alias("start"))
    over = Window.orderBy("__bucket")
    edges = edges.withColumn("before", F.lag("last").over(over)).withColumn("new", ~goes_on(F.col("first.at"), F.col("before.at")))
    # the start of the run that is open at a bucket's end, if it is in that bucket
    edges = edges.withColumn("own", F.coalesce("start", F.when(F.col("new"), F.col("first.seq"))))
    edges = edges.withColumn("open", F.last("own", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.select("__bucket", F.when(F.col("new"), F.col("first.seq")).otherwise(F.col("open")).alias("__open"), F.when(~F.col("new"), F.col("before.scope")).alias("__scope"))
    scope = F.when(F.col("__first"), F.col("__scope")).when(~F.col("__new"), F.col("__before.scope"))
    rows = rows.join(edges, "__bucket").withColumns({"chain": F.coalesce("__start", "__open"), "scope_before": scope})
    return rows.drop("__bucket", "__before", "__first", "__new", "__start", "__open", "__scope")


def retry_chains(events: DataFrame, gap: int = RETRY_SECONDS) -> DataFrame:
    """Runs of more than one search: first seq, length, wasted milliseconds (of empty searches)
    and whether a search of a project was followed by one of everything."""
    escalated = (F.col("scope_before") == "project") & (F.col("scope") == "all")
    return chained(events, gap).groupBy("chain").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("results") == 0, F.col("ms")).otherwise(F.lit(0))).alias("wasted_ms"), F.count_if(escalated).alias("escalations")
    ).where("n > 1")


def chain_stats(events: DataFrame, gap: int = RETRY_SECONDS) -> DataFrame:
    """Chains, their mean length (one decimal), wasted time, scope escalations, and the first of
    the longest chains, in one row."""
    return retry_chains(events, gap).agg(
        F.count("*").alias("chains"), F.round(F.avg("n"), 1).alias("avg_length"), F.coalesce(F.sum("wasted_ms"), F.lit(0)).alias("wasted_ms"),
        F.coalesce(F.sum("escalations"), F.lit(0)).alias("escalations"), F.max("n").alias("longest"), F.max_by("chain", F.struct(F.col("n"), -F.col("chain"))).alias("longest_first"),
    )


def longest_chain_patterns(events: DataFrame, gap: int = RETRY_SECONDS) -> DataFrame:
    """The searches of the first of the longest chains, in order."""
    rows = chained(events, gap)
    sizes = rows.groupBy("chain").agg(F.count("*").alias("n")).where("n > 1")
    top = sizes.orderBy(F.desc("n"), "chain").limit(1).select("chain")
    return rows.join(F.broadcast(top), "chain", "left_semi").select("seq", "pattern", "scope", "results").orderBy("seq")  # top is one row


def report(events: DataFrame, now: datetime) -> list[str]:
    """The usage report. Its sections are aggregates of one cached log; the two lists that have no
    top-k, patterns that the pre-filter rejected and the longest chain, come partition by partition."""
    events = last_days(events, now).withColumn("at", F.try_to_timestamp("ts")).cache()
    try:
        return _report(events)
    finally:
        events.unpersist()


def _report(events: DataFrame) -> list[str]:
    s = summary(events).first()
    if not s["total"]:
        return ["no searches in the last 30 days"]
    out = [f"searches: {s['total']} (found {s['found']}, empty {s['empty']}, hit rate {s['hit_rate']}%)", f"average latency: {s['avg_ms']} ms"]
    out += [f"mode {r['mode']}: {r['n']} ({r['pct']}%)" for r in modes(events).orderBy(F.desc("n"), "mode").collect()]
    out += [f"{name}: {s[key]}" for name, key in (("basic syntax", "bre"), ("extra arguments", "extra_args")) if s[key]]
    if s["capped"]:
        out.append(f"capped: {s['capped']} ({s['capped_pct']}%)")
    rejected = prefilter_rejected_all(events)
    n = rejected.agg(F.sum("n")).first()[0]
    if n:
        out.append(f"pre-filter turned down every file: {n}")
        out += [f"  {r['pattern']}" for r in rejected.orderBy("first_seq").toLocalIterator()]
    out += [f"empty: {r['label']}" for r in empty_patterns(events).collect()]
    out += [f"flag {r['flag']}: {r['n']} ({r['pct']}%)" for r in flags(events).collect()]
    c = chain_stats(events).first()
    if c["chains"]:
        out.append(f"retry chains: {c['chains']}, average length {c['avg_length']:.1f}, wasted {c['wasted_ms']} ms, scope escalations {c['escalations']}")
        out.append("longest: " + " > ".join(r["pattern"] for r in longest_chain_patterns(events).toLocalIterator()))
    out += [f"repeated: {r['pattern']} ({r['scope']}, {r['n']}x)" for r in duplicates(events).orderBy(F.desc("n"), "pattern", "scope").limit(TOP_DUPLICATES).collect()]
    return out


#: A table of events (event_id, ts, user_id, event_type, value, props) read as a search log. The
#: same SQL runs in Spark and DuckDB but for the JSON function and one name.
ADAPTER = """
SELECT event_id AS seq, ts AS {at}, event_type AS pattern,
  CASE event_id % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'semantic' ELSE 'semantic-fallback' END AS mode,
  CASE user_id % 4 WHEN 0 THEN '-a' WHEN 1 THEN '-p -a' WHEN 2 THEN '' ELSE '-n -C --json' END AS flags,
  CASE WHEN user_id % 2 = 0 THEN 'all' ELSE 'project' END AS scope,
  CAST(coalesce({k}, 0) % 4 AS INT) AS results, CAST(1 + user_id % 5 AS INT) AS files,
  CAST(floor(value) AS BIGINT) AS ms, event_id % 11 = 0 AS bre, event_id % 13 = 0 AS extra_args, event_id % 7 = 0 AS capped,
  CAST(event_id % 6 AS INT) AS pf_skip
FROM events"""


def from_events(events: DataFrame) -> DataFrame:
    events.createOrReplaceTempView("events")
    return events.sparkSession.sql(ADAPTER.format(at="at", k="CAST(get_json_object(props, '$.k') AS BIGINT)"))


