"""What a search shows: budgets, groups, duplicates left out, and the lines of each format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import byte_prefix
from quarry.operators.bm25 import compress

#: Bytes shown in all, and the least and most of one match; bytes of a message that is context.
TOTAL_BUDGET, LEAST_BUDGET, MOST_BUDGET, CONTEXT_BYTES = 30_000, 300, 2_000, 200


def budget(n: Column) -> Column:
    """Bytes of each of n matches."""
    return F.greatest(F.lit(LEAST_BUDGET), F.least(F.lit(MOST_BUDGET), F.floor(F.lit(TOTAL_BUDGET) / F.greatest(n, F.lit(1))))).cast("int")


def grouped(matches: DataFrame) -> DataFrame:
    """Matches, at most the search's cap of them, with out_pos (place among the matches), group_pos
    (place of its session's first match) and budget."""
    order = Window.orderBy(F.desc("similarity"), "file_path", "msg_index") if "similarity" in matches.columns else Window.orderBy(F.desc("timestamp"), "file_path", "msg_index")
    rows = matches.withColumn("out_pos", F.row_number().over(order))
    rows = rows.withColumn("group_pos", F.min("out_pos").over(Window.partitionBy("project", "session_id")))
    return rows.withColumn("budget", budget(F.count("*").over(Window.partitionBy(F.lit(1)))))


def match_text(text: Column, query: dict[str, int], size: Column) -> Column:
    return F.replace(compress(text, query, size), F.lit("\n"), F.lit(" "))


def context_text(text: Column) -> Column:
    short = F.when(F.octet_length(text) > CONTEXT_BYTES, F.concat(byte_prefix(text, CONTEXT_BYTES), F.lit("..."))).otherwise(text)
    return F.replace(short, F.lit("\n"), F.lit(" "))


def first_seen(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Of rows with equal text the first in order."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def line(marker: Column, timestamp: Column, role: Column, similarity: Column, text: Column) -> Column:
    tag = F.when(role == "assistant", F.lit("AI ")).otherwise(F.lit("YOU"))
    sim = F.when((marker == ">") & (similarity > 0), F.format_string(" [%.2f]", similarity)).otherwise(F.lit(""))
    return F.concat(F.lit("  "), marker, F.lit(" "), timestamp, F.lit(" ["), tag, F.lit("]"), sim, F.lit(" "), text)


def display_rows(matches: DataFrame, query: dict[str, int]) -> DataFrame:
    """(group_pos, project, session_id, pos, msg_index, line) to be printed in that order.

    A match whose text was shown before is left out with its context; within a session a message
    is printed once, as what it is first."""
    rows = grouped(matches)
    for c in ("context_before", "context_after"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.expr("cast(array() as array<struct<msg_index:int,role:string,timestamp:string,text:string>>)"))
    if "similarity" not in rows.columns:
        rows = rows.withColumn("similarity", F.lit(0.0).cast("float"))
    rows = first_seen(rows.withColumn("shown", match_text(F.col("text"), query, F.col("budget"))), "shown", ["group_pos", "out_pos"])
    one = lambda x: F.struct(x["msg_index"].alias("msg_index"), x["role"].alias("role"), x["timestamp"].alias("timestamp"), context_text(x["text"]).alias("text"), F.lit(" ").alias("marker"))
    itself = F.array(F.struct(F.col("msg_index"), F.col("role"), F.col("timestamp"), F.col("shown").alias("text"), F.lit(">").alias("marker")))
    each = rows.select("group_pos", "out_pos", "project", "session_id", "similarity", F.posexplode(F.concat(F.transform("context_before", one), itself, F.transform("context_after", one))).alias("part", "m"))
    each = each.withColumn("msg_index", F.col("m.msg_index"))
    once = Window.partitionBy("project", "session_id", "msg_index").orderBy("out_pos", "part")
    each = each.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    m = F.col("m")
    return each.select(
        "group_pos", "project", "session_id", F.struct("out_pos", "part").alias("pos"), "msg_index", line(m["marker"], m["timestamp"], m["role"], F.col("similarity"), m["text"]).alias("line")
    ).orderBy("group_pos", "pos")


def list_rows(matches: DataFrame) -> DataFrame:
    """A line for each match, sessions in the order of their first one."""
    return grouped(matches).select("group_pos", "out_pos", F.concat("session_id", F.lit("  "), "timestamp").alias("line")).orderBy("group_pos", "out_pos")


def terminal(matches: DataFrame, query: dict[str, int], list_only: bool = False, separators: bool = False) -> list[str]:
    """The lines to print: at most as many as the search's cap and its context allow."""
    if list_only:
        return [r["line"] for r in list_rows(matches).collect()]
    out: list[str] = []
    group = match = None
    for r in display_rows(matches, query).collect():
        if r["group_pos"] != group:
            if group is not None:
                out.append("")
            group, match = r["group_pos"], None
            out.append(f"--- {r['project']}/{r['session_id']} ---")
        if separators and match is not None and r["pos"]["out_pos"] != match:
            out.append("  --")
        match = r["pos"]["out_pos"]
        out.append(r["line"])
    return out


def json_rows(matches: DataFrame) -> DataFrame:
    """Matches as JSON objects; a similarity of 0 and empty contexts are left out."""
    has = set(matches.columns)
    ctx = lambda c: F.when(F.size(c) > 0, F.transform(c, lambda x: F.struct(x["timestamp"].alias("timestamp"), x["role"].alias("role"), F.make_valid_utf8(x["text"]).alias("text"))))
    fields = [F.col("session_id").alias("session"), F.col("project"), F.col("timestamp"), F.col("role"), F.make_valid_utf8("text").alias("text")]
    if "similarity" in has:
        fields.append(F.when(F.col("similarity") != 0, F.col("similarity")).alias("similarity"))
    fields += [ctx(c).alias(c) for c in ("context_before", "context_after") if c in has]
    rows = grouped(matches)
    return rows.select("out_pos", F.to_json(F.struct(*fields)).alias("json")).orderBy("out_pos")


def json_text(matches: DataFrame) -> str:
    """The matches as one JSON list, indented, with <, > and & escaped; null if there are none."""
    import json

    rows = [json.loads(r["json"]) for r in json_rows(matches).collect()]
    text = json.dumps(rows, indent=2, ensure_ascii=False) if rows else "null"
    for c in "<>&":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text + "\n"
