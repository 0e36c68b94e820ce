"""Chat sessions: JSON-lines files as a table of messages, and adapters for tables that hold messages."""

from __future__ import annotations

from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import byte_prefix, trim

#: A file written within so many seconds is taken for the session that asks.
CURRENT_SECONDS = 60
#: Bytes of a file's name that make a session's id.
SESSION_ID_BYTES = 12
MESSAGE_COLUMNS = ("role", "type", "text", "timestamp", "session_id", "project", "file_path", "msg_index")


def encode_path(path: str) -> str:
    """The name of a working folder's project."""
    return "-" + path.removeprefix("/").replace("/", "-")


def session_files(spark: SparkSession, base: str, now: datetime | None = None, max_age: timedelta | None = None) -> DataFrame:
    """(file_path, modified, value) of each .jsonl file at any depth below base, not older than
    max_age at the time now. Reading whole files makes one row of a file: the listing prunes by
    name and time, and unused text is pruned from the plan."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if max_age is not None:
        now = now or datetime.now(ZoneInfo(spark.conf.get("spark.sql.session.timeZone"))).replace(tzinfo=None)  # the reader's zone
        reader = reader.option("modifiedAfter", (now - max_age - timedelta(microseconds=1)).strftime("%Y-%m-%dT%H:%M:%S.%f"))
    try:
        files = reader.text(base, wholetext=True)
    except Exception as e:  # no such folder, or one without files
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file_path string, modified timestamp, value string")
    return files.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def newest(files: DataFrame, now: datetime) -> str | None:
    """The newest file, if it was written within CURRENT_SECONDS of now. One small aggregate."""
    row = files.agg(F.max_by("file_path", F.struct("modified", "file_path")).alias("path"), F.max("modified").alias("at"), F.count("*").alias("n")).first()
    if not row["n"] or row["at"] is None or now - row["at"] > timedelta(seconds=CURRENT_SECONDS):
        return None
    return row["path"]


def without_current(files: DataFrame, now: datetime) -> DataFrame:
    """Without the newest file, if that is the current session and not the only file."""
    row = files.agg(F.max_by("file_path", F.struct("modified", "file_path")).alias("path"), F.max("modified").alias("at"), F.count("*").alias("n")).first()
    if row["n"] <= 1 or now - row["at"] > timedelta(seconds=CURRENT_SECONDS):
        return files
    return files.where(F.col("file_path") != row["path"])


def session_id(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return byte_prefix(F.regexp_replace(name, r"\.[^.]*$", ""), SESSION_ID_BYTES)


def project(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(_kind(v), F.lit("OBJECT")), F.lit(False))


def message_text(v: Column) -> Column:
    """Text of a record: a string, or the text blocks of a list of blocks. Records of another
    shape have none. Needs spark.sql.variant.allowDuplicateKeys for records that repeat a key."""
    m = F.try_variant_get(v, "$.message", "variant")
    inner = F.when(_is_object(m), F.try_variant_get(m, "$.content", "variant")).when(
        m.isNotNull() & (_kind(m) != "VOID"), F.try_variant_get(v, "$.data.message.content", "variant")
    )
    blocks = F.try_variant_get(inner, "$", "array<variant>")
    fine = F.forall(blocks, lambda e: e.isNull() | _is_object(e) | (_kind(e) == "VOID"))

    def of_block(e: Column) -> Column:
        t = F.try_variant_get(e, "$.text", "variant")
        wanted = (F.try_variant_get(e, "$.type", "string") == "text") & (_kind(F.try_variant_get(e, "$.type", "variant")) == "STRING") & (_kind(t) == "STRING")
        return F.coalesce(F.when(wanted, F.try_variant_get(t, "$", "string")), F.lit(""))

    joined = F.array_join(F.filter(F.transform(blocks, of_block), lambda x: x != ""), " ")
    text = F.when(_kind(inner) == "STRING", F.try_variant_get(inner, "$", "string")).when(blocks.isNotNull() & fine, joined)
    return F.coalesce(trim(text), F.lit(""))


def collapse_runs(rows: DataFrame, group: list[str], key: list[str], order: str) -> DataFrame:
    """Of consecutive rows of a group with equal key the last."""
    w = Window.partitionBy(*group).orderBy(order)
    here = F.struct(*[F.col(c) for c in key])
    return rows.withColumn("__next", F.lead(here).over(w)).where(F.col("__next").isNull() | (F.col("__next") != here)).drop("__next")


def renumber(rows: DataFrame, group: list[str], order: str, name: str = "msg_index") -> DataFrame:
    """Numbers from 0 in each group."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1).cast("int"))


def messages(files: DataFrame) -> DataFrame:
    """Messages of session files: users' and assistants', with text, runs of one role within a
    second collapsed to the last one, numbered from 0 in each file."""
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = files.select("file_path", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where("line <> ''")
    v = F.try_parse_json("line")
    role = F.when(_kind(F.try_variant_get(F.col("v"), "$.type", "variant")) == "STRING", F.try_variant_get(F.col("v"), "$.type", "string"))
    stamp = F.when(_kind(F.try_variant_get(F.col("v"), "$.timestamp", "variant")) == "STRING", F.try_variant_get(F.col("v"), "$.timestamp", "string"))
    rows = (
        lines.withColumn("v", v)
        .where(_is_object(F.col("v")))
        .withColumn("role", role)
        .where(F.col("role").isin("user", "assistant"))
        .select("file_path", "line_no", "role", F.coalesce(byte_prefix(stamp, 19), F.lit("")).alias("timestamp"), message_text(F.col("v")).alias("text"))
        .where("text <> ''")
    )
    rows = renumber(collapse_runs(rows, ["file_path"], ["timestamp", "role"], "line_no"), ["file_path"], "line_no")
    path = F.col("file_path")
    return rows.select("role", F.col("role").alias("type"), "text", "timestamp", session_id(path).alias("session_id"), project(path).alias("project"), "file_path", "msg_index")


def from_conversations(rows: DataFrame, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Messages of a table (conv_id, turn, role, text): a conversation is a session. It has no
    times; each message gets one that rises with its conversation and turn."""
    made = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("conv_id") * 3600 + F.col("turn") * 30), "yyyy-MM-dd'T'HH:mm:ss")
    rows = rows.where(F.col("role").isin("user", "assistant")).withColumn("text", trim(F.col("text"))).where("text <> ''")
    rows = renumber(rows.withColumn("timestamp", made), ["conv_id"], "turn")
    return rows.select(
        "role", F.col("role").alias("type"), "text", "timestamp", F.col("conv_id").cast("string").alias("session_id"),
        F.concat(F.lit("project-"), F.col("conv_id") % 7).alias("project"), F.col("conv_id").cast("string").alias("file_path"), "msg_index", "conv_id",
    )
