"""The embedding index: two tables, kept up to date file by file.

entries: session_id, msg_index, role, timestamp, preview, file_path, vector, project
files: project, file_path, last_modified

A run writes a version: a folder with the partitions of the projects that changed. A manifest names
the version of each project; the newest manifest counts. Both are on any file system Spark reaches.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import byte_prefix
from quarry.operators.semantic import Embedder, embed_column
from quarry.sources.folder import Folder
from quarry.sources.sessions import project, session_files
from quarry.sources.sessions import messages as read_messages

PREVIEW_BYTES, EMBED_BYTES = 200, 2048
LOCK_STALE_SECONDS = 2 * 3600
#: Beyond so many versions in use, a run writes all projects anew.
MOST_VERSIONS = 32
ENTRIES = "session_id string, msg_index int, role string, timestamp string, preview string, file_path string, vector array<float>, project string"
FILES = "file_path string, last_modified timestamp, project string"


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; empty if it isn't there or cannot be read as one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if not any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "FAILED_READ_FILE")):
            raise
        return spark.createDataFrame([], schema)


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that the index has not, or that were written since."""
    k = known.select("file_path", F.col("last_modified"))
    return files.join(k, "file_path", "left").where(F.col("last_modified").isNull() | (F.col("modified") > F.col("last_modified"))).drop("last_modified")


def incremental_plan(files: DataFrame, known: DataFrame) -> DataFrame:
    """How many files are indexed again and how many skipped, in one row."""
    k = known.select("file_path", "last_modified")
    stale = F.col("last_modified").isNull() | (F.col("modified") > F.col("last_modified"))
    return files.join(k, "file_path", "left").agg(F.count_if(stale).alias("indexed"), F.count_if(~stale).alias("skipped"))


@contextlib.contextmanager
def lock(folder: Folder, name: str = "lock", now: float | None = None) -> Iterator[None]:
    """One writer at a time; a lock left for two hours is taken over, by one taker. It goes whatever happens."""
    at = folder.written(name)
    if at is not None and (time.time() if now is None else now) - at > LOCK_STALE_SECONDS:
        stale = f".{name}-{uuid.uuid4().hex}"
        if folder.move(name, stale):
            folder.delete(stale)
    if not folder.create(name):
        raise RuntimeError(f"another index run holds {folder.path}/{name}")
    try:
        yield
    finally:
        folder.delete(name)


def _manifests(folder: Folder) -> list[str]:
    return [n for n in folder.names() if n.startswith("manifest-")]


def _manifest(folder: Folder) -> dict[str, str]:
    """The version of each project's partitions."""
    found = _manifests(folder)
    return json.loads(folder.read(found[-1])) if found else {}


def build_index(spark: SparkSession, base: str, index_dir: str, embedder: Embedder, rebuild: bool = False) -> dict[str, int]:
    """Brings the index up to date and counts files indexed and skipped, and messages that could
    not be embedded. A changed file's entries are all made again; files that are gone keep theirs; a
    file that now has no messages loses its entries and keeps its old time; a message that cannot
    be embedded is left out and its file still counts as indexed.

    Files' times are listed before anything is read and these are what is recorded, so a file that
    is written meanwhile is newer than its record and indexed again by the next run. Only projects
    with changed files are written. The manifest is written last, so a reader or a rerun never sees
    half a version; folders that neither it nor the one before name go."""
    if not embedder.available():
        raise RuntimeError("the embedding service does not answer")
    folder = Folder(spark, index_dir)
    with lock(folder):
        version = f"v{time.time_ns():020d}"
        top = f"{index_dir}/{version}"
        before = {} if rebuild else _manifest(folder)
        session_files(spark, base).select("file_path", "modified").write.parquet(f"{top}/seen")
        seen = read_table(spark, f"{top}/seen", "file_path string, modified timestamp")
        entries, known = _tables(spark, index_dir, before)
        counts = incremental_plan(seen, known).first()
        stale = changed(seen, known)
        oldest = stale.agg(F.date_format(F.min("modified"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        if oldest is None:
            folder.delete(version)
            return {"indexed": 0, "skipped": counts["skipped"], "failed": 0}
        # only files written since the oldest changed one are read
        texts = session_files(spark, base, datetime.fromisoformat(oldest), timedelta(0)).select("file_path", "value")
        found = read_messages(texts.join(stale.select("file_path"), "file_path", "left_semi"))
        inputs = found.select(
            "session_id", "msg_index", "role", "timestamp", byte_prefix(F.col("text"), PREVIEW_BYTES).alias("preview"), "file_path", byte_prefix(F.col("text"), EMBED_BYTES).alias("input"), "project"
        )
        columns = ("session_id", "msg_index", "role", "timestamp", "preview", "file_path", "vector", "project")
        embed_column(inputs, "input", embedder).select(*columns).write.partitionBy("project").parquet(f"{top}/made")
        made = read_table(spark, f"{top}/made", ENTRIES)
        touched = sorted(r[0] for r in stale.select(project(F.col("file_path"))).distinct().toLocalIterator())
        if len({v for p, v in before.items() if p not in touched}) >= MOST_VERSIONS:
            touched = sorted({*touched, *before})
        kept = entries.where(F.col("project").isin(touched)).join(stale.select("file_path"), "file_path", "left_anti")
        kept.select(*columns).unionByName(made.where("vector IS NOT NULL").select(*columns)).write.partitionBy("project").parquet(f"{top}/entries")
        times = stale.join(made.select("file_path").distinct(), "file_path", "left_semi").select("file_path", F.col("modified").alias("last_modified"), project(F.col("file_path")).alias("project"))
        old = known.where(F.col("project").isin(touched)).join(times, "file_path", "left_anti").select(*times.columns)
        old.unionByName(times).write.partitionBy("project").parquet(f"{top}/files")
        failed = made.where("vector IS NULL").count()
        last = _manifests(folder)[-1:]
        folder.put(f"manifest-{version}", json.dumps(before | dict.fromkeys(touched, version)))
        for part in ("seen", "made"):
            folder.delete(f"{version}/{part}")
        named = {version, *before.values(), *(v for m in last for v in json.loads(folder.read(m)).values())}
        for name in folder.names():
            if (name.startswith("v") and name not in named) or (name.startswith("manifest-") and name not in (f"manifest-{version}", *last)):
                folder.delete(name)
    return {"indexed": counts["indexed"], "skipped": counts["skipped"], "failed": failed}


def _tables(spark: SparkSession, index_dir: str, manifest: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    entries, files = spark.createDataFrame([], ENTRIES), spark.createDataFrame([], FILES)
    for v in sorted(set(manifest.values())):
        of = F.col("project").isin([p for p, x in manifest.items() if x == v])  # prunes partitions
        entries = entries.unionByName(read_table(spark, f"{index_dir}/{v}/entries", ENTRIES).where(of))
        files = files.unionByName(read_table(spark, f"{index_dir}/{v}/files", FILES).where(of))
    return entries, files


def load_index(spark: SparkSession, index_dir: str) -> tuple[DataFrame, DataFrame]:
    """entries and files of the newest manifest; empty tables if there is none."""
    return _tables(spark, index_dir, _manifest(Folder(spark, index_dir)))


def index_stats(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Numbers of projects, files and vectors, in one row."""
    f = files.agg(F.countDistinct("project").alias("projects"), F.countDistinct("file_path").alias("files"))
    return f.crossJoin(entries.agg(F.count("*").alias("vectors")))  # one row with one row


def human_size(n: Column) -> Column:
    """Bytes in units of 1024, with one decimal; halves go to the even digit."""
    units = lambda unit: F.bround(n / unit, 1)
    return (
        F.when(n >= 1 << 30, F.format_string("%.1f GB", units(1 << 30)))
        .when(n >= 1 << 20, F.format_string("%.1f MB", units(1 << 20)))
        .when(n >= 1 << 10, F.format_string("%.1f KB", units(1 << 10)))
        .otherwise(F.format_string("%d B", n))
    )


def index_bytes(spark: SparkSession, index_dir: str) -> int:
    """Bytes of the partitions that the newest manifest names."""
    folder = Folder(spark, index_dir)
    return sum(folder.bytes(f"{v}/{kind}/project={p}") for p, v in _manifest(folder).items() for kind in ("entries", "files"))


def index_status(spark: SparkSession, index_dir: str) -> str:
    """A line about the index: what it does and what it holds."""
    at = Folder(spark, index_dir).written("lock")
    busy = at is not None and time.time() - at <= LOCK_STALE_SECONDS
    row = index_stats(*load_index(spark, index_dir)).first()
    size = spark.range(1).select(human_size(F.lit(index_bytes(spark, index_dir)))).first()[0]
    return f"{'indexing' if busy else 'idle'}: {row['projects']} projects, {row['files']} files, {row['vectors']} vectors, {size}"


def as_of(files: DataFrame, when: datetime) -> DataFrame:
    """Files last written before when."""
    return files.where(F.col("modified") <= F.lit(when))
