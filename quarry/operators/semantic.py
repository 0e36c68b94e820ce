"""Semantic search: exact nearest neighbours by cosine over an index of message embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine
from quarry.operators.search import SearchOptions, with_context

THRESHOLD = 0.55
DEFAULT_RESULTS = 10


class Embedder(Protocol):
    """Makes vectors of texts. A text that fails gives None; available() is asked before a search."""

    def available(self) -> bool: ...

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class HashedWords:
    """Deterministic vectors without a service: words hashed to signed dimensions, normalised."""

    def __init__(self, dimensions: int = 256):
        self.dimensions = dimensions

    def available(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions, np.float32)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                v[(h >> 1) % self.dimensions] += 1 if h & 1 else -1
            norm = float(np.linalg.norm(v))
            out.append((v / norm).tolist() if norm else None)
        return out


class HttpEmbedder:
    """A service that takes {"model", "input"} by POST, input being a text or several, and answers {"embeddings": [[...]]}."""

    BATCH = 32

    def __init__(self, url: str, model: str, health: str | None = None, timeout: float = 60.0, health_timeout: float = 2.0):
        self.url, self.model, self.health, self.timeout, self.health_timeout = url, model, health or url, timeout, health_timeout

    def available(self) -> bool:
        from urllib.request import urlopen

        try:
            with urlopen(self.health, timeout=self.health_timeout) as r:
                return r.status == 200
        except OSError:
            return False

    def _post(self, given: str | list[str]) -> list[list[float]] | None:
        """The vectors of a text or of several; None if the service fails or gives another number of them."""
        import json
        from urllib.request import Request, urlopen

        try:
            body = json.dumps({"model": self.model, "input": given}).encode()
            with urlopen(Request(self.url, body, {"Content-Type": "application/json"}), timeout=self.timeout) as r:
                got = json.load(r).get("embeddings") or []
                fine = r.status == 200 and len(got) == (1 if isinstance(given, str) else len(given)) and all(got)
            return got if fine else None
        except (OSError, ValueError):
            return None

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        """BATCH texts a request; those of a request that fails are tried one by one."""
        out: list[list[float] | None] = []
        for at in range(0, len(texts), self.BATCH):
            part = texts[at : at + self.BATCH]
            got = self._post(part) if len(part) > 1 else None
            out += got if got is not None else [(self._post(t) or [None])[0] for t in part]
        return out


def embed_column(df: DataFrame, text: str, embedder: Embedder, name: str = "vector") -> DataFrame:
    """df and the vectors of a text column, made in batches on the executors."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{name: embedder.embed(b[text].tolist())})

    return df.mapInPandas(run, schema)


def similar(entries: DataFrame, query: list[float], threshold: float = THRESHOLD, vector: str = "vector") -> DataFrame:
    """Entries whose similarity to the query, a float, is above the threshold. The query is a
    constant of the plan, so nothing is joined or shuffled."""
    q = F.array(*[F.lit(float(x)).cast("float") for x in query])
    return entries.withColumn("similarity", cosine(F.col(vector), q)).where(F.col("similarity") > F.lit(threshold).cast("float"))


def nearest(rows: DataFrame, limit: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc("similarity"), *ties).limit(limit if limit > 0 else DEFAULT_RESULTS)


def recent(entries: DataFrame, now: datetime, max_days: int) -> DataFrame:
    """By the messages' own time, in UTC; entries without a readable one pass. No cutoff for 0 days."""
    if max_days <= 0:
        return entries
    cutoff = F.lit((now - timedelta(days=max_days)).strftime("%Y-%m-%d %H:%M:%S"))
    at = F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return entries.where(F.coalesce(at >= F.to_timestamp(cutoff), F.lit(True)))


def semantic_search(
    entries: DataFrame,
    messages: DataFrame | None,
    query: list[float],
    options: SearchOptions,
    now: datetime,
    project_prefix: str | None = None,
    current_file: str | None = None,
    threshold: float = THRESHOLD,
    use_hours: bool = False,
) -> DataFrame:
    """The nearest messages of an index, filters first. Their text is the stored preview unless
    context is asked for or the preview is empty; only then the messages are joined, so a search
    without context reads the index alone. use_hours: let max_hours cut off too."""
    rows = entries
    if project_prefix is not None:
        rows = rows.where(F.startswith("project", F.lit(project_prefix)))
    if current_file is not None:
        rows = rows.where(F.col("file_path") != current_file)
    if options.role != "both":
        rows = rows.where(F.col("role") == options.role)
    rows = recent(rows, now, options.max_days)
    if use_hours and options.max_hours > 0:
        at = F.try_to_timestamp(F.col("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        rows = rows.where(F.coalesce(at >= F.lit(now - timedelta(hours=options.max_hours)), F.lit(True)))
    top = nearest(similar(rows, query, threshold), options.max_results, "file_path", "msg_index").drop("vector")
    if messages is None or not (options.before or options.after):
        return top.withColumn("text", F.col("preview"))
    # at most max_results rows pick the files whose messages are read, whatever the index holds
    files = top.select("file_path").distinct()
    near = with_context(messages.join(F.broadcast(files), "file_path", "left_semi"), options.before, options.after)
    full = near.select("file_path", "msg_index", F.col("text").alias("full_text"), "context_before", "context_after")
    return top.join(full, ["file_path", "msg_index"], "left").withColumn("text", F.coalesce("full_text", "preview")).drop("full_text")
