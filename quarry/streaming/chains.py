"""Retry chains of a stream of search events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Session windows join events that are exactly the gap apart, and chains must not: a log with
#: whole seconds takes a second less, one with microseconds a microsecond less.
GAP_SECONDS, GAP_MICROSECONDS = "89 seconds", "89.999999 seconds"


def streaming_chains(events: DataFrame, key: str = "log_id", at: str = "at", gap: str = GAP_MICROSECONDS, watermark: str = "10 minutes") -> DataFrame:
    """(key, start, n, wasted_ms) of runs of more than one event. Events later than the watermark are dropped."""
    rows = events.withWatermark(at, watermark).groupBy(F.col(key), F.session_window(at, gap).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("results") == 0, F.col("ms")).otherwise(F.lit(0))).alias("wasted_ms")).where("n > 1").select(
        key, F.col("w.start").alias("start"), "n", "wasted_ms"
    )


def index_new_files(stream: DataFrame, index: callable, checkpoint: str):
    """Starts a query that calls index(batch) for each micro-batch of changed session files."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: index(batch)).start()
