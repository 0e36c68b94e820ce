"""Regex search over messages: filters, context, newest first, statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.patterns import PatternError, near_miss_literal, prefilter_literals, to_java

DEFAULT_RESULTS, DEFAULT_DAYS = 100, 7
#: Files after which the near-miss count stops.
NEAR_MISS_FILES = 3


@dataclass(frozen=True)
class SearchOptions:
    """What a search asks for. role: both, user or assistant. max_hours wins over max_days."""

    role: str = "both"
    max_results: int = DEFAULT_RESULTS
    max_days: int = DEFAULT_DAYS
    max_hours: int = 0
    before: int = 0
    after: int = 0
    context: int = 0
    list_only: bool = False
    exclude_self: bool = True

    def __post_init__(self):
        if self.max_results < 0:
            raise ValueError("max_results must not be negative")
        if self.context > 0:
            object.__setattr__(self, "before", self.before or self.context)
            object.__setattr__(self, "after", self.after or self.context)

    @property
    def max_age(self) -> timedelta:
        return timedelta(hours=self.max_hours) if self.max_hours > 0 else timedelta(days=self.max_days)

    def but(self, **changes) -> SearchOptions:
        return replace(self, **changes)


def checked_regex(df: DataFrame, pattern: str) -> str:
    """The Java regex of an RE2 pattern. Both translators' refusals are PatternErrors, before any job runs."""
    java = to_java(pattern)
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:
        raise PatternError(f"cannot use pattern {pattern!r}: {e}") from e
    return java


def with_context(messages: DataFrame, before: int, after: int) -> DataFrame:
    """Messages with the ones before and after them in their file, of any role. The windows are
    bounded, so Spark streams through a file's messages; without context there is no window."""
    part = Window.partitionBy("file_path").orderBy("msg_index")
    one = F.struct("msg_index", "role", "timestamp", "text")
    kind = "array<struct<msg_index:int,role:string,timestamp:string,text:string>>"
    none = F.expr(f"cast(array() as {kind})")
    return messages.withColumns({
        "context_before": F.collect_list(one).over(part.rowsBetween(-before, -1)) if before > 0 else none,
        "context_after": F.collect_list(one).over(part.rowsBetween(1, after)) if after > 0 else none,
    })


def matching(messages: DataFrame, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """All messages that match, with context if it is asked for. Not ordered, not capped."""
    regex = checked_regex(messages, pattern)
    rows = with_context(messages, options.before, options.after) if options.before or options.after else messages
    if options.role != "both":
        rows = rows.where(F.col("type") == options.role)
    return rows.where(F.col("text").rlike(regex))


def newest_first(rows: DataFrame, limit: int) -> DataFrame:
    """The newest rows; of one second, those of earlier files and messages first."""
    return rows.orderBy(F.desc("timestamp"), "file_path", "msg_index").limit(limit)


def search(messages: DataFrame, pattern: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    return newest_first(matching(messages, pattern, options), options.max_results)


def passes_prefilter(pattern: str, text: str = "value"):
    """Whether a file may match by its raw text, as a column. Unsound: regexes see decoded text,
    and the literals are read off the pattern without its grammar. Searches don't use it unless asked."""
    literals = prefilter_literals(pattern)
    if not literals:
        return F.lit(True)
    low, out = F.lower(F.col(text)), F.lit(False)
    for x in literals:
        out = out | F.contains(low, F.lit(x))
    return out


def search_stats(files: DataFrame, pattern: str, text: str = "value") -> DataFrame:
    """files_total, prefilter_skipped and regex_searched, in one row."""
    passes = passes_prefilter(pattern, text)
    return files.agg(
        F.count("*").alias("files_total"), F.count_if(~passes).alias("prefilter_skipped"), F.count_if(passes).alias("regex_searched")
    )


def near_miss(files: DataFrame, pattern: str, text: str = "value") -> tuple[str, int] | None:
    """The literal a failed pattern contains and how many files have it, counted to NEAR_MISS_FILES."""
    literal = near_miss_literal(pattern)
    if literal is None:
        return None
    n = files.where(F.contains(F.lower(F.col(text)), F.lit(literal.lower()))).limit(NEAR_MISS_FILES).count()
    return (literal, n) if n else None
