"""What a search does beyond its plan: wider scope, semantic fallback, hints, status."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import PatternError, is_match_all, is_short, normalize_bre
from quarry.operators import index as indexing
from quarry.operators.bm25 import query_terms
from quarry.operators.search import DEFAULT_DAYS, DEFAULT_RESULTS, SearchOptions, near_miss, passes_prefilter, search, search_stats
from quarry.operators.semantic import Embedder, semantic_search
from quarry.operators.usage import append_event
from quarry.plans.display import json_text, terminal
from quarry.sources import sessions

#: A project with so few recent sessions is searched together with all others.
FEW_FILES = 5
COMMAND = "quarry"


class Status(IntEnum):
    MATCH, NONE, ERROR = 0, 1, 2


@dataclass
class Outcome:
    status: Status
    matches: DataFrame | None = None
    lines: list[str] = field(default_factory=list)
    messages: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Request:
    pattern: str
    options: SearchOptions = SearchOptions()
    all_projects: bool = False
    semantic: bool = False
    as_json: bool = False
    raw: bool = False  # escaped parentheses and the like stay as they are
    prefilter: bool = False  # "compat": turn files down by literals, although that can lose matches
    extra: tuple[str, ...] = ()


def flag_names(r: Request) -> str:
    o = r.options
    pairs = (
        ("-p", o.role == "user"), ("-r", o.role == "assistant"), ("-a", r.all_projects), ("-l", o.list_only), ("-s", r.semantic), ("--json", r.as_json),
        ("-H", o.max_hours > 0), ("-d", o.max_days != DEFAULT_DAYS), ("-n", o.max_results != DEFAULT_RESULTS), ("-C", o.before > 0 or o.after > 0 or o.context > 0),
    )
    return " ".join(name for name, on in pairs if on)


def no_match_hints(pattern: str, n_files: int, options: SearchOptions, all_projects: bool, semantic: bool, skipped_all: bool) -> list[str]:
    scope = "all projects" if all_projects else "current project"
    out = [f'nothing found for "{pattern}": {n_files} files of {options.max_days} days, {scope}']
    words = pattern.split()
    if not semantic and " " in pattern:
        if skipped_all:
            out.append(f'note: the words of "{pattern}" are searched side by side, as they stand')
        if len(words) >= 2:
            out.append(f'hint: any of the words is "({"|".join(words)})", all in this order "{".*".join(words)}"')
    if not all_projects or options.max_days <= 7:
        out.append(f'search more: {COMMAND} -a -d 30 "{pattern}"')
    if not semantic:
        out.append(f'search by meaning: {COMMAND} -s "{pattern}"')
    return out


def cap_hint(options: SearchOptions) -> str:
    more = ", -d 30" if options.max_days <= 7 else ""
    return f"only the newest {options.max_results} are shown; a longer pattern finds fewer, -n 100{more} shows more"


def run(
    spark: SparkSession, base: str, cwd: str, request: Request, embedder: Embedder | None = None, index_dir: str | None = None, log: str | None = None, now: datetime | None = None
) -> Outcome:
    """Searches session files below base for a request made in the folder cwd."""
    now = now or datetime.now(UTC).replace(tzinfo=None)
    r, o, began, notes = request, request.options, time.monotonic(), []
    if is_match_all(r.pattern):
        return Outcome(Status.ERROR, messages=[f'"{r.pattern}" would find everything; patterns that begin with - go after --'])
    if not r.semantic and is_short(r.pattern):
        notes.append(f'note: "{r.pattern}" is short and may be found in much else; {COMMAND} -s searches by meaning')
    if r.extra:
        notes.append(f"note: not used: {' '.join(r.extra)}")
    own = f"{base}/{sessions.encode_path(cwd)}"
    if not r.all_projects:
        n = _files(spark, own, now, o).limit(FEW_FILES + 1).count()
        if not n and not _exists(spark, own):
            return Outcome(Status.ERROR, messages=[*notes, f"{cwd} has no sessions; -a searches those of all projects"])
        if n <= FEW_FILES:
            notes.append(f"this project has {n} recent sessions; searching all projects")
            r = Request(r.pattern, o, True, r.semantic, r.as_json, r.raw, r.prefilter, r.extra)
    path, scope = (base, "all") if r.all_projects else (own, "project")

    def logged(mode: str, results: int, files: int, **more) -> None:
        if log:
            append_event(
                spark, log, now, pattern=request.pattern, mode=mode, flags=flag_names(r), results=results, files=files, days=o.max_days, scope=scope,
                ms=int((time.monotonic() - began) * 1000), bre=more.get("bre", False), extra_args=bool(r.extra), capped=more.get("capped", False), pf_skip=more.get("pf_skip", 0), pf_pass=more.get("pf_pass", 0),
            )

    def taken(matches: DataFrame) -> tuple[DataFrame, int]:
        """The matches, at most max_results rows, computed once, and their number."""
        rows = matches.collect()
        return spark.createDataFrame(rows, matches.schema), len(rows)

    def shown(matches: DataFrame) -> list[str]:
        if r.as_json:
            return json_text(matches).splitlines()
        return terminal(matches, query_terms(spark, request.pattern), o.list_only, bool(o.before or o.after))

    def by_meaning() -> DataFrame:
        entries, _ = indexing.load_index(spark, index_dir)
        vector = embedder.embed([request.pattern])[0]
        if vector is None:
            raise RuntimeError("the pattern could not be embedded")
        everything = sessions.session_files(spark, path, now)
        current = sessions.newest(everything, now) if o.exclude_self else None
        prefix = None if r.all_projects else sessions.encode_path(cwd)
        context = sessions.messages(sessions.session_files(spark, base)) if o.before or o.after else None
        return semantic_search(entries, context, vector, o, now, prefix, current)

    recent = _files(spark, path, now, o)
    files = sessions.session_files(spark, path, now, o.max_age)
    if r.semantic:
        if embedder is None or index_dir is None or not embedder.available():
            return Outcome(Status.ERROR, messages=[*notes, "the embedding service does not answer"])
        try:
            matches, n = taken(by_meaning())
        except RuntimeError as e:
            return Outcome(Status.ERROR, messages=[*notes, str(e)])
        n_files = recent.count()
        capped = n >= o.max_results
        logged("semantic", n, n_files, capped=capped)
        if not n:
            return Outcome(Status.NONE, messages=notes + no_match_hints(r.pattern, n_files, o, r.all_projects, True, False))
        return Outcome(Status.MATCH, matches, shown(matches), notes + [cap_hint(o)] * capped)

    pattern = r.pattern if r.raw else normalize_bre(r.pattern)
    searched = sessions.without_current(files, now) if o.exclude_self else files
    try:
        read = searched.where(passes_prefilter(pattern)) if r.prefilter else searched
        matches, n = taken(search(sessions.messages(read), pattern, o))
    except PatternError as e:
        return Outcome(Status.ERROR, messages=[*notes, str(e)])
    if r.prefilter:
        stats = search_stats(searched, pattern).first().asDict()
    else:  # no file was turned down, and none needs to be read to count them
        total = searched.count()
        stats = {"files_total": total, "prefilter_skipped": 0, "regex_searched": total}
    capped = n >= o.max_results
    logged("regex", n, stats["files_total"], bre=pattern != r.pattern, capped=capped, pf_skip=stats["prefilter_skipped"], pf_pass=stats["regex_searched"])
    if n:
        return Outcome(Status.MATCH, matches, shown(matches), notes + [cap_hint(o)] * capped)
    if embedder is not None and index_dir is not None and embedder.available():
        notes.append("no regex matches; trying semantic search")
        try:
            matches, n = taken(by_meaning())
        except RuntimeError:
            n = 0
        if n:
            logged("semantic-fallback", n, stats["files_total"])
            return Outcome(Status.MATCH, matches, shown(matches), notes)
        notes.append("semantic search found nothing either")
    total = stats["files_total"]
    notes += no_match_hints(pattern, total, o, r.all_projects, False, 0 < total == stats["prefilter_skipped"])
    near = near_miss(sessions.session_files(spark, path, now, SearchOptions(max_days=o.max_days).max_age), pattern)
    if near:
        notes.append(f'near: "{near[0]}" is in {near[1]} files: {COMMAND} "{near[0]}"')
    return Outcome(Status.NONE, messages=notes)


def _files(spark: SparkSession, path: str, now: datetime, options: SearchOptions) -> DataFrame:
    """Recent files by max_days alone."""
    return sessions.session_files(spark, path, now, SearchOptions(max_days=options.max_days).max_age).select("file_path", F.col("modified"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))
