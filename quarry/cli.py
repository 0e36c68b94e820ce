"""Command line: python -m quarry.cli [flags] pattern. Flags may follow the pattern; -- ends them."""

from __future__ import annotations

import argparse
import os
import sys

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("quarry", description="Search chat sessions.")
    p.add_argument("pattern", nargs="*")
    for flag, name, text in (
        ("-p", "prompts", "only users' messages"), ("-r", "responses", "only assistants' messages"), ("-a", "all_projects", "all projects"), ("-l", "list_only", "sessions and times only"),
        ("-s", "semantic", "search by meaning"), ("--json", "as_json", "JSON output"), ("--index", "index", "update the index"), ("--status", "status", "with --index: show its state"),
        ("--all", "rebuild", "with --index: build it anew"), ("--usage", "usage", "report on the search log"), ("--version", "version", "show the version"), ("--raw", "raw", "leave escapes as they are"),
        ("--prefilter", "prefilter", "turn files down by literals first"),
    ):
        p.add_argument(flag, dest=name, action="store_true", help=text)
    for flag, name, default in (("-n", "max_results", 100), ("-d", "max_days", 7), ("-H", "max_hours", 0), ("-C", "context", 0), ("-B", "before", 0), ("-A", "after", 0)):
        p.add_argument(flag, dest=name, type=int, default=default)
    p.add_argument("--base", default=os.environ.get("QUARRY_BASE", os.path.expanduser("~/.quarry/sessions")))
    p.add_argument("--state", default=os.environ.get("QUARRY_STATE", os.path.expanduser("~/.quarry")))
    p.add_argument("--embed-url", default=os.environ.get("QUARRY_EMBED_URL"), help="embedding service; without one, words are hashed")
    p.add_argument("--embed-model", default=os.environ.get("QUARRY_EMBED_MODEL", "default"))
    p.add_argument("--embed-health", default=os.environ.get("QUARRY_EMBED_HEALTH"))
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """What follows -- is never a flag, wherever flags stand."""
    if "--" in argv:
        at = argv.index("--")
        args = parser().parse_intermixed_args(argv[:at])
        args.pattern += argv[at + 1 :]
        return args
    return parser().parse_intermixed_args(argv)


def main(argv: list[str] | None = None) -> int:
    from datetime import UTC, datetime

    args = parse(sys.argv[1:] if argv is None else argv)
    if args.version:
        print(f"quarry {VERSION}")
        return 0
    if not (args.usage or args.index or args.pattern):
        parser().print_usage(sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from quarry.operators.index import build_index, index_status
    from quarry.operators.search import SearchOptions
    from quarry.operators.semantic import HashedWords, HttpEmbedder
    from quarry.operators.usage import read_log, report
    from quarry.plans.policy import Request, Status, run
    from quarry.sources.folder import Folder

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()
    index_dir, log = f"{args.state}/index", f"{args.state}/log"
    embedder = HttpEmbedder(args.embed_url, args.embed_model, args.embed_health) if args.embed_url else HashedWords()
    if args.usage:
        now = datetime.now(UTC).replace(tzinfo=None)
        print("\n".join(report(read_log(spark, log), now)) if Folder(spark, log).exists() else "no searches logged")
        return 0
    if args.index:
        if args.status:
            print(index_status(spark, index_dir))
        else:
            done = build_index(spark, args.base, index_dir, embedder, rebuild=args.rebuild or args.all_projects)
            print(f"indexed {done['indexed']} files, skipped {done['skipped']}" + (f", {done['failed']} messages could not be embedded" if done["failed"] else ""))
        return 0
    role = "user" if args.prompts else "assistant" if args.responses else "both"
    try:
        options = SearchOptions(role, args.max_results, args.max_days, args.max_hours, args.before, args.after, args.context, args.list_only)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return int(Status.ERROR)
    request = Request(args.pattern[0], options, args.all_projects, args.semantic, args.as_json, args.raw, args.prefilter, tuple(args.pattern[1:]))
    done = run(spark, args.base, os.getcwd(), request, embedder, index_dir, log)
    for m in done.messages:
        print(m, file=sys.stderr)
    for x in done.lines:
        print(x)
    return int(done.status)


if __name__ == "__main__":
    sys.exit(main())
