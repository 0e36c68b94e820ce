import glob
import json
import os
import threading
import time
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from quarry.operators.index import LOCK_STALE_SECONDS, build_index, index_bytes, index_status, load_index, lock
from quarry.operators.search import SearchOptions, search, search_stats
from quarry.operators.semantic import HashedWords, HttpEmbedder, embed_column, semantic_search
from quarry.plans.display import json_text, terminal
from quarry.plans.policy import Request, Status, run
from quarry.sources import sessions as S
from quarry.sources.folder import Folder


def now():
    return datetime.now(UTC).replace(tzinfo=None)


def put(path, records, age=3600.0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)
    at = time.time() - age
    os.utime(path, (at, at))


def say(role, text, second=0):
    return {"type": role, "timestamp": f"2024-05-01T10:00:{second:02d}.123Z", "message": {"role": role, "content": text}}


EDGE = [
    (say("user", "plain"), "plain"),
    (say("user", "  \t padded  \n"), "padded"),
    (say("user", [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "no"}, {"type": "text", "text": ""}, {"type": "text", "text": "b"}]), "a b"),
    (say("user", [None, {"type": "text", "text": "x"}]), "x"),
    (say("user", ["str", {"type": "text", "text": "x"}]), None),
    (say("user", 5), None),
    (say("user", {"text": "x"}), None),
    (say("user", None), None),
    ({"type": "user", "message": "s", "data": {"message": {"content": "inner"}}}, "inner"),
    ({"type": "user", "message": None, "data": {"message": {"content": "inner"}}}, None),
    ({"type": "user", "data": {"message": {"content": "inner"}}}, None),
    ({"type": 7, "message": {"content": "x"}}, None),
    ({"type": "system", "message": {"content": "x"}}, None),
    ('{"type":"user","message":{"content":"first"},"message":{"content":"second"}}', "second"),
    ("not json", None),
    ("[1]", None),
    ("null", None),
]


@pytest.mark.parametrize("i", range(len(EDGE)))
def test_record_shapes(spark, tmp_path_factory, i):
    record, want = EDGE[i]
    base = tmp_path_factory.mktemp("edge")
    put(f"{base}/p/0123456789abcdef.jsonl", [record])
    got = S.messages(S.session_files(spark, str(base))).collect()
    assert [r["text"] for r in got] == ([] if want is None else [want])
    for r in got:
        assert (r["session_id"], r["project"], r["msg_index"]) == ("0123456789ab", "p", 0)


def test_runs_collapse_before_numbering(spark, tmp_path):
    put(f"{tmp_path}/p/s.jsonl", [say("user", "a", 1), say("user", "b", 1), say("assistant", "c", 1), say("user", "d", 1), say("user", "e", 2)])
    put(f"{tmp_path}/p/deep/t.jsonl", [{"type": "user", "message": {"content": x}} for x in "xyz"])
    put(f"{tmp_path}/p/other.txt", [say("user", "no")])
    got = S.messages(S.session_files(spark, str(tmp_path))).orderBy("file_path", "msg_index").collect()
    assert [(r["project"], r["msg_index"], r["text"]) for r in got] == [("deep", 0, "z"), ("p", 0, "b"), ("p", 1, "c"), ("p", 2, "d"), ("p", 3, "e")]


def test_ages_and_the_current_session(spark, tmp_path):
    for name, age in (("a", 600), ("b", 300), ("c", 1)):
        put(f"{tmp_path}/p/{name}.jsonl", [say("user", name)], age)
    files = S.session_files(spark, str(tmp_path), now(), timedelta(seconds=450))
    assert files.count() == 2
    names = lambda df: sorted(os.path.basename(r["file_path"]) for r in df.select("file_path").collect())
    everything = S.session_files(spark, str(tmp_path))
    assert names(S.without_current(everything, now())) == ["a.jsonl", "b.jsonl"]
    assert names(S.without_current(everything, now() + timedelta(hours=1))) == ["a.jsonl", "b.jsonl", "c.jsonl"]
    assert S.without_current(everything.where("file_path LIKE '%c.jsonl'"), now()).count() == 1
    assert S.newest(everything, now()).endswith("c.jsonl")
    assert S.newest(everything, now() + timedelta(hours=1)) is None
    assert S.session_files(spark, f"{tmp_path}/absent").count() == 0
    assert S.encode_path("/home/me/x") == "-home-me-x"


def test_search_context_and_sinks(spark, tmp_path):
    put(f"{tmp_path}/p/s1.jsonl", [say("user" if i % 2 == 0 else "assistant", f"line {i} <b> {'needle' if i in (2, 3) else ''}", i) for i in range(6)])
    m = S.messages(S.session_files(spark, str(tmp_path)))
    got = search(m, "needle", SearchOptions(context=1)).collect()
    assert [r["msg_index"] for r in got] == [3, 2]
    assert [x["msg_index"] for x in got[0]["context_before"]] == [2] and [x["msg_index"] for x in got[0]["context_after"]] == [4]
    assert [r["msg_index"] for r in search(m, "needle", SearchOptions(role="user")).collect()] == [2]
    assert search(m, "needle", SearchOptions(max_results=0)).count() == 0
    lines = terminal(search(m, "needle", SearchOptions(context=1)), {"needl": 1}, separators=True)
    assert lines[0] == "--- p/s1 ---"
    assert [x[2] for x in lines[1:] if x.startswith("  ") and x != "  --"] == [" ", ">", " ", " "]  # message 2 was printed as context first
    assert "\x1b" not in "".join(lines) and "[YOU]" in "".join(lines)
    assert terminal(search(m, "needle"), {}, list_only=True) == ["s1  2024-05-01T10:00:03", "s1  2024-05-01T10:00:02"]
    text = json_text(search(m, "needle", SearchOptions(context=1)))
    assert "\\u003cb\\u003e" in text and len(json.loads(text)) == 2 and "similarity" not in json.loads(text)[0]
    assert json_text(search(m, "absent")) == "null\n"
    stats = search_stats(S.session_files(spark, str(tmp_path)), "needle|zzz").first()
    assert (stats["files_total"], stats["prefilter_skipped"], stats["regex_searched"]) == (1, 0, 1)


def test_repeated_texts_are_shown_once(spark, tmp_path):
    put(f"{tmp_path}/p/s1.jsonl", [say("user", "same needle", 5)])
    put(f"{tmp_path}/p/s2.jsonl", [say("user", "same needle", 4)])
    lines = terminal(search(S.messages(S.session_files(spark, str(tmp_path))), "needle"), {})
    assert sum("needle" in x for x in lines) == 1


def test_index_touches_changed_files_only(spark, tmp_path):
    base, index = f"{tmp_path}/base", f"{tmp_path}/index"
    put(f"{base}/-p/a.jsonl", [say("user", "alpha beta", 1)])
    put(f"{base}/-p/b.jsonl", [say("user", "gamma delta", 1), say("assistant", "epsilon", 2)])
    assert build_index(spark, base, index, HashedWords()) == {"indexed": 2, "skipped": 0, "failed": 0}
    assert build_index(spark, base, index, HashedWords()) == {"indexed": 0, "skipped": 2, "failed": 0}
    put(f"{base}/-p/a.jsonl", [say("user", "alpha changed", 1)], age=10)
    put(f"{base}/-q/c.jsonl", ["nothing"], age=10)
    assert build_index(spark, base, index, HashedWords()) == {"indexed": 2, "skipped": 1, "failed": 0}
    entries, files = load_index(spark, index)
    assert sorted(r["preview"] for r in entries.collect()) == ["alpha changed", "epsilon", "gamma delta"]
    assert files.count() == 2
    os.unlink(f"{base}/-p/b.jsonl")
    build_index(spark, base, index, HashedWords())
    assert load_index(spark, index)[0].count() == 3  # what is gone stays
    assert build_index(spark, base, index, HashedWords(), rebuild=True)["indexed"] == 2
    assert "2 files" not in index_status(spark, index) and index_status(spark, index).startswith("idle: 1 projects, 1 files, 1 vectors")
    q = HashedWords().embed(["alpha changed"])[0]
    found = semantic_search(load_index(spark, index)[0], S.messages(S.session_files(spark, base)), q, SearchOptions(context=1, max_days=0), now())
    assert [(r["text"], round(r["similarity"], 4)) for r in found.collect()] == [("alpha changed", 1.0)]
    assert semantic_search(load_index(spark, index)[0], None, q, SearchOptions(max_days=1), now()).count() == 0  # by the message's time
    assert semantic_search(load_index(spark, index)[0], None, q, SearchOptions(max_days=0), now(), project_prefix="-x").count() == 0


def test_lock(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}")
    with lock(folder), pytest.raises(RuntimeError), lock(folder):
        pass
    assert not folder.exists("lock")
    folder.create("lock")
    with lock(folder, now=time.time() + LOCK_STALE_SECONDS + 5):
        pass
    assert folder.names() == []


class Meanwhile(HashedWords):
    """Writes a file anew while the index is built; fails on some texts."""

    def __init__(self, path):
        super().__init__()
        self.path = path

    def embed(self, texts):
        put(self.path, [say("user", "written meanwhile", 1)], age=-30)
        return [None if "unlucky" in t else v for t, v in zip(texts, super().embed(texts), strict=True)]


def test_index_misses_nothing_written_meanwhile(spark, tmp_path):
    base, index = f"{tmp_path}/base", f"file://{tmp_path}/index"
    for p in ("p", "q"):
        put(f"{base}/-{p}/a.jsonl", [say("user", f"first {p}", 1), say("user", "unlucky", 2)], age=100)
    assert build_index(spark, base, index, Meanwhile(f"{base}/-p/a.jsonl")) == {"indexed": 2, "skipped": 0, "failed": 2}
    assert build_index(spark, base, index, HashedWords()) == {"indexed": 1, "skipped": 1, "failed": 0}
    assert sorted(r["preview"] for r in load_index(spark, index)[0].collect()) == ["first q", "written meanwhile"]
    folder = Folder(spark, index)
    versions = [n for n in folder.names() if n.startswith("v")]
    assert len(versions) == 2  # -q is still in the first one
    assert [os.path.basename(x) for x in sorted(glob.glob(f"{tmp_path}/index/{versions[1]}/entries/project=*"))] == ["project=-p"]
    assert index_bytes(spark, index) > 0 and ", 0 B" not in index_status(spark, index)
    build_index(spark, base, index, HashedWords(), rebuild=True)
    build_index(spark, base, index, HashedWords(), rebuild=True)
    assert len([n for n in folder.names() if n.startswith("v")]) == 2  # the newest, and the one that readers may still have


def test_embedding_service(spark):
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            given = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            given = [given] if isinstance(given, str) else given
            seen.append(len(given))
            self.send_response(500 if "bad" in given else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"embeddings": [[float(len(t)), 1.0] for t in given]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    try:
        e = HttpEmbedder(url, "m")
        assert e.available() and e.embed(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]] and seen == [2]
        assert e.embed(["a", "bad", "ccc"]) == [[1.0, 1.0], None, [3.0, 1.0]]
        assert [len(x or []) for x in e.embed(["x"] * 70)] == [2] * 70 and seen[-3:] == [32, 32, 6]
        rows = embed_column(spark.createDataFrame([("abc",)], "t string"), "t", e).collect()
        assert rows[0]["vector"] == [3.0, 1.0]
    finally:
        server.shutdown()
        server.server_close()
    assert not HttpEmbedder(url, "m", health_timeout=0.5).available()


def test_policy(spark, tmp_path):
    base, index, log = f"{tmp_path}/base", f"{tmp_path}/index", f"{tmp_path}/log"
    for i in range(3):
        put(f"{base}/-w-p/s{i}.jsonl", [say("user", f"needle {i} in hay", i)], 4000 + i)
    go = lambda p, **k: run(spark, base, "/w/p", Request(p, **k), None, None, log)
    done = go("needle")
    assert done.status == Status.MATCH and len(done.lines) == 8
    assert any("searching all projects" in m for m in done.messages)
    assert go(".*").status == Status.ERROR and go("c++").status == Status.ERROR
    none = go("needle zzz")
    assert none.status == Status.NONE and any("is in 3 files" in m or "hint" in m for m in none.messages)
    assert run(spark, base, "/elsewhere", Request("x")).status == Status.ERROR
    assert go(r"\(needle\|x\)").status == Status.MATCH
    capped = go("needle", options=SearchOptions(max_results=2))
    assert any("newest 2 are shown" in m for m in capped.messages)
    build_index(spark, base, index, HashedWords())
    meant = run(spark, base, "/w/p", Request("hay in needle 2", options=SearchOptions(max_days=100000)), HashedWords(), index, log)
    assert meant.status == Status.MATCH and any("[1.00]" in x for x in meant.lines)
    from quarry.operators.usage import read_log

    modes = sorted(r["mode"] for r in read_log(spark, log).collect())
    assert modes.count("semantic-fallback") == 1 and modes.count("regex") >= 4


def test_cli_arguments():
    from quarry.cli import parse

    a = parse(["needle", "-n", "5", "-a"])
    assert (a.pattern, a.max_results, a.all_projects) == (["needle"], 5, True)
    assert parse(["-a", "--", "-x", "-n"]).pattern == ["-x", "-n"]
