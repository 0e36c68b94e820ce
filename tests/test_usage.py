import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.operators import usage
from quarry.streaming.chains import streaming_chains


def events(spark, seconds, **more):
    at = [None if s is None else datetime(2024, 5, 1) + timedelta(seconds=s) for s in seconds]
    rows = [(i, t, more.get("pattern", "p"), "project" if i % 2 == 0 else "all", 0, 10) for i, t in enumerate(at)]
    return spark.createDataFrame(rows, "seq long, at timestamp, pattern string, scope string, results int, ms long")


def lengths(spark, seconds):
    return [r["n"] for r in usage.retry_chains(events(spark, seconds)).orderBy("chain").collect()]


def test_chains(spark):
    assert lengths(spark, [0, 10, 20, 200, 210]) == [3, 2]
    assert lengths(spark, []) == [] and lengths(spark, [0]) == []
    assert lengths(spark, [0, 89]) == [2] and lengths(spark, [0, 90]) == [] and lengths(spark, [0, 91]) == []
    assert lengths(spark, [100, 5]) == [2]  # a step back goes on
    assert lengths(spark, [0, None, 5, 6]) == [2]


def test_chains_run_on_over_buckets(spark, monkeypatch):
    seconds = [0, 10, 20, 30, 200, 210, 220, 500, 600, 601, 602, 603, 604]
    whole = [tuple(r) for r in usage.retry_chains(events(spark, seconds)).orderBy("chain").collect()]
    monkeypatch.setattr(usage, "BUCKET", 2)
    assert [tuple(r) for r in usage.retry_chains(events(spark, seconds)).orderBy("chain").collect()] == whole
    assert [r[1] for r in whole] == [4, 3, 5]


def test_duplicates(spark):
    rows = [("foo", "all"), ("foo", "all"), ("foo", "project"), ("bar", "all")]
    assert [tuple(r) for r in usage.duplicates(spark.createDataFrame(rows, "pattern string, scope string")).collect()] == [("foo", "all", 2)]


def test_log_and_report(spark, tmp_path):
    path, now = f"{tmp_path}/log", datetime(2024, 5, 20)
    for i in range(3):
        usage.append_event(spark, path, now - timedelta(seconds=100 - i), pattern="x", mode="regex", flags="-a", results=0, files=2, scope="all", ms=5, pf_skip=2)
    with open(f"{path}/more.json", "w") as f:
        f.write("broken\n" + json.dumps({"ts": "2024-05-19T00:00:00Z", "pattern": "y", "mode": "regex", "results": 3, "ms": 7}) + "\n")
        f.write(json.dumps({"ts": "2020-01-01T00:00:00Z", "pattern": "old", "mode": "regex", "results": 3, "ms": 7}) + "\n")
    log = usage.read_log(spark, path)
    assert log.count() == 5 and log.where("flags IS NULL OR capped IS NULL").count() == 0
    lines = usage.report(log, now)
    assert lines[0] == "searches: 4 (found 1, empty 3, hit rate 25%)"
    assert "empty: x (3x)" in lines and "repeated: x (all, 3x)" in lines and "flag -a: 3 (75%)" in lines
    assert any(x.startswith("retry chains: 1") for x in lines)
    assert usage.report(log.limit(0), now) == ["no searches in the last 30 days"]


def test_the_log_is_read_in_the_order_it_was_written(spark, tmp_path):
    path, start = f"{tmp_path}/log", datetime(2024, 5, 1)
    for i in range(8):  # a file each, 600 s apart
        usage.append_event(spark, path, start + timedelta(seconds=600 * i), pattern=f"p{i}", results=0, scope="all")
    log = usage.read_log(spark, path)
    assert [(r["seq"], r["pattern"]) for r in log.orderBy("seq").collect()] == [(i, f"p{i}") for i in range(8)]
    assert usage.retry_chains(log.withColumn("at", F.try_to_timestamp("ts"))).count() == 0
    # a plain log: one file, no order in the lines themselves
    with open(f"{tmp_path}/plain.jsonl", "w") as f:
        f.write("".join(json.dumps({"ts": f"2024-05-01T00:{m:02}:00Z", "pattern": str(m)}) + "\n" for m in (5, 1, 9, 2)))
    assert [r["pattern"] for r in usage.read_log(spark, f"{tmp_path}/plain.jsonl").orderBy("seq").collect()] == ["5", "1", "9", "2"]


def test_streaming_chains_equal_the_batch(spark, tmp_path):
    rows = events(spark, [0, 10, 20, 110, 300, 389, 500]).withColumn("log_id", F.lit(1) + F.col("seq") * 0)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = streaming_chains(stream).writeStream.format("memory").queryName("chains").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = [r["n"] for r in spark.sql("SELECT n FROM chains ORDER BY start").collect()]
    assert got == [r["n"] for r in usage.retry_chains(rows).orderBy("chain").collect()] == [3, 2]
