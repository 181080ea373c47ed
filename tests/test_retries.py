"""Retries and quarantine as state of a stream, over restarts; snapshots of progress."""

import json
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from occulta.streaming import index, retries

T0 = pd.Timestamp("2024-01-01 00:00:00")


@pytest.fixture
def feed(spark, tmp_path):
    """``put(rows)`` adds attempts (path, seconds, kind); ``run()`` works off what is new and returns the standing."""
    source, n = tmp_path / "in", [0]

    def put(rows):
        n[0] += 1
        df = spark.createDataFrame([(p, None if s is None else (T0 + pd.Timedelta(seconds=s)).to_pydatetime(), k) for p, s, k in rows], retries.ATTEMPTS)
        df.coalesce(1).write.mode("append").parquet(str(source))

    def run(**options):
        stream = spark.readStream.schema(retries.ATTEMPTS).parquet(str(source))
        query = retries.start(stream, str(tmp_path / "out"), str(tmp_path / "check"), **options)
        query.awaitTermination(120)
        assert query.exception() is None
        return {r.src_path: (r.status, r.fail_count) for r in retries.standing(spark, str(tmp_path / "out")).collect()}

    return SimpleNamespace(put=put, run=run, out=str(tmp_path / "out"))


def test_quarantine_over_restarts(spark, feed):
    later = 10**8 * 5  # far ahead, so that no clock's retry comes in between
    feed.put([("a", later + 1, "failed"), ("b", later + 1, "failed"), ("c", later + 1, "marked"), ("d", None, "failed"), (None, later, "failed"), ("d", later, "odd")])
    assert feed.run() == {"a": ("waiting", 1), "b": ("waiting", 1), "c": ("queued", 0)}
    feed.put([(p, later + k, "failed") for k in (2, 3, 4) for p in "ab"])
    got = feed.run()
    assert got["a"] == ("waiting", 4) and got["c"] == ("queued", 0)
    feed.put([("a", later + 5, "failed"), ("b", later + 5, "indexed")])
    got = feed.run()
    assert got["a"] == ("quarantined", 5) and got["b"] == ("cleared", 0)
    feed.put([("a", later + 6, "failed"), ("b", later + 3, "failed"), ("b", later + 5, "failed")])
    got = feed.run()
    assert got["a"] == ("quarantined", 5) and got["b"] == ("cleared", 0)  # what failed before the success doesn't count
    feed.put([("a", later + 9, "indexed"), ("b", later + 9, "failed")])
    got = feed.run()
    assert got["a"] == ("cleared", 0) and got["b"] == ("waiting", 1)
    assert [r.src_path for r in retries.due(retries.standing(spark, feed.out)).collect()] == ["c"]


def test_order_and_batches_don_t_matter(spark, tmp_path, feed):
    rows = [("p", s, "failed") for s in range(40)] + [("p", 37, "indexed"), ("q", 3, "failed"), ("q", 3, "failed"), ("q", 1, "indexed")]
    for k in range(0, len(rows), 11):
        feed.put(rows[k : k + 11][::-1])
    got = feed.run()
    assert {k: v[1] for k, v in got.items()} == {"p": 2, "q": 2}


def test_retry_comes_when_due(spark, feed):
    feed.put([("a", 0, "failed"), ("a", 10, "failed"), ("z", 0, "marked")])
    feed.run(watermark="0 seconds", first_wait_s=30.0)
    rows = spark.read.schema(retries.DECISIONS + ", epoch bigint").parquet(feed.out)
    assert rows.filter("status = 'retry'").isEmpty()
    feed.put([("z", 80, "marked")])  # the watermark passes 10 s + 2 * 30 s
    feed.put([("z", 90, "marked")])
    feed.run(watermark="0 seconds", first_wait_s=30.0)
    due = rows.sparkSession.read.schema(retries.DECISIONS + ", epoch bigint").parquet(feed.out).filter("status = 'retry'").select("src_path", "fail_count", F.col("due_at").cast("long").alias("due")).collect()
    assert [(r.src_path, r.fail_count, r.due - int(T0.timestamp())) for r in due] == [("a", 2, 70)]


def test_a_hot_file_sends_few_rows(spark):
    rows = spark.range(20000).selectExpr("'hot' AS src_path", "timestamp_millis(id) AS at", "CASE WHEN id % 9 = 0 THEN 'marked' WHEN id = 7000 THEN 'indexed' ELSE 'failed' END AS kind").coalesce(2)
    got = retries.thinned(rows).groupBy("kind").agg(F.count("*").alias("n"), F.max("at").cast("double").alias("last")).collect()
    assert sum(r.n for r in got) <= 4 * 7 and {r.kind: r.last for r in got} == {"marked": 19998 / 1000, "failed": 19999 / 1000, "indexed": 7.0}


def test_as_the_batch_says(spark, feed):
    rows = [(f"p{k % 7}", k, "failed" if k % 3 else "marked") for k in range(60)]
    feed.put(rows)
    got = feed.run()
    marks = spark.createDataFrame([(p, T0.to_pydatetime(), k == "failed") for p, _, k in rows], "src_path string, marked_at timestamp, failed boolean")
    empty = spark.createDataFrame([], "src_path string, marked_at timestamp, fail_count int")
    want = {r.src_path: min(index.QUARANTINE, r.fail_count) for r in index.mark_pending(empty, marks).collect()}
    assert {k: v[1] for k, v in got.items()} == want


def test_snapshots_are_throttled(spark, tmp_path):
    at, now, written = tmp_path / "progress.json", [0.0], []
    snap = retries.Snapshots(spark, str(at), every=2.0, figures=lambda: {"covered": 7}, clock=lambda: now[0])
    inner = snap.write
    snap.write = lambda figures: (written.append(now[0]), inner(figures))
    progress = SimpleNamespace(id="i", runId="r", name="n", batchId=0, numInputRows=5, processedRowsPerSecond=1.0, stateOperators=[])
    snap.onQueryStarted(SimpleNamespace(id="i", runId="r", name="n"))
    for t in (0.0, 0.5, 1.9, 2.0, 3.0, 4.5):
        now[0] = t
        progress.batchId += 1
        snap.onQueryProgress(SimpleNamespace(progress=progress))
    assert written == [0.0, 2.0, 4.5]
    got = json.loads(at.read_text())
    assert got["rows"] == 30 and got["batch"] == 6 and got["state"] == "running" and got["covered"] == 7
    snap.onQueryTerminated(SimpleNamespace(id="i", runId="r", exception=None))
    assert json.loads(at.read_text())["state"] == "done" and not list(tmp_path.glob("*.part"))


def test_snapshots_of_a_stream(spark, tmp_path, feed):
    at = tmp_path / "progress.json"
    listener = retries.Snapshots(spark, str(at))
    spark.streams.addListener(listener)
    try:
        feed.put([("a", 0, "failed"), ("b", 0, "marked")])
        feed.run()
        for _ in range(100):
            if at.exists() and json.loads(at.read_text())["state"] == "done":
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = json.loads(at.read_text())
    assert got["state"] == "done" and got["rows"] == 2 and got["state_rows"] >= 2
