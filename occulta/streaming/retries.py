"""Retries and quarantine as keyed state of a stream, and snapshots of its progress.

``decisions`` is what ``index.mark_pending`` and ``index.quarantined`` are to a
batch: attempts at files come in, and for each file its standing comes out. The
state is of one size a file, whatever number of attempts it has had: the last
success, the last ``QUARANTINE`` failures and the last mark. What it says depends
on the attempts alone, not on their order or on how they fall into batches.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.listener import StreamingQueryListener

from .index import QUARANTINE

#: The state store that timers and typed state need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds until a file is tried again; doubled with each failure.
FIRST_WAIT_S = 60.0
ATTEMPTS = "src_path string, at timestamp, kind string"
DECISIONS = "src_path string, status string, fail_count int, marked_at timestamp, due_at timestamp"


def processor(most: int = QUARANTINE, first_wait_s: float = FIRST_WAIT_S) -> StatefulProcessor:
    """The stateful processor of ``decisions``; made in a function so that it travels to the workers by value."""
    import heapq

    import pandas as pd

    class Retries(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("pending", "marked bigint, cleared bigint, timer bigint, failures array<bigint>")

        def handleInputRows(self, key, rows, timerValues):
            marked, cleared, timer, kept = self.state.get() if self.state.exists() else (None, None, None, [])
            failures = [int(t) for t in kept]
            heapq.heapify(failures)
            for batch in rows:
                ms = batch["at"].astype("datetime64[ns]").astype("int64") // 1_000_000
                for kind, at in zip(batch["kind"], ms, strict=True):
                    at = int(at)
                    if kind == "indexed":
                        cleared = at if cleared is None else max(cleared, at)
                    else:
                        marked = at if marked is None else max(marked, at)
                        if kind == "failed":
                            heapq.heappush(failures, at)
                            if len(failures) > most:
                                heapq.heappop(failures)
            failures = sorted(t for t in failures if cleared is None or t > cleared)
            if timer is not None:
                self.handle.deleteTimer(timer)
            n = len(failures)
            due = failures[-1] + int(first_wait_s * 1000 * 2 ** (n - 1)) if 0 < n < most else None
            self.state.update((marked, cleared, due, failures))
            if due is not None:
                self.handle.registerTimer(due)
            open_ = marked is not None and (cleared is None or marked > cleared)
            status = "quarantined" if n >= most else "waiting" if n else "queued" if open_ else "cleared"
            yield self.row(key, status, n, marked, due)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            marked, cleared, timer, failures = self.state.get()
            self.state.update((marked, cleared, None, list(failures)))
            yield self.row(key, "retry", len(failures), marked, timer)

        def row(self, key, status, n, marked, due):
            return pd.DataFrame({"src_path": [key[0]], "status": [status], "fail_count": pd.Series([n], dtype="int32"), "marked_at": pd.to_datetime(pd.Series([marked], dtype="Int64"), unit="ms"), "due_at": pd.to_datetime(pd.Series([due], dtype="Int64"), unit="ms")})

        def close(self) -> None:
            pass

    return Retries()


def thinned(attempts: DataFrame, most: int = QUARANTINE) -> DataFrame:
    """``attempts`` without those that can't count: of each Arrow batch and file the last ``most`` failures, mark and success stay.

    So a file that is tried over and over sends a few rows a batch to its state,
    and says the same.
    """

    def run(batches):
        for b in batches:
            b = b.sort_values("at", ascending=False, kind="stable")
            place = b.groupby(["src_path", "kind"]).cumcount()
            yield b[(place < 1) | ((b["kind"] == "failed") & (place < most))]

    rows = attempts.filter("src_path IS NOT NULL AND at IS NOT NULL AND kind IN ('marked', 'failed', 'indexed')").select("src_path", "at", "kind")
    return rows.mapInPandas(run, ATTEMPTS)


def decisions(attempts: DataFrame, most: int = QUARANTINE, first_wait_s: float = FIRST_WAIT_S, watermark: str | None = None) -> DataFrame:
    """Streaming (src_path, status, fail_count, marked_at, due_at) of streaming ``attempts(src_path, at, kind)``.

    ``kind`` is ``marked`` (wanted, not tried), ``failed`` or ``indexed``; other
    kinds, and rows without a path or time, count for nothing; times count in
    whole milliseconds, the rest cut off. Failures up to the last success are
    forgotten, one at the same moment too. A file has a row in each micro-batch
    that has attempts at it: ``queued``, ``waiting`` until ``due_at``,
    ``quarantined`` once it has failed ``most`` times (more aren't counted) or
    ``cleared``; and a row ``retry`` when its time comes. Timers run by the
    clock, or by the attempts' own times, ``watermark`` behind the latest one.
    Needs the ``PROVIDER`` state store.
    """
    rows = thinned(attempts, most)
    if watermark is not None:
        rows = rows.withWatermark("at", watermark)
    mode = "ProcessingTime" if watermark is None else "EventTime"
    return rows.groupBy("src_path").transformWithStateInPandas(processor(most, first_wait_s), DECISIONS, "Append", mode)


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """A query keeps the session's settings of its start; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(attempts: DataFrame, path: str, checkpoint: str, available_now: bool = True, watermark: str | None = None, **options):
    """A query that appends ``decisions`` to a Parquet table, each row with its ``epoch``; a batch done twice replaces itself.

    With ``available_now`` it ends once all attempts are worked off. Timers by
    the clock then come with the next run that has new attempts; until then
    ``due`` tells what is to be tried, and a query that goes on needs none.
    """
    # batches without data would follow each other for ever while timers run by the clock
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER} | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if available_now and watermark is None else {})

    def each(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = decisions(attempts, watermark=watermark, **options).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    with _settings(attempts.sparkSession, settings):
        return (writer.trigger(availableNow=True) if available_now else writer).start()


def standing(spark: SparkSession, path: str) -> DataFrame:
    """The last decision for each file of a table that ``start`` writes; of one epoch's rows the retry counts less."""
    rows = spark.read.schema(DECISIONS + ", epoch bigint").parquet(path)
    last = F.max_by(F.struct("status", "fail_count", "marked_at", "due_at"), F.struct("epoch", F.expr("status <> 'retry'")))
    return rows.groupBy("src_path").agg(last.alias("x")).select("src_path", "x.*")


def due(standing: DataFrame) -> DataFrame:
    """What is to be tried now: what is wanted, and what failed and whose time has come."""
    return standing.filter("status IN ('queued', 'retry') OR status = 'waiting' AND due_at <= current_timestamp()")


class Snapshots(StreamingQueryListener):
    """Writes a stream's progress to one JSON file: at most every ``every`` seconds, and at its end.

    A snapshot has the query's name, its state (``running``, ``done`` or
    ``failed``), batch number, rows read so far, rows a second, rows in state and
    time; ``figures`` may add more, such as ``index.live_counts``'s. A new file
    takes the old one's place in one step, so readers see a whole one. Register it with
    ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, path: str, every: float = 2.0, figures: Callable[[], dict] | None = None, clock: Callable[[], float] = time.monotonic):
        self.spark, self.path, self.every, self.figures, self.clock = spark, path, every, figures, clock
        self.last: dict[str, float] = {}
        self.seen: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.seen[str(event.runId)] = {"id": str(event.id), "name": event.name, "batch": None, "rows": 0, "rows_per_second": 0.0, "state_rows": 0}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = self.seen.setdefault(str(p.runId), {"id": str(p.id), "name": p.name, "rows": 0})
        at |= {"batch": p.batchId, "rows": at["rows"] + max(0, p.numInputRows), "rows_per_second": p.processedRowsPerSecond, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        now = self.clock()
        if now - self.last.get(str(p.runId), float("-inf")) >= self.every:
            self.last[str(p.runId)] = now
            self.write(at | {"state": "running"})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        at = self.seen.pop(str(event.runId), {"id": str(event.id)})
        self.last.pop(str(event.runId), None)
        self.write(at | {"state": "failed" if event.exception else "done"})

    def write(self, figures: dict) -> None:
        """One snapshot; a folder that can't be written to is no reason to end the stream."""
        figures = figures | (self.figures() if self.figures else {}) | {"written_at": time.time()}
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        at, part = jvm.org.apache.hadoop.fs.Path(self.path), jvm.org.apache.hadoop.fs.Path(self.path + ".part")
        fs = at.getFileSystem(conf)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        try:
            out = fs.create(part, True)
            out.write(bytearray(json.dumps(figures, default=str).encode()))
            out.close()
            overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
            files.rename(part, at, overwrite)
        except Exception:  # noqa: BLE001 - progress is advice
            return
