"""The index of masked documents by content: lookups, sweeps, retries, invalidation.

Tables: shadows (content_hash, src_path, clean_text, size, mtime, indexed_at,
stale), values (content_hash, value_hash), pending (src_path, marked_at,
fail_count). A sweep is a batch job, or each micro-batch of a stream.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lists import served
from ..operators.vault import tokens_in, value_hash
from ..sources.store import Store

#: Retries before a file is left alone; age limits in days; files that hold no client text.
QUARANTINE = 5
AGE_DAYS = (30, 365, 1095)
SCANS, SCAN_COST = ("pdf", "png", "jpg", "jpeg", "tiff", "heic"), 3.0
IGNORED_NAMES = (".DS_Store", ".localized", "Thumbs.db", "desktop.ini")
IGNORED_ENDS = ("ds_store", "log", "tmp", "lock", "part", "crdownload", "png", "jpg", "jpeg", "gif", "bmp", "tiff", "heic", "webp", "mp3", "mp4", "mov", "wav", "avi", "mkv", "zip", "gz", "tar", "7z", "rar", "dmg", "pkg", "app", "exe", "dll", "so", "dylib")


def content_hash(content: str = "content") -> str:
    return f"sha2({content}, 256)"


def base_name(path: str) -> str:
    return f"substring_index({path}, '/', -1)"


def extension(path: str) -> str:
    """SQL: the lower-case extension; a name that only begins with a dot has none."""
    return rf"lower(regexp_extract({base_name(path)}, r'[^.]\.([^.]+)$', 1))"


def ignorable(path: str) -> str:
    names, ends = ", ".join(map(repr, IGNORED_NAMES)), ", ".join(map(repr, IGNORED_ENDS))
    return f"({base_name(path)} IN ({names}) OR {extension(path)} IN ({ends}))"


def protected(path: str, marked: str, folders: str, exempt_paths: str = "cast(array() AS array<string>)", exempt_ends: str = "cast(array() AS array<string>)") -> str:
    """SQL: whether a path is under protection.

    ``marked``: array of (folder, enabled) with a marker file, of which the
    nearest folder above decides; without one, the global ``folders`` do.
    Exempt paths and extensions are free; the marker file itself always is.
    """
    nearest = f"array_sort(filter({marked}, m -> startswith({path}, concat(m.folder, '/'))), (l, r) -> length(r.folder) - length(l.folder))"
    glob = f"exists({folders}, f -> startswith({path}, concat(f, '/')))"
    free = f"({base_name(path)} = '.occulta.json' OR exists({exempt_paths}, p -> {path} = p OR startswith({path}, concat(p, '/'))) OR array_contains({exempt_ends}, {extension(path)}))"
    return f"(NOT {free} AND coalesce(get({nearest}, 0).enabled, {glob}))"


def order_columns(now: str, path: str = "path", size: str = "size", mtime: str = "mtime") -> list[Column]:
    """What a sweep is sorted by: age class, cost (scans cost three times their size), path; unreadable files last."""
    age = " + ".join(f"cast({now} - {mtime} >= {d * 86400} AS int)" for d in AGE_DAYS)
    cost = f"{size} * if({extension(path)} IN ({', '.join(map(repr, SCANS))}), {SCAN_COST}D, 1.0D)"
    return [F.expr(f"coalesce({age}, {len(AGE_DAYS)})").alias("bucket"), F.expr(f"coalesce({cost}, cast('Infinity' AS double))").alias("cost"), F.expr(path).alias("path")]


def upsert(shadows: DataFrame, new: DataFrame) -> DataFrame:
    """``shadows`` with ``new`` rows; of one content the latest stays, current again."""
    rows = shadows.unionByName(new.withColumn("stale", F.lit(0)))
    return rows.groupBy("content_hash").agg(F.max_by(F.struct(*[c for c in shadows.columns if c != "content_hash"]), "indexed_at").alias("x")).select("content_hash", "x.*")


def mark_stale(shadows: DataFrame, values: DataFrame, hashes: DataFrame) -> DataFrame:
    """``shadows`` with those that hold any of ``hashes(value_hash)`` stale; they are served on."""
    hit = values.join(hashes.distinct(), "value_hash", "left_semi").select("content_hash").distinct().withColumn("__hit", F.lit(True))
    return shadows.join(hit, "content_hash", "left").withColumn("stale", F.when(F.col("__hit"), 1).otherwise(F.col("stale"))).drop("__hit")


def current(shadows: DataFrame) -> DataFrame:
    return shadows.filter("stale = 0").select("content_hash")


def mark_pending(pending: DataFrame, marks: DataFrame) -> DataFrame:
    """``pending`` with ``marks(src_path, marked_at, failed)``: failures add up, plain misses don't."""
    new = marks.select("src_path", "marked_at", F.col("failed").cast("int").alias("fail_count"))
    return pending.unionByName(new).groupBy("src_path").agg(F.max("marked_at").alias("marked_at"), F.sum("fail_count").cast("int").alias("fail_count"))


def due(pending: DataFrame) -> DataFrame:
    return pending.filter(F.col("fail_count") < QUARANTINE)


def quarantined(pending: DataFrame) -> DataFrame:
    return pending.filter(F.col("fail_count") >= QUARANTINE)


def clear_pending(pending: DataFrame, paths: DataFrame) -> DataFrame:
    return pending.join(paths.select("src_path").distinct(), "src_path", "left_anti")


def work(files: DataFrame, shadows: DataFrame, pending: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """``files(path, content_hash, ...)`` with ``outcome``: ignored, quarantined, deferred (unreadable), indexed before (skipped), or todo."""
    done = current(shadows).distinct().withColumn("__done", F.lit(True))
    bad = quarantined(pending).select(F.col("src_path").alias("path")).distinct().withColumn("__bad", F.lit(True))
    wanted = "true" if extensions is None else f"{extension('path')} IN ({', '.join(map(repr, extensions))})"
    outcome = f"CASE WHEN {ignorable('path')} OR NOT {wanted} THEN 'ignored' WHEN __bad THEN 'quarantined' WHEN content_hash IS NULL THEN 'deferred' WHEN __done THEN 'skipped' ELSE 'todo' END"
    return files.join(done, "content_hash", "left").join(bad, "path", "left").withColumn("outcome", F.expr(outcome)).drop("__done", "__bad")


def has_work(files: DataFrame, shadows: DataFrame, pending: DataFrame) -> bool:
    """Whether any file is to be indexed, or can't be read yet; stops at the first."""
    return not work(files, shadows, pending).filter("outcome IN ('todo', 'deferred')").limit(1).isEmpty()


def sweep(files: DataFrame, shadows: DataFrame, values: DataFrame, pending: DataFrame, mask: Callable[[DataFrame], DataFrame], extensions: list[str] | None = None) -> dict[str, DataFrame]:
    """One run: the new tables, and ``counts`` (outcome, n).

    ``mask`` takes (path, content_hash, content, ...) and returns, for each
    content, (content_hash, clean_text, status, value_hashes); a status other
    than ``ok`` stores nothing and counts as a failure.
    """
    from ..sources.tables import materialise

    judged = materialise(work(files, shadows, pending, extensions), "work")
    todo = judged.filter("outcome = 'todo'")
    done = materialise(mask(todo.dropDuplicates(["content_hash"])), "swept")
    met = todo.join(done.select("content_hash", "status"), "content_hash", "left").withColumn("outcome", F.when(F.col("status") == "ok", "indexed").otherwise("failed"))
    now = F.current_timestamp()
    good = done.filter("status = 'ok'")
    paths = todo.groupBy("content_hash").agg(F.min_by(F.struct(F.col("path").alias("src_path"), "size", "mtime"), "path").alias("p"))
    new = good.join(paths, "content_hash").select("content_hash", "p.src_path", "clean_text", "p.size", "p.mtime", now.alias("indexed_at"))
    fresh = good.select("content_hash", F.explode("value_hashes").alias("value_hash"))
    failed = met.filter("outcome = 'failed'").select(F.col("path").alias("src_path"), now.alias("marked_at"), F.lit(True).alias("failed"))
    outcomes = judged.filter("outcome <> 'todo'").select("outcome").unionByName(met.select("outcome"))
    return {
        "shadows": upsert(shadows, new),
        "values": values.join(good.select("content_hash"), "content_hash", "left_anti").unionByName(fresh).distinct(),
        "pending": clear_pending(mark_pending(pending, failed), met.filter("outcome = 'indexed'").select(F.col("path").alias("src_path"))),
        "counts": outcomes.groupBy("outcome").agg(F.count("*").alias("n")),
    }


#: The index's tables in a store (see ``sources.store``).
SCHEMAS = {
    "shadows": "content_hash string, src_path string, clean_text string, size long, mtime double, indexed_at timestamp, stale int",
    "values": "content_hash string, value_hash string",
    "pending": "src_path string, marked_at timestamp, fail_count int",
}


def swept(store: Store, files: DataFrame, mask: Callable[[DataFrame], DataFrame], extensions: list[str] | None = None) -> dict[str, int]:
    """One run over a store: all its tables change together, or none does; returns the counts by outcome."""
    from ..sources.tables import materialise

    base = store.version()
    old = store.read(base)
    made = sweep(files, old["shadows"], old["values"], old["pending"], mask, extensions)
    counts = materialise(made["counts"], "counts")
    store.commit({k: made[k] for k in SCHEMAS}, base)
    return {r.outcome: r.n for r in counts.collect()}


def used_hashes(masked: DataFrame, vault: DataFrame) -> DataFrame:
    """(content_hash, value_hash): digests of the vault values that a masked text's tokens stand for."""
    tokens = masked.select("content_hash", "mission", F.explode(F.expr(tokens_in("clean_text"))).alias("token"))
    return tokens.join(vault.select("mission", "token", "value"), ["mission", "token"]).select("content_hash", F.expr(value_hash()).alias("value_hash")).distinct()


def read(files: DataFrame, shadows: DataFrame, known: DataFrame | list[str]) -> tuple[DataFrame, DataFrame]:
    """(answers, misses): a hit is the stored text once more cleared of ``known(value)``; a miss has no text and is queued."""
    if not isinstance(known, DataFrame):
        known = files.sparkSession.createDataFrame([(v,) for v in known], "value string")
    met = files.join(shadows.select("content_hash", "clean_text"), "content_hash", "left")
    answers = served(met, known, "clean_text", "served").withColumnRenamed("served", "text").withColumn("status", F.when(F.col("clean_text").isNull(), "miss").otherwise("hit")).drop("clean_text")
    misses = answers.filter("status = 'miss'").select(F.col("path").alias("src_path"), F.current_timestamp().alias("marked_at"), F.lit(False).alias("failed"))
    return answers, misses


def requestable(path: str = "path", digest: str = "content_hash") -> str:
    """SQL: whether a request to index names a file below the root, by a relative path, and its content by a digest."""
    return f"(NOT startswith({path}, '/') AND NOT contains({path}, ':') AND NOT exists(split({path}, r'[/\\\\]'), p -> p = '..') AND {digest} rlike '^[0-9a-f]{{64}}$')"


class Busy(RuntimeError):
    """Another sweep of the same store is running."""


@contextmanager
def single_run(spark: SparkSession, folder: str, stale_hours: float = 12.0) -> Iterator[None]:
    """One batch sweep at a time: a lock file in the store's folder, made in one step, gone at the end.

    A lock older than ``stale_hours`` belongs to a job that died, and is taken over.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(f"{folder.rstrip('/')}/.sweep.lock")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def old(file) -> bool:
        return time.time() - fs.getFileStatus(file).getModificationTime() / 1000 > stale_hours * 3600

    if fs.exists(at) and old(at):
        # moved away under a name of our own first: of several that see it stale one moves it, and what it moved is looked at again
        own = path(f"{folder.rstrip('/')}/.sweep.lock.{uuid.uuid4().hex}")
        if fs.rename(at, own):
            if not old(own):
                fs.rename(own, at)
                raise Busy(folder)
            fs.delete(own, False)
    if not fs.createNewFile(at):
        raise Busy(folder)
    try:
        yield
    finally:
        fs.delete(at, False)


def stream(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], available_now: bool = True):
    """A query over a folder's new files; ``each(files, epoch)`` gets (path, mtime, size, content, content_hash).

    One writer runs at a time, so that vault numbers stay unique; a file that
    was edited is new content, an unchanged one is skipped by ``work``.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    named = files.select("path", F.unix_timestamp("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content", F.expr(content_hash()).alias("content_hash"))
    writer = named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_counts(tokens: DataFrame) -> DataFrame:
    """Streaming counts by type of ``tokens(path, type, number, ts)``: a token counts once per file within a day."""
    return tokens.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["path", "type", "number"]).groupBy("type").count()
