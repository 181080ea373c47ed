"""Candidates under review, and taking ordinary words off the list of known values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EXPIRY_DAYS = 30
#: Types that may be taken off the list; identifiers and company names never are.
JUDGED_TYPES = ("NOM", "POSTE", "ADRESSE")
BATCH = 8
#: Files listed with an item where it is shown.
SHOWN_REFS = 20


def candidates(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Rows for review of ``docs(doc_id, mission, entities, residual)``.

    Entities under the threshold; all of them if the document has a residual;
    nothing of a clean document.
    """
    which = f"CASE WHEN size(residual) > 0 THEN entities ELSE filter(entities, m -> m.score < {threshold}) END"
    flat = docs.select("doc_id", "mission", F.explode(F.expr(which)).alias("m"), (F.size("residual") > 0).alias("is_residual"))
    return flat.select(F.col("m.value").alias("value"), F.upper(F.trim("m.value")).alias("normalized"), F.col("m.type").alias("entity_type"), F.col("doc_id").cast("string").alias("source_doc"), F.col("m.score").alias("score"), F.lit(threshold).alias("threshold"), F.col("m.s").alias("char_start"), F.col("m.e").alias("char_end"), "mission", "is_residual")


def queue(found: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The queue of ``found(normalized, value, entity_type, doc_ref, first_seen)``: one row a value.

    Known values aren't queued. Files are counted; which they are stays in a
    table of its own (:func:`references`), as a value may be in very many.
    ``from_depollute`` says whether taking words off the list named it.
    """
    known = gazetteer.select(F.upper(F.trim("value")).alias("normalized")).distinct()
    new = found.join(known, "normalized", "left_anti")
    first = new.groupBy("normalized").agg(F.min("value").alias("value"), F.min("entity_type").alias("entity_type"), F.count("*").alias("occurrence_count"), F.min("first_seen").alias("first_seen"), F.coalesce(F.bool_or(F.col("doc_ref") == "depollute"), F.lit(False)).alias("from_depollute"))
    counted = references(new).groupBy("normalized").agg(F.count("*").alias("n_docs"))
    return first.join(counted, "normalized", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0))).withColumn("status", F.lit("pending"))


def references(found: DataFrame) -> DataFrame:
    """(normalized, doc_ref): the files of each value, each once."""
    return found.filter("doc_ref IS NOT NULL").select("normalized", "doc_ref").distinct()


def shown(items: DataFrame, refs: DataFrame, most: int = SHOWN_REFS) -> DataFrame:
    """``items`` with ``doc_refs``, the first ``most`` of their files, for display."""
    first = F.row_number().over(Window.partitionBy("normalized").orderBy("doc_ref"))
    few = refs.join(items.select("normalized"), "normalized", "left_semi").withColumn("__k", first).filter(F.col("__k") <= most)
    listed = few.groupBy("normalized").agg(F.array_sort(F.collect_list("doc_ref")).alias("doc_refs"))
    return items.join(listed, "normalized", "left").withColumn("doc_refs", F.coalesce("doc_refs", F.array().cast("array<string>")))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Candidate rows of sidecar files (JSON lines), ready for :func:`queue`; none if there is no file."""
    schema = "value string, normalized string, entity_type string, source_doc string, score double, threshold double, char_start int, char_end int, mission string, is_residual boolean, ts string"
    try:
        rows = spark.read.schema(schema).json(path)
        rows.limit(1).collect()
    except Exception:  # noqa: BLE001 - no sidecar yet
        rows = spark.createDataFrame([], schema)
    return rows.filter(F.trim("value") != "").select(F.coalesce("normalized", F.upper(F.trim("value"))).alias("normalized"), "value", "entity_type", F.col("source_doc").alias("doc_ref"), F.to_timestamp("ts").alias("first_seen")).dropDuplicates()


def pending(items: DataFrame) -> DataFrame:
    return items.filter("status = 'pending'").orderBy(F.desc("occurrence_count"), "normalized")


def expire(items: DataFrame, now: Column, days: int = EXPIRY_DAYS) -> DataFrame:
    """Pending items first seen more than ``days`` ago are dismissed."""
    old = (F.col("status") == "pending") & (F.col("first_seen") < now - F.expr(f"INTERVAL {days} DAYS"))
    return items.withColumn("dismiss_reason", F.when(old, "auto-expired").otherwise(F.col("dismiss_reason"))).withColumn("resolved_at", F.when(old, now).otherwise(F.col("resolved_at"))).withColumn("status", F.when(old, "dismissed").otherwise(F.col("status")))


def resolve(items: DataFrame, decisions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, values to know, words that are safe) after ``decisions(normalized, decision, reason)``.

    ``confirm`` makes a value known, ``dismiss`` makes it a safe word and keeps
    the reason; decided items stay, as a log.
    """
    met = items.join(decisions, "normalized", "left")
    decided = (F.col("status") == "pending") & F.col("decision").isin("confirm", "dismiss")
    state = F.when(decided & (F.col("decision") == "confirm"), "confirmed").when(decided, "dismissed").otherwise(F.col("status"))
    out = met.withColumn("dismiss_reason", F.when(decided & (F.col("decision") == "dismiss"), F.col("reason")).otherwise(F.col("dismiss_reason"))).withColumn("resolved_at", F.when(decided, now).otherwise(F.col("resolved_at")))
    known = met.filter(decided & (F.col("decision") == "confirm")).select("value", "entity_type", now.alias("added_at"))
    safe = met.filter(decided & (F.col("decision") == "dismiss")).select(F.lower(F.trim("value")).alias("word"))
    return out.withColumn("status", state).drop("decision", "reason"), known, safe


def triage(values: DataFrame, common: DataFrame) -> DataFrame:
    """``values(value, ...)`` with ``verdict``: junk if in lower case and a common word, else uncertain."""
    words = common.select(F.lower(F.trim("word")).alias("__w")).distinct().withColumn("__common", F.lit(True))
    met = values.withColumn("__w", F.lower(F.trim("value"))).join(words, "__w", "left")
    junk = F.col("__common").isNotNull() & (F.trim("value") == F.col("__w")) & F.col("__w").rlike(r"\p{L}")
    return met.withColumn("verdict", F.when(junk, "junk").otherwise("uncertain")).drop("__w", "__common")


def depollute(gazetteer: DataFrame, judged: DataFrame, common: DataFrame, classify: Callable[[Column], Column]) -> dict[str, DataFrame]:
    """One pass over ``gazetteer(value, entity_type, ...)``: four tables of changes.

    Only types that may be judged, and values not judged before, are looked
    at. Common words in lower case, and what ``classify`` (a column function,
    as a pandas UDF; null if it fails) calls MOT, are taken off: ``removed``,
    ``safe`` (words), ``log``. ``judged``: values that are done; those without
    an answer stay masked and come again.
    """
    from ..sources.tables import materialise

    seen = judged.select(F.lower(F.trim("value")).alias("__v")).distinct()
    due = gazetteer.filter(F.col("entity_type").isin(*JUDGED_TYPES)).withColumn("__v", F.lower(F.trim("value"))).join(seen, "__v", "left_anti").drop("__v")
    sorted_ = triage(due, common).withColumn("answer", F.when(F.col("verdict") == "uncertain", classify(F.col("value"))))
    done = materialise(sorted_, "judged")
    off = done.filter("verdict = 'junk' OR answer = 'MOT'")
    return {
        "removed": off.select("value", "entity_type"),
        "safe": off.select(F.lower(F.trim("value")).alias("word")).distinct(),
        "log": off.select("value", "entity_type", F.when(F.col("verdict") == "junk", "common word").otherwise("judged").alias("reason"), F.current_timestamp().alias("unmasked_at")),
        "judged": done.filter("verdict = 'junk' OR answer IS NOT NULL").select("value"),
    }


def batches(values: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, values): groups of ``size`` for one call of a model each; rows stay in their partitions."""
    number = F.monotonically_increasing_id()
    return values.withColumn("batch", F.floor(number / size)).groupBy("batch").agg(F.collect_list("value").alias("values"))


def safe_added(safe: DataFrame, word: str, typed: str) -> DataFrame:
    """The list of safe words with ``word``, in lower case, if it was typed again as confirmation; else a ``ValueError``."""
    if not word.strip() or word.strip().lower() != typed.strip().lower():
        raise ValueError("the confirmation must repeat the word")
    new = safe.sparkSession.createDataFrame([(word.strip().lower(),)], "word string")
    return safe.select("word").unionByName(new).distinct()


def safe_removed(safe: DataFrame, word: str) -> DataFrame:
    """The list of safe words without ``word``, in any case."""
    return safe.filter(F.lower(F.trim("word")) != word.strip().lower())
