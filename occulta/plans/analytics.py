"""Statistics over masked documents, the audit log and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import TOKEN

RUNS = ("anonymize", "sweep_index")


def token_keys(docs: DataFrame, text: str = "masked", key: str = "doc_id") -> DataFrame:
    """(doc_id, type, number): the distinct tokens of each document."""
    tokens = docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)))).alias("t"))
    return tokens.select(key, F.regexp_extract("t", TOKEN, 1).alias("type"), F.regexp_extract("t", TOKEN, 2).alias("number")).distinct()


def token_stats(docs: DataFrame, text: str = "masked", key: str = "doc_id") -> DataFrame:
    """(type, n_tokens, n_files): distinct tokens per document, summed by type, most first."""
    keys = token_keys(docs, text, key)
    return keys.groupBy("type").agg(F.count("*").alias("n_tokens"), F.count_distinct(key).alias("n_files")).orderBy(F.desc("n_tokens"), "type")


def token_counts(text: str) -> str:
    """SQL: a map from type to number of distinct tokens of one text."""
    types = f"transform(array_distinct(regexp_extract_all({text}, r'{TOKEN}', 0)), t -> regexp_extract(t, r'{TOKEN}', 1))"
    return f"map_from_entries(transform(array_distinct({types}), k -> named_struct('key', k, 'value', size(filter({types}, t -> t = k)))))"


def summary(audit: DataFrame) -> DataFrame:
    """One row of risk figures of ``audit(event, safe_to_send, counts)``.

    Runs are maskings; one without a verdict counts as unsafe. Counts that are
    no numbers are left out.
    """
    run = F.col("event").isin(*RUNS)
    ok = run & F.coalesce(F.col("safe_to_send"), F.lit(False))
    entities = F.when(run, F.aggregate(F.transform(F.map_values("counts"), lambda v: F.coalesce(v.try_cast("long"), F.lit(0))), F.lit(0).cast("long"), lambda a, v: a + v)).otherwise(0)
    figures = audit.agg(
        F.count_if(run).alias("total_runs"), F.count_if(ok).alias("safe_runs"), F.count_if(F.col("event") == "error").alias("error_runs"),
        F.count_if(F.col("event") == "vault_reveal").alias("reveal_runs"), F.coalesce(F.sum(F.coalesce(entities, F.lit(0))), F.lit(0)).alias("total_entities"), (F.count("*") > 0).alias("has_data"),
    )
    rate = F.when(F.col("total_runs") > 0, F.round(F.col("safe_runs") / F.col("total_runs"), 3)).otherwise(0.0)
    return figures.withColumn("unsafe_runs", F.col("total_runs") - F.col("safe_runs")).withColumn("safe_rate", rate)


def entity_totals(audit: DataFrame) -> DataFrame:
    """(type, n): what all runs masked."""
    flat = audit.filter(F.col("event").isin(*RUNS)).select(F.explode("counts").alias("type", "n")).withColumn("n", F.col("n").try_cast("long")).filter("n IS NOT NULL")
    return flat.groupBy("type").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "type")


def recent(audit: DataFrame, n: int = 50) -> DataFrame:
    """The newest ``n`` entries."""
    return audit.orderBy(F.desc("timestamp")).limit(n)


def merged_stats(store: DataFrame, audit: DataFrame) -> DataFrame:
    """Volume from the index if it has any, risk from the audit log: two one-row tables as one row."""
    s, a = store.withColumn("__k", F.lit(1)), audit.withColumn("__k", F.lit(1))
    return s.select("__k", F.col("total").alias("__total"), F.col("files").alias("__files")).join(a, "__k", "full").withColumn("total_entities", F.when(F.col("__total") > 0, F.col("__total")).otherwise(F.col("total_entities"))).withColumn("files", F.coalesce("__files", F.lit(0))).drop("__k", "__total", "__files")


def coverage(files: DataFrame, shadows: DataFrame) -> DataFrame:
    """(root, total, indexed, pending, pct) of ``files(root, content_hash)`` against current shadows."""
    current = shadows.filter("stale = 0").select("content_hash").distinct().withColumn("__in", F.lit(True))
    marked = files.join(current, "content_hash", "left")
    got = marked.groupBy("root").agg(F.count("*").alias("total"), F.count_if("__in").alias("indexed"))
    return got.withColumn("pending", F.col("total") - F.col("indexed")).withColumn("pct", F.round(100.0 * F.col("indexed") / F.col("total"), 1))


def audit_rows(masked: DataFrame, event: str = "anonymize") -> DataFrame:
    """Entries of the log for ``masked(mission, entities, safe)``: counts by type, never values."""
    types = "transform(entities, m -> m.type)"
    counts = F.expr(f"map_from_entries(transform(array_distinct({types}), k -> named_struct('key', k, 'value', size(filter({types}, t -> t = k)))))")
    return masked.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "mission", F.lit(event).alias("event"), counts.alias("counts"), F.size("entities").alias("total"), F.col("safe").alias("safe_to_send"))


def quality(found: DataFrame, gold: DataFrame) -> DataFrame:
    """(type, n_gold, n_found, n_both, recall, precision) of two tables (doc_id, s, e, type)."""
    keys = ["doc_id", "s", "e", "type"]
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(found.select(*keys).distinct().withColumn("f", F.lit(1)), keys, "full")
    sums = both.groupBy("type").agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("n_both"))
    return sums.withColumn("recall", F.round(F.try_divide("n_both", "n_gold"), 3)).withColumn("precision", F.round(F.try_divide("n_both", "n_found"), 3))


def split_by_score(spans: str, threshold: float = 0.6) -> str:
    """SQL: (confident, to_review) spans."""
    return f"named_struct('confident', filter({spans}, m -> m.score >= {threshold}), 'to_review', filter({spans}, m -> m.score < {threshold}))"
