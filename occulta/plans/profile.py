"""What a dossier's documents teach about its client, and the second look it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import NONE, quote, resolved
from ..operators.lists import distinctive, listed_spans
from ..operators.masker import Masker
from ..operators.recognizers import FORENAMES, TITLE
from ..operators.vault import tokens_in

STRUCTURED = ("EMAIL", "IBAN", "SIRET", "SIREN", "SECU", "TEL", "ADRESSE", "DATE_NAISSANCE", "NUM_CLIENT", "NUM_FISCAL", "NUM_TELEDECLARANT", "PIECE_IDENTITE", "LIEU_NAISSANCE")
LEAST_NAME = 0.85


def person_signal(m: str) -> str:
    """SQL: whether a detected name looks like a person's: from a model, or with a title or forename and several words."""
    names = ", ".join(quote(n.lower()) for n in FORENAMES)
    return f"({m}.priority <= 5 OR ({m}.score >= {LEAST_NAME} AND size(filter(split(trim({m}.value), r'\\s+'), w -> w <> '')) >= 2 AND ({m}.value rlike {quote('^' + TITLE)} OR exists(split(lower({m}.value), r'(?U)[^\\p{{L}}]+'), w -> w IN ({names})))))"


def learn(found: DataFrame, allowed: str = "false") -> DataFrame:
    """(dossier, kind, value): values and name words of ``found(dossier, spans)``.

    Structured identifiers count as they are, names if a person's; what the
    allow list names (SQL over ``m``) is never learnt. One row a value, so that
    a large dossier is no large array.
    """
    flat = found.select("dossier", F.explode_outer("spans").alias("m")).filter("m IS NOT NULL").filter(f"NOT coalesce({allowed}, false)")
    clean = "regexp_replace(trim(m.value), r'\\s+', ' ')"
    structured = ", ".join(map(repr, STRUCTURED))
    good = flat.filter(f"m.type IN ({structured}) OR (m.type = 'NOM' AND {person_signal('m')})")
    values = good.select("dossier", F.lit("value").alias("kind"), F.expr(clean).alias("value"), F.col("m.type").alias("type"))
    words = good.filter("m.type = 'NOM'").select("dossier", F.lit("word").alias("kind"), F.explode(F.expr(distinctive("m.value"))).alias("value"), F.lit("NOM").alias("type"))
    return values.unionByName(words).filter("value <> ''").distinct()


def sweep(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """``docs(dossier, doc_id, text, ...)`` with ``swept``: places of the dossier's profile.

    Values are found as they are, across any white space, name words in any
    case; see ``lists.listed_spans``.
    """
    listed = profile.select("dossier", "value", "type", (F.col("kind") != "word").alias("exact")).distinct()
    made = "named_struct('s', s, 'e', e, 'type', c.type, 'value', substring(__text, s + 1, e - s), 'score', 0.9D, 'priority', 58)"
    return listed_spans(docs, listed, ["dossier", "doc_id"], ["dossier"], made, "swept")


def two_pass(docs: DataFrame, masker: Masker, allowed: str = "false") -> DataFrame:
    """``docs(dossier, doc_id, text)`` with spans of a first pass and of a sweep for what it taught."""
    from ..sources.tables import materialise

    first = materialise(masker.detect(docs), "pass-one")
    swept = sweep(first, learn(first, allowed))
    return swept.withColumn("__all", F.concat("spans", "swept")).withColumn("spans", F.expr(resolved("__all"))).drop("__all", "swept")


def mask_dossiers(docs: DataFrame, masker: Masker) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents masked, vault, one row a dossier): a vault and a profile for each dossier.

    One ``doc_id`` in two dossiers is two documents.
    """
    from dataclasses import replace

    from ..sources.tables import materialise

    given = materialise(two_pass(docs, masker).withColumn("mission", F.col("dossier")).withColumnRenamed("spans", "__given"), "dossier")
    again = replace(masker, recognizers=[], extra_recognizers=[], forms=False, dictionary=None, lists=None, keep=None, extra={"given": lambda d: F.col("__given") if "__given" in d.columns else F.expr(NONE)})
    out, vault = again.mask(given)
    files = out.select("doc_id", F.col("mission").alias("dossier"), "masked", "entities", "state", "safe")
    totals = files.groupBy("dossier").agg(F.count_if(F.col("safe")).alias("n_ok"), F.sum(F.size("entities")).alias("total_entities"), F.min("safe").alias("all_safe"))
    return files, vault, totals


def consistency(masked: DataFrame) -> DataFrame:
    """(dossier, n_persons, most_files): distinct person numbers, and the most files that one is in."""
    tokens = masked.select("dossier", "doc_id", F.explode(F.expr(tokens_in("masked"))).alias("t")).withColumn("person", F.regexp_extract("t", r"^⟦NOM_(\d+)", 1)).filter("person <> ''")
    per = tokens.groupBy("dossier", "person").agg(F.count_distinct("doc_id").alias("n"))
    return per.groupBy("dossier").agg(F.count("*").alias("n_persons"), F.max("n").alias("most_files"))


def safe_name(stem: str, values: str, kind: str, index: str) -> str:
    """SQL: a file's name without known values and forenames, or the kind, or a number."""
    names = ", ".join(quote(n.lower()) for n in FORENAMES)
    words = f"flatten(transform({values}, v -> split(lower(v), r'(?U)[^\\p{{L}}\\p{{N}}]+')))"
    kept = f"array_join(filter(split({stem}, r'[\\s_\\-.]+'), w -> w <> '' AND NOT array_contains({words}, lower(w)) AND NOT lower(w) IN ({names})), '-')"
    return f"coalesce(nullif({kept}, ''), nullif({kind}, ''), concat('document-', {index}))"
