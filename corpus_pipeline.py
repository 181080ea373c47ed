"""From raw documents to packed training sequences, stage by stage.

Each stage works on all that the one before kept, written as Parquet in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occulta.llm import common, langid, near_dedup, packing, pii, tokenise
from occulta.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if its language is known at least so surely.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identified language; those without letters or between languages go."""
    model = langid.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    scored = langid.predict(docs.select(*COLUMNS), model)
    return scored.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least doc_id, once."""
    return near_dedup.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each piece of personal data replaced by its kind in brackets."""
    found = pii.find(docs.select(*COLUMNS))
    return found.withColumn("text", pii.masked()).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of 2048 ids."""
    return packing.pack(docs, tokenise.default_path(), end_id=1)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: Language models, signatures and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, name)
    return docs
