"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hard_negatives, langid, licences, merkle, near_dedup, oracles, packing, pii, suffix_dedup, token_files, tokenise, topk, vector_dedup
from .common import new_dir, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read back from the token files that hold all of them."""
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenise.default_path(), 2, new_dir(spark, "tokens"))
    return token_files.read_token_files(manifest)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those that the method adds."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenise.default_path(), end_id=1)


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document states, and where."""
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors, by inner product, of each whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.filter("vec_id % 50 = 0"), 5)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted, written and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    return chat.digest_formatted(chat.format_conversations(rows.unionByName(extra)))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    given = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return langid.predict(given, model, keep=["doc_id", "held_out"])


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of every document's ids and of the text they decode to."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenise.default_path())


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document: five words, similarity 0.8."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten negatives for each of the five positives of every hundredth vector; every seventh has its label moved."""
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), label)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and proofs of every document, a third of them tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    altered = F.when(tampered, merkle.leaf(text=merkle.lowered()))
    return merkle.verify(table(spark, sf_dir, "documents"), altered=altered)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 200-byte strings that begin anywhere else too."""
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_pii, op3_packing, op4_licences, op5_top_k, op6_chat, op7_vector_dedup, op8_language_id, op9_bpe, op10_minhash, op11_hard_negatives, op12_merkle, op13_suffix_dedup)}
ORACLE_SQL: dict[str, str] = {"op5_top_k": oracles.TOP_K, "op6_chat": oracles.CHAT, "op7_vector_dedup": oracles.VECTOR_DEDUP, "op10_minhash": oracles.MINHASH, "op11_hard_negatives": oracles.HARD_NEGATIVES, "op12_merkle": oracles.merkle()}
