"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and cut into runs of 1 to 4 characters (code points), each
hashed into ``2**BITS`` buckets. Learning counts buckets per language over a bounded
sample of labelled rows; the matrix of log probabilities (``2**BITS`` rows, one
column a language: a fixed size) is broadcast, and each batch of texts is
scored in numpy by gathering and summing its rows.

The score is the chosen language's posterior probability for one average
n-gram stretch of ``TEMPER`` characters, so that long texts don't all score 1.
Null texts and texts without a letter get ``und`` and score 0. Ties go to the
language that sorts first; without any labelled row everything is ``und``.
Repeated rows give repeated results, and are all learned or all not; rows
without an id are sampled by their texts; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 16
ORDERS = (1, 2, 3, 4)
SMOOTHING = 0.5
#: Labelled rows learned from: about so many a language, those of least hash.
SAMPLE_ROWS = 1500
TEMPER = 200
UNKNOWN = "und"
SCHEMA = "lang_pred string, score double"
_MULTIPLY, _STEP = np.uint32(0x9E3779B1), np.uint32(0x01000193)


def gram_hashes(chars: np.ndarray, order: int) -> np.ndarray:
    """Buckets of all runs of ``order`` characters of one buffer of code points."""
    n = len(chars) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    x = np.full(n, order, np.uint32)
    for k in range(order):
        x *= _STEP
        x += chars[k : k + n]
    x ^= x >> np.uint32(15)
    x *= _MULTIPLY
    return x >> np.uint32(32 - BITS)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one buffer, a line end after each, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    whole = "".join([t + "\n" for t in texts])
    return np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(sizes) - sizes


def count(texts: list[str]) -> np.ndarray:
    raw, _ = _joined(texts)
    return sum(np.bincount(gram_hashes(raw, k), minlength=1 << BITS) for k in ORDERS)


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and the log probability of each bucket in each.

    ``docs`` has (doc_id, text, lang); rows without text or lang are left out.
    Of each language the rows are learned whose hashed id and text fall under a
    share of ``sample_rows`` to all its rows. Buckets are counted and summed on the
    executors; the driver gets 2**BITS sums a language at most.
    """
    common.ship(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not sizes:
        return [], np.zeros((1 << BITS, 0), np.float32)
    shares = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, sample_rows / r["n"]) * 1e6)])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < shares[F.col("lang")]).select("lang", F.lower("text").alias("text"))

    def counts(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                found[lang] = found.get(lang, 0) + count([t for x, t in zip(langs, texts) if x == lang])
        for lang, c in found.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    summed = sample.mapInArrow(counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    langs = sorted(r["lang"] for r in sizes)
    totals = np.zeros((len(langs), 1 << BITS))
    at = {x: k for k, x in enumerate(langs)}
    totals[[at[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] = got["n"].to_numpy()
    totals += SMOOTHING
    logs = np.log(totals) - np.log(totals.sum(axis=1, keepdims=True))
    return langs, np.ascontiguousarray(logs.T, np.float32)


def score_texts(texts: list[str], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best column and its score for each lower-cased text, all texts at once."""
    raw, starts = _joined(texts)
    total = np.zeros((len(texts), matrix.shape[1]))
    for k in ORDERS:
        h = gram_hashes(raw, k)
        for c in range(matrix.shape[1]):
            column = np.ascontiguousarray(matrix[:, c])
            sums = np.add.reduceat(column[h], np.minimum(starts, len(h) - 1), dtype=np.float64) if len(h) else np.zeros(len(texts))
            total[:, c] += sums
    sizes = np.diff(np.append(starts, len(raw)))
    scaled = total * np.minimum(1.0, TEMPER / np.maximum(1, sizes))[:, None]
    scaled -= scaled.max(axis=1, keepdims=True)
    best = total.argmax(axis=1)
    p = np.exp(scaled)
    return best, p[np.arange(len(texts)), best] / p.sum(axis=1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns (``keep``, or all) with ``lang_pred`` and ``score``.

    Only the lower-cased text goes to Python; other columns stay in the JVM.
    """
    spark = docs.sparkSession
    common.ship(spark)
    langs, matrix = model
    known = spark.sparkContext.broadcast(matrix)

    def run(texts: pa.Array) -> pa.Array:
        from .token_files import _lengths

        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        for i, j in common.slices(len(texts), _lengths(texts), 1 << 20):
            part = texts.slice(i, j - i).to_pylist()
            some = [k for k, t in enumerate(part) if t is not None] if langs else []
            if some:
                best, p = score_texts([part[k] for k in some], known.value)
                for k, c, s in zip(some, best.tolist(), p.tolist()):
                    pred[i + k], score[i + k] = langs[c], s
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    found = F.arrow_udf(run, "lang_pred string, score double")
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    scored = docs.withColumn("__found", found(F.when(F.col(text).rlike(r"\p{L}"), F.lower(F.col(text)))))
    return scored.select(*kept, "__found.lang_pred", "__found.score")
