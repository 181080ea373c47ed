"""Packing by concatenating and cutting, with two passes of prefix sums.

Pass one encodes each partition once and writes ids, their places within the
partition and the partition's total into the shared folder. The totals, one
number a partition, are summed up to each partition's global offset. Pass two
cuts the endless row of ids into fixed windows; a document that crosses a
border leaves one boundary record (piece) in each window it reaches.

Every sequence but the last is full, so only the last one can need padding.
Null text counts as empty: such a document is its end id alone. Repeated rows
are packed each; an empty table gives no piece; extra columns are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, token_files, tokenise

LENGTH = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_WRITTEN = "part int, local_start long, n_tokens long, doc_id long, ids binary"


def padded_length(length: int, most: int = LENGTH) -> int:
    """The stored length of a sequence: its own if a power of two, else ``most``."""
    return length if length & (length - 1) == 0 else most


def encode_partitions(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pass one: each document's ids and its place in its partition, written once."""
    common.ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def encode(batches):
        import zstandard
        from pyspark import TaskContext

        part, at, small = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(1)
        for ids, found, dtype in token_files.encode_batches(tokenizer, end_id)(batches):
            n = np.array([len(x) // dtype.itemsize for x in found], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), ids.cast(pa.int64()), pa.array([small.compress(x) for x in found], pa.binary())], ["part", "local_start", "n_tokens", "doc_id", "ids"])

    return common.materialise(docs.mapInArrow(encode, _WRITTEN), "pack")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH) -> DataFrame:
    """Pieces of all ``docs(doc_id, text)`` in sequences of ``length`` ids.

    One row a piece: which ids of which document it holds, and where it lies.
    """
    spark = docs.sparkSession
    written = encode_partitions(docs, tokenizer, end_id)
    totals = sorted(written.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, before = {}, 0
    for part, n in totals:  # one number for each input partition
        offsets[part] = before
        before += n
    known = spark.sparkContext.broadcast(offsets)

    def cut(batches):
        import zstandard

        dtype, big, offset_of = tokenise.encoder(tokenizer).dtype, zstandard.ZstdDecompressor(), known.value
        for b in batches:
            rows = []
            for part, local, n, doc, raw in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4)):
                ids = np.frombuffer(big.decompress(raw.as_buffer()), dtype).astype("<u4").tobytes()
                at, start = offset_of[part] + local, 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    take = min(n - start, length - offset)
                    rows.append((doc, start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), n, sequence, offset))
                    start += take
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [x.split()[0] for x in SCHEMA.split(", ")])

    return written.mapInArrow(cut, SCHEMA)
