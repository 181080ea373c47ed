"""Token-ID files: every id in the fewest bits the vocabulary needs.

A file is ``header | packed blocks | block offsets | document table``. A block
holds ``BLOCK`` ids of ``width`` bits each, little end first; its byte offset is
in the block table, so any run of ids is unpacked from the blocks that hold it,
all ids at once. The document table has each document's id, whether that id is
null, and the number of ids before its end.

Documents stand in ascending ``doc_id`` order over all files (null ids first;
rows of one id, or of none, by the check sum of their ids), whatever partitions
they came in. There are as many files as the stored bytes need, so a file, its
document table and a task's work don't grow with the corpus.
Null text counts as empty, so such a document holds only the end id; an empty
table gives no file and no row; extra columns are left alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokenise

MAGIC = b"OCTK"
VERSION = 1
#: Ids in a block; a multiple of 8, so that every block ends on a byte.
BLOCK = 1 << 14
#: Stored bytes of documents in a file, about; fewer, down to the second number, while there are fewer files than cores.
FILE_BYTES, LEAST_FILE_BYTES = 64 << 20, 4 << 20
#: Ids by which ranges are drawn: so many a file, and so many at least.
SAMPLED, LEAST_SAMPLED = 10, 50_000
#: Files whose ids are added up in one task.
GROUP = 4096
_HEADER = struct.Struct("<4sHHIQQQ")  # magic, version, width, block, ids, documents, place of the tables

SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
MANIFEST = "shard int, file string, n_docs long, n_tokens long"


def width_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` bits each, the last byte filled with zero bits."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, count: int, width: int) -> np.ndarray:
    """The first ``count`` ids of a packed run, as 32-bit integers."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=count * width).reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Appends documents to one file; holds one block and the document table."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.waiting: list[np.ndarray] = []
        self.held = self.n_tokens = 0
        self.offsets, self.ends, self.ids, self.nulls = [], [], [], bytearray()
        self.place = _HEADER.size

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n_tokens += len(ids)
        self.ends.append(self.n_tokens)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush()

    def _flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for at in range(0, whole, BLOCK):
            raw = pack(ids[at : min(at + BLOCK, whole)], self.width)
            self.offsets.append(self.place)
            self.place += len(raw)
            self.out.write(raw)
        self.waiting, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> bytes:
        """The tables and the trailer, which repeats the header's fields."""
        self._flush(last=True)
        tables = np.array(self.offsets, "<u8").tobytes() + np.array(self.ends, "<u8").tobytes() + np.array(self.ids, "<i8").tobytes() + bytes(self.nulls)
        header = _HEADER.pack(MAGIC, VERSION, self.width, BLOCK, self.n_tokens, len(self.ends), self.place)
        self.out.write(tables + header)
        return header


def write(uri: str, docs: Iterator[tuple[int | None, np.ndarray]], width: int) -> tuple[int, int]:
    """A whole file; returns its numbers of documents and of ids."""
    made: list[Writer] = []

    def body(f) -> None:
        f.write(b"\0" * _HEADER.size)
        w = Writer(f, width)
        made.append(w)
        for doc_id, ids in docs:
            w.add(doc_id, ids)
        w.close()

    common.write_file(uri, body)
    return len(made[0].ends), made[0].n_tokens


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        self.file = common.open_file(uri)
        self.file.seek(0, 2)
        size = self.file.tell()
        self.file.seek(size - _HEADER.size)
        magic, version, self.width, self.block, self.n_tokens, self.n_docs, place = _HEADER.unpack(self.file.read(_HEADER.size))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{uri} is no token file of version {VERSION}")
        self.file.seek(place)
        tables = self.file.read(size - _HEADER.size - place)
        blocks = -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(tables, "<u8", blocks)
        self.ends = np.frombuffer(tables, "<u8", self.n_docs, 8 * blocks).astype(np.int64)
        self.doc_ids = np.frombuffer(tables, "<i8", self.n_docs, 8 * (blocks + self.n_docs))
        self.nulls = np.frombuffer(tables, np.uint8, self.n_docs, 8 * (blocks + 2 * self.n_docs)).astype(bool)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        stop = min((last + 1) * self.block, self.n_tokens)
        count = stop - first * self.block
        self.file.seek(int(self.offsets[first]))
        raw = self.file.read(-(-count * self.width // 8))
        return unpack(raw, count, self.width)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, ids), reading about ``at_once`` ids at a time."""
        i = 0
        while i < self.n_docs:
            low = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, low + at_once, "right")))
            run = self.tokens(low, int(self.ends[j - 1]))
            for k in range(i, j):
                a = (int(self.ends[k - 1]) if k else 0) - low
                yield None if self.nulls[k] else int(self.doc_ids[k]), low + a, run[a : int(self.ends[k]) - low]
            i = j

    def close(self) -> None:
        self.file.close()


def encode_batches(path: str, end_id: int | None):
    """A function for mapInArrow over (doc_id, text): rows of (doc_id, ids as bytes)."""

    def run(batches):
        enc = tokenise.encoder(path)
        tail = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            texts = batch.column(1)
            for a, b in common.slices(len(texts), _lengths(texts)):
                ids = enc.encode(texts.slice(a, b - a).to_pylist())
                yield batch.column(0).slice(a, b - a), [x + tail for x in ids], enc.dtype

    return run


def _lengths(texts) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_pylist()


def file_count(docs: DataFrame) -> int:
    """Files for ``docs(doc_id, text)``, by the stored size of what it reads, or by its texts where no size is known."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # not known: such a plan counts as endless
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // FILE_BYTES), min(cores, -(-size // LEAST_FILE_BYTES)))


def ranges(docs: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(files for rows without an id, bounds between the other files), of ``n`` files, or one more.

    Bounds are ids of a sample, as whole numbers; an id with more rows than a
    file holds is several bounds.
    """
    rows, nulls = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    empty = min(n, max(1, round(n * nulls / rows))) if nulls else 0
    rest = max(1, n - empty)
    if rest == 1 or rows == nulls:
        return empty, np.zeros(0, np.int64)
    share = min(1.0, max(SAMPLED * rest, LEAST_SAMPLED) / rows)
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL")
    known = np.sort((ids if share == 1 else ids.sample(share, 1)).toArrow()["doc_id"].to_numpy())
    return empty, known[(np.arange(1, rest) * len(known)) // rest] if len(known) else np.zeros(0, np.int64)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, out: str, shards: int | None = None) -> DataFrame:
    """Encode every text of ``docs(doc_id, text)`` into token files below ``out``.

    Returns the manifest (shard, file, n_docs, n_tokens), written beside the
    files: it names only files of tasks that ended well. Texts are encoded
    where they are read; only compressed ids are dealt out, to ranges of
    doc_id. An id with more rows than a range holds, and rows without an id,
    are spread over several files by check sum; equal rows stay together.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    empty, bounds = ranges(docs, shards or file_count(docs))
    n, known = empty + len(bounds) + 1, spark.sparkContext.broadcast(bounds)
    width = width_for(tokenise.vocabulary_size(tokenizer))

    def encode(batches):
        import zstandard

        small = zstandard.ZstdCompressor(1)
        for ids, found, _ in encode_batches(tokenizer, end_id)(batches):
            crc = np.array([zlib.crc32(x) for x in found], np.int64)
            keys = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            low, high = (np.searchsorted(known.value, keys, side) for side in ("left", "right"))
            shard = empty + low + (crc * (high - low + 1) >> 32)
            none = np.asarray(ids.is_null())
            shard[none] = crc[none] * empty >> 32
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), ids.cast(pa.int64()), pa.array(crc), pa.array([small.compress(x) for x in found], pa.binary())], ["shard", "doc_id", "crc", "ids"])

    dealt = docs.mapInArrow(encode, "shard int, doc_id long, crc long, ids binary").repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "crc")

    def store(batches):
        import uuid

        import zstandard

        dtype, big = tokenise.encoder(tokenizer).dtype, zstandard.ZstdDecompressor()

        def rows():
            for b in batches:
                for s, d, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                    yield s, d, np.frombuffer(big.decompress(i.as_buffer()), dtype).astype("<u4")

        it = rows()
        row = next(it, None)
        while row is not None:
            shard = row[0]

            def of_shard():
                nonlocal row
                while row is not None and row[0] == shard:
                    yield row[1:]
                    row = next(it, None)

            uri = f"{out}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.octk"
            n_docs, n_tokens = write(uri, of_shard(), width)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [uri], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    dealt.mapInArrow(store, MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files, with the ids before each over all files and a check sum.

    The ids before a file are summed within groups of files, and over groups;
    only the groups' sums come to the driver.
    """
    spark = manifest.sparkSession
    common.ship(spark)
    group = F.floor(F.col("shard") / GROUP)
    sums, before = {}, 0
    for g, n_tokens in sorted(manifest.groupBy(group.alias("g")).agg(F.sum("n_tokens").alias("n")).collect()):
        sums[g] = before
        before += n_tokens
    known = spark.sparkContext.broadcast(sums)
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy(group).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = manifest.select("shard", "file", inside.cast("long").alias("before")).repartition(max(1, manifest.count()))

    def load(batches):
        for b in batches:
            for shard, file, first in zip(*(b.column(k).to_pylist() for k in range(3))):
                first += known.value[shard // GROUP]
                r, rows = Reader(file), []
                for doc_id, start, ids in r.documents():
                    rows.append((doc_id, first + start, len(ids), zlib.crc32(ids.tobytes())))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                r.close()
                if rows:
                    yield _batch(rows)

    return listed.mapInArrow(load, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])
