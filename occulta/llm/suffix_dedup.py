"""Removal of byte strings that repeat anywhere, by suffix sorting of shards.

A string of ``LENGTH`` bytes that begins twice is found where suffixes are
sorted: next to an equal one. So that equal strings meet in one shard, each is
dealt by the least hash of the words of ``WORD`` bytes in it; neighbours share
that word, so what travels is a segment of text, not its strings one by one.
Segments are cut only where the word is there twice in the corpus, and one of
equal segments stands for all. If all segments of a word are equal, their strings
repeat by that; the others are sorted, shard by shard, by external induced
sorting (see ``induced``), which finds the strings that are there twice.

Shards are as many as the segments' bytes need. A word with more than ``HOT``
different segments would make a shard of its own size: its strings are dealt
one by one, by their digests, of which equal ones are added up before the
shuffle. Documents meet their results by id and digest of the text, so that
copies of one text are spread, and only one of them is read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, induced
from .near_dedup import _BASE, _power, mix

LENGTH, WORD = induced.CAP, 32
SHARD_BYTES, HOT = 4 << 20, 8192
#: Bytes of text hashed in one go.
CHUNK = 1 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def segments(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, word, digest, from, to) of the segments of texts in one buffer.

    A segment's strings begin at the places ``from`` to ``to``, exclusive, and
    have one word in common, the least by hash, the first of equal ones; its
    text ends ``LENGTH - 1`` bytes behind ``to``. ``digest`` is of that text.
    Which word is a string's own depends on nothing but the string.
    """
    n, wide = len(raw), LENGTH - WORD + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none, none
    powers, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    words = mix((sums[WORD:] - sums[:-WORD]) * inverse[: n - WORD + 1])
    bits = np.uint64((1 << max(1, int(n).bit_length())) - 1)
    ranked = (words & ~bits) | np.arange(len(words), dtype=np.uint64)
    # the least of each window: of the end of one block and the start of the next
    padded = np.append(ranked, np.full(-len(ranked) % wide, ~np.uint64(0))).reshape(-1, wide)
    head, tail = np.minimum.accumulate(padded, axis=1).ravel(), np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    own = (np.minimum(tail[:count], head[wide - 1 : wide - 1 + count]) & bits).astype(np.int64)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[:count]
    inside = np.arange(count) + LENGTH <= starts[1:][doc]
    edge = np.concatenate([[True], (own[1:] != own[:-1]) | (inside[1:] != inside[:-1])])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], count)
    begin, end = begin[inside[begin]], end[inside[begin]]
    word, last = own[begin], end + LENGTH - 1
    digest = mix((sums[last] - sums[begin]) * inverse[begin] + mix((last - begin).astype(np.uint64) * np.uint64(_BASE) + (word - begin).astype(np.uint64)))
    doc = doc[begin]
    return doc, words[word].view(np.int64), digest.view(np.int64), begin - starts[doc], end - starts[doc]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, without copying them, and where each begins."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segments_of(raw: np.ndarray, starts: np.ndarray):
    """The same for buffers of any size: documents by runs, a long one by pieces that overlap."""
    parts, i, n = [], 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK, "right")) - 1)
        if j > i + 1 or starts[j] - starts[i] <= 2 * CHUNK:
            doc, *rest = segments(raw[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            parts.append((doc + i, *rest))
        else:
            size = int(starts[j] - starts[i])
            for c in range(0, size, CHUNK):
                some = raw[starts[i] + c : min(starts[i] + c + CHUNK + LENGTH - 1, starts[j])]
                doc, word, digest, begin, end = segments(some, np.array([0, len(some)]))
                parts.append((doc + i, word, digest, begin + c, end + c))
        i = j
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5


def sketch(docs: DataFrame) -> DataFrame:
    """(id, doc_id, key, n_bytes, sha, h, s, a, e): every document's segments, written once."""

    def run(batches):
        for b in batches:
            doc, word, digest, begin, end = _segments_of(*_bytes_of(b.column(4)))
            offsets = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (word, digest, begin.astype(np.int32), end.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *lists], ["doc_id", "key", "n_bytes", "sha", "h", "s", "a", "e"])

    given = docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
    found = given.mapInArrow(run, "doc_id long, key binary, n_bytes long, sha binary, h array<long>, s array<long>, a array<int>, e array<int>")
    return common.materialise(found.withColumn("id", F.monotonically_increasing_id()), "segments")


def _meet(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(key, doc_id, ...)`` with the text of a document of that id and digest."""
    given = rows.withColumnsRenamed({"key": "__key", "doc_id": "__id"})
    return docs.join(given, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key"))).drop("__key", "__id")


_PIECE = "h long, s long, n long, at int, piece binary"


def pieces(docs: DataFrame, wanted: DataFrame, drawn: DataFrame) -> DataFrame:
    """(h, s, n, at, piece): the text of each segment of ``wanted(id, h, s, a, e, n, hot)``, ``at`` -1; of a hot one its strings' digests, by place."""

    def run(batches):
        for b in batches:
            out = []
            raw, starts = _bytes_of(b.column(0))
            for k, some in enumerate(b.column(1).to_pylist()):
                text = raw[starts[k] : starts[k + 1]].tobytes()
                for x in some:
                    piece = text[x["a"] : x["e"] + LENGTH - 1]
                    if x["hot"]:
                        out += [(x["h"], x["s"], x["n"], at, hashlib.blake2b(piece[at : at + LENGTH], digest_size=16).digest()) for at in range(x["e"] - x["a"])]
                    else:
                        out.append((x["h"], x["s"], x["n"], -1, piece))
                if len(out) > 20_000 or k == b.num_rows - 1:
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["h", "s", "n", "at", "piece"])
                    out = []

    of_doc = wanted.groupBy("id").agg(F.collect_list(F.struct("h", "s", "a", "e", "n", "hot")).alias("some"))
    given = _meet(docs, drawn.select("id", "key", "doc_id").join(of_doc, "id").drop("id"))
    return common.materialise(given.select("text", "some").mapInArrow(run, _PIECE), "pieces")


def sort_shard(batches):
    """(h, s, x, y): the runs of places at which a repeated string begins, of each segment of a shard, by sorting its suffixes."""
    with tempfile.TemporaryFile() as file:
        seen, kept, size = set(), [], 0
        for b in batches:
            for h, s, n, piece in zip(*(b.column(k).to_pylist() for k in range(4))):
                if (h, s) not in seen:
                    seen.add((h, s))
                    file.write(piece + bytes([induced.END]))
                    kept.append((h, s, n, size, len(piece) - LENGTH + 1))
                    size += len(piece) + 1
        if not size:
            return
        file.flush()
        twice = induced.repeated(np.memmap(file, np.uint8, "r", shape=(size,)))
        for k in range(0, len(kept), 10_000):
            rows = []
            for h, s, n, at, count in kept[k : k + 10_000]:
                flags = np.concatenate([[False], twice[at : at + count] | (n > 1), [False]])
                cuts = np.flatnonzero(flags[1:] != flags[:-1])
                if len(cuts):
                    rows.append((h, s, [{"x": int(x), "y": int(y)} for x, y in zip(cuts[::2], cuts[1::2])]))
            if rows:
                kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), kind))], ["h", "s", "runs"])


def repeated_runs(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """(id, runs): for documents of ``drawn`` the runs (x, y) of places at which a string begins that begins elsewhere too."""
    flat = drawn.select("id", F.explode(F.arrays_zip("h", "s", "a", "e")).alias("x")).select("id", "x.*")
    words = flat.groupBy("h").agg(F.count("*").alias("c"), (F.min("s") != F.max("s")).alias("several")).filter("c > 1").select("h", "several")
    # written, so that both sides of the join are plain exchanges, which the skew join can split
    words = common.materialise(words, "words")
    met = common.materialise(flat.join(words, "h"), "repeated")
    kinds = met.filter("several").groupBy("h", "s").agg(F.min(F.struct("id", "a", "e")).alias("x"), F.count("*").alias("n")).select("h", "s", "x.*", "n")
    kinds = common.materialise(kinds, "kinds")
    hot = kinds.groupBy("h").agg(F.count("*").alias("m")).filter(F.col("m") > HOT).select("h", F.lit(True).alias("hot"))
    wanted = kinds.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    cut = pieces(docs, wanted, drawn)
    size = cut.filter("at < 0").agg(F.sum(F.octet_length("piece").cast("long"))).first()[0] or 0
    sorted_ = cut.filter("at < 0").select("h", "s", "n", "piece").repartition(max(1, -(-size // SHARD_BYTES)), "h").mapInArrow(sort_shard, "h long, s long, runs array<struct<x:int,y:int>>")
    # strings of hot words: equal ones are added up, then come back to their segments
    strings = cut.filter("at >= 0").dropDuplicates(["h", "s", "at"])
    twice = strings.groupBy("h", "piece").agg(F.sum("n").alias("m")).filter("m > 1").select("h", "piece")
    one = F.struct(F.col("at").alias("x"), (F.col("at") + 1).alias("y"))
    single = strings.join(twice, ["h", "piece"]).groupBy("h", "s").agg(F.collect_list(one).alias("runs"))
    found = common.materialise(sorted_.unionByName(single), "sorted")
    moved = F.expr("transform(runs, r -> named_struct('x', a + r.x, 'y', a + r.y))")
    some = met.filter("several").join(found, ["h", "s"]).select("id", moved.alias("runs"))
    whole = met.filter("NOT several").select("id", F.expr("array(named_struct('x', a, 'y', e))").alias("runs"))
    return some.unionByName(whole).groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))


def without_repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: what is left when repeated strings are taken out.

    Every byte goes that a string of ``LENGTH`` bytes covers which begins at
    another place too, in the same document or any other; all are judged on the
    texts as given. ``n_spans`` counts the runs removed; with ``keep_bytes``
    ``kept`` has the bytes left, null where none went (cuts may fall within a character). Null text counts as
    empty; shorter texts are left alone; texts that occur twice, and rows
    repeated whole, go if long enough. An empty table gives no row; extra
    columns are left alone.
    """
    common.ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    drawn = sketch(docs)
    runs = repeated_runs(docs, drawn)
    of_text = drawn.select("id", "key", "doc_id").join(runs, "id").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("runs").alias("runs"))

    def cut(batches):
        for b in batches:
            raw, starts = _bytes_of(b.column(1))
            rows = []
            for k, (key, given) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                text, digest, kept, at, removed, spans = raw[starts[k] : starts[k + 1]].tobytes(), hashlib.sha256(), [], 0, 0, 0
                end = -1
                for r in given:
                    x, y = r["x"], r["y"] + LENGTH - 1
                    if x > end:
                        kept.append(text[at:x])
                        spans += 1
                        end = at = x
                    if y > end:
                        removed += y - max(x, end)
                        end = at = y
                kept.append(text[at:])
                for part in kept:
                    digest.update(part)
                rows.append((key, removed, spans, digest.digest(), b"".join(kept) if keep_bytes else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "n_removed", "n_spans", "left", "bytes"])

    cleaned = _meet(docs, of_text).select("key", "text", "runs").mapInArrow(cut, "key binary, n_removed long, n_spans long, left binary, bytes binary").dropDuplicates(["key"])
    out = drawn.select("doc_id", "key", "n_bytes", "sha").join(cleaned, "key", "left")
    zero = F.lit(0).cast("long")
    more = [F.col("bytes").alias("kept")] if keep_bytes else []
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.lower(F.hex(F.coalesce("left", "sha"))).alias("kept_sha256"), *more)
