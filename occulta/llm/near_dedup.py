"""Near-duplicate documents by DartMinHash signatures of weighted word shingles.

A document is the multiset of its five-word shingles, a shingle's weight being
its count. Each shingle owns an endless region, cut into strips of weight
[2**v - 1, 2**(v+1) - 1); hashing throws darts into a strip at the rate of its
width, in order of rank. A document takes the darts under its weights, up to a
rank that gives it about ``K * (ln K + 4)`` of them, however long it is, and
keeps the earliest dart of each of ``K`` coordinates (with twice the rank if a
coordinate got none). Two documents agree in a coordinate with the probability
of their weighted Jaccard similarity.

Documents that agree in all rows of a band meet. Equal texts are one class from
the start. Each bucket's members are compared with its least member, by exact
similarity of the texts; then members of one bucket that are still in different
components are all compared, block against block, and leave a task as a forest
of links. So no candidate pair is lost, and no pair is written out. Bands of 5 rows, 26 of them, miss a
pair of similarity 0.8 three times in 100,000.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graph

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 26, 5
K = BANDS * ROWS
#: Words and texts in a block of which all are compared; columns of a 0/1 matrix.
BLOCK_WORDS, BLOCK_TEXTS, COLUMNS = 400_000, 2048, 2048
#: Rows of ids small enough to be sent to every executor (checked by count).
BROADCAST_ROWS = 1_000_000
SCHEMA = "doc_id long, class_id long, class_size long, kept boolean"

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits given."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2**64, at least ``n`` of them."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _powers[0], _powers[1]


_IN_WORD = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])


def shingles(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of lower-cased texts in one buffer.

    ``starts`` has each text's first byte and the buffer's length at the end; a
    byte between texts is no word's. Words are runs of letters, digits, ``_``
    and bytes of other alphabets. A text of fewer words is one shingle.
    """
    inside = np.concatenate([[False], _IN_WORD[raw], [False]])
    flips = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = flips[::2], flips[1::2]
    powers, inverse = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    doc_of = np.searchsorted(starts, begin, "right") - 1
    n_docs = len(starts) - 1
    per_doc = np.bincount(doc_of, minlength=n_docs)
    n = len(words) - WORDS + 1
    docs, found = [], []
    if n > 0:
        x = np.zeros(n, np.uint64)
        for k in range(WORDS):
            x = x * np.uint64(_BASE) + words[k : k + n]
        same = doc_of[:n] == doc_of[WORDS - 1 :]
        docs.append(doc_of[:n][same])
        found.append(mix(x[same]))
    first = np.cumsum(per_doc) - per_doc
    for d in np.flatnonzero((per_doc > 0) & (per_doc < WORDS)):
        x = np.uint64(per_doc[d])
        with np.errstate(over="ignore"):
            for w in words[first[d] : first[d] + per_doc[d]]:
                x = x * np.uint64(_BASE) + w
        docs.append(np.array([d]))
        found.append(mix(np.array([x], np.uint64)))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, hashed = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((hashed, doc))
    doc, hashed = doc[order], hashed[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashed[1:] != hashed[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashed[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """Earliest dart of each coordinate: an array (n_docs, k), all ones for no element.

    ``doc`` is sorted; weights are positive numbers, not necessarily whole.
    """
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_docs * k, empty, np.uint64)
    total = np.bincount(doc, weight, minlength=n_docs)
    reach = np.zeros(n_docs)
    np.divide(k * (np.log(k) + 4), total, out=reach, where=total > 0)
    open_docs = total > 0
    while open_docs.any():
        some = open_docs[doc]
        d, e, w = doc[some], element[some], weight[some].astype(np.float64)
        strip = 0
        while len(d):
            _throw(out, d, mix(e + np.uint64(strip * 0x632BE59BD9B4E019 & (1 << 64) - 1)), w, strip, reach, k)
            strip += 1
            more = w > (1 << strip) - 1
            d, e, w = d[more], e[more], w[more]
        lacking = (out.reshape(n_docs, k) == empty).any(axis=1) & (total > 0)
        reach *= 2
        out.reshape(n_docs, k)[lacking] = empty
        open_docs = lacking
    return out.reshape(n_docs, k)


def _throw(out: np.ndarray, doc: np.ndarray, seed: np.ndarray, weight: np.ndarray, strip: int, reach: np.ndarray, k: int) -> None:
    """Throw darts into one strip of each element up to its document's reach.

    Darts come in blocks of 1, 2, 4 ... so that few rounds do for any reach.
    """
    width, low = float(1 << strip), float((1 << strip) - 1)
    far, rank = reach[doc], np.zeros(len(doc))
    step, block = 1, 1
    while len(doc):
        part = max(1, (1 << 20) // block)
        keep = []
        for a in range(0, len(doc), part):
            s = slice(a, a + part)
            number = np.arange(step, step + block, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            x = mix(seed[s, None] + number)
            gaps = -np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            ranks = rank[s, None] + np.cumsum(gaps, axis=1)
            rank[s] = ranks[:, -1]
            row, column = np.nonzero(ranks <= far[s, None])
            hit = mix(x[row, column] ^ np.uint64(0xD6E8FEB86659FD93))
            r, at = ranks[row, column], doc[s][row]
            inside = low + width * ((mix(hit) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < weight[s][row]
            if not inside.all():
                hit, r, at = hit[inside], r[inside], at[inside]
            coordinate = ((hit >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            packed = (r.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (hit & np.uint64(0xFFFFFFFF))
            np.minimum.at(out, at * k + coordinate.astype(np.int64), packed)
            keep.append(rank[s] <= far[s])
        go = np.concatenate(keep)
        doc, seed, weight, far, rank = doc[go], seed[go], weight[go], far[go], rank[go]
        step += block
        block *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        x = mix(x * np.uint64(_BASE) + parts[:, :, k])
    return x.view(np.int64)


def _buffer(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8") + b"\n" for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return np.frombuffer(b"".join(raw), np.uint8), starts


def similarities(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """Exact weighted Jaccard similarity of each pair of lower-cased texts; 0 without words."""
    n = len(left)
    doc, element, weight = shingles(*_buffer([*left, *right]))
    side, pair = doc >= n, doc % n if n else doc
    order = np.lexsort((side, element, pair))
    pair, element, weight, side = pair[order], element[order], weight[order].astype(np.float64), side[order]
    total = np.bincount(pair, weight, minlength=n)
    twin = (pair[1:] == pair[:-1]) & (element[1:] == element[:-1])
    common_weight = np.bincount(pair[1:][twin], np.minimum(weight[1:], weight[:-1])[twin], minlength=n)
    return np.divide(common_weight, total - common_weight, out=np.zeros(n), where=total > 0)


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, key, weight, bands) of every document, written once.

    ``key`` is a digest of the lower-cased text, ``weight`` its number of shingles.
    """
    common.ship(docs.sparkSession)
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(text).alias("key"), text.alias("text"))

    def run(batches):
        from .token_files import _lengths

        for b in batches:
            texts = b.column(2)
            for i, j in common.slices(len(texts), _lengths(texts), 1 << 20):
                doc, element, weight = shingles(*_buffer(texts.slice(i, j - i).to_pylist()))
                n = j - i
                keys = band_keys(signatures(doc, element, weight, n))
                total = np.bincount(doc, weight, minlength=n).astype(np.int64)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, n), b.column(1).slice(i, n), pa.array(total), bands], ["doc_id", "key", "weight", "bands"])

    return common.materialise(given.mapInArrow(run, "doc_id long, key binary, weight long, bands array<long>"), "signatures")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, text): the text of each of ``nodes(key, doc_id)``."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    wanted = nodes.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    some = wanted.select("__id").distinct()
    if some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    # a class of which no row has an id is fetched by its null id
    same_id = F.col("doc_id").eqNullSafe(F.col("__id"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(some, same_id, "left_semi").select("doc_id", _key(text).alias("key"), text.alias("text"))
    return own.join(wanted, same_id & (F.col("key") == F.col("__key")), "left_semi").dropDuplicates(["key"]).select("key", "text")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts are as similar as ``least``."""
    full = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        from .token_files import _lengths

        for b in batches:
            sizes = np.add(_lengths(b.column(2)), _lengths(b.column(3))).tolist()
            for i, j in common.slices(b.num_rows, sizes, 2 << 20):
                x = b.slice(i, j - i)
                good = pa.array(similarities(x.column(2).to_pylist(), x.column(3).to_pylist()) >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(good)

    return full.mapInArrow(run, "a binary, b binary")


def block_links(left: list[str], right: list[str] | None, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all similar lower-cased texts of one block, or of two, exactly.

    Texts are numbered over both sides, left first. All similarities are
    computed, as products of 0/1 matrices over the shingles that two texts or
    more have (a shingle's second occurrence is an element of its own); only a
    forest is returned: (text, its component's first text).
    """
    n = len(left) + len(right or ())
    doc, element, weight = shingles(*_buffer([*left, *(right or ())]))
    total = np.bincount(doc, weight, minlength=n)
    nth = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    doc, element = np.repeat(doc, weight), mix(np.repeat(element, weight) + nth.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
    _, column, seen = np.unique(element, return_inverse=True, return_counts=True)
    often = seen[column] > 1
    doc, column = doc[often], (np.cumsum(seen > 1) - 1)[column[often]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    first, second = (0, n) if right is None else (0, len(left)), (0, n) if right is None else (len(left), n)
    both = np.zeros((first[1] - first[0], second[1] - second[0]), np.float32)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(column, column[at] + COLUMNS))
        part = np.zeros((n, COLUMNS), np.float32)
        part[doc[at:stop], column[at:stop] - column[at]] = 1
        both += part[slice(*first)] @ part[slice(*second)].T
        at = stop
    either = total[slice(*first), None] + total[None, slice(*second)] - both
    r, c = np.nonzero((both > 0) & (both >= (least - 1e-12) * either))
    r, c = r + first[0], c + second[0]
    r, c = r[r != c], c[r != c]
    label = np.arange(n)
    while len(r):
        before = label.copy()
        low = np.minimum(label[r], label[c])
        np.minimum.at(label, r, low)
        np.minimum.at(label, c, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def link_buckets(rows: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect whatever is similar within each band of ``rows(band, key, weight)``.

    A band's texts are dealt to blocks of about ``BLOCK_WORDS`` words or
    ``BLOCK_TEXTS`` texts, whichever are more blocks, and each
    pair of blocks is one task's group.
    """
    sizes = rows.groupBy("band").agg(F.ceil(F.greatest(F.sum("weight") / BLOCK_WORDS, F.count("*") / BLOCK_TEXTS)).cast("int").alias("parts"))
    placed = rows.join(sizes, "band").withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    given = placed.select("band", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "key").join(texts.select("key", "text"), "key")

    def compare(group: pa.Table) -> pa.Table:
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        keys, side, said = group["key"].to_pylist(), group["i"].to_pylist(), group["text"].to_pylist()
        left = [k for k, s in enumerate(side) if s == x]
        right = [k for k, s in enumerate(side) if s == y] if x != y else []
        order = left + right
        node, label = block_links([said[k] for k in left], [said[k] for k in right] if x != y else None, least) if len(order) > 1 else ((), ())
        return pa.table({"a": pa.array([keys[order[k]] for k in label], pa.binary()), "b": pa.array([keys[order[k]] for k in node], pa.binary())})

    return given.groupBy("band", "x", "y").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)`` with its class of near duplicates.

    ``class_id`` is the least doc_id of the class, ``class_size`` its number of
    rows and ``kept`` whether the row is the class's own (``doc_id`` equal to
    ``class_id``; null ids only where a class has none but null). ``text_key``
    is a digest of the text and ``class_key`` one of the class. Null text
    counts as empty; equal texts, empty ones too, are of one class; a text
    without a word is similar to nothing else. Repeated rows count each. An
    empty table gives no row; extra columns are left alone.
    """
    signed = sign(docs)
    nodes = common.materialise(
        signed.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "weight", "bands")).alias("x"), F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
        .select("key", F.col("x.doc_id").alias("doc_id"), "least_id", "n", F.col("x.weight").alias("weight"), F.col("x.bands").alias("bands")),
        "classes",
    )
    rows = nodes.filter("weight > 0").select(F.explode("bands").alias("band"), "key", "weight")
    leaders = rows.groupBy("band").agg(F.min(F.struct("key", "weight")).alias("leader"), F.count("*").alias("m")).filter("m > 1").select("band", F.col("leader.key").alias("a"), F.col("leader.weight").alias("a_weight"))
    met = common.materialise(rows.join(leaders, "band").select("band", "a", "a_weight", F.col("key").alias("b"), F.col("weight").alias("b_weight")), "buckets")

    def alike(x: str, y: str):
        return F.least(x, y) >= F.greatest(x, y) * (least - 1e-9)

    stars = common.materialise(met.filter("a <> b").filter(alike("a_weight", "b_weight")).select("a", "b").distinct(), "pairs")
    names = nodes.select("key", "doc_id")
    texts = common.materialise(_texts(docs, names.join(met.select(F.col("b").alias("key")).distinct(), "key", "left_semi")), "texts")
    links = common.materialise(verify(stars, texts, least), "verified")
    first = graph.components(links)
    placed = met.join(first.select(F.col("node").alias("b"), "component"), "b", "left").select("band", "b", "b_weight", F.coalesce("component", "b").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("band")
    left = common.materialise(placed.join(mixed, "band", "left_semi").select("band", F.col("b").alias("key"), F.col("b_weight").alias("weight")), "mixed")
    more = link_buckets(left, texts, least)
    found = graph.components(links.unionByName(more))
    classes = nodes.select("key", "least_id", "n").join(found.select(F.col("node").alias("key"), "component"), "key", "left").select("key", "least_id", "n", F.coalesce("component", "key").alias("component"))
    sizes = classes.groupBy("component").agg(F.min("least_id").alias("class_id"), F.sum("n").alias("class_size"))
    of_key = classes.join(sizes, "component").select("key", "class_id", "class_size", "component")
    met = signed.select("doc_id", "key").join(of_key, "key")
    return met.select("doc_id", "class_id", "class_size", F.expr("doc_id <=> class_id").alias("kept"), F.col("key").alias("text_key"), F.col("component").alias("class_key"))


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stand for their classes: of each the least doc_id (null last), then text digest, once."""
    found = near_duplicates(docs, least)
    best = found.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("x")).select(F.col("x.doc_id").alias("__id"), F.col("x.text_key").alias("__key"))
    keyed = docs.withColumn("__k", _key(F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    kept = keyed.join(best, (F.col("__k") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__k"]).drop("__k")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))
