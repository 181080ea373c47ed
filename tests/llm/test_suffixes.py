"""Removal of repeated strings against brute force: the sort itself, then the whole operator."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from occulta.llm import common, induced, queries, suffix_dedup


def begin_twice(pieces, cap):
    """For each text and place whether the ``cap`` bytes from there on begin anywhere else."""
    count = Counter(p[i : i + cap] for p in pieces for i in range(len(p) - cap + 1))
    return [[count[p[i : i + cap]] > 1 for i in range(len(p) - cap + 1)] for p in pieces]


@pytest.mark.parametrize("batch", [5, 1 << 18])
@pytest.mark.parametrize("memory", [64, 0])
def test_sorted_suffixes(monkeypatch, batch, memory):
    monkeypatch.setattr(induced, "BATCH", batch)
    rng = np.random.default_rng(batch + memory)
    for _ in range(40):
        cap, letters = int(rng.choice([3, 8, 20])), int(rng.choice([1, 2, 4, 200]))
        base = rng.integers(0, letters, size=100).astype(np.uint8)
        pieces = []
        for _ in range(rng.integers(1, 8)):
            a, b = sorted(rng.integers(0, 101, size=2))
            pieces.append(bytes(rng.integers(0, letters, size=rng.integers(0, 30)).astype(np.uint8)) + base[a:b].tobytes())
        text = np.frombuffer(b"".join(p + bytes([induced.END]) for p in pieces), np.uint8)
        got, at = induced.repeated(text, cap, memory), 0
        for p, want in zip(pieces, begin_twice(pieces, cap)):
            assert got[at : at + len(want)].tolist() == want
            at += len(p) + 1


def test_queue_keeps_order_and_spills():
    with induced.Scratch(256) as scratch:
        queue = induced.Queue(scratch, np.int64)
        for k in range(50):
            queue.put(k % 3, np.arange(10) + 10 * k)
        assert queue.file is not None
        got = np.concatenate(list(queue.all(1)))
        assert got.tolist() == [10 * k + x for k in range(1, 50, 3) for x in range(10)]
        back = []
        while (some := queue.take(2, last=True)) is not None:
            back = [*some.tolist(), *back]
        assert back == [10 * k + x for k in range(2, 50, 3) for x in range(10)]
        assert queue.take(1) is None


def test_a_strings_word_depends_on_the_string_alone():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, size=700).astype(np.uint8)
    text[300:500] = 97  # all words alike
    other = np.concatenate([rng.integers(97, 100, size=333).astype(np.uint8), text[100:650]])
    owner = []
    for raw in (text, other):
        doc, word, _, a, b = suffix_dedup.segments(raw, np.array([0, len(raw)]))
        assert a[0] == 0 and b[-1] == len(raw) - 199 and (a[1:] == b[:-1]).all() and (b - a).max() <= 169
        owner.append(np.repeat(word, b - a))
    assert (owner[0][100:451] == owner[1][333:684]).all()


def expected(texts, cap=200):
    raw = [(t or "").encode() for t in texts]
    out = []
    for p, twice in zip(raw, begin_twice(raw, cap)):
        gone = np.zeros(len(p) + 1, bool)
        for i in np.flatnonzero(twice):
            gone[i : i + cap] = True
        kept = np.frombuffer(p, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(p), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


def made(rng):
    def word():
        return "".join(rng.choice(list("abcdé "), size=rng.integers(1, 9)))

    def prose(n):
        return " ".join(word() for _ in range(n))

    passage, line = prose(150), "=" * 260
    texts = [prose(int(rng.integers(0, 120))) for _ in range(30)]
    texts += [prose(20) + passage + prose(20) for _ in range(25)]  # many contexts for one passage
    texts += [prose(30) + passage[50:260] + prose(5) for _ in range(5)]
    texts += [texts[3]] * 6 + [texts[32]] * 3 + [line, "x" + line, prose(9) + ("ab" * 400) + prose(9), prose(60) * 2, None, "", "a", "é" * 150]
    texts += [passage[:199], passage[:200], prose(40) + texts[40][:400]]
    return texts


@pytest.mark.parametrize("hot", [8192, 3])
def test_documents_without_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 5000)
    texts = made(np.random.default_rng(4))
    ids = [*range(len(texts) - 3), None, 7, 7]
    rows = spark.createDataFrame([(i, t, "other", 1) for i, t in zip(ids, texts)], "doc_id long, text string, key string, id int").repartition(3)
    got = sorted((tuple(r) for r in suffix_dedup.without_repeats(rows).collect()), key=str)
    assert got == sorted(((i, *x) for i, x in zip(ids, expected(texts))), key=str)


def test_what_is_left(spark):
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh"), size=300))
    rows = spark.createDataFrame([(1, "x1 " + shared + " y1"), (2, "x2 " + shared + " y2"), (3, "alone")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) if r.kept is not None else None for r in suffix_dedup.without_repeats(rows, keep_bytes=True).collect()}
    # the spaces and the letter around the passage are part of what repeats
    assert got == {1: b"x1" + b"1", 2: b"x2" + b"2", 3: None}
    assert suffix_dedup.without_repeats(rows.filter("false")).count() == 0


def test_long_texts_by_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rng = np.random.default_rng(6)
    raw = rng.integers(97, 123, size=6000).astype(np.uint8)
    starts = np.array([0, 10, 3000, 3300, 6000])
    doc, word, _, a, b = suffix_dedup._segments_of(raw, starts)
    for d in range(4):
        size, at = starts[d + 1] - starts[d], 0
        for x, y in zip(a[doc == d], b[doc == d]):
            assert x == at
            at = y
        assert at == max(0, size - 199)
    column = pa.array(["ab", None, "cdé"])[1:]
    bytes_, offsets = suffix_dedup._bytes_of(column)
    assert bytes(bytes_) == "cdé".encode() and offsets.tolist() == [0, 0, 4]


def test_whole_table(spark, sf):
    docs = common.table(spark, sf, "documents")
    got = sorted(tuple(r) for r in queries.op13_suffix_dedup(spark, sf).collect())
    given = docs.orderBy("doc_id").select("doc_id", "text").collect()
    assert got == [(r.doc_id, *x) for r, x in zip(given, expected([r.text for r in given]))]
    assert sum(r[2] for r in got) > 0
