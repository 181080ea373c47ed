"""Token files, packing and BPE against the tokenizers library."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from occulta.llm import bpe, common, packing, queries, token_files, tokenise

PATH = tokenise.default_path()
TEXTS = [
    "The quick, brown fox. It's 12.5%!", None, "", " \n\t ", "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>", "a.,b ... 'tis we'll", "Éa è ß Σας ΣΑΣ İi ﬁ ½ 가각 🎉👍🏽",
    "x" * 3000, "word " * 4000, "same", "same", "\x1c\x85\xa0a", "café. naïve, œuvre. «quoted.»",
]


@pytest.fixture(scope="module")
def library():
    return tokenise.encoder(PATH).tokenizer


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(7, "again", "y"), (None, "no id", "z"), (7, "again", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)


def expected_order(library, rows, end):
    out = []
    for d, t in rows:
        ids = np.array([*encoded(library, t), end], tokenise.encoder(PATH).dtype)
        out.append((d is not None, d or 0, zlib.crc32(ids.tobytes()), d, ids.astype("<u4")))
    return [(x[3], x[4]) for x in sorted(out, key=lambda x: x[:3])]


@given(st.text(alphabet="abThe inger'.,!?0123éÈß\n\t<|>endoftextΣς́ \x1c\x85", max_size=40))
@settings(max_examples=300, deadline=None)
def test_encoders_equal_the_library(text):
    library = tokenise.encoder(PATH).tokenizer
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.codec(PATH).encode(text) == ids
    assert np.frombuffer(tokenise.encoder(PATH).encode([text])[0], tokenise.encoder(PATH).dtype).tolist() == ids
    assert bpe.codec(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cache_limits_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(tokenise, "CACHE_CHUNKS", 6)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 5)
    e, p = tokenise.ChunkEncoder(PATH), bpe.PrefixBPE(PATH)
    for _ in range(3):
        for t in TEXTS:
            assert np.frombuffer(e.encode([t, t])[1], e.dtype).tolist() == encoded(library, t)
            assert p.digests(t)[0] == len(encoded(library, t))


def test_bpe_query_form(spark, docs, library):
    got = sorted(map(tuple, bpe.encode_decode(docs, PATH).collect()), key=str)
    want = []
    for d, t, _ in docs.collect():
        ids = encoded(library, t)
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_packed_files(width, tmp_path):
    rng = random.Random(width)
    docs = [(k if k != 3 else None, np.array([rng.randrange(1 << width) for _ in range(n)], "<u4")) for k, n in enumerate([0, 5, 70_000, 1, 0, 3])]
    uri = f"file://{tmp_path}/a/b.octk"
    assert token_files.write(uri, iter(docs), width) == (6, 70_009)
    r = token_files.Reader(uri)
    for at_once in (1, 10, 1 << 20):
        got = list(r.documents(at_once))
        assert [g[0] for g in got] == [d for d, _ in docs]
        assert all((g[2] == i).all() for g, (_, i) in zip(got, docs))
    assert (r.document(2) == docs[2][1]).all() and (r.tokens(50_000, 50_010) == np.concatenate([i for _, i in docs])[50_000:50_010]).all()
    assert token_files.width_for(49_408) == 16 and token_files.width_for(1) == 1 and token_files.width_for(65_537) == 17


def test_token_files_of_a_table(spark, docs, library, tmp_path):
    manifest = token_files.write_token_files(docs, PATH, 2, f"file://{tmp_path}/t", shards=5)
    got = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=lambda r: r[1])
    before = 0
    for (d, ids), row in zip(expected_order(library, [(r[0], r[1]) for r in docs.collect()], 2), got, strict=True):
        assert row == (d, before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)


def test_hot_id_is_spread(spark, library, tmp_path):
    rows = [(5, f"text {k}") for k in range(200)] + [(k, "x") for k in range(20)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2, f"file://{tmp_path}/t", shards=6)
    assert max(r["n_docs"] for r in manifest.collect()) < 150
    ids = [r["doc_id"] for r in sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r["start"])]
    assert ids == sorted(ids) and len(ids) == 220


def check_packing(library, rows, pieces, length):
    want = sorted((d, zlib.crc32(np.array([*encoded(library, t), 1], "<u4").tobytes())) for d, t in rows if d is not None)
    sequences = {}
    for p in pieces:
        assert 0 < p.length <= length
        sequences.setdefault(p.sequence_id, []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for s, ps in sequences.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == length or s == len(sequences) - 1
    return want


def test_packing(spark, docs, library):
    pieces = packing.pack(docs, PATH, 1, 64).collect()
    check_packing(library, [(r[0], r[1]) for r in docs.collect()], pieces, 64)
    total = sum(len(encoded(library, r[1])) + 1 for r in docs.collect())
    assert sum(p.length for p in pieces) == total
    by = {}
    for p in pieces:
        if p.doc_id not in (7, None):
            by.setdefault(p.doc_id, []).append(p)
    for d, ps in by.items():
        ids = np.array([*encoded(library, TEXTS[d]), 1], "<u4")
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    assert [packing.padded_length(n) for n in (1, 3, 1024, 2047, 2048)] == [1, 2048, 1024, 2048, 2048]


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0
    assert bpe.encode_decode(none, PATH).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, PATH, 2, f"file://{tmp_path}/t", 3)).count() == 0


def test_registered_queries(spark, sf, library):
    rows = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    before = 0
    for r in sorted(queries.op1_token_files(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = np.array([*encoded(library, rows[r.doc_id]), 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (before, len(ids), zlib.crc32(ids.tobytes()))
        before += len(ids)
    pieces = queries.op3_packing(spark, sf).collect()
    check_packing(library, rows.items(), pieces, 2048)
    for r in queries.op9_bpe(spark, sf).collect():
        ids = encoded(library, rows[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_files_by_size_and_whole_ids(spark, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 2000)
    monkeypatch.setattr(token_files, "GROUP", 3)
    big = 2**63 - 400
    rows = [(big + k, f"text {k} " * 5, 0) for k in range(300)] + [(None, f"null {k}", 0) for k in range(150)] + [(7, f"hot {k}", 0) for k in range(150)] + [(-(2**63), None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    manifest = token_files.write_token_files(docs, PATH, 2, str(tmp_path / "files"))
    sizes = [r.n_docs for r in manifest.collect()]
    assert len(sizes) > 6 and max(sizes) < 200 and sum(sizes) == len(rows)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(manifest).collect())
    want = [(d, np.array([*encoded(library, t), 2], "<u4")) for d, t, _ in rows]
    start = 0
    order = sorted(((d is not None, d or 0, zlib.crc32(x.astype(tokenise.encoder(PATH).dtype).tobytes()), x) for d, x in want), key=lambda x: x[:3])
    for (has, d, _, x), r in zip(order, got):
        assert r == (start, d if has else None, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_caches_are_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(tokenise, "CACHE_BYTES", 5000)
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    e, p = tokenise.ChunkEncoder(PATH), bpe.PrefixBPE(PATH)
    texts = ["x" * 4000 + str(k) + " the cat" for k in range(20)]
    for t in texts:
        assert np.frombuffer(e.encode([t])[0], e.dtype).tolist() == encoded(library, t)
        assert p.digests(t)[0] == len(encoded(library, t))
    assert sum(map(len, e.cache)) < 20_000 and sum(map(len, p.cache)) < 20_000


def test_a_symbol_without_a_token_is_an_error():
    p = bpe.PrefixBPE(PATH)
    p.automaton = type(p.automaton)()
    p.automaton.add_word("a", (1, 0))
    p.automaton.make_automaton()
    with pytest.raises(ValueError, match="no token"):
        p.encode_piece("zz")
