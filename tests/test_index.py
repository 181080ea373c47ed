"""Sources, the index, its stream, and the registered queries."""

import io
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from occulta import catalogue
from occulta.operators.vault import value_hash
from occulta.sources import files
from occulta.sources.tables import materialise
from occulta.streaming import index

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def docx(*lines):
    out = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(text):
    stream = zlib.compress(f"BT ({text}) Tj ET".encode("latin-1"))
    return b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream\nendobj"


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for name, raw in {"a.txt": "écrire à a@b.fr".encode(), "b.docx": docx("Un", "Deux"), "c.pdf": pdf("Bonjour tout le monde"), "d.png": b"\x89PNG\r\n\x1a\nxx", "e.txt": b"", "f.zip": b"PK\x03\x04", "g.txt": b"DC04ABCD" + b"A" * 44}.items():
        (d / name).write_bytes(raw)
    (d / "m.eml").write_bytes("From: =?utf-8?q?Jos=C3=A9?= <j@x.fr>\nSubject: =?latin-1?q?=E9t=E9?=\nContent-Type: text/plain; charset=utf-8\n\nvoilà\n".encode())
    return str(d)


def test_extraction(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.read_files(spark, folder)).collect()}
    assert rows["a.txt"].text == "écrire à a@b.fr" and rows["b.docx"].text == "Un\nDeux" and rows["c.pdf"].text == "Bonjour tout le monde" and "e.txt" not in rows
    assert rows["d.png"].text is None and rows["d.png"].error == "no ocr" and rows["g.txt"].text == "⟦2DDOC_BARCODE_STRIPPED⟧"
    assert files.extract(files.read_files(spark, folder, "*.png"), lambda raw: "lu").first().text == "lu"
    listed = files.listing(spark, folder).collect()
    assert [r.name for r in listed] == sorted(r.name for r in listed) and not listed[0].truncated and {r.modality for r in listed} >= {"text", "image", "pdf", "document"}
    mail = files.read_mail(spark, folder).first()
    assert (mail["from"], mail.subject, mail.body.strip()) == ("José <j@x.fr>", "été", "voilà")


def test_lists_and_log(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"version": 1, "words": ["a", "b"]}')
    (tmp_path / "bad.json").write_text("{{{")
    assert sorted(r.x for r in files.read_list(spark, str(tmp_path / "l.json"), "string", "words").collect()) == ["a", "b"]
    assert files.read_list(spark, str(tmp_path / "none.json"), "string", "words").count() == 0 and files.read_list(spark, str(tmp_path / "bad.json"), "string", "words").count() == 0
    log = str(tmp_path / "log")
    assert files.read_audit(spark, log).count() == 0
    row = spark.createDataFrame([("t", "m", "anonymize", {"NOM": 1}, 1, True)], "timestamp string, mission string, event string, counts map<string,int>, total int, safe_to_send boolean")
    files.append_audit(row, log)
    files.append_audit(row, log)
    assert files.read_audit(spark, log).count() == 2


def tables(spark):
    shadows = spark.createDataFrame([], "content_hash string, src_path string, clean_text string, size long, mtime double, indexed_at timestamp, stale int")
    values = spark.createDataFrame([], "content_hash string, value_hash string")
    pending = spark.createDataFrame([], "src_path string, marked_at timestamp, fail_count int")
    return shadows, values, pending


def mask(df):
    """Texts in capitals; one that says so fails."""
    text = F.decode("content", "utf-8")
    return df.select("content_hash", F.upper(text).alias("clean_text"), F.when(F.contains(text, F.lit("bad")), "failed").otherwise("ok").alias("status"), F.array(F.expr(value_hash("'X'"))).alias("value_hashes"))


def counts(out):
    return {r.outcome: r.n for r in out["counts"].collect()}


def test_sweeps(spark):
    shadows, values, pending = tables(spark)
    rows = [(f"/d/{n}", 1, 1.0, t.encode(), None if t == "?" else t) for n, t in [("a.txt", "one"), ("b.txt", "two"), ("copy.txt", "one"), ("c.txt", "bad"), ("x.png", "img"), ("u.txt", "?")]]
    got = spark.createDataFrame(rows, "path string, size long, mtime double, content binary, content_hash string")
    out = index.sweep(got, shadows, values, pending, mask)
    assert counts(out) == {"indexed": 3, "failed": 1, "ignored": 1, "deferred": 1}
    state = [materialise(out[k], "t") for k in ("shadows", "values", "pending")]
    assert {r.clean_text for r in state[0].collect()} == {"ONE", "TWO"} and state[2].first().fail_count == 1
    for _ in range(4):
        out = index.sweep(got, *state, mask)
        state = [materialise(out[k], "t") for k in ("shadows", "values", "pending")]
    assert counts(out) == {"skipped": 3, "failed": 1, "ignored": 1, "deferred": 1}
    assert counts(index.sweep(got, *state, mask)) == {"skipped": 3, "quarantined": 1, "ignored": 1, "deferred": 1}
    assert index.has_work(got, state[0], state[2]) and not index.has_work(got.filter("content_hash <> '?' AND path <> '/d/c.txt'"), state[0], state[2])
    stale = index.mark_stale(state[0], state[1], spark.sql(f"SELECT {value_hash(chr(39) + ' x ' + chr(39))} AS value_hash"))
    assert {r.stale for r in stale.collect()} == {1} and index.current(stale).count() == 0
    answers, misses = index.read(got.select("path", "content_hash"), stale, ["TWO"])
    hits = {r.path: (r.status, r.text) for r in answers.collect()}
    assert hits["/d/a.txt"] == ("hit", "ONE") and hits["/d/b.txt"] == ("hit", "⟦NOM_∎⟧") and hits["/d/c.txt"] == ("miss", None) and misses.count() == 3
    assert index.clear_pending(state[2], misses).count() == 0


def test_stream(spark, folder, tmp_path):
    seen = []

    def each(batch, epoch):
        rows = batch.persist()
        seen.extend(r.path.rsplit("/", 1)[1] for r in rows.select("path").collect())
        rows.unpersist()

    for _ in range(2):
        q = index.stream(spark, folder, str(tmp_path / "cp"), each)
        q.awaitTermination(120)
    assert sorted(seen) == ["a.txt", "b.docx", "c.pdf", "d.png", "f.zip", "g.txt", "m.eml"]


def normal(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.ORACLE_SQL])
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    q = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(q.columns) == cols
    want = sorted((tuple(normal(r[q.columns.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
    assert sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_stale_values_wherever_they_stand(spark, tmp_path):
    """A value counts by its letters alone: whatever is before and behind it, in its own case, in overlapping candidates and copies."""
    v = "@mail1.example.com"
    texts = [f"a{v}", f"a{v}.au", f"a{v}s", f"a{v}.Et", f"a{v}.1", f"a{v}-x", f"a{v}é", f"a{v}\U0001f600", v, f" {v}", f"é{v}", f"@{v}", f"@x{v}", f"a@b.fr{v}", f"a@mail1.example.co{v}", f"x\n{v}\n", f"\U0001f600@\U0001f600 a{v}"]
    texts += [f"A{v.upper()}", "a@Mail1.example.com", "a@mail1.example.co", "a@mail1.example.co m", "a@ mail1.example.com", "a@mail1.example\n.com", "a@xmail1.example.com", "mail1.example.com", "@", "", None, f"a{v}", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(catalogue.ORACLE_SQL["stale_by_value"]).fetchall()
    assert len(want) == len(set(texts)) and sum(s for _, s in want) == 17
    assert sorted(map(repr, want)) == sorted(repr((r.content_hash, r.stale)) for r in catalogue.stale_by_value(spark, str(tmp_path)).collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
