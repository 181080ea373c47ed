"""Sinks, gates, statistics and hooks not covered elsewhere."""

import hashlib
import hmac
import html
import json
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from occulta import catalogue
from occulta.functions import gate, spans
from occulta.operators import lists, presets, soft, vault
from occulta.operators.masker import Masker, contain_results, mask_json, restore, rewrite_outputs
from occulta.operators.spec import Recognizer
from occulta.plans import analytics, profile, review, verdict
from occulta.sources import files
from occulta.sources.tables import materialise
from occulta.streaming import index


def one(spark, **columns):
    return spark.range(1).select(*[F.expr(sql).alias(name) for name, sql in columns.items()]).first()


def test_gates(spark):
    row = one(spark, a=gate.rewritable("'text'", "'x'"), b=gate.rewritable("'object'", "'x'"), c=gate.rewritable("'text'", "repeat('x', 200001)"), d=files.labels_for_journal("array('\\\\Seen', 'INBOX', 'Dupont')"), e=vault.masked_value("'Jean Dupont'"), f=f"{vault.row_id(chr(39) + ' Jean ' + chr(39), 'k')} = {vault.row_id(chr(39) + 'jean' + chr(39), 'k')}")
    assert (row.a, row.b, row.c) == (True, False, False) and row.d == ["\\Seen", "INBOX", "custom-label"] and row.e == "Je•• Du••••" and row.f
    cases = [("IBAN", "FR76", 1.0, True), ("IBAN", "FR76", 0.5, False), ("EMAIL", "a@gmail.com", 1.0, True), ("EMAIL", "a@example.com", 1.0, False), ("NOM", "Jean", 1.0, False)]
    rows = spark.createDataFrame(cases, "type string, value string, score double, want boolean").withColumn("m", F.struct("type", "value", "score")).select("want", F.expr(gate.publishable_risk()).alias("got"), F.expr(gate.redacted()).alias("r")).collect()
    assert all(r.got == r.want for r in rows) and rows[2].r == "EMAIL len11 xxxxxx•"


def test_outcomes(spark):
    ents, none = "array(1)", "cast(array() AS array<int>)"
    row = one(spark, a=verdict.verified("13", "false", "0", ents, none), b=verdict.verified("1", "true", "0", ents, none), c=verdict.verified("1", "false", "0", ents, none), d=verdict.verified("1", "false", "0", none, none), e=verdict.verified("1", "false", "2", none, none), f=verdict.added("true", "'floor'", "'more'"), g=verdict.added("false", "'floor'", "'more'"))
    assert list(row) == ["too_large", "unverified", "ok", "fail_closed", "ok", "floor", "more"]


def test_windowed_answers(spark):
    @F.pandas_udf("string")
    def model(chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda c: None if "fail" in c else "NOM: Jean\nEMAIL: a@b.fr" if "Jean" in c else "(aucune)")

    docs = spark.createDataFrame([(1, "Jean " * 3000), (2, "x" * 6000 + "fail"), (3, ""), (4, "rien")], "doc_id long, text string")
    got = {r.doc_id: r for r in soft.windowed_entities(docs, model).collect()}
    assert [(x.type, x.text) for x in got[1].entities] == [("EMAIL", "a@b.fr"), ("NOM", "Jean")] and got[2].failed and got[2].entities is None and got[4].entities == []
    span = "array(named_struct('s', 0, 'e', 4, 'type', 'NOM', 'value', 'Jean', 'score', 0.7D, 'priority', 5))"
    modes = [one(spark, x=soft.by_mode(f"'{m}'", "'Jean dort'", span, span)).x for m in ("gliner", "openai", "both", "odd")]
    assert [len(m) for m in modes] == [1, 1, 1, 1]
    row = one(spark, x=soft.entity_spans("'vu Jean'", "array(named_struct('type', 'NOM', 'text', 'Jean'), named_struct('type', 'NOM', 'text', 'Paul'))"))
    assert [(m.s, m.e) for m in row.x] == [(3, 7)]


def test_sinks_and_statistics(spark, tmp_path):
    docs = spark.createDataFrame([(1, "m", "a@b.fr\nligne"), (2, "m", "rien")], "doc_id long, mission string, text string")
    out, known = Masker().mask(docs)
    done = files.write_dossier(out.select(F.col("mission").alias("dossier"), F.concat(F.lit("n/"), "doc_id").alias("name"), "masked"), known, str(tmp_path)).collect()
    assert [(r.dossier, r.part, r.n_documents) for r in done] == [("m", 0, 2)]
    with zipfile.ZipFile(done[0].file) as z:
        assert z.namelist() == ["anonymise/01 - n_1.txt", "anonymise/02 - n_2.txt", "manifest.json"]
        assert z.read("anonymise/01 - n_1.txt").decode() == "⟦EMAIL_0001⟧\nligne" and json.loads(z.read("manifest.json"))["documents"] == z.namelist()[:2]
    assert spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/correspondance").first().value == "a@b.fr"
    log = {r.total: r for r in analytics.audit_rows(out).collect()}
    assert log[1].counts == {"EMAIL": 1} and log[0].counts == {} and log[0].safe_to_send
    store = spark.sql("SELECT 7L AS total, 2L AS files")
    audit = analytics.summary(spark.createDataFrame([], "event string, safe_to_send boolean, counts map<string,string>"))
    merged = analytics.merged_stats(store, audit).first()
    assert (merged.total_entities, merged.files, merged.total_runs) == (7, 2, 0)
    halves = one(spark, x=analytics.split_by_score("array(named_struct('score', 0.5D), named_struct('score', 0.6D))")).x
    assert (len(halves.confident), len(halves.to_review)) == (1, 1)
    used = index.used_hashes(out.select(F.lit("h").alias("content_hash"), "mission", F.col("masked").alias("clean_text")), known)
    assert [r.value_hash for r in used.collect()] == [one(spark, x=vault.value_hash("'a@b.fr'")).x]


def test_lists_of_known_values(spark):
    gaz = spark.createDataFrame([("Jean Dupont", "NOM", "1")], "value string, entity_type string, added_at string")
    v = spark.createDataFrame([("NOM", "JEAN DUPONT"), ("EMAIL", "a@b.fr"), ("MONTANT", "12 €")], "type string, value string")
    new = lists.seeds(v, gaz)
    assert [(r.value, r.entity_type) for r in new.collect()] == [("a@b.fr", "EMAIL")]
    off = spark.createDataFrame([("A@B.fr", "t")], "value string, unmasked_at string")
    assert lists.conflicts(new, off).count() == 1
    assert lists.removed(gaz, spark.sql("SELECT ' jean dupont ' AS value")).count() == 0
    assert lists.upserted(gaz, spark.createDataFrame([("jean dupont", "NOM", "2"), (" ", "NOM", "2"), ("x", "NOM", "2")], gaz.schema)).count() == 2
    assert lists.merged(v, None).count() == 3 and lists.merged(v, v).count() == 3
    rows = spark.createDataFrame([("NOM", 0.8, 5, True), ("NOM", 0.8, 50, False), ("NOM", 0.85, 50, True), ("EMAIL", 1.0, 99, False)], "type string, score double, priority int, want boolean").withColumn("m", F.struct("type", "score", "priority")).select("want", F.expr(lists.learnable()).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_detector_hook_and_masking_twice(spark):
    m = Masker()
    m.register_detector("codes", lambda df: F.expr(f"transform({spans.hits('text', 'ZZ[0-9]+')}, x -> {spans.made('CODE', '1.0D', 5)})"))
    docs = spark.createDataFrame([(1, "ZZ12 et ZZ13, a@b.fr")], "doc_id long, text string")
    out, known = m.mask(docs)
    assert out.first().masked == "⟦CODE_0001⟧ et ⟦CODE_0002⟧, ⟦EMAIL_0001⟧"
    again, _ = m.mask(out.select("doc_id", F.col("masked").alias("text")), known)
    assert again.first().masked == out.first().masked


def test_live_counts(spark, tmp_path):
    rows = [("/a", "NOM", "0001", "2026-01-01 00:00:00"), ("/a", "NOM", "0001", "2026-01-01 00:00:01"), ("/b", "NOM", "0001", "2026-01-01 00:00:02"), ("/b", "TEL", "0001", "2026-01-01 00:00:03")]
    spark.createDataFrame(rows, "path string, type string, number string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, type string, number string, ts timestamp").parquet(f"{tmp_path}/in")
    q = index.live_counts(stream).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    assert {r.type: r["count"] for r in spark.sql("SELECT * FROM live").collect()} == {"NOM": 2, "TEL": 1}


def test_large_and_long_variant_groups(spark):
    firsts = [("Prénom%02d DUPONT" % k) for k in range(30)]
    chain = [f"CHAINE{k:03d} CHAINE{k + 1:03d}" for k in range(70)]
    rows = [("m", "NOM", v, k + 1, "", "") for k, v in enumerate([*firsts, *chain, "Seul"])]
    v = spark.createDataFrame(rows, "mission string, type string, value string, number long, variant string, token string").withColumn("created_at", F.current_timestamp())
    got = {r.value: r for r in vault.variant_groups(v).collect()}
    assert [got[x].token for x in (firsts[0], firsts[25], firsts[26], firsts[29])] == ["⟦NOM_0001a⟧", "⟦NOM_0001z⟧", "⟦NOM_0001aa⟧", "⟦NOM_0001ad⟧"]
    assert {got[x].number for x in chain} == {31} and len({got[x].token for x in chain}) == 70 and got["Seul"].token == "⟦NOM_0101⟧"
    assert spark.range(1).select(F.expr(f"regexp_extract_all('⟦NOM_0001ad⟧', r'{spans.TOKEN}', 0)").alias("x")).first().x == ["⟦NOM_0001ad⟧"]


def test_highlight_documents(spark, sf):
    docs = {r.doc_id: r.text for r in catalogue.table(spark, sf, "documents").collect()}
    got = {r.doc_id: r.html for r in catalogue.highlight_documents(spark, sf).collect()}
    want = {d: "".join(f'<mark title="EMAIL">{html.escape(p, False)}</mark>' if k % 2 else html.escape(p, False).replace('"', "&quot;") for k, p in enumerate(re.split(f"({catalogue.EMAIL})", t or ""))) for d, t in docs.items()}
    assert got == want and any("<mark" in h for h in got.values())


def test_replace_outside_documents(spark, sf):
    docs = {r.doc_id: r.text for r in catalogue.table(spark, sf, "documents").collect()}
    token = "⟦NOM_0001the⟧"
    want = {}
    for d, t in docs.items():
        gaps = re.split(f"({spans.TOKEN})", t.replace(" of ", f" {token} "))[::4]
        tokens = [m.group() for m in re.finditer(spans.TOKEN, t.replace(" of ", f" {token} "))]
        want[d] = ("".join(g.replace("the", "THE") + x for g, x in zip(gaps, [*tokens, ""])), sum(g.count("the") for g in gaps))
    assert {r.doc_id: (r.out, r.n) for r in catalogue.replace_outside_documents(spark, sf).collect()} == want and any(token in o for o, _ in want.values())


def test_sweep_across_long_white_space(spark):
    text = "vu Jean" + " " * 90 + "\n" * 40 + "Dupont hier"
    docs = spark.createDataFrame([("d", 1, text)], "dossier string, doc_id long, text string")
    known = spark.createDataFrame([("d", "NOM", "Jean Dupont", "value")], "dossier string, type string, value string, kind string")
    got = profile.sweep(docs, known).first().swept
    assert [(m.s, m.e) for m in got] == [(3, len(text) - 5)]


def test_values_found_whatever_case_accents_and_length(spark):
    docs = spark.createDataFrame([(1, "İİ x Dupont ici"), (1, "vu E\u0301lodie  Le\u0301ger et ELODIE\n\n\nLEGER, x_leger"), (None, "dupont"), (None, "DUPONT!"), (2, "dupontel, jean, paul"), (3, None), (4, "")], "doc_id long, text string")
    known = spark.createDataFrame([("Dupont", "NOM"), ("Élodie Léger", "NOM"), ("jean, paul", "NOM"), ("  ", "NOM"), ("--", "NOM"), (None, "NOM")], "value string, entity_type string")
    got = {r.text: [m.value for m in r.known] for r in lists.dictionary_spans(docs, known).collect()}
    assert got == {"İİ x Dupont ici": ["Dupont"], docs.collect()[1].text: ["E\u0301lodie  Le\u0301ger", "ELODIE\n\n\nLEGER"], "dupont": ["dupont"], "DUPONT!": ["DUPONT"], "dupontel, jean, paul": ["jean, paul"], None: [], "": []}
    assert lists.dictionary_spans(docs, known.filter("false")).filter("size(known) > 0").count() == 0
    masked, _ = Masker(dictionary=known).mask(docs)
    assert "Dupont" not in str([r.masked for r in masked.collect()]) and masked.count() == 7


def test_model_names_are_swept_and_widened(spark):
    def load():
        def model(texts):
            return [[{"label": "person name", "text": w, "start": t.find(w), "end": t.find(w) + len(w), "score": s} for w, s in (("Kowalska", 0.9), ("Anna Kowalska", 0.25)) if w in t] for t in texts]

        return model

    docs = spark.createDataFrame([(1, "vu Anna Kowalska hier, et KOWALSKA demain"), (1, "kowalska seule")], "doc_id long, text string")
    soft_ = materialise(soft.model_spans(docs, soft.model_udf(load)), "soft")
    assert {r.text: [m.value for m in r.soft] for r in soft_.collect()} == {"vu Anna Kowalska hier, et KOWALSKA demain": ["Anna Kowalska"], "kowalska seule": []}
    found = Masker(extra={"soft": lambda d: F.col("soft")}).detect(soft_)
    assert {tuple(m.value for m in r.spans) for r in found.collect()} == {("Anna Kowalska", "KOWALSKA"), ()}


def test_presets(spark):
    docs = spark.createDataFrame([(1, "Mme Anne PETIT et M. Paul BON de l'AMF, 45 000 €, marie@acme.com")], "doc_id long, text string")
    allow = lists.allowed(["amf"], ["acme.com"], [])
    kinds = lambda m: [(x.type, x.value) for x in m.detect(docs).first().spans]
    assert kinds(presets.web({"MONTANT": False, "NOM": False}, allow)) == [("NOM", "Mme Anne PETIT"), ("NOM", "M. Paul BON")]
    words = spark.createDataFrame([("m. paul bon",)], "word string")
    assert kinds(presets.standard(spark, allow=allow, common=words)) == [("NOM", "Mme Anne PETIT")]
    gazetteer = spark.createDataFrame([("M. Paul Bon", "NOM")], "value string, entity_type string")
    assert kinds(presets.standard(spark, gazetteer, policy={"MONTANT": True}, allow=allow, common=words)) == [("NOM", "Mme Anne PETIT"), ("NOM", "M. Paul BON"), ("MONTANT", "45 000 €")]


def test_json_and_tool_results(spark):
    texts = [
        '{"a@b.fr": ", \\"x\\": ", "k": ["a@b.fr", 1, {"z": "é\\n06 12 34 56 78 \\u00e9"}], "e": ""}', "no json a@b.fr", None, '"a@b.fr"', "[]", '{"k": "rien"}', '{"k": "rien"}',
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, json string")
    out, known = mask_json(docs, Masker())
    got = {r.doc_id: r for r in out.collect()}
    assert json.loads(got[0].masked) == {"a@b.fr": ', "x": ', "k": ["⟦EMAIL_0001⟧", 1, {"z": "é\n⟦TEL_0001⟧ é"}], "e": ""} and got[0].n_changed == 2
    assert [got[k].masked for k in (1, 2, 4, 5, 6)] == [texts[k] for k in (1, 2, 4, 5, 6)] and got[3].masked == '"⟦EMAIL_0001⟧"' and len(got) == 7
    results = docs.withColumn("tool", F.when(F.col("doc_id") == 3, F.lit("mail_read")).otherwise(F.lit("other")))
    contained = {r.doc_id: (r.masked, r.rewritten) for r in contain_results(results, Masker(), "^mail_")[0].collect()}
    assert contained[3] == ('"⟦EMAIL_0001⟧"', True) and contained[0] == (texts[0], False)
    rows = spark.createDataFrame([(1, "text", "a@b.fr"), (2, "text", "rien"), (3, "image", "a@b.fr"), (4, None, None)], "doc_id long, shape string, text string")
    done = {r.doc_id: (r.masked, r.rewritten) for r in rewrite_outputs(rows, Masker(), True)[0].collect()}
    assert done == {1: ("⟦EMAIL_0001⟧", True), 2: ("rien", False), 3: ("a@b.fr", False), 4: (None, False)}
    assert {r.rewritten for r in rewrite_outputs(rows, Masker(), False)[0].collect()} == {False}


def test_vault_at_rest_and_opaque_ids(spark, tmp_path):
    v = spark.createDataFrame([("m", "NOM", "Marie"), ("m", "NOM", "sealed1:odd"), ("n", "TEL", "")], "mission string, type string, value string").withColumn("created_at", F.current_timestamp())
    key = vault.derived("pass", b"salt", 1000)
    assert len(key) == 32 and key == vault.derived("pass", b"salt", 1000) != vault.derived("pass", b"tlas", 1000)
    path = f"{tmp_path}/vault"
    v.write.parquet(path)
    assert vault.migrate(spark, path, key) == 3 and vault.migrate(spark, path, key) == 0
    stored = spark.read.parquet(path)
    assert vault.plaintext_count(stored) == 0 and {r.value for r in vault.opened(stored, key).collect()} == {"Marie", "sealed1:odd", ""}
    assert key.hex() not in vault.sealed(v, key)._jdf.queryExecution().toString().lower()
    with pytest.raises(Exception):
        vault.opened(stored, vault.derived("other", b"salt", 1000)).collect()
    odd = "it's a \"key\""
    ids = {r.value: r.i for r in v.select("value", F.expr(vault.row_id("value", odd)).alias("i")).collect()}
    assert ids["Marie"] == hmac.new(odd.encode(), b"marie", hashlib.sha256).hexdigest()[:24]
    chosen = spark.createDataFrame([(ids["Marie"],)], "row_id string")
    assert [r.value for r in vault.by_row_id(v, chosen, odd).collect()] == ["Marie"]
    assert {r.mission: r.n_values for r in vault.missions(v).collect()} == {"m": 2, "n": 1}
    assert vault.purged(v, 1).count() == 3 and vault.purged(v, 1, F.current_timestamp() + F.expr("INTERVAL 2 DAYS")).count() == 0
    value, log = vault.revealed(v.withColumn("token", F.col("value")), "m", "Marie")
    assert value.first().value == "Marie" and log.first().event == "vault_reveal" and "Marie" not in str(log.first())


def test_safe_words_sidecars_and_references(spark, tmp_path):
    safe = spark.createDataFrame([("vert",)], "word string")
    assert {r.word for r in review.safe_added(safe, " Petit ", "petit").collect()} == {"vert", "petit"} and review.safe_removed(safe, "VERT").count() == 0
    with pytest.raises(ValueError):
        review.safe_added(safe, "Petit", "petits")
    assert review.read_sidecars(spark, f"{tmp_path}/none").count() == 0
    with open(f"{tmp_path}/side.jsonl", "w") as f:
        for value, doc in (("Paul", "a"), ("paul", "b"), ("paul", "b"), ("", "c"), ("Max", "depollute")):
            f.write(json.dumps({"value": value, "entity_type": "NOM", "source_doc": doc, "ts": "2026-01-01T00:00:00"}) + "\n")
    found = review.read_sidecars(spark, f"{tmp_path}/side.jsonl")
    items = review.queue(found, spark.createDataFrame([], "value string"))
    got = {r.normalized: r for r in review.shown(items, review.references(found), 1).collect()}
    assert (got["PAUL"].occurrence_count, got["PAUL"].n_docs, got["PAUL"].doc_refs) == (2, 2, ["a"]) and got["MAX"].from_depollute and not got["PAUL"].from_depollute


def test_probe_scan_mail_order_and_pdf_strings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    paths = spark.createDataFrame([(f"file://{tmp_path}/a.txt",), (f"{tmp_path}/a.txt",), (f"{tmp_path}/gone.txt",), (None,)], "path string")
    assert [r.status for r in files.probe(paths).collect()] == ["ok", "ok", "deferred", "deferred"]
    names = {"/r/a.py": True, "/r/README": True, "/r/fixtures/a.py": False, "/r/a.png": False, "/r/.git/x.txt": False}
    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", F.expr(files.scannable()).alias("s")).collect()
    assert {r.path: r.s for r in rows} == names
    for uid in ("9", "10", "x"):
        (tmp_path / f"{uid}.eml").write_bytes(b"From: a@b.fr\r\nSubject: s\r\n\r\nbody")
    assert sorted(r.uid for r in files.read_mail(spark, str(tmp_path), 2).collect()) == ["10", "x"]
    assert files.pdf_string(b"<48 656C6C6F>") == "Hello" and files.pdf_string(b"<FEFF00E9>") == "é" and files.pdf_string(rb"(a\)\101)") == "a)A"
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\nstream\nBT <426f6e6a6f7572> Tj ET\nendstream"
    assert files.pdf_text(pdf) == ("Bonjour", 1)
    glued = b"%PDF-1.4\nstream\nBT (" + b"gerantETESTONIdeLaSocieteDuNordOuest " * 40 + b") Tj ET\nendstream"
    given = spark.createDataFrame([("/x.pdf", bytearray(glued))], "path string, content binary")
    assert files.extract(given, lambda raw: "un texte clair et net").first().text == "un texte clair et net"


def test_residual_rounds_carry_only_what_is_left(spark):
    docs = spark.createDataFrame([(k, f"a{k}@b.fr") for k in range(20)] + [(99, "rien")], "doc_id long, text string")
    # a recogniser that finds something only in what masking leaves
    late = Recognizer("LATE", r"(?<=⟧) ?fin[0-9]+", 1)
    docs = docs.unionByName(spark.createDataFrame([(100, "c@d.fr fin12")], "doc_id long, text string"))
    out, known = Masker(extra_recognizers=[late]).mask(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == 22 and rows[100].masked == "⟦EMAIL_0021⟧⟦LATE_0001⟧" and [e.phase for e in rows[100].entities] == ["body", "residual"]
    assert known.groupBy("mission", "type", "number").count().filter("count > 1").count() == 0
    assert {r.doc_id: r.restored for r in restore(out, known).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_viterbi_bias_requests_locks_and_guarded_files(spark, tmp_path):
    names = ["O", "B-NOM", "I-NOM", "E-NOM", "S-NOM"]
    grid = [[1.0, 0.0, 0.0, 0.0, 0.9], [1.0, 0.0, 0.0, 0.0, 0.0]]
    assert soft.decoded([grid], [names]) == [[]]
    (span,) = soft.decoded([grid], [names], {"single": 2.0, "outside": -1.0})[0:1]
    assert [x[:3] for x in span][:1] == [(0, 1, "NOM")] and 0 < span[0][3] < 0.5
    df = spark.createDataFrame([(grid, names)], "logits array<array<double>>, labels array<string>")
    assert df.select(soft.viterbi_udf({"single": 2.0})("logits", "labels").alias("x")).first().x[0].category == "NOM"
    asked = spark.createDataFrame([("a/b.pdf", "0" * 64, True), ("/a", "0" * 64, False), ("a/../b", "0" * 64, False), ("a", "xyz", False), ("c:\\a", "0" * 64, False)], "path string, content_hash string, want boolean")
    assert all(r.got == r.want for r in asked.withColumn("got", F.expr(index.requestable())).collect())
    with index.single_run(spark, str(tmp_path)):
        with pytest.raises(index.Busy), index.single_run(spark, str(tmp_path)):
            pass
    with index.single_run(spark, str(tmp_path)), index.single_run(spark, str(tmp_path), stale_hours=-1):
        pass
    rows = spark.createDataFrame([("/p/a", "é", 1, 0), ("/q/b", "x", 0, 0), (None, "y", 0, 0)], "name string, restored string, n_restored int, n_unresolved int")
    report = {r.name: (r.n_bytes, r.refused) for r in files.restored_files(rows, f"{tmp_path}/out", "startswith(name, '/p/')").collect()}
    assert report == {"/p/a": (2, False), "/q/b": (0, True), None: (0, True)} and spark.read.parquet(f"{tmp_path}/out").count() == 1
