"""Masking, vault, restoring, verdicts, profiles, soft layers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from occulta.functions import spans as S
from occulta.operators import soft, vault
from occulta.operators.masker import Masker, anonymise_mail, highlight, json_strings, replace_outside_tokens, restore, serve_net, unresolved
from occulta.operators.recognizers import core
from occulta.plans import analytics, profile, review, verdict

PROSE = "Le marché reste calme et les taux bougent peu cette semaine selon nos notes internes du jour."


def docs_of(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_mask_and_restore(spark):
    texts = ["Monsieur Jean Dupont, jean@ex.fr, 06 12 34 56 78", "Écrire à jean@ex.fr ou marie@ex.fr", PROSE, "ok", None, "IBAN FR00 0000 0000 0000 0000 0000 000 du client."]
    out, known = Masker().mask(docs_of(spark, *texts))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].masked == "⟦NOM_0001⟧, ⟦EMAIL_0001⟧, ⟦TEL_0001⟧" and rows[1].masked == "Écrire à ⟦EMAIL_0001⟧ ou ⟦EMAIL_0002⟧"
    assert [rows[k].state for k in range(6)] == ["masked_ok", "masked_ok", "zero_detection", "nothing_to_do", "nothing_to_do", "low_confidence"]
    assert [rows[k].safe for k in range(6)] == [True, True, False, True, True, False]
    back = {r.doc_id: r for r in restore(out, known).collect()}
    assert all(back[k].restored == (texts[k] or "") for k in range(6)) and back[1].n_restored == 2
    foreign = restore(out.limit(1).withColumn("masked", F.lit("⟦NOM_0001⟧ ⟦NOM_9999⟧")), known).first()
    assert foreign.restored.endswith("⟦NOM_9999⟧") and foreign.n_unresolved == 1
    more, grown = Masker().mask(docs_of(spark, "marie@ex.fr et paul@ex.fr"), known)
    assert more.first().masked == "⟦EMAIL_0002⟧ et ⟦EMAIL_0003⟧" and grown.count() == known.count() + 1


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a@b.fr"), (1, "vu c@d.fr et a@b.fr"), (1, "a@b.fr"), (None, "e@f.fr"), (None, "rien")]
    out, known = Masker().mask(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.original, r.masked) for r in out.collect())
    assert len(got) == 5 and known.count() == 3 and all("@" not in m and (m == o) == (o == "rien") for o, m in got)
    assert sorted(r.restored for r in restore(out, known).collect()) == sorted(t for _, t in rows)
    none, vault_ = Masker().mask(spark.createDataFrame([], "doc_id long, text string"))
    assert none.count() == 0 and vault_.count() == 0


def test_surrogates_and_policy(spark):
    out, known = Masker(surrogates=True).mask(docs_of(spark, "marie@ex.fr 06 12 34 56 78"))
    assert "marie" not in out.first().masked and "@exemple.invalid" in out.first().masked
    many = spark.range(300).selectExpr("'NOM' AS type", "id + 1 AS number", "'' AS value").select(vault.surrogate().alias("x"))
    assert many.distinct().count() == 300
    kept = Masker(keep="m.type <> 'MONTANT'").detect(docs_of(spark, "45 000 € à a@b.fr")).first().spans
    assert [m.type for m in kept] == ["EMAIL"]


def test_numbering_over_partitions(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("'m' AS mission", "CASE WHEN id % 3 = 0 THEN 'A' ELSE 'B' END AS type", "concat('v', id % 1000) AS value", "id AS doc_id", "0 AS s")
    got = vault.allocate(rows).collect()
    by = {}
    for r in got:
        by.setdefault(r.type, {})[r.value] = r.number
    want = {"A": {}, "B": {}}
    for k in range(5000):
        t = want["A" if k % 3 == 0 else "B"]
        t.setdefault(f"v{k % 1000}", len(t) + 1)
    assert by == want


def test_vault_operations(spark):
    v = spark.createDataFrame([("m", "NOM", "Marie Dubois", 1, "", "⟦NOM_0001⟧"), ("m", "NOM", "Dubois", 2, "", "⟦NOM_0002⟧"), ("m", "NOM", "Paul Durand", 3, "", "⟦NOM_0003⟧"), ("m", "LIEU_NAISSANCE", "Dubois", 1, "", "⟦LIEU_NAISSANCE_0001⟧")], "mission string, type string, value string, number long, variant string, token string").withColumn("created_at", F.current_timestamp())
    got = {(r.type, r.value): r.token for r in vault.variant_groups(v).collect()}
    assert got == {("NOM", "Marie Dubois"): "⟦NOM_0001a⟧", ("NOM", "Dubois"): "⟦NOM_0001b⟧", ("NOM", "Paul Durand"): "⟦NOM_0003⟧", ("LIEU_NAISSANCE", "Dubois"): "⟦LIEU_NAISSANCE_0001⟧"}
    assert vault.forget(v, "Dubois").count() == 2 and vault.forget_subject(v, "dubois").count() == 1 and vault.forget_subject(v, " ").count() == 4
    assert vault.subject_count(v, "DUBOIS").first().n_values == 3
    assert vault.rectify(v, "Dubois", "Duval").filter("value = 'Duval' AND token = '⟦NOM_0002⟧'").count() == 1
    assert v.filter(vault.expired(1)).count() == 0 and v.filter(vault.expired(1, F.current_timestamp() + F.expr("INTERVAL 2 DAYS"))).count() == 4
    key = "0123456789abcdef"
    sealed = vault.sealed(v, key)
    assert sealed.filter(vault.plaintext(sealed)).count() == 0 and v.filter(vault.plaintext(v)).count() == 4
    assert {r.value for r in vault.opened(sealed, key).collect()} == {r.value for r in v.collect()}
    with pytest.raises(Exception):
        vault.opened(sealed, "0" * 16).collect()


def test_text_rewrites(spark):
    row = spark.sql("SELECT 'x ⟦NOM_0001⟧ Jean NOM_0001 Jean' AS t, '{\"a\": \"b\\\\\"c\", \"d\": [\"e\", 1]}' AS j, 'a<b>' AS h").select(
        F.expr(replace_outside_tokens("t", "'NOM_0001'", "'#'")).alias("r"), F.expr(serve_net("t", "array('Jean', 'x')")).alias("s"), F.expr(json_strings("j")).alias("j"), F.expr(unresolved("t")).alias("u"),
        F.expr(highlight("h", "array(named_struct('s', 1, 'e', 2, 'type', 'NOM'), named_struct('s', 1, 'e', 3, 'type', 'X'))")).alias("h"),
    ).first()
    assert (row.r.text, row.r.n) == ("x ⟦NOM_0001⟧ Jean # Jean", 1) and row.s == "x ⟦NOM_0001⟧ ⟦NOM_∎⟧ NOM_0001 ⟦NOM_∎⟧" and row.u
    assert [x.v for x in row.j] == ['b\\"c', "e"] and row.h == 'a<mark title="NOM">&lt;</mark>b&gt;'


def test_mail(spark):
    mail = spark.createDataFrame([("7", "Jean <jean@ex.fr>", "Rdv", "06 12 34 56 78"), ("8", "x", "y", PROSE)], "uid string, from string, subject string, body string")
    got = {r.uid: r for r in anonymise_mail(mail, Masker())[0].collect()}
    assert got["7"].text.startswith("UID: 7\nFrom: Jean <⟦EMAIL_0001⟧>") and got["8"].text is None and got["8"].state == "zero_detection"


def test_verdict_tables(spark):
    cases = [("off", True, "fail_closed"), ("off", False, "skip"), ("hard", True, "run_failclosed"), ("all", True, "run_failclosed"), ("all", False, "run_additive"), ("hard", False, "skip")]
    rows = spark.createDataFrame(cases, "mode string, form boolean, want string").withColumn("got", F.expr(verdict.second_pass("mode", "form"))).collect()
    assert all(r.got == r.want for r in rows)
    row = spark.sql(f"SELECT {verdict.mode_of(chr(39) + ' HARD ' + chr(39))} a, {verdict.mode_of(chr(39) + 'x' + chr(39))} b, {verdict.window_count(chr(39) * 2)} c, {verdict.complete('NULL')} d, {verdict.label(chr(39) + 'leak' + chr(39))} e").first()
    assert (row.a, row.b, row.c, row.d) == ("hard", "all", 1, False) and "NE PAS" in row.e


def test_profile(spark):
    docs = spark.createDataFrame([("d1", 1, "Madame Marie Dubois, marie@ex.fr"), ("d1", 2, "vu avec dubois puis MARIE DUBOIS"), ("d2", 3, "vu avec dubois"), ("d1", 4, "Contrat EUROPE")], "dossier string, doc_id long, text string")
    found = profile.two_pass(docs, Masker(context_boost=False))
    got = {r.doc_id: [m.value for m in r.spans] for r in found.collect()}
    assert got == {1: ["Madame Marie Dubois", "marie@ex.fr"], 2: got[2], 3: [], 4: []} and "dubois" in got[2] and any("DUBOIS" in v for v in got[2])
    files, known, totals = profile.mask_dossiers(docs, Masker(context_boost=False))
    assert {r.dossier: (r.n_ok, r.total_entities) for r in totals.collect()}["d2"] == (1, 0)
    texts = {r.doc_id: r.masked for r in files.collect()}
    assert "dubois" not in texts[2].lower() and texts[3] == "vu avec dubois"
    row = spark.sql("SELECT array('Marie Dubois') v").select(F.expr(profile.safe_name("'DUBOIS Marie - RIB'", "v", "'x'", "'1'")).alias("a"), F.expr(profile.safe_name("'Dubois'", "v", "''", "'1'")).alias("b")).first()
    assert (row.a, row.b) == ("RIB", "document-1")


def test_soft_layers(spark):
    def load():
        def model(texts):
            return [[{"label": "person name", "text": t[k : k + 4], "start": k, "end": k + 4, "score": 0.9} for k in [t.find("Jean")] if k >= 0] + [{"label": "email", "text": "none", "start": 0, "end": 4, "score": 0.9}, {"label": "odd", "text": "x", "start": 0, "end": 1, "score": 1.0}] for t in texts]

        return model

    text = "x" * 950 + " Jean " + "........ " + "y" * 800
    got = soft.model_spans(docs_of(spark, text, "", None, "Jean"), soft.model_udf(load)).orderBy("doc_id").collect()
    assert [[(m.s, m.value, m.priority) for m in r.soft] for r in got] == [[(951, "Jean", 5)], [], [], [(0, "Jean", 5)]]
    broken = soft.model_spans(docs_of(spark, "Jean"), soft.model_udf(lambda: 1 / 0)).first().soft
    assert broken == []
    w = spark.sql("SELECT repeat('a', 2400) t, '' e").select(F.expr(soft.windows("t")).alias("w"), F.expr(soft.windows("e")).alias("e")).first()
    assert [(x.base, len(x.chunk)) for x in w.w] == [(0, 1000), (700, 1000), (1400, 1000)] and w.e == []
    a = "array(named_struct('s', 0, 'e', 10, 'type', 'NOM', 'value', '', 'score', 0.7D, 'priority', 5))"
    b = "array(named_struct('s', 2, 'e', 12, 'type', 'NOM', 'value', '', 'score', 0.9D, 'priority', 5), named_struct('s', 50, 'e', 60, 'type', 'TEL', 'value', '', 'score', 0.9D, 'priority', 5))"
    m = spark.sql("SELECT repeat('a', 99) t").select(F.expr(soft.merged("t", a, b)).alias("m"), F.expr(soft.widened("t", a, b.replace("'s', 2, 'e', 12", "'s', 0, 'e', 12"))).alias("w")).first()
    assert [(x.s, x.e, x.score) for x in m.m] == [(0, 12, 0.9), (50, 60, 0.9)] and [(x.s, x.e, x.score) for x in m.w] == [(0, 12, 0.7)]


def test_model_answers(spark):
    row = spark.sql("""SELECT '{"entities":[{"type":"PERSON","text":"Jean"},{"type":"ODD","text":"x"}]}' a, '[{"type":"ORG","text":"Acme"}]' b, 'bad' c, 'NOM: Jean\nODD: x\nEMAIL: a@b.fr\nNOM: (aucune)' d""").select(
        *[F.expr(soft.llm_entities(x)).alias(x) for x in "abc"], F.expr(soft.answer_lines("d")).alias("d"), F.expr(soft.name_verdict("'MOT'")).alias("v"), F.expr(soft.name_verdict("'NOM ou MOT'")).alias("w"), F.expr(soft.value_verdict("'GENERIQUE'")).alias("g"), F.expr(soft.value_verdict("NULL")).alias("n")
    ).first()
    assert [(x.type, x.text) for x in row.a] == [("NOM", "Jean")] and [(x.type, x.text) for x in row.b] == [("SOCIETE", "Acme")] and row.c == []
    assert [(x.type, x.text) for x in row.d] == [("NOM", "Jean"), ("EMAIL", "a@b.fr")] and (row.v, row.w, row.g, row.n) == ("MOT", "NOM", True, False)


def test_viterbi(spark):
    labels = ["S-p", "B-p", "I-p", "E-p", "O"]
    hot = [[float(v) for v in r] for r in ([-10, 5, -10, -10, -10], [-10, -10, 4, -10, 4.5], [-10, -10, -10, 5, -10], [-10, -10, -10, -10, 9])]
    got = spark.createDataFrame([(hot, labels), ([], labels)], "logits array<array<double>>, labels array<string>").select(soft.viterbi("logits", "labels").alias("v")).collect()
    assert [(x.first, x.last, x.category) for x in got[0].v] == [(0, 3, "p")] and got[1].v == []


def test_review_and_depollution(spark):
    known = spark.createDataFrame([("compte", "NOM"), ("Dupont", "NOM"), ("total", "IBAN"), ("maison", "NOM"), ("rue", "ADRESSE")], "value string, entity_type string")
    common = spark.createDataFrame([("compte",), ("maison",)], "word string")

    @F.pandas_udf("string")
    def judge(v: pd.Series) -> pd.Series:
        return v.map({"Dupont": "NOM", "rue": "MOT"})

    out = review.depollute(known, spark.createDataFrame([("Maison",)], "value string"), common, judge)
    assert {r.value for r in out["removed"].collect()} == {"compte", "rue"} and {r.word for r in out["safe"].collect()} == {"compte", "rue"}
    assert {r.value for r in out["judged"].collect()} == {"compte", "Dupont", "rue"} and out["log"].count() == 2
    docs, _ = Masker(recognizers=core()).mask(docs_of(spark, "IBAN FR00 0000 0000 0000 0000 0000 000 a@b.fr", "c@d.fr"))
    found = review.candidates(docs)
    assert [r.entity_type for r in found.collect()] == ["IBAN"]
    now = F.lit("2026-01-01").cast("timestamp")
    items = review.queue(found.select("normalized", "value", "entity_type", F.col("source_doc").alias("doc_ref"), F.lit("2025-01-01").cast("timestamp").alias("first_seen")), known).withColumn("dismiss_reason", F.lit(None).cast("string")).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    assert review.expire(items, now).first().dismiss_reason == "auto-expired"
    decided = items.select("normalized", F.lit("dismiss").alias("decision"), F.lit("no").alias("reason"))
    done, confirmed, safe = review.resolve(items, decided, now)
    assert done.first().status == "dismissed" and confirmed.count() == 0 and safe.count() == 1


def test_statistics(spark):
    log = spark.createDataFrame([("1", "anonymize", {"NOM": "2", "X": "bad"}, True), ("2", "sweep_index", {"NOM": "1"}, None), ("3", "vault_reveal", None, None), ("4", "error", None, None)], "timestamp string, event string, counts map<string,string>, safe_to_send boolean")
    row = analytics.summary(log).first()
    assert (row.total_runs, row.safe_runs, row.unsafe_runs, row.error_runs, row.reveal_runs, row.total_entities, row.safe_rate) == (2, 1, 1, 1, 1, 3, 0.5)
    none = analytics.summary(log.filter("false")).first()
    assert (none.total_runs, none.safe_rate, none.has_data, none.total_entities) == (0, 0.0, False, 0)
    assert [r.timestamp for r in analytics.recent(log, 2).collect()] == ["4", "3"]
    texts = docs_of(spark, "⟦NOM_0001⟧ ⟦NOM_0001⟧ ⟦TEL_0001⟧", "⟦NOM_0001a⟧").withColumnRenamed("text", "masked")
    assert [(r.type, r.n_tokens, r.n_files) for r in analytics.token_stats(texts).collect()] == [("NOM", 2, 2), ("TEL", 1, 1)]
    assert texts.select(F.expr(analytics.token_counts("masked")).alias("c")).first().c == {"NOM": 1, "TEL": 1}
    assert S.TOKEN
