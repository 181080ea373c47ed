"""Recognisers, check sums and span algebra on small texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from occulta.functions import checksums, gate, quality
from occulta.functions import spans as S
from occulta.operators import forms, lists
from occulta.operators.masker import Masker
from occulta.operators.recognizers import core
from occulta.operators.spec import FieldError, custom_recognizer, custom_recognizers

IBAN = "FR7630006000011234567890189"


def detect(spark, *texts, **options):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = Masker(context_boost=False, **options).detect(df).select("doc_id", "spans").orderBy("doc_id").collect()
    return [[(m.type, m.value, m.score) for m in r.spans] for r in rows]


def kinds(found):
    return [t for t, _, _ in found]


def test_core_recognisers(spark):
    texts = [
        "IBAN FR76 3000 6000 0112 3456 7890 189", "IBAN FR76-3000-6000-0112-3456-7890-189", "IBAN FR00 0000 0000 0000 0000 0000 000 du client.", "ISIN FR0000120271 svp",
        "compte FR14 3000 4008 2800 0123 4567 890 fin", "siren 552 100 554", "siren 821 099 422", "Référence de l'avis : 25 92 0364665 70", "avis : 25 92 0364665 71",
        "Télédéclarant 922 65 91 2768797789 3 A", "né le 14/03/1968, opération du 02/01/2026", "45 000 € puis 60 000 euros", "Le Petit Robert Illustré est paru", "Robert Half recrute",
        "M. Robert Dupont signe", "Monsieur Jean Dupont IBAN " + IBAN, "Né(e) le 03/05/1980", "numéro fiscal : 30 23 456 789 012", "N° client O2S : AB12345", "06 12 34 56 78", "12 rue de la Paix 75002 Paris",
        "voir https://ex.fr/in/jean-dupont ok", "exemple.fr est un site", "directeur marketing chez TotalEnergies", "123 456 789-00011", None, "", "Écrire à marie@ex.fr",
    ]
    got = detect(spark, *texts)
    want = {0: ["IBAN"], 1: ["IBAN"], 2: ["IBAN"], 3: ["ISIN"], 4: ["IBAN"], 5: ["SIREN"], 6: ["SIREN"], 7: ["NUM_FISCAL"], 8: [], 9: ["NUM_TELEDECLARANT"], 10: ["DATE_NAISSANCE"], 11: ["MONTANT", "MONTANT"], 12: [], 13: [], 14: ["NOM"], 15: ["NOM", "IBAN"], 16: ["DATE_NAISSANCE"], 17: ["NUM_FISCAL"], 18: ["NUM_CLIENT"], 19: ["TEL"], 20: ["ADRESSE"], 21: ["URL"], 22: [], 23: ["POSTE"], 24: ["SIRET"], 25: [], 26: [], 27: ["EMAIL"]}
    assert {k: kinds(got[k]) for k in want} == want
    assert got[0][0][2] == got[1][0][2] == 1.0 and got[2][0][2] == 0.5 and got[5][0][2] == 1.0 and got[6][0][2] == 0.4
    assert got[24][0][2] == 0.5  # a hyphen fails the check
    assert got[15] == [("NOM", "Monsieur Jean Dupont", 1.0), ("IBAN", IBAN, 1.0)]


def test_places_equal_those_of_plain_regex(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a@b.fr", " ", "é", "🎉", "06 12 34 56 78", "\n", "12 €", "xx", "552100554"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in core():
        if r.type in ("EMAIL", "TEL", "SIREN"):
            plain = re.compile(r.pattern.replace("(?U)", ""))
            for row in df.withColumn("m", F.expr(r.sql())).collect():
                assert [(x.s, x.e, x.value) for x in row.m] == [(m.start(), m.end(), m[0]) for m in plain.finditer(row.text)]


def brute_resolve(spans):
    taken = []
    for m in sorted(spans, key=lambda m: (-(m[1] - m[0]), -m[2], -m[3], m[0])):
        if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
            taken.append(m)
    return sorted(taken, key=lambda m: m[0])


def test_resolution_by_brute_force(spark):
    rng = random.Random(7)
    cases = [[(s := rng.randint(0, 60), s + rng.randint(1, 15), rng.choice([0.4, 0.5, 1.0]), rng.randint(1, 9)) for _ in range(rng.randint(0, 14))] for _ in range(150)]
    df = spark.createDataFrame([(k, [(s, e, "X", "", c, p) for s, e, c, p in x]) for k, x in enumerate(cases)], f"k int, spans array<{S.SPAN}>")
    for r in df.withColumn("out", F.expr(S.resolved("spans"))).collect():
        assert [(m.s, m.e, m.score, m.priority) for m in r.out] == brute_resolve(cases[r.k])


def test_span_helpers(spark):
    row = spark.sql(
        "SELECT named_struct('s', 0, 'e', 10) a, named_struct('s', 5, 'e', 15) b, named_struct('s', 2, 'e', 8) c, array(named_struct('s', 0, 'e', 2, 'type', 'NOM', 'value', 'ab', 'score', 0.5D, 'priority', 1)) sp, 'ab cd client' t"
    ).select(F.expr(S.iou("a", "b")).alias("iou"), F.expr(S.contains("a", "c")).alias("in"), F.expr(S.contains("a", "a")).alias("self"), F.expr(S.boosted("t", "sp", ["client"], 40)).alias("up"), F.expr(S.boosted("t", "sp", ["client"], 2)).alias("far"), F.expr(S.unglued("'⟦A_0001⟧b ⟦A_0002⟧ c'")).alias("g")).first()
    assert row.iou == pytest.approx(1 / 3) and row["in"] and not row.self
    assert row.up[0].score == pytest.approx(0.6) and row.far[0].score == 0.5 and row.g == "⟦A_0001⟧ b ⟦A_0002⟧ c"


def test_checksums(spark):
    ask = [
        (checksums.iban("'FR76.3000 6000-0112 3456 7890 189'"), True), (checksums.iban("'FR7630006000011234567890188'"), False), (checksums.isin("'US0378331005'"), True), (checksums.isin("'US0378331006'"), False),
        (checksums.siren("'552 100 554'"), True), (checksums.siren("'821 099 422'"), False), (checksums.fiscal_reference("'25 92 0364665 70'"), True), (checksums.fiscal_reference("'x'"), False),
        (checksums.secu("'1 84 12 75 116 001 42'"), 97 - 1841275116001 % 97 == 42), (checksums.luhn("''"), False), (checksums.iban_gate("'FR76 3000 6000 0112 3456 7890 189'"), True),
    ]
    row = spark.sql("SELECT " + ", ".join(q for q, _ in ask)).first()
    assert list(row) == [w for _, w in ask]


def test_custom_fields():
    good = custom_recognizer({"entity_type": "DOSSIER_X", "pattern": r"DX-\d{4}", "priority": 500})
    assert good.priority == 99 and custom_recognizer({"entity_type": "AB", "pattern": "x"}).priority == 65
    for bad in ({"entity_type": "low", "pattern": "x"}, {"entity_type": "AB", "pattern": "(a+)+"}, {"entity_type": "AB", "pattern": "("}, {"entity_type": "AB", "pattern": "x", "validator": "zz"}, {"entity_type": "AB"}):
        with pytest.raises(FieldError):
            custom_recognizer(bad)
    assert len(custom_recognizers([{"entity_type": "AB", "pattern": "x"}, {"pattern": "("}, {}])) == 1


def test_custom_field_in_use(spark):
    field = custom_recognizer({"entity_type": "DOSSIER_X", "pattern": r"DX-\d{4}"})
    assert detect(spark, "ref DX-1234.", extra_recognizers=[field]) == [[("DOSSIER_X", "DX-1234", 1.0)]]


def test_forms(spark):
    text = (
        "Nom : DURAND\nPrénom : (vide)\nNom: Collé\nNé(e) le : 03/05/1980 à : Lyon\nPasseport n° 12AB34567\nRaison sociale : SELARL SELARL DU DOCTEUR TESTONI\n"
        "gérantETESTONI x\nvu SELARL DU DOCTEUR TESTONI et TESTONI.\nSignataire : Gérant Marc LETO\nSAINT ETIENNE 42000\nFACTURE 75001\nForme juridique : SAS\n01/02/1970 LE MANS (France)\n12/05/2025 ANNEXE\nMonsieur\nJeremy LOUIS"
    )
    found = detect(spark, text, recognizers=[], forms=True)[0]
    values = {(t, v) for t, v, _ in found}
    assert {("NOM", "DURAND"), ("LIEU_NAISSANCE", "Lyon"), ("PIECE_IDENTITE", "12AB34567"), ("RAISON_SOCIALE", "SELARL DU DOCTEUR TESTONI"), ("NOM", "TESTONI"), ("NOM", "Marc LETO"), ("ADRESSE", "SAINT ETIENNE 42000"), ("LIEU_NAISSANCE", "LE MANS (France)"), ("NOM", "Jeremy LOUIS")} <= values
    assert not {v for _, v in values} & {"(vide)", "Collé", "ANNEXE", "FACTURE 75001", "SAS"}
    assert sum(v == "SELARL DU DOCTEUR TESTONI" for _, v, _ in found) == 2 and sum(v == "TESTONI" for _, v, _ in found) == 2


def test_file_names(spark):
    name = "DURAND Théophile - DER 012026 - 2026-02-18.pdf"
    words = spark.sql("SELECT 1").select(F.expr(forms.filename_words(S.quote(name))).alias("w")).first().w
    assert words == ["DURAND", "THÉOPHILE"]
    docs = spark.createDataFrame([(1, "annexe au document DURAND - DER\nle durand est un fruit", name), (2, "M. Paul DURAND\nvu par durand", name)], "doc_id long, text string, filename string")
    got = {r.doc_id: [(m.s, m.value) for m in r.spans] for r in Masker(recognizers=[], forms=True, context_boost=False).detect(docs).collect()}
    assert got[1] == [(19, "DURAND")]  # only the footer: nothing else confirms the name
    assert (22, "durand") in [(s, v) for s, v in got[2]]


def test_lists(spark):
    cloaked = lists.policy({"NOM": False, "MONTANT": True, "OTHER": False, 3: True})
    assert cloaked["NOM"] and cloaked["MONTANT"] and not cloaked["OTHER"] and not cloaked["ISIN"]
    assert lists.policy("broken")["NOM"] and lists.kept_identifying({"NOM": False, "ISIN": False}) == ["names"]
    rule = lists.allowed(["acme conseil", "amf"], ["acme.com"], ["+33 1 23 45 67 89"])
    cases = [("NOM", "ACME Conseil SAS", True), ("NOM", "l'AMF dit", True), ("NOM", "AMFORA", False), ("EMAIL", "bob@acme.com", True), ("EMAIL", "bob@x.acme.com", True), ("EMAIL", "bob@notacme.com", False), ("TEL", "01 23 45 67 89", True), ("TEL", "01 23 45 67 88", False), ("NOM", "", False)]
    rows = spark.createDataFrame(cases, "type string, value string, want boolean").withColumn("m", F.struct("type", "value")).withColumn("got", F.expr(rule)).collect()
    assert all(r.got == r.want for r in rows), rows
    docs = spark.createDataFrame([(1, "Vu M. TÈSTILLON, testillons et Jean-Paul Testillon."), (2, None)], "doc_id long, text string")
    known = spark.createDataFrame([("Testillon", "NOM", "1"), ("jean-paul testillon", "NOM", "1"), ("", "NOM", "1")], "value string, entity_type string, added_at string")
    got = {r.doc_id: [(m.s, m.value) for m in r.known] for r in lists.dictionary_spans(docs, known).collect()}
    assert got == {1: [(6, "TÈSTILLON"), (31, "Jean-Paul Testillon"), (41, "Testillon")], 2: []}


def test_input_guard(spark):
    ask = [(IBAN, "regex", False, True), ("marc@x.com", "regex", False, True), (r"\b[A-Z]{2}-\d{5}\b", "regex", False, False), ("dossier", "regex", False, False), ("Martin", "gliner_label", False, True), ("employer name", "gliner_label", False, False), ("nom d'employeur", "gliner_label", False, False), ("Acme SAS", "keep", False, True), ("Acme SAS", "keep", True, False), (IBAN, "keep", True, True), ("1 84 12 75 116 001 42", "gliner_label", False, True), ("MARC DURAND", "regex", False, True), ("123456789012", "regex", False, True), ("  ", "regex", False, True), ("x", "bogus", False, True)]
    rows = spark.createDataFrame(ask, "v string, k string, c boolean, no boolean").withColumn("r", F.expr(lists.refused("v", "k", "c"))).collect()
    assert [(r.v, r.r is not None) for r in rows] == [(r.v, r.no) for r in rows]
    assert not any(r.r and r.v.strip() and r.v in r.r for r in rows if len(r.v) > 3)


def test_quality_and_gate(spark):
    texts = ["Le contrat prévoit que le client verse une somme chaque mois.", "a b 1 2 ## @@ %% x y", "", "CERFA liasse N° 2065-SD", "en 2033 et 2034", "gerantETESTONI" * 30 + "Aa", "x DC04" + "A" * 44 + " y", "IBAN " + IBAN + " et a@b.fr 06 12 34 56 78", "voir pièce jointe"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("q", F.expr(quality.quality_signals("text")))
    rows = df.select("k", F.expr(quality.passes_quality("q")).alias("clean"), F.expr(quality.structured_form("text")).alias("form"), F.expr(quality.garbled("text")).alias("garbled"), F.expr(quality.without_barcodes("text")).alias("bare"), F.expr(gate.labels("text")).alias("labels"), F.expr(gate.action("text")).alias("act")).orderBy("k").collect()
    assert rows[0].clean and not rows[1].clean and not rows[2].clean and rows[3].form and not rows[4].form and rows[5].garbled and not rows[0].garbled
    assert rows[6].bare == "x ⟦2DDOC_BARCODE_STRIPPED⟧ y" and rows[7].labels == ["IBAN", "email", "téléphone"] and [r.act for r in rows][6:] == ["none", "nudge", "nudge"]


def test_very_many_matches_in_one_text(spark):
    from occulta.operators.masker import highlight

    email = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
    rows = [(n, "é" + " ".join(f"a{k}@mail{k % 7}.com x🎉" for k in range(n))) for n in (0, 1, 63, 64, 65, 129, 16_000)]
    docs = Masker(recognizers=core()[:1]).detect(spark.createDataFrame(rows, "doc_id long, text string"))
    got = docs.select("doc_id", F.expr(S.rewritten("text", "spans", "concat('[', x.type, ']')")).alias("masked"), F.expr(highlight("text", "spans")).alias("html")).collect()
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.masked == re.sub(email, "[EMAIL]", text) and r.html == re.sub(f"({email})", r'<mark title="EMAIL">\1</mark>', text)


def test_spans_outside_others(spark):
    rng = random.Random(3)

    def some(n):
        return [(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 300) for _ in range(n))]

    rows = [(k, some(rng.choice([0, 1, 5, 90])), some(rng.choice([0, 1, 5, 90]))) for k in range(60)]
    kind = "array<struct<s:int,e:int>>"
    df = spark.createDataFrame(rows, f"k int, a {kind}, b {kind}")
    for r in df.select("k", F.expr(S.outside("a", "b")).alias("o"), F.expr(S.outside("a", "b", own=True)).alias("u")).collect():
        a, b = rows[r.k][1:]
        free = [x for x in a if not any(y[0] <= x[0] and x[1] <= y[1] for y in b)]
        assert [tuple(x) for x in r.o] == free
        alone = [x for i, x in enumerate(free) if not any((y[0] <= x[0] and x[1] <= y[1]) and (y != x or j < i) for j, y in enumerate(free) if j != i)]
        assert [tuple(x) for x in r.u] == alone


def plain_luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return bool(digits) and total % 10 == 0


def plain_check(kind, value):
    """The checks of the recognisers, from their definitions."""
    if kind == "IBAN":
        v = re.sub(r"[\s.\-]", "", value).upper()
        return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v)) and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1
    if kind == "ISIN":
        return plain_luhn("".join(str(int(c, 36)) for c in value))
    if kind in ("SIRET", "SIREN"):
        v = re.sub(r"\s", "", value)
        return v.isdigit() and len(v) in (9, 14) and plain_luhn(v)
    v = re.sub(r"\s", "", value)
    return 97 - int(v[:11]) % 97 == int(v[11:])


def plain_spans(text):
    """What all recognisers find in a text, and what is left of overlaps, with Python's patterns."""
    import regex

    found = []
    for r in core():
        flags = (regex.I if "(?iuU)" in r.pattern else 0) | regex.V0
        for m in regex.finditer(r.pattern.replace("(?iuU)", "").replace("(?U)", ""), text, flags):
            s, e = m.span(r.group)
            if not m[r.group].strip():
                continue
            score = 1.0
            if r.check is not None and not plain_check(r.type, m[r.group]):
                if r.drop:
                    continue
                score = r.otherwise
            if r.before is not None and not regex.search(r.before.replace("(?U)", ""), text[max(0, s - r.reach) : s].rsplit("\n", 1)[-1]):
                continue
            found.append((s, e, score, r.priority, r.type, m[r.group]))
    return [(s, e, t, v, score, p) for s, e, score, p, t, v in brute_resolve(found)]


def test_all_recognisers_by_brute_force(spark, sf):
    rng = random.Random(11)
    parts = [
        "M. Robert Dupont", "Madame Élodie O'Neil", "Nathalie Petit-Jean", "Robert Half", "Mme le juge et Rose Martin", IBAN, "FR76 3000 6000 0112 3456 7890 189", "FR0000120271", "552 100 554", "552 100 554 00011", "123 456 789-00011",
        "1 84 12 75 116 001 42", "numéro fiscal : 30 23 456 789 012", "25 92 0364665 70", "25 92 0364665 71", "922 65 91 2768797789 3 A", "N° client O2S : AB12345", "client n° XY000123", "né le 14/03/1968", "née le 1er avril 1971", "06 12 34 56 78", "+33 6.12.34.56.78",
        "45 000 €", "1 234,50 euros", "12 bis, rue de la Paix 75002 Paris", "3 av. Foch", "directeur marketing chez TotalEnergies", "gérante", "PDG de Acme", "https://ex.fr/a?b=c", "www.ex.fr", "ex.fr/in/x", "marie@ex.fr", "\n", " ", " ", ", ", ". ", "é", "🎉", "le marché", "THE IBAN", "2026",
    ]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for row in Masker(context_boost=False).detect(df).collect():
        got = [(m.s, m.e, m.type, m.value, m.score, m.priority) for m in row.spans]
        assert got == plain_spans(row.text), row.text[:300]
