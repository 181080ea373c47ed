"""Stores that outlive their jobs, known values by phrases, numbers of name variants, stand-ins."""

import re

import pytest
from pyspark.sql import functions as F

from occulta.operators import lists, vault
from occulta.operators.masker import Masker, restore
from occulta.sources.store import Conflict, Store
from occulta.streaming import index
from tests.test_index import mask

SCHEMAS = {"a": "k long, v string", "b": "k long"}


def rows(spark, *values):
    return spark.createDataFrame(values, SCHEMAS["a"])


def content(store, version=None):
    return {k: sorted(map(tuple, t.collect())) for k, t in store.read(version).items()}


def test_commits_are_whole(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), SCHEMAS)
    assert store.version() == 0 and content(store) == {"a": [], "b": []}
    assert store.commit({"a": rows(spark, (1, "x"))}, 0) == 1
    assert store.commit({"b": spark.createDataFrame([(7,)], "k long")}, 1) == 2
    assert content(store) == {"a": [(1, "x")], "b": [(7,)]} and content(store, 1) == {"a": [(1, "x")], "b": []}
    # a job that dies before its pointer has its name leaves the old version, and the next commit goes through
    monkeypatch.setattr(Store, "_claim", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        store.commit({"a": rows(spark, (2, "y"))}, 2)
    monkeypatch.undo()
    assert store.version() == 2 and content(store)["a"] == [(1, "x")]
    assert Store(spark, str(tmp_path / "s"), SCHEMAS).commit({"a": rows(spark, (3, "z"))}, 2) == 3
    assert content(store) == {"a": [(3, "z")], "b": [(7,)]}
    assert store.vacuum(1) == 3 and content(store) == {"a": [(3, "z")], "b": [(7,)]}
    with pytest.raises(KeyError):
        store.commit({"c": rows(spark)}, 3)


def test_one_of_two_commits_wins(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s"), SCHEMAS) for _ in range(2))
    base = one.version()
    two.commit({"a": rows(spark, (2, "two"))}, base)
    with pytest.raises(Conflict):
        one.commit({"a": rows(spark, (1, "one"))}, base)
    assert content(one)["a"] == [(2, "two")]
    part, pointer = (one._path(f"{one.folder}/{n}") for n in ("v9-x", "current.1"))
    one._fs.createNewFile(part)
    assert not one._claim(part, pointer) and content(one, 1)["a"] == [(2, "two")]
    tries = []

    def add(tables):
        tries.append(1)
        if len(tries) == 1:
            two.commit({"a": tables["a"].unionByName(rows(spark, (3, "first")))}, two.version())
        return {"a": tables["a"].unionByName(rows(spark, (4, "second")))}

    one.update(add)
    assert len(tries) == 2 and content(one)["a"] == [(2, "two"), (3, "first"), (4, "second")]


def test_sweeps_over_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"), index.SCHEMAS)
    files = spark.createDataFrame([(f"/d/{n}", 1, 1.0, t.encode(), t) for n, t in [("a.txt", "one"), ("b.txt", "bad")]], "path string, size long, mtime double, content binary, content_hash string")
    assert index.swept(store, files, mask) == {"indexed": 1, "failed": 1}
    assert index.swept(store, files, mask) == {"skipped": 1, "failed": 1}
    tables = store.read()
    assert [r.clean_text for r in tables["shadows"].collect()] == ["ONE"] and tables["pending"].first().fail_count == 2 and store.version() == 2
    store.update(lambda t: {"shadows": index.mark_stale(t["shadows"], t["values"], t["values"].select("value_hash"))})
    assert store.read()["shadows"].first().stale == 1
    with index.single_run(spark, str(tmp_path / "index")):
        with pytest.raises(index.Busy):
            with index.single_run(spark, str(tmp_path / "index")):
                pass
    (tmp_path / "index" / ".sweep.lock").touch()  # left by a job that died
    with index.single_run(spark, str(tmp_path / "index"), stale_hours=-1):
        pass
    assert not list((tmp_path / "index").glob(".sweep*"))


def found(docs, listed):
    got = lists.dictionary_spans(docs, listed)
    return {r.doc_id: [(m.s, m.e, m.type) for m in r.known] for r in got.collect()}


def test_many_values_with_one_first_word(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('vu Jean Nom', id, ' et jean  NOM', id + 1, ' x') AS text")
    listed = spark.range(15000).selectExpr("concat('Jean Nom', id) AS value", "'NOM' AS entity_type")
    got = found(docs, listed)
    assert all(len(m) == 2 and m[0][0] == 3 for m in got.values()) and len(got) == 3000
    met = lists.dictionary_spans(docs, listed)
    assert met._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2


def test_phrases(spark):
    long = "un deux trois quatre cinq six sept huit neuf dix"
    docs = spark.createDataFrame([(1, f"vu {long} et un deux trois quatre cinq six sept huit neuf onze"), (2, "É̀lodie, ΣΊΣΥΦΟΣ  Straße"), (3, None), (4, "dupont-martin dupont martin DUPONT MARTIN"), (4, "rien")], "doc_id long, text string")
    listed = spark.createDataFrame([(long.upper(), "A"), ("σίσυφος strasse", "B"), ("Dupont Martin", "C"), ("dupont  martin", "C"), ("?!", "D"), (" ", "E"), (None, "F")], "value string, entity_type string")
    got = lists.dictionary_spans(docs, listed).collect()
    spans = sorted((r.doc_id, m.s, m.e, m.type) for r in got for m in r.known)
    assert spans == [(1, 3, 3 + len(long), "A"), (2, 9, 24, "B"), (4, 14, 27, "C"), (4, 28, 41, "C")] and len(got) == 5
    exact = listed.filter("entity_type = 'C'").selectExpr("value", "entity_type", "true AS exact")
    span = "named_struct('s', s, 'e', e, 'type', c.entity_type, 'value', '', 'score', 1.0D, 'priority', 1)"
    one = lists.listed_spans(docs.filter("doc_id = 4"), exact, ["doc_id"], [], span, "x")
    assert sorted((m.s, m.e) for r in one.collect() for m in r.x) == [(14, 27)]
    assert found(docs, listed.filter("false")) == {1: [], 2: [], 3: [], 4: []}


def test_served_texts(spark):
    docs = spark.createDataFrame([(1, "Jean Dupont et Jeannette, xDupont"), (2, None), (3, "")], "k long, text string")
    known = spark.createDataFrame([("Jean",), ("Jean Dupont",), ("Dupont",), ("et",), (None,), ("a-b",)], "value string")
    got = {r.k: r.served for r in lists.served(docs, known).collect()}
    assert got == {1: "⟦NOM_∎⟧ et ⟦NOM_∎⟧nette, x⟦NOM_∎⟧", 2: None, 3: ""}
    plan = lists.served(docs, known)._jdf.queryExecution().toString()
    assert "Dupont" not in plan
    assert {r.k: r.served for r in lists.served(docs, known.filter("false")).collect()}[1] == "Jean Dupont et Jeannette, xDupont"


def number(token):
    return re.search(r"_(\d+)", token)[1]


def test_variants_of_a_name_share_a_number(spark):
    names = Masker(recognizers=[], extra={"n": lambda d: F.expr("array(named_struct('s', 0, 'e', length(text), 'type', 'NOM', 'value', text, 'score', 1.0D, 'priority', 50))")}, context_boost=False)
    first, known = names.mask(spark.createDataFrame([(1, "Marie Dubois"), (2, "Paul Durand"), (3, "Marie Dubois")], "doc_id long, text string"))
    known = lists.materialise(known, "known")
    second, more = names.mask(spark.createDataFrame([(4, "Dubois"), (5, "Mme DURAND"), (6, "Lyon Ville"), (7, "Dubois Durand")], "doc_id long, text string"), known)
    token = {r.value: r.token for r in more.collect()}
    assert number(token["Marie Dubois"]) == number(token["Dubois"]) == "0001" and number(token["Paul Durand"]) == number(token["Mme DURAND"]) == "0002"
    assert number(token["Lyon Ville"]) == "0003" and number(token["Dubois Durand"]) == "0001"
    assert token["Marie Dubois"] == "⟦NOM_0001⟧" and {token["Dubois"], token["Dubois Durand"]} == {"⟦NOM_0001a⟧", "⟦NOM_0001b⟧"} and token["Mme DURAND"] == "⟦NOM_0002a⟧"
    back = {r.doc_id: r.restored for r in restore(second, more).collect()}
    assert back == {4: "Dubois", 5: "Mme DURAND", 6: "Lyon Ville", 7: "Dubois Durand"}
    assert len(set(token.values())) == len(token)


def test_stand_ins_never_collide(spark):
    """Numbers on either side of every power of ten, and very large ones."""
    edges = sorted({10**k + d for k in range(1, 13) for d in range(-40, 40) if 10**k + d > 0})
    made = spark.createDataFrame([(n,) for n in edges], "number long").withColumn("variant", F.lit("")).withColumn("type", F.explode(F.array(*map(F.lit, ["NOM", "TEL", "IBAN", "SECU", "SIREN", "SIRET", "ISIN", "EMAIL", "POSTE"]))))
    per = made.withColumn("s", vault.surrogate()).groupBy("type").agg(F.count_distinct("s").alias("n")).collect()
    assert all(r.n == len(edges) for r in per)
    other = made.withColumn("s", vault.surrogate("other key")).filter("type = 'TEL' AND number < 1000").agg(F.count_distinct("s")).first()[0]
    assert other == sum(n < 1000 for n in edges)
