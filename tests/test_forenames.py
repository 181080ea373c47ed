"""Names by lists of forenames: as the pattern finds them, whatever the list's size."""

import pytest
from pyspark.sql import functions as F

from occulta.operators import lists, recognizers
from occulta.operators.masker import Masker

TEXTS = [
    "Vu Jean Dupont et Anne-Marie Claire Petit Durand Long.",
    "Jean-Marie Dupont, L'Anne Petit, xJean Dupont, Jean\nDupont, Jean  Martin-Long IBAN",
    "Jeanne Dupont Jean Jean Jean Jean Jean",
    "Madame, voici Rose Dupont; et\nRose Dupont",
    "Mme Rose Petit et Rose Petit",
    "Rose Petit",
    "JEAN DUPONT jean dupont (Jean Dupont) «Jean Dupont» Jean’Anne Dupont",
    "_Jean Dupont 3Jean Dupont É-Jean Dupont",
    "Jean",
    "",
    None,
]
PLAIN, HOMOGRAPHS = ("Jean", "Anne", "Anne-Marie", "Jeanne", "Marie"), ("Rose",)


def by_pattern(docs):
    two = [r for r in recognizers.core(PLAIN, HOMOGRAPHS) if r.priority == 45]
    return docs.select("doc_id", F.expr(f"concat({', '.join(r.sql('coalesce(text, chr(10))') for r in two)})").alias("names"))


def spans(df):
    return {r.doc_id: sorted((m.s, m.e, m.value, m.type, m.priority) for m in r.names) for r in df.collect()}


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([(f, False) for f in PLAIN] + [(f, True) for f in HOMOGRAPHS] + [("Jean Paul", False), ("", False), (None, None), ("J.*", False), ("Jean", None)], "forename string, homograph boolean")


def test_as_the_pattern(spark, listed):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = spans(lists.forename_spans(docs, listed))
    assert got == spans(by_pattern(docs)) and sum(map(len, got.values())) == 14


def test_lists_of_any_size(spark):
    n = 20000
    names = spark.range(n).select(F.expr("concat('Q', translate(cast(id AS string), '0123456789', 'abcdefghij'))").alias("forename"), F.lit(False).alias("homograph"))
    docs = names.select(F.monotonically_increasing_id().alias("doc_id"), F.expr("concat('avec ', forename, ' Durand, puis Jean Petit')").alias("text"))
    found = lists.forename_spans(docs, names)
    assert found.filter("size(names) = 1 AND names[0].s = 5 AND names[0].value = split(substr(text, 6), ',')[0]").count() == n
    few = lists.forename_spans(docs, names.limit(3))
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    assert abs(size(found) - size(few)) < 500


def test_edges(spark, listed):
    docs = spark.createDataFrame([(1, "Jean Dupont", "a"), (1, "Jean Dupont", "b"), (None, "Jean Petit", "c"), (None, None, "d")], "doc_id int, text string, forename string")
    got = lists.forename_spans(docs, listed)
    assert got.columns == ["doc_id", "text", "forename", "names"]
    assert sorted((r.forename, len(r.names)) for r in got.collect()) == [("a", 1), ("b", 1), ("c", 1), ("d", 0)]
    assert all(len(r.names) == 0 for r in lists.forename_spans(docs, listed.limit(0)).collect())
    assert lists.forename_spans(docs.limit(0), listed).isEmpty()


def test_in_the_engine(spark, listed):
    docs = spark.createDataFrame([(1, "Avec Jean Dupont hier; joindre a@b.fr"), (2, "Rose Dupont")], "doc_id int, text string")
    out, vault = Masker(recognizers=recognizers.core((), ()), forenames=listed).mask(docs)
    got = {r.doc_id: r.masked for r in out.collect()}
    assert got[1].startswith("Avec ⟦NOM_") and "Dupont" not in got[1] and "⟦EMAIL_" in got[1] and got[2] == "Rose Dupont"
