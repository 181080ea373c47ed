"""Registered queries of the vault, the soft layers, profiles and lists, and their SQL.

Models are stubs: Spark expressions over a window's text. Snippets in braces are
of both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checksums
from .functions import spans as S
from .operators import lists, masker, presets, soft, vault
from .operators.masker import Masker
from .operators.recognizers import core
from .plans import profile

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def customer(spark: SparkSession, sf: str, **columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def spans_of(df: DataFrame, *keep: str, column: str = "spans") -> DataFrame:
    return df.select(*keep, F.explode_outer(column).alias("m")).filter("m IS NOT NULL")


# -- known values and serving


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'vu ⟦NOM_∎⟧ et x⟦NOM_∎⟧y.' ELSE 'vu ' || c_name || ' et x⟦NOM_∎⟧y.' END AS served FROM customer"""
)
def serve_known_values(spark, sf):
    """Texts cleared of a list of names, of which every second is listed, and of words within words."""
    docs = customer(spark, sf, k="c_custkey", text="concat('vu ', c_name, ' et x', c_mktsegment, 'y.')")
    known = customer(spark, sf, value="c_name", k="c_custkey").filter("k % 2 = 0").select("value").unionByName(customer(spark, sf, value="c_mktsegment").distinct())
    return lists.served(docs, known.unionByName(known.limit(0).union(spark.sql("SELECT 'vu'"))), "text", "served").select("k", "served")


@query(
    """SELECT c_custkey AS k, CAST(3 AS INTEGER) AS s, CAST(3 + length(v) AS INTEGER) AS e FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ΑΘΗΝΑ' WHEN 1 THEN 'Éloi' ELSE 'ИВАН' END || ' ' || c_custkey AS v FROM customer) WHERE c_custkey % 2 = 0"""
)
def dictionary_scripts(spark, sf):
    """Known values of several scripts, in other case, accents and composition, a few first words for all of them."""
    shown = "concat('vu ', CASE k % 3 WHEN 0 THEN 'ΑΘΗΝΑ' WHEN 1 THEN 'Éloi' ELSE 'ИВАН' END, ' ', k, ' ici')"
    docs = customer(spark, sf, doc_id="c_custkey", k="c_custkey").withColumn("text", F.expr(shown))
    known = docs.filter("k % 2 = 0").select(F.expr("concat(CASE k % 3 WHEN 0 THEN 'Αθηνά' WHEN 1 THEN 'e\u0301loi' ELSE 'иван' END, '  ', k)").alias("value"), F.lit("NOM").alias("entity_type"))
    return spans_of(lists.dictionary_spans(docs, known), "k", column="known").select("k", "m.s", "m.e")


# -- the vault


@query(
    """SELECT c_custkey AS k, ('⟦NOM_' || lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END || '⟧') AS token
    FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_custkey // 3) AS n FROM customer)"""
)
def variant_numbers(spark, sf):
    """Three names of one person, two in a first batch and one in a second: one number, letters of their own."""
    name = "concat('Fam', lpad(cast(k div 3 AS string), 7, '0'))"
    # a forename of three letters tells nothing, so families stay apart
    rows = customer(spark, sf, k="c_custkey").withColumn("value", F.expr(f"CASE k % 3 WHEN 0 THEN concat('Ida ', {name}) WHEN 1 THEN {name} ELSE concat('M. ', {name}) END"))
    found = rows.select("k", F.lit("m").alias("mission"), F.lit("NOM").alias("type"), "value", F.col("k").alias("doc_id"), F.lit(0).alias("s"))
    first = lists.materialise(vault.allocate(found.filter("k % 3 < 2"), variants=True), "first")
    second = vault.allocate(found.filter("k % 3 = 2"), first, variants=True)
    return first.unionByName(second).join(found.select("k", "value"), "value").select("k", "token")


_TYPES = ("NOM", "EMAIL", "IBAN", "SECU", "TEL", "SIREN", "SIRET", "ISIN")


@query("SELECT type, count(*) AS n, count(DISTINCT l_orderkey * 8 + l_linenumber) AS n_distinct, true AS valid FROM lineitem, (SELECT unnest(['NOM', 'EMAIL', 'IBAN', 'SECU', 'TEL', 'SIREN', 'SIRET', 'ISIN']) AS type) GROUP BY type")
def surrogate_numbers(spark, sf):
    """Stand-ins of every kind for numbers up to millions: all different, their check digits right."""
    keys = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("number"))
    # a number that comes again has the same stand-in
    once = keys.groupBy("number").agg(F.count("*").alias("c"))
    made = vault.with_surrogates(once.withColumn("type", F.explode(F.array(*map(F.lit, _TYPES)))), "s")
    valid = f"CASE type WHEN 'IBAN' THEN {checksums.iban('s')} WHEN 'SECU' THEN {checksums.secu('s')} WHEN 'SIREN' THEN {checksums.siren('s')} WHEN 'SIRET' THEN {checksums.siren('s')} WHEN 'ISIN' THEN {checksums.isin('s')} ELSE true END"
    each = made.groupBy("type", "s").agg(F.sum("c").alias("c"), F.bool_and(F.expr(valid)).alias("valid"))
    return each.groupBy("type").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.bool_and("valid").alias("valid"))


@query("SELECT c_custkey AS k, 'vu le ' || p || ' de a' || c_custkey || '@b.fr fin' AS restored, false AS leaks FROM (SELECT c_custkey, '06 12 34 ' || lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') || ' 78' AS p FROM customer)")
def surrogate_roundtrip(spark, sf):
    """Texts with stand-ins for numbers and addresses, and the texts again from the vault."""
    docs = customer(spark, sf, doc_id="c_custkey", text="concat('vu le 06 12 34 ', lpad(cast(c_custkey % 90 AS string), 2, '0'), ' 78 de a', c_custkey, '@b.fr fin')")
    out, known = Masker(recognizers=[r for r in core() if r.type in ("EMAIL", "TEL")], surrogates=True).mask(docs)
    back = masker.restore_surrogates(out, known)
    return back.select(F.col("doc_id").alias("k"), "restored", F.expr("masked rlike '06 12 34|@b[.]fr'").alias("leaks"))


@query("SELECT c_custkey AS k, c_name AS value, c_custkey % 4 <> 0 AS sealed FROM customer WHERE c_custkey % 5 > 1 AND c_custkey % 7 > 0")
def vault_lifecycle(spark, sf):
    """A vault sealed but for what was plain, opened again, purged of the old and rid of a subject."""
    rows = customer(spark, sf, k="c_custkey", mission="'m'", type="'NOM'", value="c_name", number="c_custkey", variant="''", token="concat('t', c_custkey)", created_at="timestamp_seconds(86400 * cast(c_custkey % 5 AS int))", plain="c_custkey % 4 = 0")
    some = rows.withColumn("value", F.expr("if(k % 7 = 0, concat('Jean Tiers ', k), value)"))
    shut = vault.sealed(some.filter("NOT plain"), b"k" * 16).unionByName(some.filter("plain"))
    marked = lists.materialise(shut.withColumn("sealed", ~vault.plaintext(shut)), "sealed")
    open_ = vault.opened(marked, b"k" * 16)
    kept = vault.forget_subject(vault.purged(open_, 3, F.expr("timestamp_seconds(86400 * 5 - 1)")), "jean TIERS")
    return kept.select("k", "value", "sealed")


# -- soft layers, with stub models


def _model(word: str, label: str, score: str = "0.9D"):
    """A stub that finds every place of a pattern in a window."""
    return lambda c: F.expr(f"transform({S.hits('chunk', word)}, x -> named_struct('label', '{label}', 'text', x.v, 'start', x.s, 'end', x.e, 'score', {score}))")


@query(
    r"""SELECT doc_id, value, CAST(instr(text, value) - 1 AS INTEGER) AS s, 'NOM' AS type FROM (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '[A-Z][a-z]{8,}')) AS value FROM documents)"""
)
def model_windows(spark, sf):
    """Names that a stub finds in overlapping windows of all texts, each at its first place in the text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = soft.model_spans(docs, _model("[A-Z][a-z]{8,}", "person name"), compress=False)
    whole = spans_of(found, "doc_id", "text", column="soft")
    # a window's edge may cut a word, whose parts are no words of the text
    real = whole.filter("array_contains(regexp_extract_all(text, '[A-Z][a-z]{8,}', 0), m.value)")
    return real.select("doc_id", "m.value", F.expr("instr(text, m.value) - 1").alias("s"), "m.type").distinct()


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'gliner' WHEN c_custkey % 3 = 1 THEN 'openai' ELSE 'both' END AS mode, CAST(CASE WHEN c_custkey % 3 = 1 THEN 2 ELSE 0 END AS INTEGER) AS s, CAST(CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 10 END AS INTEGER) AS e,
    CASE WHEN c_custkey % 3 = 0 THEN 0.5 ELSE 0.7 END AS score FROM customer"""
)
def model_merge(spark, sf):
    """Two models' spans by mode: one, the other, or their union with the better score."""
    span = "array(named_struct('s', {s}, 'e', {e}, 'type', 'NOM', 'value', substring(text, {s} + 1, {e} - {s}), 'score', {score}D, 'priority', 5))"
    rows = customer(spark, sf, k="c_custkey", text="c_name", mode="CASE c_custkey % 3 WHEN 0 THEN 'gliner' WHEN 1 THEN 'openai' ELSE 'both' END")
    merged = rows.withColumn("spans", F.expr(soft.by_mode("mode", "text", span.format(s=0, e=8, score=0.5), span.format(s=2, e=10, score=0.7))))
    return spans_of(merged, "k", "mode").select("k", "mode", "m.s", "m.e", "m.score")


@query("SELECT c_custkey AS k, type, text FROM (SELECT c_custkey, unnest(CASE c_custkey % 3 WHEN 0 THEN [{type: 'NOM', text: c_name}, {type: 'SOCIETE', text: c_mktsegment}] WHEN 1 THEN [{type: 'NOM', text: c_name}, {type: 'EMAIL', text: 'a@b.fr'}] ELSE [] END, recursive := true) FROM customer)")
def model_answers(spark, sf):
    """Entities in models' answers: JSON, lines of types and values, and what is neither."""
    answer = "CASE k % 3 WHEN 0 THEN concat('{\"entities\": [{\"type\": \"person\", \"text\": \"', c_name, '\"}, {\"type\": \"ORG\", \"text\": \"', seg, '\"}, {\"type\": \"X\", \"text\": \"y\"}]}') WHEN 1 THEN concat('NOM: ', c_name, '\\nEMAIL : a@b.fr\\nSOCIETE: (aucune)\\nVILLE: x') ELSE 'rien: du tout' END"
    rows = customer(spark, sf, k="c_custkey", c_name="c_name", seg="c_mktsegment").withColumn("answer", F.expr(answer))
    found = rows.withColumn("got", F.expr(f"CASE WHEN k % 3 = 0 THEN {soft.llm_entities('answer')} ELSE {soft.answer_lines('answer')} END"))
    return found.select("k", F.explode("got").alias("x")).select("k", "x.type", "x.text")


@query("SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'MOT' ELSE 'NOM' END AS verdict, c_custkey % 4 = 2 AS generic FROM customer")
def model_verdicts(spark, sf):
    """What answers say of a word, and of a value; in doubt it stays masked."""
    answer = "CASE k % 4 WHEN 0 THEN 'un mot.' WHEN 1 THEN 'mot ou nom' WHEN 2 THEN 'generique' ELSE 'generique, PII' END"
    return customer(spark, sf, k="c_custkey").select("k", F.expr(soft.name_verdict(answer)).alias("verdict"), F.expr(soft.value_verdict(answer)).alias("generic"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'B-NOM E-NOM O S-NOM' ELSE 'O O O S-NOM' END AS path FROM customer")
def model_paths(spark, sf):
    """Best valid label paths; where the likeliest labels form none, the likeliest path that is one."""
    names = ["O", "B-NOM", "I-NOM", "E-NOM", "S-NOM"]
    grid = "array(if(k % 2 = 0, array(0D, 5D, 0D, 0D, 0D), array(2D, 0D, 0D, 3D, 0D)), if(k % 2 = 0, array(0D, 0D, 0D, 5D, 0D), array(2D, 0D, 3D, 0D, 0D)), array(5D, 0D, 0D, 0D, 0D), array(0D, 0D, 0D, 0D, 5D))"
    rows = customer(spark, sf, k="c_custkey").withColumn("logits", F.expr(grid)).withColumn("labels", F.array(*map(F.lit, names)))
    spans = rows.withColumn("found", soft.viterbi("logits", "labels"))
    label = "CASE WHEN NOT exists(found, f -> f.first <= t AND t < f.last) THEN 'O' WHEN exists(found, f -> f.first = t AND f.last = t + 1) THEN 'S-NOM' WHEN exists(found, f -> f.first = t) THEN 'B-NOM' WHEN exists(found, f -> f.last = t + 1) THEN 'E-NOM' ELSE 'I-NOM' END"
    return spans.select("k", F.expr(f"array_join(transform(sequence(0, 3), t -> {label}), ' ')").alias("path"))


@query("SELECT c_custkey AS k, CAST(s AS INTEGER) AS s, CAST(s + length(c_name) AS INTEGER) AS e FROM (SELECT c_custkey, c_name, unnest([0, length(c_name) + 4]) AS s FROM customer WHERE c_custkey % 2 = 0)")
def model_name_sweep(spark, sf):
    """Further places of names that a model found once."""
    rows = customer(spark, sf, doc_id="c_custkey", text="concat('Xa', lpad(cast(c_custkey AS string), 4, '0'), ' ', c_name)", k="c_custkey", n="c_name")
    word = "translate(n, 'Customer#0123456789', 'Customerkabcdefghij')"
    rows = rows.select("doc_id", "k", F.expr(f"concat(n, ' vu ', n)").alias("raw"), F.expr(f"concat({word}, ' vu ', lower({word}))").alias("text"), F.expr(word).alias("w"))
    given = "CASE WHEN k % 2 = 0 THEN array(named_struct('s', 0, 'e', length(w), 'type', 'NOM', 'value', w, 'score', 0.9D, 'priority', 5)) ELSE " + S.NONE + " END"
    return spans_of(rows.withColumn("given", F.expr(f"cast({given} AS array<{S.SPAN}>)")).withColumn("spans", F.expr(lists.name_sweep("text", "given"))), "k").select("k", "m.s", "m.e")


# -- profiles


@query(
    """SELECT c_custkey AS k, CAST(3 AS INTEGER) AS s, 'EMAIL' AS type FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, CAST(3 AS INTEGER), 'EMAIL' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 10 = 1"""
)
def profile_two_pass(spark, sf):
    """What half of a dossier's documents teach is found in the others: an address written with spaces, of its own dossier only."""
    mail = "concat('c', {n}, '@ex.fr')"
    text = f"CASE WHEN k % 2 = 0 THEN concat('vu ', {mail.format(n='k')}, ' ici') WHEN k % 10 = 1 THEN concat('vu ', {mail.format(n='k + 1')}, ' ici') ELSE concat('vu ', c_name, ' ici') END"
    docs = customer(spark, sf, k="c_custkey", doc_id="c_custkey", c_name="c_name", dossier="cast((c_custkey + 1) div 2 AS string)").withColumn("text", F.expr(text))
    # only even documents are looked at in the first pass
    engine = Masker(recognizers=[], extra={"mail": lambda d: F.when(F.col("k") % 2 == 0, F.expr([r for r in core() if r.type == "EMAIL"][0].sql("text")))} , context_boost=False)
    return spans_of(profile.two_pass(docs, engine), "k").select("k", "m.s", "m.type").filter("type = 'EMAIL'")


@query("SELECT source AS dossier, count(*) AS n_files, count(*) AS n_ok FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}') GROUP BY 1")
def dossier_masking(spark, sf):
    """Documents with addresses masked dossier by dossier, each with a vault of its own; all of them end safe."""
    mail = [r for r in core() if r.type == "EMAIL"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("dossier"), "doc_id", "text").filter(F.expr(mail[0].needs.format(text="text"))).filter(F.expr(f"text rlike {S.quote(mail[0].pattern)}"))
    files, _, totals = profile.mask_dossiers(docs, Masker(recognizers=mail))
    return totals.join(files.groupBy("dossier").agg(F.count("*").alias("n_files")), "dossier").select("dossier", "n_files", "n_ok")


@query("SELECT c_custkey AS k, CAST(s AS INTEGER) AS s, CAST(s + length(v) AS INTEGER) AS e, type, v AS value FROM (SELECT c_custkey, 3 AS s, 'EMAIL' AS type, 'a' || c_custkey || '@b.fr' AS v FROM customer UNION ALL SELECT c_custkey, 3 + length('a' || c_custkey || '@b.fr') + 4, 'TEL', '06 12 34 56 78' FROM customer WHERE c_custkey % 2 = 0)")
def table_function_matches(spark, sf):
    """Addresses and numbers found by the SQL table function in a lateral join; texts in which nothing is found have no row."""
    presets.table_function(spark, "detect_contacts", [r for r in core() if r.type in ("EMAIL", "TEL")])
    customer(spark, sf, k="c_custkey", text="concat('vu a', c_custkey, '@b.fr et ', if(c_custkey % 2 = 0, '06 12 34 56 78', 'rien'))").createOrReplaceTempView("contact_texts")
    return spark.sql("SELECT k, s, e, type, value FROM contact_texts, LATERAL detect_contacts(text)")
