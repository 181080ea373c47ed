"""Registered queries of each recogniser and form rule, over texts made of ``customer`` keys.

A text is ``before``, a value and ``after``, all made of the key ``k`` and the
segment ``c_mktsegment``; the SQL says by construction where the value is, what
it is and how sure, and which texts have none. Snippets are of both dialects.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import forms
from .operators.recognizers import core

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def pad(x: str, n: int) -> str:
    return f"lpad(cast({x} AS string), {n}, '0')"


def luhn(d: str) -> str:
    """DuckDB: whether the digits ``d`` have the check digit of cards."""
    v = f"CAST({d}[i] AS INTEGER)"
    return f"list_sum(list_transform(generate_series(1, length({d})), lambda i: CASE WHEN (length({d}) - i) % 2 = 1 THEN CASE WHEN {v} > 4 THEN {v} * 2 - 9 ELSE {v} * 2 END ELSE {v} END)) % 10 = 0"


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def _texts(spark: SparkSession, sf: str, before: str, value: str, after: str) -> DataFrame:
    made = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "c_mktsegment")
    return made.selectExpr("k", f"concat({before}, {value}, {after}) AS text")


def _spans(spans: str, before: str, value: str, after: str, spark: SparkSession, sf: str) -> DataFrame:
    found = _texts(spark, sf, before, value, after).withColumn("spans", F.expr(spans))
    return found.select("k", F.explode_outer("spans").alias("m")).filter("m IS NOT NULL").select("k", "m.s", "m.e", "m.type", "m.value", "m.score", "m.priority")


def add(name: str, spans: str, doc: str, type_: str, priority: int, value: str, before: str = "'vu '", after: str = "' fin'", score: str = "1.0", where: str = "true", shown: str | None = None) -> None:
    """Register the query ``name`` and its SQL; ``shown``: the value reported, if not the one in the text."""
    run = partial(_spans, spans, before, value, after)
    run.__doc__, run.__name__ = doc, name
    QUERIES[name] = run
    ORACLE_SQL[name] = f"""SELECT k, CAST(length(b) AS INTEGER) AS s, CAST(length(b) + length(v) AS INTEGER) AS e, '{type_}' AS type, {shown or 'v'} AS value, CAST({score} AS DOUBLE) AS score, {priority} AS priority
      FROM (SELECT k, c_mktsegment, {before} AS b, {value} AS v FROM (SELECT c_custkey AS k, c_mktsegment FROM customer)) WHERE {where}"""


def recogniser(name: str, type_: str, nth: int, value: str, **options) -> None:
    r = [x for x in core() if x.type == type_][nth]
    add(f"recognise_{name}", r.sql("text"), f"{type_} in texts made of customer keys, with places and scores.", type_, r.priority, value, **options)


_IBAN = f"concat('FR', {pad('k % 97', 2)}, '30006', {pad('k', 5)}, {pad('k * 7919', 11)}, '89')"
_GROUPED = f"concat(substring({_IBAN}, 1, 4), ' ', substring({_IBAN}, 5, 4), ' ', substring({_IBAN}, 9, 4), ' ', substring({_IBAN}, 13, 4), ' ', substring({_IBAN}, 17, 4), ' ', substring({_IBAN}, 21, 4), ' ', substring({_IBAN}, 25, 3))"
_PLAIN_IBAN = "replace(v, ' ', '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(regexp_extract_all(substr({_PLAIN_IBAN}, 5) || '1527' || substr({_PLAIN_IBAN}, 3, 2), '[0-9]'), lambda x: CAST(x AS BIGINT))), lambda a, x: (a * 10 + x) % 97) = 1"
recogniser("iban", "IBAN", 0, f"CASE WHEN k % 2 = 0 THEN {_IBAN} ELSE {_GROUPED} END", score=f"CASE WHEN {_MOD97} THEN 1.0 ELSE 0.5 END")
recogniser("isin", "ISIN", 0, f"concat('FR', {pad('k * 7907 % 10000000000', 10)})", score=f"(SELECT CASE WHEN {luhn('d')} THEN 1.0 ELSE 0.5 END FROM (SELECT '1527' || substr(v, 3) AS d))")
_FOURTEEN = pad("k * 104729 % 100000000000000", 14)
_SIRET = f"CASE k % 3 WHEN 0 THEN {_FOURTEEN} WHEN 1 THEN concat(substring({_FOURTEEN}, 1, 3), ' ', substring({_FOURTEEN}, 4, 3), ' ', substring({_FOURTEEN}, 7, 3), ' ', substring({_FOURTEEN}, 10, 5)) ELSE concat(substring({_FOURTEEN}, 1, 9), '-', substring({_FOURTEEN}, 10, 5)) END"
recogniser("siret", "SIRET", 0, _SIRET, score=f"CASE WHEN k % 3 < 2 AND (SELECT {luhn('d')} FROM (SELECT {digits('v')} AS d)) THEN 1.0 ELSE 0.5 END")
_NINE = pad("k * 7919 % 1000000000", 9)
recogniser("siren", "SIREN", 0, f"CASE k % 2 WHEN 0 THEN {_NINE} ELSE concat(substring({_NINE}, 1, 3), ' ', substring({_NINE}, 4, 3), ' ', substring({_NINE}, 7, 3)) END", score=f"CASE WHEN (SELECT {luhn('d')} FROM (SELECT {digits('v')} AS d)) THEN 1.0 ELSE 0.4 END")
recogniser("secu", "SECU", 0, f"concat(1 + k % 2, ' ', {pad('k % 100', 2)}, ' ', {pad('k % 12 + 1', 2)}, ' 75 ', {pad('k % 1000', 3)}, ' ', {pad('k % 997', 3)}, CASE WHEN k % 2 = 0 THEN concat(' ', {pad('k % 97 + 1', 2)}) ELSE '' END)")
recogniser("num_fiscal_labelled", "NUM_FISCAL", 0, pad("k * 7919", 13), before="CASE k % 4 WHEN 0 THEN 'Numéro fiscal : ' WHEN 1 THEN 'le SPI ' WHEN 2 THEN 'Référence fiscale ' ELSE 'ref ' END", where="k % 4 < 3")
_ELEVEN = pad("k * 104729 % 100000000000", 11)
_KEY = "97 - k * 104729 % 97 - CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END"
recogniser("num_fiscal_bare", "NUM_FISCAL", 1, f"concat(substring({_ELEVEN}, 1, 2), ' ', substring({_ELEVEN}, 3, 2), ' ', substring({_ELEVEN}, 5, 7), ' ', {pad(_KEY, 2)})", where="k % 2 = 0")
recogniser("num_teledeclarant", "NUM_TELEDECLARANT", 0, f"concat({pad('k % 1000', 3)}, ' ', {pad('k % 100', 2)}, ' 91 ', {pad('k', 10)}, ' ', k % 10, ' ', chr(cast(65 + k % 26 AS int)))")
recogniser("num_client", "NUM_CLIENT", 0, f"concat('AB', {pad('k', 6)})", before="CASE k % 4 WHEN 0 THEN 'N° client O2S : ' WHEN 1 THEN 'Client n° ' WHEN 2 THEN 'Référence client ' ELSE 'client ' END", where="k % 4 < 3")
recogniser("date_naissance", "DATE_NAISSANCE", 0, f"CASE WHEN k % 2 = 0 THEN concat({pad('k % 28 + 1', 2)}, '/', {pad('k % 12 + 1', 2)}, '/', 1940 + k % 60) ELSE concat(k % 28 + 1, ' mars ', 1940 + k % 60) END", before="CASE k % 4 WHEN 0 THEN 'Né le ' WHEN 1 THEN 'Date de naissance : ' WHEN 2 THEN 'née le ' ELSE 'le ' END", where="k % 4 < 3")
recogniser("tel", "TEL", 0, f"CASE WHEN k % 2 = 0 THEN concat('0', k % 9 + 1, ' 12 34 ', {pad('k % 100', 2)}, ' 78') ELSE concat('+33 6.12.34.56.', {pad('k % 100', 2)}) END")
recogniser("montant", "MONTANT", 0, "CASE k % 3 WHEN 0 THEN concat(k % 900 + 100, ' 000 €') WHEN 1 THEN concat(k % 900 + 1, ',50 euros') ELSE concat(k % 900 + 1, ' EUR') END")
recogniser("adresse", "ADRESSE", 0, "CASE WHEN k % 2 = 0 THEN concat(k % 200 + 1, ' rue de la Paix 75002 Paris') ELSE concat(k % 200 + 1, ' bis, avenue Foch') END", after="', merci'")
recogniser("nom_titled", "NOM", 0, "concat(CASE k % 3 WHEN 0 THEN 'M. Jean ' WHEN 1 THEN 'Madame ' ELSE 'Mlle Zoé ' END, c_mktsegment)", after="' signe'")
recogniser("nom_forename", "NOM", 1, "concat(CASE WHEN k % 2 = 0 THEN 'Nathalie ' ELSE 'Hélène ' END, c_mktsegment)", after="' signe'")
recogniser("nom_homograph", "NOM", 2, "concat('Robert ', c_mktsegment)", before="CASE WHEN k % 2 = 0 THEN 'Mme le juge et ' ELSE 'le juge et ' END", after="' signe'", where="k % 2 = 0")
recogniser("poste", "POSTE", 0, "CASE WHEN k % 2 = 0 THEN 'directeur marketing chez TotalEnergies' ELSE 'gérante' END", after="', hier'")


def rule(name: str, doc: str, type_: str, value: str, **options) -> None:
    r = forms.RULES[name][0]
    add(f"form_{name}", forms.rule_spans(name), doc, type_, r.priority, value, score=str(r.score), **options)


rule("birthplace", "Towns in capitals behind a date; headings are none.", "LIEU_NAISSANCE", "CASE WHEN k % 3 = 0 THEN 'ANNEXE' WHEN k % 3 = 1 THEN 'LE MANS (France)' ELSE 'LYON' END", before=f"concat({pad('k % 28 + 1', 2)}, '/02/1970 ')", after="'\n'", where="k % 3 > 0")
rule("civility_name", "Names behind a title, on its line or the next.", "NOM", "concat('Jeanne ', c_mktsegment)", before="CASE WHEN k % 2 = 0 THEN 'vu Madame ' ELSE 'Madame\n' END", after="' email'")
rule("form_nom", "Values of name fields that are filled in; a colon at once behind the word is no field.", "NOM", "CASE WHEN k % 4 = 3 THEN '(vide)' ELSE c_mktsegment END", before="CASE k % 4 WHEN 0 THEN 'Nom : ' WHEN 1 THEN 'Prénom: ' WHEN 2 THEN 'Nom:' ELSE 'Nom : ' END", after="'\nx'", where="k % 4 < 2")
rule("form_lieu_naissance", "Birth places in their fields.", "LIEU_NAISSANCE", "'Lyon'", before="CASE k % 3 WHEN 0 THEN 'Lieu de naissance : ' WHEN 1 THEN 'Né(e) le : 03/05/1980 à : ' ELSE 'Lieu : ' END", after="'\nx'", where="k % 3 < 2")
rule("form_piece_identite", "Numbers of identity documents behind their labels.", "PIECE_IDENTITE", f"concat('12AB', {pad('k', 6)})", before="CASE k % 3 WHEN 0 THEN 'Passeport n° ' WHEN 1 THEN 'CNI : ' ELSE 'colis ' END", after="'\nx'", where="k % 3 < 2")
rule("commune_postcode", "Towns with their postcodes; headings are none.", "ADRESSE", f"concat(CASE WHEN k % 3 = 0 THEN 'FACTURE' WHEN k % 3 = 1 THEN 'SAINT ETIENNE' ELSE 'Lyon' END, ' ', {pad('42000 + k % 1000', 5)})", before="'à '", where="k % 3 > 0")
rule("form_raison_sociale", "Company names in their fields, a doubled legal form once.", "RAISON_SOCIALE", "concat(CASE WHEN k % 2 = 0 THEN 'SARL ' ELSE 'SAS SAS ' END, c_mktsegment)", before="'Raison sociale : '", after="'\nx'", shown="replace(v, 'SAS SAS', 'SAS')")
rule("forme_juridique", "Legal forms with a name in capitals; the field of the form itself is none.", "RAISON_SOCIALE", "concat('SELARL ', c_mktsegment)", before="CASE WHEN k % 2 = 0 THEN 'vu ' ELSE 'Forme juridique : ' END", after="' hier'", where="k % 2 = 0")
rule("signataire", "Who signs, the office left out of the value.", "NOM", "concat(CASE WHEN k % 2 = 0 THEN 'Gérant ' ELSE '' END, 'Marc ', c_mktsegment)", before="CASE WHEN k % 3 = 0 THEN 'Signataire : ' ELSE 'Déclarant : ' END", after="'\nx'", shown="replace(v, 'Gérant ', '')")

_COMPANY = "array(named_struct('s', 17, 'e', 22 + length(c_mktsegment), 'type', 'RAISON_SOCIALE', 'value', concat('SARL ', c_mktsegment), 'score', 0.9D, 'priority', 59))"


def _made(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "c_mktsegment")


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


@query("SELECT c_custkey AS k, CAST(17 + 5 + length(c_mktsegment) + 4 + n * (9 + length(c_mktsegment)) AS INTEGER) AS s, 'SARL ' || c_mktsegment AS value FROM customer, (SELECT unnest(generate_series(0, 4)) AS n) WHERE n < c_custkey % 5")
def form_company_repetition(spark, sf):
    """Every further place of a company's name, as often as the text has it."""
    text = "concat('Raison sociale : SARL ', c_mktsegment, repeat(concat(' vu SARL ', c_mktsegment), cast(k % 5 AS int)))"
    made = _made(spark, sf).withColumn("text", F.expr(text)).withColumn("m", F.explode(F.expr(forms.company_repetitions("text", _COMPANY))))
    return made.select("k", "m.s", "m.value")


@query("SELECT c_custkey AS k, CAST(CASE WHEN c_custkey % 2 = 0 THEN 19 ELSE 18 END AS INTEGER) AS s, c_mktsegment AS value FROM customer WHERE c_custkey % 3 < 2")
def form_filename_footer(spark, sf):
    """Words of a file's name where a footer quotes the file."""
    before = "CASE WHEN k % 3 = 2 THEN 'rien de cela ici : ' WHEN k % 2 = 0 THEN 'Annexe au document ' ELSE 'Annexe au fichier ' END"
    made = _made(spark, sf).withColumn("text", F.expr(f"concat({before}, c_mktsegment, ' - DER')"))
    return made.withColumn("m", F.explode(F.expr(forms.footer_names("text", "array(c_mktsegment)")))).select("k", "m.s", "m.value")


@query("SELECT c_custkey AS k, CAST(s AS INTEGER) AS s, value FROM (SELECT c_custkey, c_mktsegment AS value, 22 + length(c_mktsegment) + 4 AS s FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 22 + 2 * length(c_mktsegment) + 11 FROM customer WHERE c_custkey % 2 = 0)")
def form_person_repetition(spark, sf):
    """A company's person elsewhere in the text: as a word, and glued to the word before."""
    text = "concat('Raison sociale : SARL ', c_mktsegment, ' vu ', c_mktsegment, CASE WHEN k % 2 = 0 THEN concat(' gérant', c_mktsegment) ELSE concat(' x', lower(c_mktsegment), 's') END)"
    made = _made(spark, sf).withColumn("text", F.expr(text)).withColumn("none", F.expr("cast(array() AS array<struct<s:int,e:int>>)")).withColumn("words", F.array().cast("array<string>"))
    return made.withColumn("m", F.explode(F.expr(forms.person_repetitions("text", _COMPANY, "words", "none")))).select("k", "m.s", "m.value")


@query("SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'SAS ' || c_mktsegment WHEN 1 THEN 'SARL ' || c_mktsegment ELSE c_mktsegment || ' SAS SAS' END AS company, list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'SMITH' ELSE c_mktsegment END, 'JONES'], lambda w: true) AS person, CASE WHEN c_custkey % 2 = 0 THEN 'Marc ' || c_mktsegment ELSE 'Gérant' END AS signer, c_custkey % 4 < 2 AS placeholder FROM customer")
def form_name_values(spark, sf):
    """Companies' names with one legal form, the person in them, signers without their office, empty fields."""
    return _made(spark, sf).select(
        "k", F.expr(forms.canonical_company("CASE k % 3 WHEN 0 THEN concat('SAS SAS ', c_mktsegment) WHEN 1 THEN concat('SARL ', c_mktsegment) ELSE concat(c_mktsegment, ' SAS SAS') END")).alias("company"),
        F.expr(forms.company_person("concat('SELARL DU DOCTEUR ', CASE WHEN k % 2 = 0 THEN 'Smith' ELSE c_mktsegment END, '-Jones')")).alias("person"),
        F.expr(forms.without_role("CASE WHEN k % 2 = 0 THEN concat('Gérant Marc ', c_mktsegment) ELSE 'Gérant' END")).alias("signer"),
        F.expr(forms.placeholder("CASE k % 4 WHEN 0 THEN ' Néant. ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' ELSE c_mktsegment END")).alias("placeholder"),
    )
