"""Detect, mask, judge and restore documents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import gate
from ..functions import spans as S
from ..plans import verdict as V
from ..sources.tables import materialise
from . import forms, vault
from . import lists as L
from .recognizers import core
from .spec import Recognizer

#: Most rounds in which what is still found in the output is masked too.
RESIDUAL_ROUNDS = 3
#: Own list: words that make a match near them more likely.
CUES = ["client", "cliente", "nom", "prénom", "né", "née", "naissance", "adresse", "téléphone", "tél", "mail", "courriel", "compte", "iban", "monsieur", "madame", "demeurant", "titulaire", "souscripteur"]


@dataclass
class Masker:
    """A configured engine over documents (doc_id, text[, mission, filename]).

    ``extra``: functions from the DataFrame to a column of spans, by name;
    ``keep``: SQL over a span ``m`` that says which to keep (policy and lists);
    ``forms``: whether form rules run; ``dictionary``: known values (value,
    entity_type), found whatever their case and accents; ``forenames``: a list of any size (see
    ``lists.forename_spans``), beside the recognisers'; ``lists``: tables that
    keep matches in clear; ``variants``: names that share a distinctive word get
    one number (see ``vault.allocate``). Where there are ``extra`` sources, names of a model's
    are looked for in the whole text. Null text counts as empty.
    """

    recognizers: list[Recognizer] = field(default_factory=core)
    extra_recognizers: list[Recognizer] = field(default_factory=list)
    extra: dict[str, Callable[[DataFrame], object]] = field(default_factory=dict)
    keep: str | None = None
    forms: bool = False
    context_boost: bool = True
    threshold: float = V.THRESHOLD
    surrogates: bool = False
    variants: bool = True
    dictionary: DataFrame | None = None
    lists: L.Lists | None = None
    forenames: DataFrame | None = None

    def register_detector(self, name: str, fn: Callable[[DataFrame], object]) -> None:
        """Add a source of spans: a function from a DataFrame to a span column, such as a pandas UDF's."""
        self.extra[name] = fn

    def detect(self, docs: DataFrame, out: str = "spans") -> DataFrame:
        """``docs`` with disjoint spans in order, kept and boosted as configured."""
        docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
        names = []
        if self.dictionary is not None:
            names.append("__known")
            docs = L.dictionary_spans(docs, self.dictionary, out="__known")
        if self.forenames is not None:
            names.append("__forenames")
            docs = L.forename_spans(docs, self.forenames, out="__forenames")
        docs = docs.withColumn("__low", F.lower("text"))
        for k, r in enumerate([*self.recognizers, *self.extra_recognizers]):
            names.append(f"__r{k}")
            docs = docs.withColumn(names[-1], F.expr(r.sql("text", "__low")))
        if self.forms:
            names.append("__forms")
            docs = docs.withColumn("__forms", F.concat(*[F.expr(forms.rule_spans(n, "text", "__low")) for n in forms.ORDER]))
            docs = docs.withColumn("__forms", F.concat("__forms", F.expr(forms.company_repetitions("text", "__forms"))))
            words = forms.filename_words("filename") if "filename" in docs.columns else "cast(array() AS array<string>)"
            docs = docs.withColumn("__words", F.coalesce(F.expr(words), F.array().cast("array<string>"))).withColumn("__footers", F.expr(forms.footer_names("text", "__words")))
            docs = docs.withColumn("__forms", F.concat("__forms", F.expr(forms.rule_spans("signataire", "text", "__low")), "__footers"))
            docs = docs.withColumn("__forms", F.concat("__forms", F.expr(forms.person_repetitions("text", "__forms", "__words", "__footers"))))
        for name, fn in self.extra.items():
            names.append(f"__x_{name}")
            docs = docs.withColumn(names[-1], F.coalesce(fn(docs), F.expr(S.NONE)))
        docs = docs.withColumn("__all", F.concat(F.expr(S.NONE), *names)).withColumn(out, F.expr(S.resolved("__all")))
        if self.extra:
            docs = docs.withColumn(out, F.expr(L.name_sweep("text", out)))
        if self.context_boost:
            docs = docs.withColumn(out, F.expr(f"CASE WHEN size({out}) = 0 THEN {out} ELSE {S.boosted('text', out, CUES)} END"))
        if self.keep:
            docs = docs.withColumn(out, F.expr(f"filter({out}, m -> {self.keep})"))
        docs = docs.drop("__all", "__low", "__words", "__footers", *names)
        return docs if self.lists is None else L.kept_by(docs, out, self.lists)

    def mask(self, docs: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Masked documents and the vault that restores them.

        Columns: doc_id, mission, original, masked, entities (spans with token
        and phase), residual, state, safe. Only exploded spans are shuffled, to
        meet their tokens and to come back to their documents. What is still
        found in the output is masked too, for ``RESIDUAL_ROUNDS`` rounds at
        most; a round has only the documents with something left, and adds only
        its own new values to the vault.
        """
        if "mission" not in docs.columns:
            docs = docs.withColumn("mission", F.lit("default"))
        found = self.detect(docs)
        work = materialise(found.select("doc_id", "mission", F.col("text").alias("original"), F.col("text").alias("masked"), "spans", *(["filename"] if "filename" in docs.columns else [])), "detected")
        settled, vaults, entities = [], [] if known is None else [known], None
        for phase in range(RESIDUAL_ROUNDS + 1):
            work = work.withColumn("__key", _row_key("masked"))
            flat = work.select("__key", "doc_id", "mission", F.explode("spans").alias("m")).select("__key", "doc_id", "mission", F.col("m.*"))
            vaults.append(materialise(vault.allocate(flat, _union(vaults), variants=self.variants), "vault"))
            values = _union(vaults).select("mission", "type", "value", F.expr("token") if not self.surrogates else vault.surrogate(variant="variant").alias("token"))
            named = flat.join(values, ["mission", "type", "value"])
            put = named.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct("s", "e", "type", "value", "score", "priority", "token"))).alias("tokens"))
            empty = F.expr("cast(array() AS array<struct<s:int,e:int,type:string,value:string,score:double,priority:int,token:string>>)")
            work = work.join(put, "__key", "left").drop("__key").withColumn("tokens", F.coalesce("tokens", empty))
            work = work.withColumn("masked", F.expr(S.unglued(S.rewritten("masked", "tokens", "x.token"))))
            own = F.transform("tokens", lambda x: F.struct(*[x[c].alias(c) for c in ("s", "e", "type", "value", "score", "priority", "token")], F.lit("body" if phase == 0 else "residual").alias("phase")))
            work = work.withColumn("entities", own if entities is None else F.concat("entities", own)).drop("tokens", "spans")
            entities = True
            # a text without entities is as it was, and nothing was found in it
            again = self.detect(work.withColumn("text", F.when(F.size("entities") > 0, F.col("masked")).otherwise("")))
            tokens = S.hits("masked", S.TOKEN)
            rest = F.expr(f"CASE WHEN size(spans) = 0 THEN spans ELSE {S.outside('spans', tokens)} END") if not self.surrogates else F.expr("filter(spans, m -> NOT exists(entities, t -> contains(t.token, m.value) OR contains(m.value, t.token)))")
            work = materialise(again.withColumn("spans", rest).drop("text"), "masked")
            left = work.filter(F.size("spans") > 0)
            if phase == RESIDUAL_ROUNDS or left.isEmpty():
                settled.append(work)
                break
            settled.append(work.filter(F.size("spans") == 0))
            work = left
        out = _union(settled).withColumnRenamed("spans", "residual").withColumn("state", F.expr(V.state("original", "entities", "residual", self.threshold))).withColumn("safe", F.expr(V.safe("state")))
        return out, _union(vaults)

    def restore(self, docs: DataFrame, known: DataFrame) -> DataFrame:
        return restore(docs, known)


def _union(tables: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, tables) if tables else None


def _row_key(text: str):
    """A row by its id, mission and text: rows alike in these share their tokens' places, others never do."""
    return F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x02")), F.coalesce("mission", F.lit("\x02")), F.col(text)).cast("binary"))


def restore(docs: DataFrame, known: DataFrame, column: str = "masked") -> DataFrame:
    """``docs`` with ``restored``: tokens replaced by their values; foreign tokens stay.

    ``n_restored`` and ``n_unresolved`` count distinct tokens.
    """
    if "mission" not in docs.columns:
        docs = docs.withColumn("mission", F.lit("default"))
    places = docs.withColumn("__hits", F.expr(f"CASE WHEN contains({column}, '⟦') THEN {S.hits(column, S.TOKEN)} ELSE cast(array() AS array<struct<s:int,e:int,v:string>>) END"))
    places = places.withColumn("__key", _row_key(column))
    flat = places.select("__key", "mission", F.explode("__hits").alias("h")).select("__key", "mission", "h.*")
    met = flat.join(known.select("mission", F.col("token").alias("v"), "value"), ["mission", "v"], "left")
    back = met.groupBy("__key").agg(F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.struct("s", "e", "value")))).alias("__put"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("v"))).alias("n_restored"), F.count_distinct(F.when(F.col("value").isNull(), F.col("v"))).alias("n_unresolved"))
    joined = docs.withColumn("__key", _row_key(column)).join(back, "__key", "left").drop("__key")
    put = F.coalesce("__put", F.expr("cast(array() AS array<struct<s:int,e:int,value:string>>)"))
    return (
        joined.withColumn("__put", put).withColumn("restored", F.expr(S.rewritten(column, "__put", "x.value")))
        .withColumn("n_restored", F.coalesce("n_restored", F.lit(0))).withColumn("n_unresolved", F.coalesce("n_unresolved", F.lit(0))).drop("__put")
    )


def restore_surrogates(docs: DataFrame, known: DataFrame, column: str = "masked", key: str = vault.KEY) -> DataFrame:
    """``docs`` with ``restored``: stand-ins of the vault ``known`` replaced by its values, as whole words, exactly as they were put."""
    if "mission" not in docs.columns:
        docs = docs.withColumn("mission", F.lit("default"))
    listed = known.select("mission", vault.surrogate(key, "variant").alias("value"), F.col("value").alias("back"), F.lit(True).alias("exact"))
    span = "named_struct('s', s, 'e', e, 'type', '', 'value', c.back, 'score', 1.0D, 'priority', 0)"
    found = L.listed_spans(docs.withColumn("text", F.col(column)), listed, ["doc_id", "mission"], ["mission"], span, "__put")
    return found.withColumn("__put", F.expr(S.resolved("__put"))).withColumn("restored", F.expr(S.rewritten(column, "__put", "x.value"))).drop("__put", "text")


def unresolved(text: str) -> str:
    """SQL: whether a draft still holds a token, and so isn't sent."""
    return f"({text} rlike r'{S.TOKEN}')"


def replace_outside_tokens(text: str, value: str, put: str) -> str:
    """SQL: every ``value`` outside tokens replaced by ``put``; struct (text, n)."""
    between, tokens = f"split({text}, r'{S.TOKEN}', -1)", f"regexp_extract_all({text}, r'{S.TOKEN}', 0)"
    count = f"aggregate({between}, 0, (a, p) -> a + cast((length(p) - length(replace(p, {value}, ''))) / length({value}) AS int))"
    joined = f"array_join(flatten(zip_with(transform({between}, p -> replace(p, {value}, {put})), {tokens}, (p, t) -> array(p, coalesce(t, '')))), '')"
    return f"named_struct('text', {joined}, 'n', {count})"


def serve_net(text: str, values: str) -> str:
    """SQL: known values of three letters or more replaced by a blank token in a text about to be served, longest first."""
    ordered = f"array_sort(filter({values}, v -> length(v) >= 3), (l, r) -> length(r) - length(l))"
    return f"aggregate({ordered}, {text}, (t, v) -> replace(t, v, '⟦NOM_∎⟧'))"


def json_strings(text: str) -> str:
    """SQL: the string values of a JSON text, keys left out: array of (s, e, v), quotes outside.

    Strings are read one after the other from the start, so that nothing inside
    one is taken for another; a string before a colon is a key.
    """
    string = r'"(?:[^"\\]|\\.)*+"(?:\s*+:)?+'
    return f"transform(filter({S.hits(text, string)}, x -> NOT endswith(x.v, ':')), x -> named_struct('s', x.s + 1, 'e', x.e - 1, 'v', substring(x.v, 2, length(x.v) - 2)))"


def mask_json(docs: DataFrame, masker: Masker, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, json[, mission])`` with every string value masked, its keys and shape kept: (documents, vault).

    Documents have json (as it was), masked, n_changed (values), safe (no value
    leaks). A text that is no JSON, or in which nothing is found, passes as it
    is (n_changed 0); null stays null. Each value is one text to the masker.
    """
    mission = F.col("mission") if "mission" in docs.columns else F.lit("default")
    given = docs.select("doc_id", mission.alias("mission"), "json").withColumn("__key", F.md5(F.concat_ws("\x01", F.coalesce(F.col("doc_id").cast("string"), F.lit("\x02")), "mission", "json").cast("binary")))
    valid = "json IS NOT NULL AND try_parse_json(json) IS NOT NULL"
    leaves = given.filter(valid).select("__key", "mission", F.posexplode_outer(F.expr(json_strings("json"))).alias("i", "x")).filter("x IS NOT NULL").distinct()
    text = F.from_json(F.concat(F.lit('["'), "x.v", F.lit('"]')), "array<string>")[0]
    out, vault_ = masker.mask(leaves.select(F.struct("__key", "i").alias("doc_id"), "mission", text.alias("text")), known)
    put = F.when(F.col("masked") != F.col("original"), F.regexp_replace(F.to_json(F.array("masked")), r'^\["|"\]$', ""))
    back = out.groupBy(F.col("doc_id.__key").alias("__key")).agg(F.array_sort(F.collect_set(F.when(put.isNotNull(), F.struct(F.col("doc_id.i").alias("i"), put.alias("put"))))).alias("__put"), F.bool_and("safe").alias("__safe"))
    places = S.let("js", json_strings("json"), "transform(__put, p -> named_struct('s', js[p.i].s, 'e', js[p.i].e, 'put', p.put))")
    masked = f"CASE WHEN __put IS NULL OR size(__put) = 0 THEN json ELSE {S.rewritten('json', places, 'x.put')} END"
    met = given.join(back, "__key", "left")
    return met.select("doc_id", "mission", "json", F.expr(masked).alias("masked"), F.coalesce(F.size("__put"), F.lit(0)).alias("n_changed"), F.coalesce("__safe", F.lit(True)).alias("safe")), vault_


def contain_results(results: DataFrame, masker: Masker, tools: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tool results (doc_id, tool, json): those of tools whose name matches ``tools`` masked, the others as they are.

    ``rewritten`` says whether a result is to be put in place of the given one:
    only if something changed.
    """
    named = F.coalesce(F.col("tool").rlike(tools), F.lit(False))
    out, vault_ = mask_json(results.filter(named).select("doc_id", "json"), masker, known)
    done = out.select("doc_id", "json", "masked", "n_changed")
    rest = results.filter(~named).select("doc_id", "json", F.col("json").alias("masked"), F.lit(0).alias("n_changed"))
    return done.unionByName(rest).withColumn("rewritten", F.col("n_changed") > 0), vault_


def rewrite_outputs(rows: DataFrame, masker: Masker, opted_in: bool, in_scope: str = "true", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Tool outputs (doc_id, shape, text): masked where all conditions hold, one after the other, the cheap ones first.

    Someone opted in; the row is in scope (SQL); the result is pure text and
    not too long; the cheap gate sees personal data. ``rewritten`` only if the
    text changed.
    """
    wanted = F.expr(f"coalesce({in_scope}, false) AND coalesce({gate.rewritable('shape', 'text')}, false) AND size({gate.labels('text')}) > 0")
    unchanged = [F.col("text").alias("masked"), F.lit(False).alias("rewritten")]
    if not opted_in:
        return rows.select("doc_id", "text", *unchanged), known
    marked = rows.withColumn("__wanted", F.coalesce(wanted, F.lit(False)))
    out, vault_ = masker.mask(marked.filter("__wanted").select("doc_id", "text"), known)
    done = out.select("doc_id", F.col("original").alias("text"), "masked", (F.col("masked") != F.col("original")).alias("rewritten"))
    return done.unionByName(marked.filter("NOT __wanted").select("doc_id", "text", *unchanged)), vault_


def highlight(text: str, spans: str) -> str:
    """SQL: HTML of a text with its spans, in order, marked; one that begins inside a marked one isn't."""
    escaped = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    kept = "aggregate(r, cast(array() AS array<struct<s:int,e:int,type:string>>), (a, x) -> if(size(a) > 0 AND x.s < element_at(a, -1).e, a, array_append(a, named_struct('s', x.s, 'e', x.e, 'type', x.type))))"
    marked = S.let("o", spans, f"CASE WHEN size(o) = 0 THEN cast(array() AS array<struct<s:int,e:int,type:string>>) ELSE flatten({S.runs('o', kept)}) END")
    mark = f"concat({escaped.format('{}')}, '<mark title=\"', x.type, '\">', {escaped.format(S.cut('bl', 'x.s', 'x.e'))}, '</mark>')"
    return S.joined(text, marked, mark, escaped)


def anonymise_mail(mail: DataFrame, masker: Masker) -> tuple[DataFrame, DataFrame]:
    """Mail (uid, from, subject, body) masked as one text each, its uid put before in clear.

    A message whose verdict isn't safe has no text (null), and says so.
    """
    docs = mail.select(F.col("uid").alias("doc_id"), F.concat_ws("\n", F.concat(F.lit("From: "), F.col("from")), F.concat(F.lit("Subject: "), F.col("subject")), F.lit(""), F.col("body")).alias("text"))
    out, known = masker.mask(docs)
    return out.select(F.col("doc_id").alias("uid"), F.when(F.col("safe"), F.concat(F.lit("UID: "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("masked"))).alias("text"), "state"), known
