"""Lists that keep or drop matches: policy, allow list, common and safe words, known values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import NONE, SPAN, hits, let, made, quote, resolved
from ..sources.tables import materialise
from .recognizers import NAME_WORD, TITLED
from .spec import CATALOGUE, earlier

NAMES_LEAST, SOFT_LEAST, SOFT_PRIORITY = 0.85, 0.80, 5


def literals(words) -> str:
    return "array(" + ", ".join(quote(w) for w in words) + ")" if words else "cast(array() AS array<string>)"


# -- policy


def policy(stored: dict[str, bool] | None) -> dict[str, bool]:
    """Which types are cloaked: the defaults, changed by what is stored.

    Anything that is no mapping gives the defaults; an identifying type can't
    be kept in clear.
    """
    out = {e.name: e.cloak for e in CATALOGUE.values()}
    if isinstance(stored, dict):
        for k, v in stored.items():
            if isinstance(k, str) and isinstance(v, bool):
                out[k] = v or (k in CATALOGUE and CATALOGUE[k].identifying)
    return out


def by_policy(cloaked: dict[str, bool], m: str = "m") -> str:
    """SQL: whether a match's type is cloaked; unknown types are."""
    kept = [k for k, v in sorted(cloaked.items()) if not v]
    return f"NOT array_contains({literals(kept)}, {m}.type)" if kept else "true"


def kept_identifying(stored: dict[str, bool]) -> list[str]:
    """Labels of identifying types that someone set to keep."""
    return [e.label for e in CATALOGUE.values() if e.identifying and stored.get(e.name) is False]


# -- allow list: firms, regulators, their domains and numbers


def phone_key(v: str) -> str:
    """SQL: a phone number's digits, with a leading 33 or 0033 as 0."""
    return f"regexp_replace(regexp_replace({v}, '[^0-9]', ''), '^(?:0033|33)(?=[0-9]{{9}}$)', '0')"


def allowed(phrases: list[str], domains: list[str], phones: list[str], m: str = "m") -> str:
    """SQL: whether a match is a public party's.

    A phrase of several words counts anywhere in the value, a single word only
    as a whole word; domains count with their sub-domains.
    """
    v = f"lower({m}.value)"
    words = [p.lower() for p in phrases if p.strip() and " " not in p.strip()]
    longer = [p.lower().strip() for p in phrases if " " in p.strip()]
    host = f"substring_index({v}, '@', -1)"
    return (
        f"(trim({m}.value) <> '' AND (exists({literals(longer)}, p -> contains({v}, p)) OR arrays_overlap({literals(words)}, split({v}, r'(?U)\\W+'))"
        f" OR (contains({v}, '@') AND exists({literals([d.lower() for d in domains])}, d -> {host} = d OR endswith({host}, concat('.', d))))"
        f" OR ({m}.type = 'TEL' AND array_contains(transform({literals(phones)}, p -> {phone_key('p')}), {phone_key(m + '.value')}))))"
    )


def merged(public: DataFrame, own: DataFrame | None) -> DataFrame:
    """The public list and a deployment's own, if there is one."""
    return (public if own is None else public.unionByName(own)).distinct()


def negative(known: str, allow: str, common: str, safe: str, m: str = "m") -> str:
    """SQL: whether a match is kept. Known personal values are, whatever the other lists say."""
    return f"(coalesce({known}, false) OR NOT (coalesce({allow}, false) OR ({m}.type = 'NOM' AND (coalesce({common}, false) OR coalesce({safe}, false)))))"


def filtered(spans: DataFrame, known: DataFrame, allow: str, common: DataFrame, safe: DataFrame) -> DataFrame:
    """Those of ``spans`` (one row each) that the lists keep; lists are (value) or (word) tables.

    Lists are joined by equality on lower case; Spark broadcasts those that
    are small and joins the others by hash.
    """
    v = F.lower(F.trim("value"))
    marked = spans.withColumn("__v", v)
    for name, table in (("known", known.select(F.lower(F.trim("value")).alias("__v"))), ("common", common.select(F.lower("word").alias("__v"))), ("safe", safe.select(F.lower(F.trim("word")).alias("__v")))):
        marked = marked.join(table.distinct().withColumn(f"__{name}", F.lit(True)), "__v", "left")
    return marked.withColumn("m", F.struct("type", "value")).filter(F.expr(negative("__known", allow, "__common", "__safe"))).drop("m", "__v", "__known", "__common", "__safe")


# -- known personal values


def learnable(m: str = "m") -> str:
    """SQL: whether a detected name is sure enough to be known from now on."""
    return f"({m}.type = 'NOM' AND {m}.score >= if({m}.priority <= {SOFT_PRIORITY}, {SOFT_LEAST}, {NAMES_LEAST}))"


def upserted(gazetteer: DataFrame, new: DataFrame) -> DataFrame:
    """``gazetteer(value, entity_type, added_at)`` with ``new``; a value counts once per type, in any case, the oldest staying."""
    both = gazetteer.unionByName(new).filter(F.trim("value") != "")
    first = F.min_by(F.struct("value", "added_at"), F.struct("added_at", "value")).alias("x")
    return both.groupBy(F.lower(F.trim("value")).alias("__v"), "entity_type").agg(first).select("x.value", "entity_type", "x.added_at")


def removed(gazetteer: DataFrame, values: DataFrame) -> DataFrame:
    """``gazetteer`` without ``values(value)``, in any case."""
    return gazetteer.join(values.select(F.lower(F.trim("value")).alias("__v")).distinct(), F.lower(F.trim(gazetteer.value)) == F.col("__v"), "left_anti")


def seeds(vault: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The vault's identifying values that the gazetteer lacks."""
    identifying = [e.name for e in CATALOGUE.values() if e.identifying]
    new = vault.filter(F.col("type").isin(identifying)).select("value", F.col("type").alias("entity_type")).distinct()
    have = gazetteer.select(F.lower(F.trim("value")).alias("__v"), F.col("entity_type").alias("__t")).distinct()
    return new.join(have, (F.lower(F.trim("value")) == F.col("__v")) & (F.col("entity_type") == F.col("__t")), "left_anti")


def conflicts(new: DataFrame, unmasked: DataFrame) -> DataFrame:
    """Seeds that were taken off the list of late: they are masked all the same, and logged."""
    return new.join(unmasked.select(F.lower(F.trim("value")).alias("__v"), "unmasked_at").distinct(), F.lower(F.trim(new.value)) == F.col("__v")).drop("__v")


#: A word, with the marks that decomposed accents are.
WORD = r"(?U)[\p{L}\p{N}\p{M}_]+"
#: Equality of letters whatever their case, accents and composition, in any script.
ALIKE = "UNICODE_CI_AI"
#: Words of a value that it is looked up by; longer ones are compared from there on.
PHRASE = 8


def words_of(text: str) -> str:
    """SQL: a text's words, array of (s, e, v, g): place, word, and what stands before it, white space as one space."""
    gap = "if(gs[i] IN ('', ' '), gs[i], regexp_replace(gs[i], r'(?U)\\s+', ' '))"
    return let("gs", f"split({text}, {quote(WORD)}, -1)", f"transform({hits(text, WORD)}, (x, i) -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'g', {gap}))")


def phrase(words: str, i: str, n: str) -> str:
    """SQL: ``n`` of ``words`` from the ``i``-th on, with what stands between them."""
    return f"concat({words}[{i}].v, array_join(transform(slice({words}, {i} + 2, {n} - 1), y -> concat(y.g, y.v)), ''))"


def keyed(docs: DataFrame, *by: str) -> DataFrame:
    """``docs`` with ``__key``: a digest of the columns ``by`` and the text; only rows alike in all of them share it."""
    return docs.withColumn("__key", F.md5(F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x02")) for c in by], F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")))


def listed_spans(docs: DataFrame, listed: DataFrame, by: list[str], on: list[str], span: str, out: str) -> DataFrame:
    """``docs`` with ``out``: places of listed values, by an index of phrases.

    ``listed`` has (*on, value, exact, ...). A text's runs of as many words as
    listed values have, of which there are ``PHRASE`` numbers at most, meet the
    values by an equality join on ``on`` and the whole run, in any case, accent
    and composition, white space of any length being alike. Values of more
    words join by their first ``PHRASE`` and are compared in the text. With
    ``exact`` case and accents count. Only (key, place, run) is dealt out, only
    hits come back to a text, and it is shuffled once. ``span`` is SQL of a span
    from ``c`` (the listed row), ``s`` and ``e``.
    """
    split_ = listed.withColumn("__ws", F.expr(words_of("trim(value)"))).withColumn("__n", F.size("__ws")).filter("__n > 0")
    split_ = split_.withColumn("__whole", F.expr(phrase("__ws", "0", "__n"))).withColumn("__run", F.expr(f"collate({phrase('__ws', '0', f'least(__n, {PHRASE})')}, '{ALIKE}')"))
    rest = [c for c in listed.columns if c not in on]
    # values that are alike in all that counts are one
    kinds = [F.when(F.col("exact"), F.col(c)) if c == "value" else F.col(c) for c in rest]
    same = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(kinds)])
    values = split_.groupBy(*on, "__run", same.alias("__same"), F.when(~F.col("exact"), F.col("__n")).alias("__m"), F.when(F.col("exact") | (F.col("__n") > PHRASE), F.col("__whole")).alias("__w")).agg(F.min(F.struct(*rest, F.col("__whole").alias("whole"), F.col("__n").alias("n"))).alias("c"))
    values = materialise(values.select(*on, "__run", "c"), "phrases")
    lengths = sorted({min(r[0], PHRASE) for r in values.select(F.least("c.n", F.lit(PHRASE))).distinct().collect()})
    if not lengths:
        return docs.withColumn(out, F.expr(NONE))
    marked = keyed(docs, *by).withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    # one run of a length from each word on; the outer form, as the inner one would evaluate the words once more in a filter
    runs = let("ws", words_of("__text"), "flatten(transform(array(" + ", ".join(map(str, lengths)) + f"), n -> if(size(ws) < n, cast(array() AS array<struct<i:int,v:string>>), transform(sequence(0, size(ws) - n), i -> named_struct('i', i, 'v', {phrase('ws', 'i', 'n')})))))")
    placed = marked.select("__key", *on, F.explode_outer(F.expr(runs)).alias("x")).select("__key", *on, F.col("x.i").alias("i"), F.col("x.v").alias("v"), F.expr(f"collate(x.v, '{ALIKE}')").alias("__run"))
    hit = F.expr(f"NOT c.exact OR c.n > {PHRASE} OR v = c.whole")
    met = placed.join(values, [*on, "__run"]).filter(hit).groupBy("__key").agg(F.collect_set(F.struct("i", "c")).alias("__met"))
    same_words = let("v", phrase("tw", "x.i", "x.c.n"), f"if(x.c.exact, v = x.c.whole, collate(v, '{ALIKE}') = collate(x.c.whole, '{ALIKE}'))")
    alike = f"x.c.n <= {PHRASE} OR (x.i + x.c.n <= size(tw) AND {same_words})"
    one = let("c", "x.c", let("s", "tw[x.i].s", let("e", "tw[x.i + x.c.n - 1].e", span)))
    found = let("tw", words_of("__text"), f"array_sort(array_distinct(transform(filter(__met, x -> {alike}), x -> {one})))")
    return marked.join(met, "__key", "left").withColumn(out, F.expr(f"CASE WHEN __met IS NULL THEN {NONE} ELSE cast({found} AS array<{SPAN}>) END")).drop("__met", "__key", "__text")


def dictionary_spans(docs: DataFrame, gazetteer: DataFrame, priority: int = 75, out: str = "known") -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``out``: whole-word places of the values of ``gazetteer(value, entity_type, ...)``, in any case and accent.

    An empty list finds nothing, nor does a value without a letter or digit;
    null text counts as empty; rows with the same or no id stay apart.
    """
    listed = gazetteer.filter(F.trim("value") != "").select("value", "entity_type", F.lit(False).alias("exact")).distinct()
    value = "substring(__text, s + 1, e - s)"
    span = f"named_struct('s', s, 'e', e, 'type', c.entity_type, 'value', {value}, 'score', 1.0D, 'priority', {priority})"
    return listed_spans(docs, listed, [c for c in ("doc_id", "mission", "filename") if c in docs.columns], [], span, out)


def forename_spans(docs: DataFrame, forenames: DataFrame, priority: int = 45, out: str = "names") -> DataFrame:
    """``docs`` with ``out``: names that begin with a forename of ``forenames(forename, homograph)``, a list of any size.

    A name is the forename, as it is written in the list, and one to three name
    words on its line. One that is a ``homograph`` counts only after a title. The
    texts' distinct words that stand before a name word, and their parts from a
    hyphen or apostrophe on, meet the list by an equality join; then each text is
    searched for the few that it has, so no list is in the plan. A forename
    listed both ways counts without a title; those that aren't one word of
    letters, hyphens and apostrophes are left out. Null text counts as empty, an
    empty list finds nothing, and rows with the same or no id stay apart.
    """
    listed = forenames.filter(r"forename rlike r'^\p{L}[\p{L}\u0027’\-]*$'").groupBy("forename").agg(F.min(F.coalesce("homograph", F.lit(False))).alias("homograph"))
    marked = keyed(docs, *[c for c in ("doc_id", "mission", "filename") if c in docs.columns]).withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    before_name = quote(rf"(?U)[\w'’\-]+(?=[^\S\n]+{NAME_WORD})")
    parts = "transform(filter(sequence(1, length(w)), i -> i = 1 OR substring(w, i - 1, 1) IN ('-', '\\'', '’')), i -> substring(w, i))"
    words = f"array_distinct(flatten(transform(array_distinct(regexp_extract_all(__text, {before_name}, 0)), w -> {parts})))"
    said = marked.select("__key", F.explode_outer(F.expr(words)).alias("forename")).filter("forename IS NOT NULL")
    # the longest first, as one may begin another
    kinds = [F.array_sort(F.collect_set(F.when(F.col("homograph") == h, F.struct((-F.length("forename")).alias("n"), "forename")))).alias(f"__h{int(h)}") for h in (False, True)]
    met = said.join(listed, "forename").groupBy("__key").agg(*kinds)
    tail = quote(rf")[^\S\n]+{NAME_WORD}(?:[^\S\n]+{NAME_WORD}){{0,2}}")
    found = []
    for k, wanted in enumerate(("true", earlier("__text", TITLED))):
        x = hits("__text", rf"concat(r'(?U)\b(?:', array_join(__h{k}.forename, '|'), {tail})")
        found.append(f"CASE WHEN size(__h{k}) > 0 THEN transform(filter({x}, x -> {wanted}), x -> {made('NOM', '1.0D', priority)}) ELSE {NONE} END")
    return marked.join(met, "__key", "left").withColumn(out, F.expr(f"CASE WHEN __h0 IS NULL THEN {NONE} ELSE concat({', '.join(found)}) END")).drop("__h0", "__h1", "__key", "__text")


SERVED, LEAST_SERVED = "⟦NOM_∎⟧", 3


def served(docs: DataFrame, known: DataFrame, text: str = "text", out: str = "served") -> DataFrame:
    """``docs`` with ``out``: ``text`` with every value of ``known(value)``, of three letters or more, replaced by a blank token, longest first.

    Values of one word are found within longer words too: the texts' distinct
    words, of which there are far fewer than texts, meet the values by an
    equality join on their parts of the values' lengths. Values of several words
    are looked up by the phrase index. A text gets those that may be in it as a
    column, so no value is in the plan; null texts stay null, an empty list
    changes nothing.
    """
    values = known.select("value").filter(F.length("value") >= LEAST_SERVED).distinct().withColumn("__ws", F.expr(words_of("value")))
    values = materialise(values.select("value", F.size("__ws").alias("n"), F.expr("__ws[0].v").alias("word")).withColumn("single", F.col("n").eqNullSafe(1) & (F.col("word") == F.col("value"))), "served")
    given = keyed(docs.withColumn("text", F.col(text))).withColumnRenamed("__key", "__of")
    found = []
    several = values.filter("NOT single AND n > 0").select("value", F.lit(True).alias("exact"))
    span = "named_struct('s', s, 'e', e, 'type', '', 'value', c.value, 'score', 1.0D, 'priority', 0)"
    texts = given.select("__of", "text").dropDuplicates(["__of"])
    hit = listed_spans(texts, several, [], [], span, "__m").select("__of", F.explode_outer("__m").alias("m")).filter("m IS NOT NULL")
    found.append(hit.select("__of", F.col("m.value").alias("value")))
    lengths = sorted(r[0] for r in values.filter("single").select(F.length("value")).distinct().collect())
    if lengths:
        said = materialise(texts.select("__of", F.explode_outer(F.expr(f"array_distinct(regexp_extract_all(coalesce(text, ''), {quote(WORD)}, 0))")).alias("word")).filter("word IS NOT NULL"), "vocabulary")
        sizes = "array(" + ", ".join(map(str, lengths)) + ")"
        parts = f"array_distinct(flatten(transform(filter({sizes}, n -> n <= length(word)), n -> transform(sequence(1, length(word) - n + 1), i -> substring(word, i, n)))))"
        within = said.select("word").distinct().select("word", F.explode(F.expr(parts)).alias("value")).join(values.filter("single").select("value"), "value")
        found.append(said.join(within, "word").select("__of", "value"))
    per = found[0]
    for more in found[1:]:
        per = per.unionByName(more)
    per = per.groupBy("__of").agg(F.collect_set("value").alias("__values"))
    ordered = "array_sort(__values, (l, r) -> if(length(l) <> length(r), length(r) - length(l), if(l < r, -1, 1)))"
    put = f"CASE WHEN __values IS NULL THEN text ELSE aggregate({ordered}, text, (t, v) -> replace(t, v, '{SERVED}')) END"
    met = given.join(per, "__of", "left").withColumn("__served", F.expr(put))
    return met.select(*docs.columns, F.col("__served").alias(out))


#: Own list: words of forms and headings that are no one's name.
FORM_WORDS = tuple(
    "adresse avenant annexe client cliente compte conjoint conjointe contrat convention date document dossier euros fiche madame mademoiselle mandat monsieur montant naissance nom notre numéro objet page prénom produit profil propriété référence signature société souscripteur titulaire total versement votre vous".split()
)
LEAST_TOKEN = 4


def distinctive(value: str) -> str:
    """SQL: a name's words over all its lines, form words left out, four letters at least."""
    words = ", ".join(quote(w) for w in FORM_WORDS)
    return f"filter(split({value}, r'(?U)[^\\p{{L}}\\-]+'), w -> length(w) >= {LEAST_TOKEN} AND NOT lower(w) IN ({words}))"


def name_sweep(text: str, spans: str) -> str:
    """SQL: ``spans`` and every further place of the words of names that a model found, in any case, resolved."""
    soft = f"m.type = 'NOM' AND m.priority <= {SOFT_PRIORITY}"
    seeds = f"array_distinct(transform(flatten(transform(filter(ns, m -> {soft}), m -> {distinctive('m.value')})), w -> lower(w)))"
    word = r"(?U)[\p{L}\-]+"
    swept = f"transform(filter({hits(text, word)}, x -> array_contains(sd, lower(x.v))), x -> {made('NOM', '0.9D', 58)})"
    return let("ns", spans, f"CASE WHEN exists(ns, m -> {soft}) THEN {resolved(f'concat(ns, {let("sd", seeds, swept)})')} ELSE ns END")


def kept_by(docs: DataFrame, spans: str, lists: "Lists") -> DataFrame:
    """``docs`` with those of its spans that the lists keep; only keys and values are dealt out.

    What was detected is written first, as it is read twice.
    """
    marked = materialise(keyed(docs, *[c for c in ("doc_id", "mission", "filename") if c in docs.columns]), "to-filter")
    flat = marked.select("__key", F.posexplode(spans).alias("i", "m")).select("__key", "i", "m.type", "m.value").distinct()
    kept = filtered(flat, lists.known, lists.allow, lists.common, lists.safe).groupBy("__key").agg(F.collect_set("i").alias("__kept"))
    chosen = f"CASE WHEN size({spans}) = 0 THEN {spans} ELSE filter({spans}, (m, i) -> array_contains(coalesce(__kept, cast(array() AS array<int>)), i)) END"
    return marked.join(kept, "__key", "left").withColumn(spans, F.expr(chosen)).drop("__key", "__kept")


@dataclass(frozen=True)
class Lists:
    """What keeps matches in clear: an allow list (SQL over ``m``), common words and safe words (word); known values (value) stay masked."""

    known: DataFrame
    common: DataFrame
    safe: DataFrame
    allow: str = "false"


# -- what users may enter

_KINDS = ("regex", "gliner_label", "keep")


def refused(value: str, kind: str, confirm: str) -> str:
    """SQL: why an input is refused as configuration, or null. The reason never shows the value."""
    from ..functions import checksums

    pii = rf"({checksums.iban(value)} OR {value} rlike r'[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}' OR {value} rlike r'^\s*[12][ ]?\d{{2}}[ ]?\d{{2}}[ ]?\d{{2}}[ ]?\d{{3}}[ ]?\d{{3}}(?:[ ]?\d{{2}})?\s*$')"
    literal = rf"NOT {value} rlike r'[\\\[\](){{}}*+?|^$]'"
    return f"""CASE WHEN trim(coalesce({value}, '')) = '' THEN 'empty'
      WHEN NOT {kind} IN ({', '.join(map(repr, _KINDS))}) THEN 'unknown kind'
      WHEN {pii} THEN 'looks like personal data'
      WHEN {literal} AND length(regexp_replace({value}, '[^0-9]', '')) >= 8 THEN 'a long run of digits'
      WHEN {kind} = 'keep' AND NOT coalesce({confirm}, false) THEN 'needs a confirmation'
      WHEN {kind} = 'regex' AND {literal} AND trim({value}) rlike r'^[A-ZÀ-Þ]{{2,}}(?:[ \\-][A-ZÀ-Þ]{{2,}})+$' THEN 'looks like a name'
      WHEN {kind} = 'gliner_label' AND trim({value}) rlike '^[A-ZÀ-Þ]' THEN 'a label is a common noun' END"""
