"""Personal data in texts, found by labelers that vote, with DataFrame functions only.

Four patterns with their checks give the base spans: e-mail addresses, IP
addresses, payment cards, phone numbers. In what base spans leave of a text,
looser patterns give further candidates: addresses spelled out (``(at)``), phone
numbers without ``+``, 15-digit cards, IPv6, bank accounts (IBAN) and secrets
(values assigned to a word such as token, keys of known shapes). On every
candidate four labelers vote yes, no or not at all: the pattern's own check, a
gazetteer (issuers, dialling codes, domain ends, shapes of keys), cue words
before the span, and the characters beside it.

Expectation-maximisation over the counted vote patterns estimates how reliable
each labeler is; a naive Bayes span classifier is then trained on the expected
labels, over kind, votes and length. Candidates beyond the base that it takes
for personal data join the result; base spans always stay.

Patterns are written so that matching never backtracks over a run again
(possessive parts, starts only at a run's start or where the last match ended),
and places are summed in chunks, so long texts, and texts with very many
matches, take near-linear time. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums
from ..functions import spans as S
from . import common

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds, after the others.
ADDED = ("iban", "secret")
#: The base patterns, in a form that gives the same matches in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?+[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
FURTHER = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9A-Fa-f:])|\G)[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){7}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[ -]?+[0-9]){14}+(?![ -]?[0-9])",
    "phone": r"(?:(?<![0-9+().-])|\G)(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "secret": r"""(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?)["']?+\s{0,3}+(?:[:=]|=>)\s{0,3}+(?:bearer )?["']?+((?=[a-z+/_=.~-]*+[0-9])[a-z0-9+/_=.~-]{16,}+)""",
}
#: The group that is a pattern's value, if not the whole match.
GROUP = {"secret": 1}
#: Cheap conditions that hold wherever a pattern can match.
GATE = {
    "email": "contains(text, '@')",
    "ip": r"text rlike r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'",
    "card": r"text rlike r'[0-9](?:[ -]?[0-9]){15}'",
    "phone": "contains(text, '+')",
}
FURTHER_GATE = {
    "email": "(contains(text, '(at)') OR contains(text, '[at]'))",
    "ip": r"text rlike r'(?::[0-9A-Fa-f]{1,4}+){7}'",
    "card": r"text rlike r'[0-9](?:[ -]?[0-9]){14}'",
    "phone": r"text rlike r'[0-9]{3}[ .-][0-9]{4}'",
    "iban": r"text rlike r'[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}'",
    "secret": r"text rlike r'(?i)(?:token|secret|passw|pwd|key|auth)[a-z]{0,12}[^a-z]{1,16}(?:bearer )?[a-z0-9]'",
}
#: Cue words before a span, for and against, in the corpus's languages.
FOR = {
    "email": r"(?i)\b(?:e-?mail|contact|write|reach|correo|courriel|adresse|kontakt|schreib)",
    "ip": r"(?i)\b(?:ip|host|server|serveur|servidor|address|adresse|from|login|client|ping|via)\b",
    "card": r"(?i)\b(?:card|visa|master|amex|credit|debit|pay|karte|carte|tarjeta|cvv|pan)",
    "phone": r"(?i)(?:\b(?:phone|tel|call|mobile|cell|fax|text|sms|appel|ruf|llama|m[oó]vil|handy|contact)|☎)",
    "iban": r"(?i)\b(?:iban|account|bank|compte|konto|cuenta|rib)",
}
AGAINST = {
    "email": r"(?i)\b(?:sha|git|ssh|commit|pattern)",
    "ip": r"(?i)\b(?:version|release|section|chapter|v|rev|build)\W*$",
    "card": r"(?i)\b(?:isbn|ean|order|invoice|serial|sku|hash|token|id|nr|no)\W*$",
    "phone": r"(?i)\b(?:isbn|order|invoice|serial|sku|version|page|hash|token|part)\W*$",
    "iban": r"(?i)\b(?:isbn|serial|sku|hash|token|part)\W*$",
}
#: Gazetteers as patterns over the span: domain ends, address ranges, issuers, dialling codes.
KNOWN = {
    "email": r"(?i)(?:\.| ?[(\[]dot[)\]] ?)(?:com|org|net|edu|gov|io|info|biz|eu|de|fr|es|it|uk|us|ca|ch|at|nl|be|pl|se|no|dk|pt|br|mx|ar|cn|jp|in|ru|au)$",
    "ip": r"^(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|\(?[2-9][0-8][0-9])",
    "iban": r"^(?:A[DELTZ]|B[AEGHRY]|C[HRYZ]|D[EKO]|E[EGS]|F[IOR]|G[BEILRT]|H[RU]|I[ELQST]|JO|K[WZ]|L[BCITUVY]|M[CDEKRTU]|N[LO]|P[KLST]|QA|R[OS]|S[ACEIKMTV]|T[LNR]|UA|V[AG]|XK)",
    "secret": r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_\w{36}|sk-[\w-]{20,}|xox[a-z]-[\w-]{10,}|eyJ[\w-]+\.[\w-]+\.[\w-]*)$",
}
LABELERS = 4
ROUNDS = 25
#: Characters before a span in which cue words count.
WINDOW = 40

_SPAN = "struct<kind:string,s:int,e:int,base:boolean,votes:array<int>,size:int>"


_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, r'\\.'), p -> length(ltrim('0', p)) <= 3 AND coalesce(cast(nullif(ltrim('0', p), '') AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 16 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 8 AND 15",
}
_FURTHER_VALID = {"email": "true", "ip": "true", "card": f"luhn_check({_DIGITS})", "phone": "true", "iban": checksums.iban("x.v"), "secret": "true"}
#: The pattern labeler's vote on candidates beyond the base.
_FURTHER_VOTE = {"email": "1", "ip": "1", "card": r"if(x.v rlike '^3[47]', 1, 0)", "phone": r"if(x.v rlike r'^\(?[2-9][0-9]{2}\)?[ .-]?[2-9]', 1, 0)", "iban": "1", "secret": "if(x.v rlike '[A-Za-z]', 1, 0)"}


def _candidates(kind: str, base: bool) -> str:
    """SQL for one kind's candidates with their votes, in ``text``."""
    pattern, gate, valid = (BASE[kind], GATE[kind], _VALID[kind]) if base else (FURTHER[kind], FURTHER_GATE[kind], _FURTHER_VALID[kind])
    group = 0 if base else GROUP.get(kind, 0)
    # a value that is a part of its match has its cue there, and no characters of the text before it at hand
    cue = "1" if group else f"CASE WHEN x.b rlike r'{AGAINST[kind]}' THEN 0 WHEN x.b rlike r'{FOR[kind]}' THEN 1 ELSE -1 END"
    beside = "x.a" if group else "concat(right(x.b, 1), x.a)"
    votes = ["1" if base else _FURTHER_VOTE[kind], f"if(x.v rlike r'{KNOWN[kind]}', 1, 0)", cue, rf"if({beside} rlike r'[\p{{L}}0-9_/=-]', 0, 1)"]
    made = f"named_struct('kind', '{kind}', 's', x.s, 'e', x.e, 'base', {str(base).lower()}, 'votes', array({', '.join(votes)}), 'size', least(31, x.e - x.s))"
    return f"CASE WHEN {gate} THEN transform(filter({S.hits('text', pattern, group, WINDOW)}, x -> {valid}), x -> {made}) ELSE cast(array() AS array<{_SPAN}>) END"


def candidates(docs: DataFrame) -> DataFrame:
    """``docs``' columns with ``found``: base and further candidates of each text.

    Further ones are looked for in the text with ``=`` for every character of a
    base span, so that none overlaps a base span.
    """
    wide = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    wide = wide.select("*", *[F.expr(_candidates(k, True)).alias(f"__{k}_1") for k in KINDS]).withColumn("__whole", F.col("text"))
    for k in KINDS:
        wide = wide.withColumn("text", F.expr(f"CASE WHEN size(__{k}_1) = 0 THEN text ELSE {S.rewritten('text', f'__{k}_1', chr(39).join(('repeat(', '=', ', x.e - x.s)')))} END"))
    further = (*KINDS, *ADDED)
    wide = wide.select("*", *[F.expr(_candidates(k, False)).alias(f"__{k}_0") for k in further]).withColumn("text", F.col("__whole"))
    return wide.withColumn("found", F.concat(*[F.col(f"__{k}_1") for k in KINDS], *[F.col(f"__{k}_0") for k in further])).select(*docs.columns, "found")


def _posterior(x: str, state: str) -> str:
    def likelihood(rates: str) -> str:
        return f"aggregate(sequence(0, {LABELERS - 1}), 1D, (m, j) -> m * CASE {x}.v[j] WHEN 1 THEN {state}.{rates}[j] WHEN 0 THEN 1D - {state}.{rates}[j] ELSE 1D END)"

    pos, neg = f"({state}.p * {likelihood('a')})", f"((1D - {state}.p) * {likelihood('b')})"
    return f"({pos} / ({pos} + {neg}))"


def reliabilities(patterns: DataFrame) -> DataFrame:
    """One row ``state``: p (share of true candidates), a and b (how often each
    labeler says yes to true and to false ones), by expectation-maximisation.

    ``patterns`` has (votes, n): each vote pattern once or more, with counts; at
    most 3**LABELERS distinct ones, whatever the corpus. All rounds run inside
    one expression over that array.
    """
    table = patterns.groupBy("votes").agg(F.sum("n").cast("double").alias("n")).groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("t"))

    def rate(weight: str, first: float) -> str:
        yes = f"aggregate(w, {10 * first}D, (s, x) -> s + if(x.v[j] = 1, x.n * {weight}, 0D))"
        all_ = f"aggregate(w, 10D, (s, x) -> s + if(x.v[j] >= 0, x.n * {weight}, 0D))"
        return f"transform(sequence(0, {LABELERS - 1}), j -> {yes} / {all_})"

    start = f"named_struct('p', 0.5D, 'a', array_repeat(0.9D, {LABELERS}), 'b', array_repeat(0.2D, {LABELERS}))"
    weighed = f"transform(t, x -> named_struct('v', x.v, 'n', x.n, 'q', {_posterior('x', 'st')}))"
    share = "aggregate(w, 1D, (s, x) -> s + x.n * x.q) / aggregate(w, 2D, (s, x) -> s + x.n)"
    step = f"transform(array({weighed}), w -> named_struct('p', {share}, 'a', {rate('x.q', 0.9)}, 'b', {rate('(1D - x.q)', 0.2)}))[0]"
    return table.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (st, k) -> {step})").alias("state"), "t")


_FEATURES = "concat(array(concat('kind=', kind), concat('size=', size)), transform(sequence(0, {n}), j -> concat('vote', j, '=', votes[j])))".format(n=LABELERS - 1)


def train(found: DataFrame) -> dict[str, float]:
    """The span classifier: a weight for each feature, and ``bias``.

    ``found`` has a column ``found`` of candidates. They are counted by kind,
    votes and length; all else works on those counts (a few hundred rows at
    most, for the features take a few dozen values).
    """
    spans = found.filter(F.size("found") > 0).select(F.explode("found").alias("x")).select("x.kind", "x.votes", "x.size")
    counts = common.materialise(spans.groupBy("kind", "votes", "size").agg(F.count("*").alias("n")), "votes")
    state = reliabilities(counts).select("state").first()["state"]  # nine numbers
    fixed = f"named_struct('p', {float(state['p'])!r}D, 'a', array({', '.join(f'{float(x)!r}D' for x in state['a'])}), 'b', array({', '.join(f'{float(x)!r}D' for x in state['b'])}))"
    labelled = counts.withColumn("x", F.struct(F.col("votes").alias("v"))).withColumn("q", F.expr(_posterior("x", fixed)))
    sums = labelled.select("n", "q", F.explode(F.expr(_FEATURES)).alias("feature")).groupBy("feature").agg(F.sum(F.col("n") * F.col("q")).alias("pos"), F.sum(F.col("n") * (1 - F.col("q"))).alias("neg"))
    total = labelled.agg(F.coalesce(F.sum(F.col("n") * F.col("q")), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(F.col("n") * (1 - F.col("q"))), F.lit(0.0)).alias("neg")).first()
    weights = sums.select("feature", F.log((F.col("pos") + 1) / (total["pos"] + 3)).alias("up"), F.log((F.col("neg") + 1) / (total["neg"] + 3)).alias("down"))
    import math

    return {r["feature"]: r["up"] - r["down"] for r in weights.collect()} | {"bias": math.log((total["pos"] + 1) / (total["neg"] + 1))}


def classified(found: DataFrame, model: dict[str, float]) -> DataFrame:
    """``found`` without the candidates that are neither base nor taken for personal data."""
    weights = {k: v for k, v in sorted(model.items()) if k != "bias"}
    if weights:
        known = "map(" + ", ".join(f"'{k}', {v!r}D" for k, v in weights.items()) + ")"
        features = _FEATURES.replace("kind)", "x.kind)").replace("size)", "x.size)").replace("votes[", "x.votes[")
        score = f"aggregate({features}, {model['bias']!r}D, (s, f) -> s + coalesce({known}[f], 0D))"
    else:
        score = "-1D"
    kinds = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, *ADDED)) + ")"
    rank = f"CASE WHEN l.kind <> r.kind THEN cast(array_position({kinds}, l.kind) - array_position({kinds}, r.kind) AS int) ELSE l.s - r.s END"
    return found.withColumn("found", F.expr(f"CASE WHEN size(found) = 0 THEN found ELSE array_sort(filter(found, x -> x.base OR {score} > 0), (l, r) -> {rank}) END"))


def find(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs``' columns, the text only if kept, with ``found``: the personal data of each text.

    ``docs`` has a column text; null counts as empty. Candidates are found
    once, written, counted for the classifier, and judged. ``found`` holds
    (kind, s, e, base, votes, size), by kind in the order of KINDS and ADDED, then start.
    No text, or no match, gives an empty array; repeated rows are judged alike
    and counted each; an empty table gives no row.
    """
    found = candidates(docs)
    found = common.materialise(found if keep_text else found.drop("text"), "candidates")
    return classified(found, train(found))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans written out and counted."""
    written = "array_join(transform(%s, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.expr(f"cast(size(filter(found, x -> x.kind = '{k}' AND x.base)) AS bigint)").alias(f"n_{k}") for k in KINDS],
        F.expr(f"sha2({written % 'filter(found, x -> x.base)'}, 256)").alias("base_sha256"),
        F.expr(written % "found").alias("spans"),
        F.expr("cast(size(found) AS bigint)").alias("n_spans"),
    )


def masked(text: str = "text", found: str = "found") -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    by_start = f"array_sort({found}, (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s ELSE r.e - l.e END)"
    one = "named_struct('s', r[0].s, 'e', array_max(transform(r, x -> x.e)), 'kind', r[0].kind)"
    runs = S.let("o", by_start, S.runs("o", one))
    return F.expr(f"CASE WHEN size({found}) = 0 THEN {text} ELSE {S.rewritten(text, runs, "concat('[', upper(x.kind), ']')")} END")
