"""Soft layers: model output to spans, in windows, merged and swept. Models are hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quality import without_dot_runs
from ..functions.spans import NONE, SPAN, contains, iou
from .lists import keyed

SIZE, OVERLAP, LEAST, PRIORITY, MERGE = 1000, 300, 0.30, 5, 0.6
PROBE = 0.7
#: Model labels and the types they stand for.
LABELS = {
    "person name": "NOM", "full name": "NOM", "family member name": "NOM", "child name": "NOM", "spouse name": "NOM", "address": "ADRESSE", "postal address": "ADRESSE",
    "place of birth": "LIEU_NAISSANCE", "city": "ADRESSE", "phone number": "TEL", "email": "EMAIL", "email address": "EMAIL", "date of birth": "DATE_NAISSANCE",
    "marriage date": "DATE_EVENEMENT", "date": "DATE_EVENEMENT", "passport number": "PIECE_IDENTITE", "identity document number": "PIECE_IDENTITE",
    "social security number": "SECU", "tax number": "NUM_FISCAL", "iban": "IBAN", "bank account number": "IBAN",
}
LLM_TYPES = {"PERSON": "NOM", "ORG": "SOCIETE", "LOCATION": "ADRESSE"}
LINE_TYPES = ("NOM", "PRENOM", "ADRESSE", "TELEPHONE", "EMAIL", "SOCIETE", "DATE_NAISSANCE", "IBAN")
MODEL_SCHEMA = "array<struct<label:string,text:string,start:int,end:int,score:double>>"


def windows(text: str, size: int = SIZE, overlap: int = OVERLAP) -> str:
    """SQL: array of (base, chunk), the last window reaching the end; empty text has none."""
    if size <= overlap:
        raise ValueError("a window must exceed its overlap")
    step = size - overlap
    n = f"if(length({text}) <= {size}, 1, cast(ceil((length({text}) - {size}) / {step}) AS int) + 1)"
    return f"CASE WHEN coalesce(length({text}), 0) = 0 THEN cast(array() AS array<struct<base:int,chunk:string>>) ELSE transform(sequence(0, {n} - 1), k -> named_struct('base', k * {step}, 'chunk', substring({text}, k * {step} + 1, {size}))) END"


def all_windows(text: str, size: int, overlap: int) -> str:
    """SQL: as :func:`windows`, but a window begins at every step before the end."""
    step = size - overlap
    return f"CASE WHEN coalesce(length({text}), 0) = 0 THEN cast(array() AS array<struct<base:int,chunk:string>>) ELSE transform(sequence(0, cast((length({text}) - 1) / {step} AS int)), k -> named_struct('base', k * {step}, 'chunk', substring({text}, k * {step} + 1, {size}))) END"


def model_udf(load: Callable[[], Callable[[list[str]], list[list[dict]]]]):
    """A pandas UDF of a model that is loaded once in each worker.

    ``load()`` gives a function from texts to lists of {label, text, start,
    end, score}. If it gives None, or fails, nothing is found.
    """

    @F.pandas_udf(MODEL_SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            model = load()
        except Exception:  # noqa: BLE001 - a model that can't be had finds nothing
            model = None
        for s in batches:
            yield pd.Series([[(d["label"], d["text"], int(d["start"]), int(d["end"]), float(d["score"])) for d in r] for r in model(s.tolist())] if model else [[] for _ in s])

    return run


def model_spans(docs: DataFrame, model: Callable[[Column], Column], labels: dict[str, str] | None = None, least: float = LEAST, compress: bool = True, probe: float = PROBE) -> DataFrame:
    """``docs(doc_id, text)`` with ``soft``: the model's spans over all windows.

    Names are widened to the longest that strictly contains them of those found
    at ``probe`` times the threshold or better; their scores stay. Places come
    back to rows with the same id and text.

    Of equal type and text the best score counts, the first of equals. Unknown
    labels, scores under ``least`` and e-mails without ``@`` are dropped. If
    fill characters were taken out, a place is the text's first in its window.
    """
    known = F.create_map(*[F.lit(x) for kv in (LABELS | (labels or {})).items() for x in kv])
    docs = keyed(docs, "doc_id")
    chunks = docs.select("__key", F.explode(F.expr(windows("text"))).alias("w")).select("__key", "w.base", "w.chunk")
    seen = chunks.withColumn("found", model(F.expr(without_dot_runs("chunk")) if compress else F.col("chunk")))
    flat = seen.select("__key", "base", "chunk", F.explode("found").alias("f")).select("__key", "base", "chunk", "f.*").withColumn("type", known[F.col("label")])
    at = F.when(F.expr("substring(chunk, start + 1, length(text)) = text"), F.col("start")).otherwise(F.expr("instr(chunk, text) - 1")) if compress else F.col("start")
    good = flat.withColumn("s", at).filter(f"type IS NOT NULL AND s >= 0 AND trim(text) <> '' AND score >= {least * probe} AND (type <> 'EMAIL' OR contains(text, '@'))")
    best = good.groupBy("__key", "type", "text").agg(F.min(F.struct(-F.col("score"), F.col("base") + F.col("s"))).alias("x"))
    spans = best.select("__key", F.struct(F.col("x.col2").cast("int").alias("s"), (F.col("x.col2") + F.length("text")).cast("int").alias("e"), "type", F.col("text").alias("value"), (-F.col("x.col1")).alias("score"), F.lit(PRIORITY).alias("priority")).alias("m"))
    grouped = spans.groupBy("__key").agg(F.array_sort(F.collect_list("m")).alias("__probe"))
    met = docs.join(grouped, "__key", "left").withColumn("__probe", F.coalesce(F.expr(f"cast(__probe AS array<{SPAN}>)"), F.expr(NONE)))
    kept = f"filter(__probe, m -> m.score >= {least})"
    return met.withColumn("soft", F.expr(f"CASE WHEN size(__probe) = 0 THEN __probe ELSE {widened('text', kept, '__probe')} END")).drop("__probe", "__key")


def widened(text: str, kept: str, probe: str) -> str:
    """SQL: kept names widened to the longest probed name that contains them; scores stay."""
    wider = f"array_sort(filter({probe}, p -> p.type = 'NOM' AND {contains('p', 'm')}), (l, r) -> if(l.e - l.s <> r.e - r.s, (r.e - r.s) - (l.e - l.s), l.s - r.s))"
    return f"transform({kept}, m -> transform(array(get({wider}, 0)), p -> if(m.type = 'NOM' AND p IS NOT NULL, named_struct('s', p.s, 'e', p.e, 'type', m.type, 'value', substring({text}, p.s + 1, p.e - p.s), 'score', m.score, 'priority', m.priority), m))[0])"


def merged(text: str, a: str, b: str, least: float = MERGE) -> str:
    """SQL: two models' spans; those of one type that overlap by ``least`` become their union with the better score.

    Each span of ``b`` joins the first span of the result that it fits; all
    others stay.
    """
    fit = f"y.type = x.type AND {iou('y', 'x')} >= {least}"
    joint = f"named_struct('s', least(y.s, x.s), 'e', greatest(y.e, x.e), 'type', y.type, 'value', substring({text}, least(y.s, x.s) + 1, greatest(y.e, x.e) - least(y.s, x.s)), 'score', greatest(y.score, x.score), 'priority', least({PRIORITY}, y.priority))"
    first = f"array_position(transform(acc, y -> {fit}), true)"
    return f"aggregate({b}, {a}, (acc, x) -> if(exists(acc, y -> {fit}), transform(acc, (y, i) -> if(i + 1 = {first}, {joint}, y)), array_append(acc, x)))"


def by_mode(mode: str, text: str, a: str, b: str) -> str:
    """SQL: one detector's spans, the other's, or both merged (also for an unknown mode)."""
    return f"CASE {mode} WHEN 'gliner' THEN {a} WHEN 'openai' THEN {b} ELSE {merged(text, a, b)} END"


TOKEN_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("category", T.StringType()), T.StructField("score", T.DoubleType())]))


def decoded(logits, labels, bias: dict[str, float] | None = None) -> list[list[tuple]]:
    """The best valid path of BIOES labels over the tokens of each text: spans of tokens, ends exclusive.

    A path may not enter I or E but from B or I of the same category, nor leave
    B or I but to I or E of it. ``bias`` may move the choice: numbers added to
    the labels of a part (outside, begin, inside, end, single). A span's score
    is the mean of its probabilities, which no bias changes.
    """
    import numpy as np

    out = []
    for grid, names in zip(logits, labels):
        names = list(names)
        if not len(grid):
            out.append([])
            continue
        x = np.array([list(r) for r in grid], float)
        part, kind = [n.partition("-")[0] for n in names], [n.partition("-")[2] for n in names]
        sure = x - np.logaddexp.reduce(x, axis=1, keepdims=True)
        log_p = sure + np.array([(bias or {}).get(PARTS.get(p, ""), 0.0) for p in part])
        begun, inner = np.array([p in "BI" for p in part]), np.array([p in "IE" for p in part])
        same = np.array([[a == b for b in kind] for a in kind])
        allowed = np.where(begun[:, None], inner[None, :] & same, ~inner[None, :])
        cost = np.where(allowed, 0.0, -1e9)
        score, back = log_p[0] + np.where(inner, -1e9, 0.0), []
        for row in log_p[1:]:
            step = score[:, None] + cost
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        path = [int((score + np.where(begun, -1e9, 0.0)).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        spans, start = [], 0
        for t, k in enumerate(path):
            if part[k] in "SB":
                start = t
            if part[k] in "SE":
                spans.append((start, t + 1, kind[k], float(np.exp([sure[u, path[u]] for u in range(start, t + 1)]).mean())))
        out.append(spans)
    return out


#: What the letters of BIOES labels are called.
PARTS = {"B": "begin", "I": "inside", "O": "outside", "E": "end", "S": "single"}


def viterbi_udf(bias: dict[str, float] | None = None):
    """A pandas UDF of :func:`decoded` over columns of logits and labels."""

    @F.pandas_udf(TOKEN_SPANS)
    def run(logits: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series(decoded(logits, labels, bias))

    return run


viterbi = viterbi_udf()


def llm_entities(answer: str) -> str:
    """SQL: (type, text) of a model's JSON answer: an object with ``entities``, or a bare array; bad JSON has none."""
    schema = "array<struct<type:string,text:string>>"
    types = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in LLM_TYPES.items()) + ")"
    got = f"coalesce(from_json({answer}, 'struct<entities:{schema}>').entities, from_json({answer}, '{schema}'), cast(array() AS {schema}))"
    return f"filter(transform({got}, x -> named_struct('type', {types}[upper(x.type)], 'text', x.text)), x -> x.type IS NOT NULL AND trim(x.text) <> '')"


def entity_spans(text: str, entities: str, score: float = 0.8) -> str:
    """SQL: the first place of each entity's text."""
    return f"transform(filter({entities}, x -> instr({text}, x.text) > 0), x -> named_struct('s', instr({text}, x.text) - 1, 'e', instr({text}, x.text) - 1 + length(x.text), 'type', x.type, 'value', x.text, 'score', {score}D, 'priority', {PRIORITY}))"


def answer_lines(answer: str) -> str:
    """SQL: (type, text) of a model's lines ``TYPE: value``; other types and "(aucune)" are dropped."""
    types = ", ".join(repr(t) for t in LINE_TYPES)
    return rf"filter(transform(split({answer}, '\n'), l -> named_struct('type', upper(trim(substring_index(l, ':', 1))), 'text', if(contains(l, ':'), trim(substring(l, instr(l, ':') + 1)), ''))), x -> x.type IN ({types}) AND x.text <> '' AND lower(x.text) <> '(aucune)')"


def windowed_entities(docs: DataFrame, model: Callable[[Column], Column], size: int = 6000, overlap: int = 400) -> DataFrame:
    """(doc_id, entities, failed): a model's answers over all windows of each text, distinct; a null answer fails the text."""
    w = docs.select("doc_id", F.explode_outer(F.expr(all_windows("text", size, overlap))).alias("w")).withColumn("answer", model(F.coalesce("w.chunk", F.lit(""))))
    failed = F.max(F.col("answer").isNull() & F.col("w").isNotNull()).alias("failed")
    got = w.groupBy("doc_id").agg(failed, F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr(answer_lines("answer")))))).alias("entities"))
    return got.select("doc_id", F.when(~F.col("failed"), F.col("entities")).alias("entities"), "failed")


def name_verdict(answer: str) -> str:
    """SQL: an ordinary word only if the model says so and doesn't say name."""
    return f"if(contains(upper({answer}), 'MOT') AND NOT contains(upper({answer}), 'NOM'), 'MOT', 'NOM')"


def value_verdict(answer: str) -> str:
    """SQL: whether a value may be shown: only if judged generic and not personal; no answer keeps it masked."""
    return f"coalesce(contains(upper({answer}), 'GENERIQUE') AND NOT contains(upper({answer}), 'PII'), false)"
