"""Arrays of spans as columns: finding, resolving, rewriting.

A span is ``struct<s:int, e:int, type:string, value:string, score:double,
priority:int>``; positions are code points, ends exclusive. All functions give
SQL text, so that they combine inside lambdas and stay within Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<s:int,e:int,type:string,value:string,score:double,priority:int>"
NONE = f"cast(array() AS array<{SPAN}>)"
#: A token: type in capitals, number of four digits or more, a variant's letters.
TOKEN = r"⟦([A-Z_]+)_(\d{4,}[a-z]*)⟧"


def quote(pattern: str) -> str:
    """A pattern as an SQL raw string, whichever quotes it holds."""
    if "'" not in pattern:
        return f"r'{pattern}'"
    if '"' not in pattern:
        return f'r"{pattern}"'
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Matches of which places are added up in one go; characters of a text's blocks.
CHUNK_BITS, BLOCK_BITS = 6, 12


def let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` standing for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hits(text: str, pattern: str, group: int = 0, around: int = 0) -> str:
    """Matches of a pattern in ``text``: array of (s, e, v).

    The pieces between matches, from a split, give the places. With a group,
    which must end the match, the span is the group's. With ``around`` a match
    also has ``b``, so many characters before it (of the piece and the match
    before it), and ``a``, the character after it. Places are sums of lengths
    within chunks of matches, then over chunks, so that a text with very many
    matches takes little more than linear time.
    """
    p = pattern if pattern.startswith("concat(") else quote(pattern)
    beside = f", 'b', right(g, {around}), 'f', left(g, 1)" if around else ""
    zipped = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, h) -> named_struct('g', length(g), 'h', h{beside}))"
    if group:
        zipped = f"zip_with({zipped}, regexp_extract_all({text}, {p}, {group}), (x, v) -> named_struct('g', x.g, 'h', x.h, 'v', v{", 'b', x.b, 'f', x.f" if around else ""}))"
    if around:
        near = f"'b', right(concat(coalesce(get(zz, i - 1).h, ''), x.b), {around}), 'a', coalesce(nullif(get(zz, i + 1).f, ''), left(get(zz, i + 1).h, 1), '')"
        zipped = let("zz", zipped, f"transform(zz, (x, i) -> named_struct('g', x.g, 'h', x.h, {"'v', x.v, " if group else ""}{near}))")
    value = "x.v" if group else "x.h"
    kind = "s:int,e:int,v:string" + (",b:string,a:string" if around else "")
    more = ", 'b', x.b, 'a', x.a" if around else ""
    placed = f"""aggregate({{0}}, named_struct('at', 0, 'out', cast(array() AS array<struct<{kind}>>)),
      (a, x) -> named_struct('at', a.at + x.g + length(x.h), 'out', array_append(a.out, named_struct('s', a.at + x.g + length(x.h) - length({value}), 'e', a.at + x.g + length(x.h), 'v', {value}{more}))))"""
    chunks = f"transform(sequence(0, shiftright(size(hs) - 1, {CHUNK_BITS})), c -> {placed.format(f'slice(hs, shiftleft(c, {CHUNK_BITS}) + 1, {1 << CHUNK_BITS})')})"
    starts = "aggregate(cs, array(0), (a, c) -> array_append(a, element_at(a, -1) + c.at))"
    moved = f"flatten(transform(cs, (c, k) -> transform(c.out, x -> named_struct('s', x.s + st[k], 'e', x.e + st[k], 'v', x.v{more}))))"
    return let("hs", f"filter({zipped}, x -> x.h IS NOT NULL)", f"CASE WHEN size(hs) <= {1 << CHUNK_BITS} THEN {placed.format('hs')}.out ELSE {let('cs', chunks, let('st', starts, moved))} END")


def before_max(ends: str) -> str:
    """For each of an array of numbers the highest before it, -1 for the first."""
    low = f"slice(en, shiftleft(shiftright(i, {CHUNK_BITS}), {CHUNK_BITS}) + 1, i & {(1 << CHUNK_BITS) - 1})"
    tops = f"transform(sequence(0, shiftright(size(en) - 1, {CHUNK_BITS})), c -> array_max(slice(en, shiftleft(c, {CHUNK_BITS}) + 1, {1 << CHUNK_BITS})))"
    return let("en", ends, f"if(size(en) = 0, en, {let('tp', tops, f'transform(en, (x, i) -> greatest(-1, array_max(slice(tp, 1, shiftright(i, {CHUNK_BITS}))), array_max({low})))')})")


def runs(ordered: str, each: str, x: str = "x") -> str:
    """SQL of ``each`` over the runs ``r`` of overlapping spans of the non-empty array named ``ordered``, sorted by start."""
    m = x.replace("x", f"{ordered}[i]", 1)
    first = f"filter(sequence(0, size({ordered}) - 1), i -> {m}.s >= mx[i])"
    return let("mx", before_max(f"transform({ordered}, x -> {x}.e)"), let("fs", first, f"transform(fs, (b, k) -> {let('r', f'slice({ordered}, b + 1, coalesce(get(fs, k + 1), size({ordered})) - b)', each)})"))


def blocks(text: str) -> str:
    """A text's blocks, from which :func:`cut` takes pieces wherever they lie."""
    return f"CASE WHEN length({text}) <= {1 << BLOCK_BITS} THEN array({text}) ELSE regexp_extract_all({text}, r'(?s).{{1,{1 << BLOCK_BITS}}}', 0) END"


def cut(bl: str, a: str, b: str) -> str:
    """SQL of the characters from ``a`` to ``b`` of a text whose blocks are named ``bl``."""
    ka, kb, low = f"shiftright({a}, {BLOCK_BITS})", f"shiftright({b}, {BLOCK_BITS})", (1 << BLOCK_BITS) - 1
    over = f"concat(substring(get({bl}, {ka}), ({a} & {low}) + 1), array_join(slice({bl}, {ka} + 2, {kb} - {ka} - 1), ''), coalesce(substring(get({bl}, {kb}), 1, {b} & {low}), ''))"
    return f"CASE WHEN {a} >= {b} THEN '' WHEN {ka} = {kb} THEN substring(get({bl}, {ka}), ({a} & {low}) + 1, {b} - {a}) ELSE {over} END"


def made(type_: str, score: str, priority: int, x: str = "x", value: str | None = None) -> str:
    """SQL of one span from a hit ``x``."""
    return f"named_struct('s', {x}.s, 'e', {x}.e, 'type', '{type_}', 'value', {value or x + '.v'}, 'score', cast({score} AS double), 'priority', {priority})"


def resolved(spans: str) -> str:
    """Disjoint spans, by place: longer first, then score, then priority, then start.

    Spans that are equal in all these keep the order given. The spans of a run
    that overlaps are taken one by one, so sorted, if they touch none taken
    before; different runs have nothing to do with one another.
    """
    first = "array_sort(transform(sp, (m, i) -> named_struct('m', m, 'i', i)), (l, r) -> if(l.m.s <> r.m.s, l.m.s - r.m.s, l.i - r.i))"
    ranked = "array_sort(r, (l, r) -> CASE WHEN l.m.e - l.m.s <> r.m.e - r.m.s THEN (r.m.e - r.m.s) - (l.m.e - l.m.s) WHEN l.m.score <> r.m.score THEN if(l.m.score > r.m.score, -1, 1) WHEN l.m.priority <> r.m.priority THEN r.m.priority - l.m.priority WHEN l.m.s <> r.m.s THEN l.m.s - r.m.s ELSE l.i - r.i END)"
    taken = f"aggregate({ranked}, {NONE}, (a, x) -> if(exists(a, y -> x.m.s < y.e AND y.s < x.m.e), a, array_append(a, x.m)))"
    each = f"if(size(r) = 1, array(r[0].m), array_sort({taken}, (l, r) -> l.s - r.s))"
    return let("sp", spans, f"CASE WHEN size(sp) < 2 THEN sp ELSE {let('o', first, f'flatten({runs("o", each, "x.m")})')} END")


def joined(text: str, spans: str, before: str, after: str = "{}") -> str:
    """A text's pieces in a row: ``before`` (SQL over the span ``x``, the piece in braces) for each of disjoint, ordered ``spans``, and ``after`` for the last piece."""
    piece = cut("bl", "coalesce(get(sp, i - 1).e, 0)", "x.s")
    last = cut("bl", "element_at(sp, -1).e", f"length({text})")
    parts = f"concat(transform(sp, (x, i) -> {before.format(piece)}), array({after.format(last)}))"
    whole = let("bl", blocks(text), f"array_join({parts}, '')")
    return let("sp", spans, f"CASE WHEN size(sp) = 0 THEN {after.format(text)} ELSE {whole} END")


def rewritten(text: str, spans: str, put: str) -> str:
    """``text`` with each of disjoint, ordered ``spans`` replaced by ``put``, SQL over the span ``x``."""
    return joined(text, spans, f"concat({{}}, {put})")


def unglued(text: str) -> str:
    """A space between a token's end and a letter that follows it at once."""
    return f"regexp_replace({text}, r'(⟧)([A-Za-zÀ-ÿ])', '$1 $2')"


def outside(spans: str, covers: str, own: bool = False) -> str:
    """Those of ``spans`` that lie within none of ``covers``; with ``own``, nor within one another (of equal ones the first stays)."""
    mixed = "array_sort(concat(transform(cv, t -> named_struct('s', t.s, 'z', -t.e, 'f', 0, 'i', -1)), transform(sp, (m, i) -> named_struct('s', m.s, 'z', -m.e, 'f', 1, 'i', i))))"
    ends = before_max("transform(mi, x -> -x.z)" if own else "transform(mi, x -> if(x.f = 0, -x.z, -1))")
    free = "array_sort(transform(filter(transform(mi, (x, k) -> if(x.f = 1 AND top[k] < -x.z, x.i, -1)), i -> i >= 0), i -> i))"
    return let("sp", spans, let("cv", covers, f"CASE WHEN size(sp) = 0{'' if own else ' OR size(cv) = 0'} THEN sp ELSE {let('mi', mixed, let('top', ends, f'transform({free}, i -> sp[i])'))} END"))


def overlap(a: str, b: str) -> str:
    return f"({a}.s < {b}.e AND {b}.s < {a}.e)"


def contains(a: str, b: str) -> str:
    """Whether span ``a`` strictly contains span ``b``."""
    return f"({a}.s <= {b}.s AND {b}.e <= {a}.e AND {a}.e - {a}.s > {b}.e - {b}.s)"


def iou(a: str, b: str) -> str:
    """Shared length over joint length of two spans."""
    shared = f"greatest(0, least({a}.e, {b}.e) - greatest({a}.s, {b}.s))"
    return f"({shared} / (({a}.e - {a}.s) + ({b}.e - {b}.s) - {shared}))"


#: Types whose score says whether a check held; no word beside them changes that.
CHECKED = ("IBAN", "ISIN", "SIRET", "SIREN")


def boosted(text: str, spans: str, cues: list[str], window: int = 50, step: float = 0.1) -> str:
    """Scores raised by ``step``, to 1 at most, where a cue stands within ``window`` characters; checked types stay."""
    words = quote(r"(?iuU)\b(?:" + "|".join(cues) + r")\b")
    before, after = cut("bl", f"greatest(0, m.s - {window})", "m.s"), cut("bl", "m.e", f"least(m.e + {window}, length({text}))")
    made_ = f"named_struct('s', m.s, 'e', m.e, 'type', m.type, 'value', m.value, 'score', if(m.score < 1 AND NOT m.type IN {CHECKED!r} AND ({before} rlike {words} OR {after} rlike {words}), least(1.0D, m.score + {step}D), m.score), 'priority', m.priority)"
    return let("sp", spans, f"CASE WHEN NOT exists(sp, m -> m.score < 1 AND NOT m.type IN {CHECKED!r}) THEN sp ELSE {let('bl', blocks(text), f'transform(sp, m -> {made_})')} END")


def token(type_: str, number: str, variant: str = "''") -> str:
    """SQL of a token's text."""
    return f"concat('⟦', {type_}, '_', lpad(cast({number} AS string), greatest(4, length(cast({number} AS string))), '0'), {variant}, '⟧')"


def column(sql: str) -> Column:
    return F.expr(sql)
