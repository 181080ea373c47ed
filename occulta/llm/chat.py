"""Chat formatting with compiled templates.

The template language has text, ``{{ expression }}``, ``{% for x in list %}``,
``{% if %} {% elif %} {% else %}``, ``{% set x = expression %}``, comments
``{# #}``, ``-`` inside a tag to drop the white space beside it, and
``{% generation %}``, which marks what a model is to learn. Expressions know
literals, names, ``a.b``, ``a['b']``, ``a[0]`` and slices ``a[1:]``, ``+ - %``,
``~``, comparisons, ``in``, ``is defined``, ``is none``, ``and``, ``or``, ``not``
and a fixed set of filters; no calls, no attributes of Python objects, nothing
else. What isn't there is empty text, and not defined. ``+`` and ``-`` and ``%``
compute with whole numbers; ``+`` joins anything else as text.

A template is parsed into a syntax tree, constants are folded by the very
functions that compute them later, and each node becomes a Python closure. A
template that only loops once over ``messages``, and looks at fixed places of
its beginning, takes the messages one after the other, so a conversation of any
length is written in pieces of bounded size; any other template holds a whole
conversation, and fails with ``TemplateError`` beyond ``HELD_CHARS`` characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Strings that mark turns; inside texts they are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]")
ESCAPE = "\\"
DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'system' %}[SYS]{{ m.text | escape }}[/SYS]"
    "{% elif m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '<' + '/s>' }}"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}[/TURN]{% endif %}"
    "{% endfor %}"
)
#: Characters after which a conversation's output is cut into a further row.
PIECE_CHARS = 1 << 20
#: Characters of a conversation that a template may hold which looks at messages out of order.
HELD_CHARS = 1 << 28
#: Characters of a text by which rows are dealt to ranges.
PREFIX = 32
FORMATTED = "conv_id long, piece long, n_turns long, formatted string, spans array<long>"
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_CODES = {c: ESCAPE + chr(97 + k) for k, c in enumerate(CONTROLS)} | {ESCAPE: ESCAPE * 2}
_TEXTS = {v: k for k, v in _CODES.items()}
_ANY = re.compile("|".join(map(re.escape, [*sorted(CONTROLS, key=len, reverse=True), ESCAPE])))
_CODE = re.compile("|".join(map(re.escape, _TEXTS)))


def escape(text: str) -> str:
    """``text`` without any control string; :func:`unescape` undoes it exactly."""
    return _ANY.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _CODE.sub(lambda m: _TEXTS[m[0]], text)


FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    """The template is not of the language."""


# -- parsing: nodes are tuples ("kind", ...)

_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_TAG = re.compile(rf"\{{\{{-?((?:{_STRING}|[^'\"])*?)-?\}}\}}|\{{%-?((?:{_STRING}|[^'\"])*?)-?%\}}|\{{#-?.*?-?#\}}", re.S)
_TOKEN = re.compile(rf"\s*(?:({_STRING})|(\d+)|([A-Za-z_][A-Za-z0-9_]*)|(==|!=|<=|>=|[-<>+%~|.:\[\]()]))")
_WORDS = ("and", "or", "not", "in", "is", "if", "else")


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            kind = next(k for k in range(1, 5) if m[k] is not None)
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[int, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (0, "")

    def take(self, *wanted: str) -> str | None:
        kind, text = self.peek()
        if kind >= 3 and text in wanted:
            self.at += 1
            return text
        return None

    def whole(self):
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                node = (op, node, self.added())
            elif self.take("is"):
                no = self.take("not")
                test = self.take("defined", "none")
                if not test:
                    raise TemplateError(f"no test {self.peek()[1]!r}")
                node = ("not", (test, node)) if no else (test, node)
            elif self.peek() == (3, "not") and self.tokens[self.at + 1 : self.at + 2] == [(3, "in")]:
                self.at += 2
                node = ("not", ("in", node, self.added()))
            else:
                return node

    def added(self):
        node = self.filtered()
        while op := self.take("+", "-", "%", "~"):
            node = (op, node, self.filtered())
        return node

    def filtered(self):
        node = self.atom()
        while self.take("|"):
            name = self.peek()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def atom(self):
        kind, text = self.peek()
        self.at += 1
        if kind == 1:
            node = ("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        elif kind == 2:
            node = ("literal", int(text))
        elif kind == 3 and text.lower() in ("true", "false"):
            node = ("literal", text.lower() == "true")
        elif kind == 3 and text.lower() == "none":
            node = ("literal", None)
        elif kind == 3 and text not in _WORDS and not text.startswith("_"):
            node = ("name", text)
        elif text == "-" and self.peek()[0] == 2:
            node = ("literal", -int(self.peek()[1]))
            self.at += 1
        elif text == "(":
            node = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while op := self.take(".", "["):
            if op == ".":
                kind, text = self.peek()
                if kind != 3 or text.startswith("_"):
                    raise TemplateError(f"unexpected {text!r}")
                self.at += 1
                node = ("item", node, ("literal", text))
            else:
                first = ("literal", None) if self.peek() == (4, ":") else self.either()
                if self.take(":"):
                    last = ("literal", None) if self.peek() == (4, "]") else self.either()
                    node = ("slice", node, first, last)
                else:
                    node = ("item", node, first)
                if not self.take("]"):
                    raise TemplateError("missing ]")
        return node


def parse(template: str):
    """The template's syntax tree."""
    parts, at, strip = [], 0, False

    def said(text: str, right: bool) -> None:
        text = text.lstrip() if strip else text
        text = text.rstrip() if right else text
        if re.search(r"\{[{%#]", text):
            raise TemplateError(f"unclosed tag in {text!r}")
        if text:
            parts.append(("text", text))

    for m in _TAG.finditer(template):
        tag = m[0]
        said(template[at : m.start()], tag[2] == "-")
        if not tag.startswith("{#"):
            parts.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at, strip = m.end(), tag[-3] == "-"
    said(template[at:], False)
    parts.reverse()

    def block(*ends: str):
        nodes = []
        while parts:
            kind, text = parts.pop()
            if kind == "text":
                nodes.append(("print", ("literal", text)))
            elif kind == "print":
                nodes.append(("print", _Expression(text).whole()))
            elif (word := text.split(None, 1)[0] if text else "") in ends:
                return ("block", nodes), text
            elif word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", text, re.S)
                if not m:
                    raise TemplateError(f"bad {text!r}")
                body, _ = block("endfor")
                nodes.append(("for", m[1], _Expression(m[2]).whole(), body))
            elif word == "if":
                nodes.append(branch(text[2:]))
            elif word == "set":
                m = re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=\s*(.+)", text, re.S)
                if not m:
                    raise TemplateError(f"bad {text!r}")
                nodes.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                body, _ = block("endgeneration")
                nodes.append(("generation", body))
            else:
                raise TemplateError(f"unexpected {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[0]}")
        return ("block", nodes), ""

    def branch(condition: str):
        test = _Expression(condition).whole()
        body, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", test, body, branch(end[4:]))
        other = block("endif")[0] if end.startswith("else") else ("block", [])
        return ("if", test, body, other)

    return block()[0]


# -- folding


class _Missing(str):
    """What a name or an item that isn't there stands for."""


MISSING = _Missing("")


def _whole(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _add(a, b):
    return a + b if _whole(a) and _whole(b) else _text(a) + _text(b)


def _numbers(name: str, op: Callable) -> Callable:
    def apply(a, b):
        if not (_whole(a) and _whole(b)) or (name == "%" and b == 0):
            raise TemplateError(f"{name} of {type(a).__name__} and {type(b).__name__}")
        return op(a, b)

    return apply


def _ordered(op: Callable) -> Callable:
    return lambda a, b: op(a, b) if _whole(a) and _whole(b) else op(_text(a), _text(b))


def _item(x, key):
    if isinstance(x, dict):
        return x.get(key, MISSING) if isinstance(key, str) else MISSING
    if isinstance(x, Stream) and _whole(key):
        return x[key]
    return x[key] if isinstance(x, list) and _whole(key) and -len(x) <= key < len(x) else MISSING


def _slice(x, a, b):
    return x[(a if _whole(a) else None) : (b if _whole(b) else None)] if isinstance(x, (list, str)) else []


def _filter(name: str, x):
    if name == "length":
        return len(x) if isinstance(x, (list, dict)) else len(_text(x))
    return FILTERS[name](_text(x))


#: How values are computed, in folding as in closures; ``and`` and ``or`` are lazy there.
_APPLY = {
    "+": _add, "-": _numbers("-", lambda a, b: a - b), "%": _numbers("%", lambda a, b: a % b), "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": _ordered(lambda a, b: a < b), ">": _ordered(lambda a, b: a > b), "<=": _ordered(lambda a, b: a <= b), ">=": _ordered(lambda a, b: a >= b),
    "in": lambda a, b: a in b if isinstance(b, (list, dict)) else _text(a) in _text(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b,
    "not": lambda a: not a, "defined": lambda a: not isinstance(a, _Missing), "none": lambda a: a is None, "item": _item, "slice": _slice,
}


def fold(node):
    """The tree with constant expressions computed, known branches taken and texts joined."""
    kind = node[0]
    if kind in _APPLY:
        parts = [fold(n) for n in node[1:]]
        if all(p[0] == "literal" for p in parts):
            try:
                return ("literal", _APPLY[kind](*(p[1] for p in parts)))
            except TemplateError:  # an error only where it is reached
                pass
        return (kind, *parts)
    if kind == "filter":
        a = fold(node[2])
        return ("literal", _filter(node[1], a[1])) if a[0] == "literal" else ("filter", node[1], a)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "print":
        return ("print", fold(node[1]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        test = fold(node[1])
        if test[0] == "literal":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    if kind == "block":
        out = []
        for n in map(fold, node[1]):
            for x in n[1] if n[0] == "block" else [n]:
                if x[0] == "print" and x[1][0] == "literal":
                    text = _text(x[1][1])
                    if out and out[-1][0] == "print" and out[-1][1][0] == "literal":
                        text = out.pop()[1][1] + text
                    x = ("print", ("literal", text))
                out.append(x)
        return ("block", out)
    return node


# -- closures

def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "literal":
        constant = node[1]
        return lambda scope: constant
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name, MISSING)
    if kind == "filter":
        name, of = node[1], _value(node[2])
        return lambda scope: _filter(name, of(scope))
    apply, parts = _APPLY[kind], [_value(n) for n in node[1:]]
    if len(parts) == 1:
        (a,) = parts
        return lambda scope: apply(a(scope))
    if len(parts) == 3:
        return lambda scope: apply(*(p(scope) for p in parts))
    a, b = parts
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: apply(a(scope), b(scope))


def _text(x: object) -> str:
    return "" if x is None else str(x)


#: Yielded after each round of the loop over messages as they come.
_ROUND = (None, False)


class Stream:
    """Messages as they come: read once in order, the first ``held`` also by place."""

    def __init__(self, messages: Iterable[dict], held: int):
        self.more = iter(messages)
        self.first = [x for _, x in zip(range(held), self.more)]

    def __getitem__(self, k: int):
        return self.first[k] if 0 <= k < len(self.first) else MISSING

    def __iter__(self):
        yield from self.first
        yield from self.more


def _action(node, learned: bool) -> Callable[[dict], Iterator[tuple[str | None, bool]]]:
    kind = node[0]
    if kind == "print":
        of = _value(node[1])
        return lambda scope: iter([(_text(of(scope)), learned)])
    if kind == "set":
        to, of = node[1], _value(node[2])

        def put(scope):
            scope[to] = of(scope)
            return iter(())

        return put
    if kind == "generation":
        return _action(node[1], True)
    if kind == "block":
        steps = [_action(n, learned) for n in node[1]]

        def block(scope):
            for step in steps:
                yield from step(scope)

        return block
    if kind == "if":
        test, yes, no = _value(node[1]), _action(node[2], learned), _action(node[3], learned)
        return lambda scope: (yes if test(scope) else no)(scope)
    name, of, body = node[1], _value(node[2]), _action(node[3], learned)

    def loop(scope):
        given = of(scope)
        items = iter(given if isinstance(given, (list, dict, Stream)) else ())
        index, nothing = 0, object()
        x = next(items, nothing)
        while x is not nothing:  # one message ahead, for loop.last
            following = next(items, nothing)
            yield from body({**scope, name: x, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": following is nothing}})
            if isinstance(given, Stream):
                yield _ROUND
            x, index = following, index + 1

    return loop


def _places(node, inside: bool = False) -> Iterator[tuple[str, int]]:
    """How a tree uses ``messages``: ("loop", 0), ("loops", 0) within another loop, ("at", place) or ("any", 0)."""
    if node == ("name", "messages"):
        yield "any", 0
    elif node[0] == "for" and node[2] == ("name", "messages"):
        yield "loops" if inside else "loop", 0
        yield from _places(node[3], True)
    elif node[0] == "item" and node[1] == ("name", "messages") and node[2][0] == "literal" and _whole(node[2][1]) and node[2][1] >= 0:
        yield "at", node[2][1]
    elif node[0] == "set" and node[1] == "messages":
        yield "any", 0
    elif node[0] != "literal":
        for n in node[1] if node[0] == "block" else node[1:]:
            if isinstance(n, tuple):
                yield from _places(n, inside or node[0] == "for")


class Template:
    """A compiled template.

    ``streams``: whether messages are taken as they come. ``turnwise``: whether
    each message's output depends on that message alone, so that parts of a
    conversation can be rendered apart.
    """

    def __init__(self, template: str):
        tree = fold(parse(template))
        uses = list(_places(tree))
        self.streams = all(u in ("loop", "at") for u, _ in uses) and sum(u == "loop" for u, _ in uses) <= 1
        self.held = 1 + max((k for u, k in uses if u == "at"), default=-1)
        nodes = tree[1] if tree[0] == "block" else [tree]
        self.turnwise = len(nodes) == 1 and nodes[0][0] == "for" and uses == [("loop", 0)] and not _uses_loop(nodes[0][3])
        self.run = _action(tree, False)

    def __call__(self, messages: Iterable[dict], **more) -> Iterator[tuple[str | None, bool]]:
        """(text, learned) as messages come, and (None, False) after each round of the loop over them; the rest of them is read too."""
        if not self.streams:
            messages = _held(messages)
        given = Stream(messages, self.held) if self.streams else messages
        yield from self.run({"messages": given, **more})
        if self.streams:
            for _ in given.more:
                pass


def _uses_loop(node) -> bool:
    return isinstance(node, (tuple, list)) and (node == ("name", "loop") or any(_uses_loop(n) for n in node))


def _held(messages: Iterable[dict]) -> list[dict]:
    out, size = [], 0
    for m in messages:
        size += len(m["text"])
        if size > HELD_CHARS:
            raise TemplateError(f"this template looks at messages out of order, which a conversation of over {HELD_CHARS} characters can't allow")
        out.append(m)
    return out


def compile_template(template: str) -> Template:
    """A function that renders messages (role, text) as they come."""
    return Template(template)


def render(messages: Iterable[dict], template: str = DEFAULT_TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and the spans under the loss mask."""
    out, spans, at = [], [], 0
    for text, learned in compile_template(template)(messages):
        if text is not None:
            if learned:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
    return "".join(out), spans


_TURN = re.compile(r"\[SYS\](?P<system>.*?)\[/SYS\]|\[INST\](?P<user>.*?)\[/INST\]|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[/TURN\]|(?P<assistant>.*?)</s>", re.S)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of the default template's output."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not the output of the default template")
        at = m.end()
        role = m.lastgroup
        yield (unescape(m["role"]), unescape(m["text"])) if role == "text" else (role, unescape(m[role]))


def format_conversations(rows: DataFrame, template: str = DEFAULT_TEMPLATE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Formatted conversations: rows (conv_id, piece, n_turns, formatted, spans), written once.

    ``rows`` has (conv_id, turn, role, text). Turns are put in order by turn
    (null first), then role and text, so ties and repeated rows all appear, in
    one order. Null role or text counts as empty; rows without conv_id form one
    conversation. ``spans`` has start and end of each learned span in turn. A
    long conversation has several pieces, each of whole turns, numbered in
    order with gaps; ``n_turns`` counts a piece's turns.

    With a template that renders each message by itself (the default does), a
    conversation's turns are dealt to ranges, so that one with very many of
    them, or rows without conv_id, are several tasks' work. Otherwise a
    conversation is one task's, read as a stream, or held if it must be.
    """
    common.ship(rows.sparkSession)
    turnwise = compile_template(template).turnwise  # an error shows here, not in a task
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"))
    dealt = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, PREFIX)) if turnwise else rows.repartition(F.col("conv_id"))
    ordered = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        from pyspark import TaskContext

        go, number = compile_template(template), TaskContext.get().partitionId() << 32

        def each():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(3)))

        it = each()
        row = next(it, None)
        while row is not None:
            conv, read, told, piece = row[0], 0, 0, number

            def messages():
                nonlocal row, read
                while row is not None and row[0] == conv:
                    read += 1
                    yield {"role": row[1], "text": row[2]}
                    row = next(it, None)

            out, spans, at, rounds = [], [], 0, 0
            for text, learned in go(messages()):
                if text is None:
                    rounds += 1
                    if at >= piece_chars:
                        yield conv, piece, rounds - told, "".join(out), spans
                        out, spans, at, told, piece = [], [], 0, rounds, piece + 1
                else:
                    if learned:
                        spans += [at, at + len(text)]
                    out.append(text)
                    at += len(text)
            if read > told or at or piece == number:
                yield conv, piece, read - told, "".join(out), spans

    return common.materialise(ordered.mapInArrow(_grouped(run), FORMATTED), "chat")


def _grouped(run):
    """Rows of ``run`` in batches."""

    def batches(given):
        rows, size = [], 0
        for r in run(given):
            rows.append(r)
            size += len(r[3])
            if size > 4 << 20 or len(rows) >= 5000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    return batches


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv, piece, turns, formatted, spans = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(turns, pa.int64()), pa.array(formatted), pa.array(spans, pa.list_(pa.int64()))], ["conv_id", "piece", "n_turns", "formatted", "spans"])


def digest_formatted(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and learned text, as digests."""
    common.ship(formatted.sparkSession)
    ordered = formatted.select("conv_id", "formatted", "spans", "piece").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "piece")

    def run(batches):
        state = None
        for b in batches:
            rows = []
            for conv, text, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(_closed(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, z in zip(spans[::2], spans[1::2]):
                    said = unescape(text[a:z])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            if rows:
                yield _result(rows)
        if state is not None:
            yield _result([_closed(state)])

    return ordered.mapInArrow(run, SCHEMA)


def _closed(s: list) -> tuple:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])
