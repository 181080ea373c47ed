"""What is looked for: entity types and recogniser specifications."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from ..functions import checksums
from ..functions.spans import NONE, hits, made, quote


@dataclass(frozen=True)
class Entity:
    """One type of the catalogue: whether it identifies a person, and what is done by default."""

    name: str
    label: str
    identifying: bool = True
    cloak: bool = True


#: The catalogue of entity types. Other types may come up; they are cloaked.
ENTITIES = (
    Entity("NOM", "names"), Entity("EMAIL", "e-mail addresses"), Entity("IBAN", "bank accounts"), Entity("SIRET", "establishment numbers"),
    Entity("SIREN", "company numbers"), Entity("SECU", "social security numbers"), Entity("TEL", "phone numbers"), Entity("ADRESSE", "postal addresses"),
    Entity("DATE_NAISSANCE", "birth dates"), Entity("NUM_CLIENT", "client numbers"), Entity("NUM_FISCAL", "tax numbers"), Entity("NUM_TELEDECLARANT", "tele-declarant numbers"),
    Entity("ISIN", "securities", False, False), Entity("MONTANT", "amounts", False, False), Entity("DATE_EVENEMENT", "event dates", False, True),
    Entity("POSTE", "job titles", False, True), Entity("URL", "web addresses"), Entity("SECRET", "secrets"), Entity("LIEU_NAISSANCE", "birth places"),
    Entity("PIECE_IDENTITE", "identity documents"), Entity("RAISON_SOCIALE", "company names"), Entity("SOCIETE", "organisations"),
)
CATALOGUE = {e.name: e for e in ENTITIES}


def earlier(text: str, pattern: str, reach: int = 60) -> str:
    """SQL: whether ``pattern`` occurs before a match ``x``, on its line and within ``reach`` characters."""
    line = rf"substring_index(substring({text}, greatest(1, x.s + 1 - {reach}), least(x.s, {reach})), '\n', -1)"
    return f"{line} rlike {quote(pattern)}"


@dataclass(frozen=True)
class Recognizer:
    """A pattern in Java's syntax and what becomes of its matches.

    ``group``: the group that is the value; it must end the match. ``check``:
    SQL over the value that gives score 1; without it the score is
    ``otherwise``, or nothing is found if ``drop``. ``before``: a pattern that
    must occur earlier on the line, within ``reach`` characters. ``needs``: SQL
    over ``{text}``, or ``{low}``, the text in lower case, that holds wherever
    the pattern can match, and costs less.
    """

    type: str
    pattern: str
    priority: int
    group: int = 0
    check: Callable[[str], str] | None = None
    otherwise: float = 0.6
    drop: bool = False
    before: str | None = None
    reach: int = 60
    needs: str | None = None

    def sql(self, text: str = "text", low: str | None = None) -> str:
        """Spans of this recogniser in ``text``; none, at the cost of one search, without a match. ``low``: a column of the text in lower case, if there is one."""
        x = hits(text, self.pattern, self.group)
        wanted = ["trim(x.v) <> ''"]
        score = "1.0D"
        if self.check is not None:
            if self.drop:
                wanted.append(self.check("x.v"))
            else:
                score = f"if({self.check('x.v')}, 1.0D, {self.otherwise}D)"
        if self.before is not None:
            wanted.append(earlier(text, self.before, self.reach))
        no = f"WHEN NOT {self.needs.format(text=text, low=low or f'lower({text})')} THEN {NONE} " if self.needs else ""
        return f"CASE {no}WHEN {text} rlike {quote(self.pattern)} THEN transform(filter({x}, x -> {' AND '.join(wanted)}), x -> {made(self.type, score, self.priority)}) ELSE {NONE} END"


def some_of(text: str, *parts: str) -> str:
    """SQL template: whether one of ``parts`` is in ``{text}`` or ``{low}``."""
    return "(" + " OR ".join(f"contains({text}, {quote(p)})" for p in parts) + ")"


class FieldError(ValueError):
    """A user's field that can't be taken."""


_RISKY = re.compile(r"\([^()]*[+*][^()]*\)\s*[+*{]|\([^()]*\|[^()]*\)\s*[+*]{1,2}")


def custom_recognizer(field: dict) -> Recognizer:
    """A recogniser of a user's own field.

    The type is in capitals, 2 to 32 characters. Patterns that repeat a
    repetition are refused, as they can take endless time; so are unknown check
    names. The priority, 65 by default, is held to 1 to 99.
    """
    kind = str(field.get("entity_type", ""))
    if not re.fullmatch(r"[A-Z][A-Z0-9_]{1,31}", kind):
        raise FieldError(f"type {kind!r}")
    pattern = field.get("pattern") or ""
    if not pattern or len(pattern) > 500 or _RISKY.search(pattern):
        raise FieldError("pattern")
    try:
        re.compile(pattern)
    except re.error as e:
        raise FieldError("pattern") from e
    name = field.get("validator")
    if name and name not in checksums.NAMED:
        raise FieldError(f"check {name!r}")
    priority = max(1, min(99, int(field.get("priority", 65))))
    return Recognizer(kind, "(?U)" + pattern, priority, check=checksums.NAMED[name] if name else None)


def custom_recognizers(fields: list[dict]) -> list[Recognizer]:
    """Those of the fields that can be taken; the others are left out."""
    out = []
    for f in fields:
        try:
            out.append(custom_recognizer(f))
        except (FieldError, TypeError, ValueError):
            continue
    return out
