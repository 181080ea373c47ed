"""Check sums as SQL over a string expression."""

from __future__ import annotations


def _expanded(v: str) -> str:
    """Letters as 10 to 35, digits as they are."""
    return f"array_join(transform(filter(split({v}, ''), c -> c <> ''), c -> if(c rlike '[A-Z]', cast(ascii(c) - 55 AS string), c)), '')"


def _mod97(v: str) -> str:
    return f"aggregate(filter(split({_expanded(v)}, ''), c -> c <> ''), 0, (a, c) -> (a * 10 + cast(c AS int)) % 97)"


def iban(v: str) -> str:
    """Country, two digits and 10 to 30 more, of which the rest by 97 is 1; separators don't count."""
    s = f"upper(regexp_replace({v}, r'[\\s.\\-]+', ''))"
    return f"({s} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{10,30}}$' AND {_mod97(f'concat(substring({s}, 5), substring({s}, 1, 4))')} = 1)"


def iban_gate(v: str) -> str:
    """The cheap gate's form: white space only, 15 characters at least."""
    s = f"upper(regexp_replace({v}, r'\\s', ''))"
    return f"(length({s}) >= 15 AND {s} rlike '^[A-Z0-9]*$' AND {_mod97(f'concat(substring({s}, 5), substring({s}, 1, 4))')} = 1)"


def luhn(v: str) -> str:
    """Of the digits alone; no digit is no number."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    return f"(length({d}) > 0 AND luhn_check({d}))"


def isin(v: str) -> str:
    s = f"upper(trim({v}))"
    return f"({s} rlike '^[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]$' AND luhn_check({_expanded(s)}))"


def siren(v: str) -> str:
    """Nine or 14 digits once white space is gone; a hyphen counts as a character."""
    d = f"regexp_replace({v}, r'\\s+', '')"
    return f"(length({d}) IN (9, 14) AND {luhn(d)})"


def fiscal_reference(v: str) -> str:
    """Thirteen digits whose last two are 97 less the rest of the first eleven by 97."""
    d = f"regexp_replace({v}, r'\\s+', '')"
    return f"({d} rlike '^[0-9]{{13}}$' AND 97 - try_cast(substring({d}, 1, 11) AS bigint) % 97 = try_cast(substring({d}, 12) AS int))"


def secu(v: str) -> str:
    """Fifteen digits whose last two are 97 less the rest of the first thirteen by 97."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    return f"(length({d}) = 15 AND 97 - try_cast(substring({d}, 1, 13) AS bigint) % 97 = try_cast(substring({d}, 14) AS int))"


NAMED = {"iban": iban, "luhn": luhn, "isin": isin, "siren": siren, "num_fiscal": fiscal_reference, "secu": secu}
