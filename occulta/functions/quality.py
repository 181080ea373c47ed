"""Text quality, form and extraction signals, as SQL over a text expression."""

from __future__ import annotations

from .spans import quote

#: Thresholds of the quality gate, the garble test and the sparse test.
LEAST_REAL_WORDS, LEAST_WORD_LENGTH, MOST_ODD_PERCENT = 0.40, 3.5, 8.0
GARBLED_SPACES, GARBLED_TOKENS, GARBLED_JOINS, LONG_TOKEN = 0.10, 0.03, 3, 25
SPARSE_CHARS, FORM_MARKS = 120, 3
SUBSTANTIAL_WORDS, SUBSTANTIAL_CHARS = 8, 40
#: Marks of a fiscal form.
FORM_MARKERS = (
    r"N°\s?20\d{2}(?:-[A-Z]{1,3})?",
    r"20(?:3[0-9]|5[0-9]|65)-?[A-Z]{1,3}",
    r"(?iu)CERFA",
    r"(?iu)liasse",
    r"(?iu)ETATS?\s+FISCAUX",
    r"(?iu)BILAN\s+(?:ACTIF|PASSIF|SIMPLIFI)",
    r"(?iu)COMPTE\s+DE\s+R[ÉE]SULTAT",
    r"(?iu)CAPITAUX\s+PROPRES",
    r"(?iu)IMMOBILISATIONS?\s+(?:CORPORELLES|INCORPORELLES|FINANCI)",
    r"(?iu)R[ÉE]GIME\s+R[ÉE]EL",
    r"(?iu)IMP[ÔO]T\s+SUR\s+LES\s+SOCI[ÉE]T[ÉE]S",
)
#: The barcode block and its marker.
BARCODE, BARCODE_MARKER = r"\bDC[0-9A-Z]{2}[0-9A-Z]{4}[0-9A-Z]{40,}", "⟦2DDOC_BARCODE_STRIPPED⟧"
#: Characters expected in clean text besides letters, digits and white space.
EXPECTED = r"""(?U)[\p{L}\p{N}\s.,;:!?'"()/€%&@°#*+=_\[\]«»…–—-]"""
#: Fill characters of forms.
DOT_RUNS = r"[.…]{3,}|[-–—]{3,}|[_]{3,}"


def words(text: str) -> str:
    return rf"regexp_extract_all({text}, r'(?U)\w+', 0)"


def substantial(text: str) -> str:
    """Eight words and forty characters at least."""
    return rf"(size({words(text)}) >= {SUBSTANTIAL_WORDS} AND length(regexp_replace({text}, r'(?U)^\s+|\s+$', '')) >= {SUBSTANTIAL_CHARS})"


def quality_signals(text: str) -> str:
    """(n_words, n_real, real_chars, n_odd, n_chars): what the gate looks at."""
    odd = f"length(regexp_replace({text}, {quote(EXPECTED)}, ''))"
    # each array is made once and bound as the one element of another
    real = r"filter(w, x -> x rlike r'(?U)^[^\W\d_]{2,}$')"
    found = f"named_struct('n_words', size(w), 'n_real', size(r), 'real_chars', aggregate(r, 0, (a, x) -> a + length(x)), 'n_odd', {odd}, 'n_chars', length({text}))"
    return f"transform(array({words(text)}), w -> transform(array({real}), r -> {found})[0])[0]"


def passes_quality(signals: str) -> str:
    """Whether text is clean enough for "nothing found" to mean something."""
    q = signals
    return f"({q}.n_words > 0 AND {q}.n_real / {q}.n_words >= {LEAST_REAL_WORDS} AND {q}.n_real > 0 AND {q}.real_chars / {q}.n_real >= {LEAST_WORD_LENGTH} AND {q}.n_odd / {q}.n_chars * 100 <= {MOST_ODD_PERCENT})"


def structured_form(text: str) -> str:
    """Three marks of a fiscal form, counting further form numbers."""
    marks = " + ".join(f"cast({text} rlike {quote(p)} AS int)" for p in FORM_MARKERS)
    numbers = f"size(array_distinct(regexp_extract_all({text}, {quote(FORM_MARKERS[1])}, 0)))"
    return f"(({marks}) + greatest(0, {numbers} - 1) >= {FORM_MARKS})"


def garbled(text: str) -> str:
    """Few spaces, long tokens and words glued by their case, all three."""
    tokens = rf"filter(split({text}, r'(?U)\s+'), t -> t <> '')"
    long = rf"filter({tokens}, t -> length(t) > {LONG_TOKEN} AND NOT t rlike r'(?i)^(?:https?://|www\.|\S+@\S+\.\S+)')"
    spaces = f"(length({text}) - length(replace({text}, ' ', '')))"
    joins = f"size(regexp_extract_all({text}, '[a-z][A-Z]|[A-Z]{{2,}}[a-z]', 0))"
    return f"coalesce(length({text}) > 0 AND {spaces} / length({text}) < {GARBLED_SPACES} AND size({tokens}) > 0 AND size({long}) / size({tokens}) >= {GARBLED_TOKENS} AND {joins} >= {GARBLED_JOINS}, false)"


def sparse(text: str, pages: str) -> str:
    return f"({pages} >= 2 AND length({text}) / {pages} < {SPARSE_CHARS})"


def without_barcodes(text: str) -> str:
    return f"regexp_replace({text}, {quote(BARCODE)}, '{BARCODE_MARKER}')"


def without_dot_runs(text: str) -> str:
    return f"regexp_replace({text}, {quote(DOT_RUNS)}, ' ')"
