"""The verdict on a masked document, and the gates before it is given out. All as SQL."""

from __future__ import annotations

from ..functions.quality import substantial

THRESHOLD = 0.6
STATES = ("leak", "low_confidence", "zero_detection", "nothing_to_do", "masked_ok")
#: What a reader is told.
LABELS = {
    "leak": "⚠️ PII résiduelle détectée — NE PAS envoyer",
    "low_confidence": "⚠️ Détection peu fiable sous le seuil — à revoir avant envoi",
    "zero_detection": "⚠️ Aucune donnée identifiante détectée — cela ne garantit PAS l'absence de PII. Une relecture humaine est requise avant envoi.",
    "nothing_to_do": "✓ Aucune donnée identifiante détectée — rien à anonymiser",
    "masked_ok": "✓ Données identifiantes masquées — revue conseillée avant envoi",
}
WINDOW, WINDOW_OVERLAP, MOST_WINDOWS = 6000, 400, 12


def least_score(entities: str) -> str:
    """The least score of the entities; 1 without any."""
    return f"coalesce(array_min(transform({entities}, m -> m.score)), 1.0D)"


def state(text: str, entities: str, residual: str, threshold: float = THRESHOLD) -> str:
    """The most serious state that holds."""
    return f"""CASE WHEN size({residual}) > 0 THEN 'leak'
      WHEN size({entities}) > 0 AND {least_score(entities)} < {threshold} THEN 'low_confidence'
      WHEN size({entities}) = 0 AND {substantial(text)} THEN 'zero_detection'
      WHEN size({entities}) = 0 THEN 'nothing_to_do' ELSE 'masked_ok' END"""


def safe(state_: str) -> str:
    """Whether nothing speaks against sending."""
    return f"({state_} IN ('nothing_to_do', 'masked_ok'))"


def label(state_: str) -> str:
    from ..functions.spans import quote

    return f"map({', '.join(f'{quote(k)}, {quote(v)}' for k, v in LABELS.items())})[{state_}]"


def second_pass(mode: str, form: str) -> str:
    """What a model pass does: forms are verified or refused, prose only gains."""
    return f"CASE WHEN {mode} = 'off' THEN if({form}, 'fail_closed', 'skip') WHEN {form} THEN 'run_failclosed' WHEN {mode} = 'all' THEN 'run_additive' ELSE 'skip' END"


def mode_of(value: str) -> str:
    """A configured mode, or ``all`` for anything unknown."""
    return f"CASE WHEN lower(trim({value})) IN ('all', 'hard', 'off') THEN lower(trim({value})) ELSE 'all' END"


def window_count(text: str, size: int = WINDOW, overlap: int = WINDOW_OVERLAP) -> str:
    return f"cast(greatest(1, ceil(greatest(1, length({text})) / {size - overlap})) AS int)"


def verified(windows: str, failed: str, applied: str, entities: str, residual: str) -> str:
    """The outcome for a form: verified only if a pass added spans, or there was something and nothing is left."""
    return f"CASE WHEN {windows} > {MOST_WINDOWS} THEN 'too_large' WHEN {failed} THEN 'unverified' WHEN {applied} > 0 OR (size({entities}) > 0 AND size({residual}) = 0) THEN 'ok' ELSE 'fail_closed' END"


def added(failed: str, floor: str, more: str) -> str:
    """The outcome for prose: the model's text, or the floor's if the pass failed."""
    return f"CASE WHEN {failed} OR {more} IS NULL THEN {floor} ELSE {more} END"


def complete(state_: str) -> str:
    """Whether a verdict is one of the known states; anything else means that masking didn't end."""
    return f"coalesce({state_} IN ({', '.join(map(repr, STATES))}), false)"
