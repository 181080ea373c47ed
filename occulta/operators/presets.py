"""Ready-made engines: the one that documents are read with, and the web form's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.spans import NONE, let, resolved
from . import lists
from .masker import Masker
from .recognizers import core
from .spec import Recognizer, custom_recognizers


def _words(spark: SparkSession, table: DataFrame | None, column: str) -> DataFrame:
    return spark.createDataFrame([], f"{column} string") if table is None else table


def standard(
    spark: SparkSession, gazetteer: DataFrame | None = None, fields: list[dict] | None = None, policy: dict[str, bool] | None = None, allow: str = "false", common: DataFrame | None = None, safe: DataFrame | None = None,
    models: dict[str, Callable[[DataFrame], object]] | None = None,
) -> Masker:
    """Forms, models, a user's fields, known values, lists and policy in one engine.

    ``gazetteer(value, entity_type)``: known values, masked whatever the lists
    say. ``common`` and ``safe`` (word) keep names in clear, ``allow`` (SQL over
    ``m``, see ``lists.allowed``) public parties; fields that can't be taken are
    left out. The policy has the last word, but can't keep an identifying type.
    """
    known = None if gazetteer is None else gazetteer.select("value", "entity_type")
    negative = None
    if common is not None or safe is not None or allow != "false":
        negative = lists.Lists(_words(spark, None if known is None else known.select("value"), "value"), _words(spark, common, "word"), _words(spark, safe, "word"), allow)
    return Masker(forms=True, extra_recognizers=custom_recognizers(fields or []), extra=dict(models or {}), dictionary=known, lists=negative, keep=lists.by_policy(lists.policy(policy)))


def web(policy: dict[str, bool] | None = None, allow: str = "false", models: dict[str, Callable[[DataFrame], object]] | None = None) -> Masker:
    """Recognisers and models, first the allow list, then the policy."""
    return Masker(extra=dict(models or {}), keep=f"NOT coalesce({allow}, false) AND {lists.by_policy(lists.policy(policy))}")


def table_function(spark: SparkSession, name: str = "detect_pii", recognizers: list[Recognizer] | None = None) -> None:
    """Register an SQL table function of a text: (s, e, type, value, score) of what the recognisers find, resolved.

    Its body is SQL, which Catalyst puts in place of the call: ``SELECT ... FROM docs, LATERAL detect_pii(text)``.
    Null text counts as empty.
    """
    found = ", ".join(r.sql("t") for r in (core() if recognizers is None else recognizers))
    spans = let("t", "coalesce(text, '')", resolved(f"concat({NONE}, {found})"))
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE(s INT, e INT, type STRING, value STRING, score DOUBLE) "
        f"RETURN SELECT m.s, m.e, m.type, m.value, m.score FROM (SELECT explode({spans}) AS m)"
    )
