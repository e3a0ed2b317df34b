"""Judge responses to scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LISTED = "array<struct<first_score: double, second_score: double, _end: int, _corrupt: string>>"
_SHAPE = "first_score double, second_score double, _corrupt string"
# Names and texts stand in double quotes, nothing else.
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parsed(raw: Column) -> Column:
    """``struct<first_score, second_score, _corrupt>`` of a response; malformed text fills ``_corrupt``."""
    return F.from_json(raw, _SHAPE, _OPTIONS)


def whole_document(raw: Column) -> Column:
    """``array<struct<first_score, second_score, _end>>``: the response in a list before a mark of its own, parsed once.

    The parser stops after a document. In the list a response that is one JSON document is the first of two elements; text after
    it breaks the list, ends it early or makes more elements.
    """
    return F.from_json(F.concat(F.lit("["), raw, F.lit(', {"_end": 1}]')), _LISTED, _OPTIONS)


def is_whole(document: Column) -> Column:
    """Whether the text held one JSON document and nothing after it."""
    return F.coalesce((F.size(document) == 2) & (F.get(document, F.lit(1))["_end"] == 1), F.lit(False))


def is_valid(raw: Column, fields: Column) -> Column:
    """A JSON object holding two finite numeric scores; one missing score voids the whole row."""
    scores = (fields["first_score"], fields["second_score"])
    finite = [s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) for s in scores]
    is_object = F.startswith(F.ltrim(raw, F.lit(" \n\r\t")), F.lit("{"))
    return F.coalesce(is_object & fields["_corrupt"].isNull() & finite[0] & finite[1], F.lit(False))


def problem_text(raw: Column) -> Column:
    """The echoed problem under either spelling of its key."""
    return F.coalesce(F.get_json_object(raw, "$.problem"), F.get_json_object(raw, "$.Problem"))
