"""Confidence scores, bands and readiness labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import round_int, to_double
from .text import let, strip

# Band floors, value shapes and the scores they earn.
HIGH_MIN = 95
REVIEW_MIN = 75
TAX_ID = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$"
ACCOUNT_ID = r"^[A-Z]{5}[0-9]{4}[A-Z]$"
DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$|^\d{2}[/-]\d{2}[/-]\d{2,4}$"
GOODS_CODE = r"^\d{4,8}$"
SCORE_EMPTY = 0
SCORE_BOOL = 99
SCORE_NUMBER = 97
SCORE_ZERO = 80
SCORE_ID = 99
SCORE_DATE = 96
SCORE_GOODS_CODE = 98
SCORE_SHORT = 78
SCORE_TEXT = 92
SCORE_UNKNOWN_FIELD = 90
READINESS_LABELS = {"ready": "Ready for SAP", "review": "Needs Review", "error": "Not Ready"}


def band(score: Column) -> Column:
    return (
        F.when(score >= HIGH_MIN, "high").when(score >= REVIEW_MIN, "review").otherwise("verify")
    )


def readiness_status(score: Column) -> Column:
    return (
        F.when(score >= HIGH_MIN, "ready").when(score >= REVIEW_MIN, "review").otherwise("error")
    )


def readiness_label(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, label in READINESS_LABELS.items():
        out = F.when(status == key, label).otherwise(out)
    return out


def heuristic_score(value: Column, json_type: Column) -> Column:
    """Score by value shape; ``json_type`` tells ``"1234"`` from ``1234``."""
    typed = _typed_score(value, json_type)
    return typed.otherwise(let(strip(value), _text_score))


def heuristic_of(value: Column, json_type: Column, stripped: Column) -> Column:
    """``heuristic_score`` of a value whose trimmed text is at hand."""
    return _typed_score(value, json_type).otherwise(_text_score(stripped))


def _typed_score(value: Column, json_type: Column) -> Column:
    number = F.when(value.try_cast("double") == 0, SCORE_ZERO).otherwise(SCORE_NUMBER)
    return (
        F.when(value.isNull() | (value == "") | (json_type == "null"), SCORE_EMPTY)
        .when(json_type == "bool", SCORE_BOOL)
        .when(json_type == "number", number)
    )


def _text_score(t: Column) -> Column:
    upper = F.upper(t)
    # The two identifier shapes have fixed lengths, so most text skips their patterns.
    tax_id = (F.length(t) == 15) & upper.rlike(TAX_ID)
    account_id = (F.length(t) == 10) & upper.rlike(ACCOUNT_ID)
    # The other two begin with a digit, which a comparison tells without a pattern.
    digit = (t >= "0") & (t < ":")
    date = digit & F.length(t).between(8, 10) & t.rlike(DATE_SHAPE)
    goods_code = digit & F.length(t).between(4, 8) & t.rlike(GOODS_CODE)
    return (
        F.when(t == "", SCORE_EMPTY)
        .when(tax_id | account_id, SCORE_ID)
        .when(date, SCORE_DATE)
        .when(goods_code, SCORE_GOODS_CODE)
        .when(F.length(t) <= 2, SCORE_SHORT)
        .otherwise(SCORE_TEXT)
    )


def reported_score(reported: Column) -> Column:
    """A model's own score clamped to 0..100; NULL when it is not a finite number.

    The NULL test comes first because ``greatest`` and ``least`` skip NULLs.
    """

    def clamp(d: Column) -> Column:
        return F.when(
            d.isNotNull() & (F.abs(d) < F.lit(float("inf"))),  # NaN is above infinity
            round_int(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(d)))),
        )

    return F.when(reported.isNotNull(), let(to_double(reported), clamp))


def field_score(value: Column, json_type: Column, reported: Column | None) -> Column:
    shape = heuristic_score(value, json_type)
    return shape if reported is None else F.coalesce(reported_score(reported), shape)


def is_present(value: Column, json_type: Column) -> Column:
    """NULL, blank text and empty containers are absent; 0 and false are present."""
    return is_present_of(value, json_type, strip(value))


def is_present_of(value: Column, json_type: Column, stripped: Column) -> Column:
    """``is_present`` of a value whose trimmed text is at hand."""
    return ~(
        value.isNull()
        | (json_type == "null")
        | ((json_type == "string") & (stripped == ""))
        | ((json_type == "array") & (value == "[]"))
        | ((json_type == "object") & (value == "{}"))
    )
