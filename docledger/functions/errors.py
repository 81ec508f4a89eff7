"""Error log columns: permanent or worth another try."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Status codes and message markers of permanent failures.
RETRYABLE_CODES = [429, 500, 502, 503, 504]
FATAL_CODES = [400, 401, 403, 404, 422]
FATAL_MARKERS = [
    "api key not valid", "api_key_invalid", "invalid api key", "invalid_api_key",
    "permission denied", "permission_denied", "unauthenticated", "invalid argument",
    "invalid_argument", "invalid request", "failed_precondition", "not found", "not_found",
    "is not found", "is not supported", "unsupported", "unknown model", "prompt", "safety",
    "blocked", "recitation",
]


def error_verdict(code: Column, message: Column) -> Column:
    """``fatal`` or ``retryable``: a known code decides, then a fatal marker.

    Every failure that is not fatal is tried again, so the markers of transient
    failures cannot change the verdict and are not needed.
    """
    text = F.lower(F.coalesce(message, F.lit("")))
    fatal_text = F.exists(F.array(*[F.lit(m) for m in FATAL_MARKERS]), lambda m: F.contains(text, m))
    return (
        F.when(code.isin(FATAL_CODES), "fatal")
        .when(code.isin(RETRYABLE_CODES), "retryable")
        .when(fatal_text, "fatal")
        .otherwise("retryable")
    )
