"""Token usage and cost columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import money, round_places

# Default rates per thousand tokens and the prediction constants.
INPUT_RATE = 0.03
OUTPUT_RATE = 0.12
PREDICT_BASE_INPUT = 2000
PREDICT_INPUT_PER_PAGE = 1200
PREDICT_OUTPUT = 900


def resolve_rate(conf: dict[str, str], names: tuple[str, ...], default: float) -> float:
    """First setting among ``names`` that reads as a number, else ``default``."""
    for name in names:
        text = (conf.get(name) or "").strip()
        try:
            return float(text)
        except ValueError:
            continue
    return default


def cost(
    input_tokens: Column,
    output_tokens: Column,
    input_rate: float = INPUT_RATE,
    output_rate: float = OUTPUT_RATE,
) -> Column:
    """Cost of a request to four places, as DECIMAL(18,4) so that sums are order-free."""
    raw = (input_tokens / F.lit(1000.0)) * F.lit(input_rate) + (
        output_tokens / F.lit(1000.0)
    ) * F.lit(output_rate)
    return money(round_places(raw, 4))


def total_or_sum(total: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """The reported total, or input plus output when it is missing or zero."""
    given = F.coalesce(total, F.lit(0).cast("bigint"))
    return F.when(given != 0, given).otherwise(input_tokens + output_tokens)


def response_usage(raw: Column) -> Column:
    """Token counts of a response body in either provider's shape."""
    body = F.from_json(
        raw,
        "usage STRUCT<prompt_tokens BIGINT, completion_tokens BIGINT, total_tokens BIGINT>, "
        "usage_metadata STRUCT<prompt_token_count BIGINT, candidates_token_count BIGINT, "
        "total_token_count BIGINT>",
    )
    zero = F.lit(0).cast("bigint")
    inp = F.coalesce(body.usage.prompt_tokens, body.usage_metadata.prompt_token_count, zero)
    out = F.coalesce(body.usage.completion_tokens, body.usage_metadata.candidates_token_count, zero)
    tot = F.coalesce(body.usage.total_tokens, body.usage_metadata.total_token_count)
    return F.struct(
        inp.alias("input_tokens"),
        out.alias("output_tokens"),
        total_or_sum(tot, inp, out).alias("total_tokens"),
    )


def predicted_input(pages: Column) -> Column:
    return F.lit(PREDICT_BASE_INPUT) + F.greatest(pages, F.lit(1)) * PREDICT_INPUT_PER_PAGE
