"""Number columns: lenient parsing and rounding that matches IEEE doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_double(c: Column) -> Column:
    """Strict decimal or scientific text to double, else NULL.

    ``try_cast`` alone would also take ``1d``, ``1f``, ``NaN`` and ``Infinity``.
    """
    return let(
        strip(c.cast("string")), lambda t: F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double"))
    )


def coerce_number(text: Column, json_type: Column | None = None) -> Column:
    """Formatted number (``"₹1,234.50"``) to double; booleans are not numbers."""
    parsed = let(
        F.regexp_replace(text, r"[^0-9.\-]", ""),
        lambda t: F.when(~t.isin("", "-", ".", "-."), t.try_cast("double")),
    )
    if json_type is None:
        return parsed
    return (
        F.when(json_type == "bool", F.lit(None).cast("double"))
        .when(json_type == "number", text.try_cast("double"))
        .otherwise(parsed)
    )


def lenient_number(text: Column) -> Column:
    """Number after dropping only thousands commas and percent signs."""
    return to_double(F.translate(text, ",%", ""))


def round_places(x: Column, places: int) -> Column:
    """Round a double to ``places`` by its exact binary value, ties to even.

    ``round`` and ``bround`` work on the shortest decimal text instead, so they
    give 2.68 for 2.675, whose stored value is below the tie.
    """
    pattern = "0." + "0" * places
    return F.call_function("format_number", x.cast("double"), F.lit(pattern)).cast("double")


def round_int(x: Column) -> Column:
    """Nearest integer, ties to even."""
    return F.rint(x).cast("int")


def optional_int(text: Column) -> Column:
    """Blank or unreadable text gives NULL, else the nearest integer."""
    return round_int(to_double(text))


def money(c: Column) -> Column:
    """Order-free exact money: DECIMAL(18,4)."""
    return c.cast("decimal(18,4)")


def exact_total(numbers: Column) -> Column:
    """Sum of an array of doubles that does not depend on order; NULL if one of them is.

    Each is added as a decimal of the first scale that holds all its digits, only those no
    decimal holds as doubles.
    """
    kinds = {f"d{places}": f"decimal(38,{places})" for places in (6, 17, 28)}
    zero = F.struct(*[F.lit(0).cast(k).alias(n) for n, k in kinds.items()], F.lit(0.0).alias("rest"))

    def add(acc: Column, x: Column) -> Column:
        def by(parts: Column) -> Column:
            sums, held = [], F.lit(False)
            for n, kind in kinds.items():
                here = F.coalesce(parts[n].cast("double") == x, F.lit(False)) & ~held
                sums.append(F.when(here, F.try_add(acc[n], parts[n]).cast(kind)).otherwise(acc[n]).alias(n))
                held = held | here
            return F.struct(*sums, F.when(held, acc.rest).otherwise(acc.rest + x).alias("rest"))

        return let(F.struct(*[x.try_cast(k).alias(n) for n, k in kinds.items()]), by)

    total = F.aggregate(numbers, zero, add)
    return let(total, lambda s: s.d28.cast("double") + s.d17.cast("double") + s.d6.cast("double") + s.rest)


def general_format(x: Column) -> Column:
    """Six significant digits without trailing zeros (C's ``%g``)."""
    sci = F.call_function("format_number", x, F.lit("0.#####E0"))
    six = sci.try_cast("double")
    fixed = F.regexp_replace(six.cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
    power = F.substring_index(sci, "E", -1).try_cast("int")
    short_sci = F.concat(
        F.substring_index(sci, "E", 1),
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    size = F.abs(six)
    return (
        F.when(x == 0, F.lit("0"))
        .when((size >= 1e-4) & (size < 1e6), fixed)
        .otherwise(short_sci)
    )


def format_currency(value: Column, currency: Column) -> Column:
    """``INR 1,234.50``; an em dash when the value is not numeric."""
    number = F.format_number(to_double(value), 2)
    prefix = F.when(F.coalesce(currency, F.lit("")) == "", "").otherwise(
        F.concat(currency, F.lit(" "))
    )
    return F.coalesce(F.concat(prefix, number), F.lit("—"))


def edit_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def edit_number(value: Column) -> Column:
    return F.coalesce(to_double(value), F.lit(0.0))
