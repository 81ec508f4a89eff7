"""Text columns: trimming, slugs, labels and display formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The characters that count as white space at the ends of a value.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# File suffix -> MIME type. ".tif" is accepted as well as ".tiff".
MIME_TYPES = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
}

# Fixed value: the slug of a name that has no usable character.
EMPTY_SLUG = "purchase_order"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Lambda bodies are interpreted, so an expression used in one would be evaluated
    for every element and every mention; a lambda variable is not. (A column of an
    earlier projection does not help: the optimizer may put it back in place.) The value is the
    start of an empty fold and ``body`` its finish: ``transform`` would copy all of the result,
    once for every ``let`` around it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _none: held, body)


def strip(c: Column) -> Column:
    """Trim all Unicode white space (Spark's ``trim`` strips only blanks)."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_long(c: Column) -> Column:
    """``strip`` of long text: trimming looks at every character, so both ends are asked first."""
    last = reduce(lambda a, b: a | b, [c.endswith(x) for x in "}`]."])
    return F.when((c > " ") & (c < "\x7f") & ~c.startswith(" ") & last, c).otherwise(strip(c))


def is_blank(c: Column) -> Column:
    """True for NULL and for text that is empty once trimmed."""
    return F.coalesce(strip(c) == "", F.lit(True))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(filename: Column) -> Column:
    """Lower-cased last suffix with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(base_name(filename), r"(?s)^.+(\.[^.]+)$", 1))


def stem(filename: Column) -> Column:
    return F.regexp_replace(base_name(filename), r"(?s)^(.+)\.[^.]+$", "$1")


def mime_type(filename: Column) -> Column:
    """MIME type by suffix, NULL for a file that is not supported."""
    sfx = suffix(filename)
    out = F.lit(None).cast("string")
    for key, mime in MIME_TYPES.items():
        out = F.when(sfx == key, mime).otherwise(out)
    return out


def label_slug(label: Column) -> Column:
    """File-safe form of a label; dots are not taken for a suffix."""
    slug = F.btrim(F.regexp_replace(label, r"[^\p{L}\p{N}_\-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(EMPTY_SLUG))


def file_slug(filename: Column) -> Column:
    return label_slug(stem(filename))


def output_name(filename: Column, name_suffix: Column, extension: str) -> Column:
    return F.concat(file_slug(filename), F.lit("_"), name_suffix, F.lit(extension))


def key_slug(value: Column) -> Column:
    """Snake-case key of a free name."""
    lowered = F.lower(strip(F.coalesce(value, F.lit(""))))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def header_key(header: Column) -> Column:
    """Header text reduced to a-z and 0-9, for tolerant matching."""
    return F.regexp_replace(F.lower(F.coalesce(header, F.lit(""))), "[^a-z0-9]", "")


def title_from_key(key: Column) -> Column:
    """Key as a title: every run of letters begins with a capital, digits and marks split runs."""
    runs = F.regexp_extract_all(F.replace(key, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def duration_text(seconds: Column) -> Column:
    """``12s`` below a minute, else ``1m 05s``."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.rint(s).cast("bigint")
    return F.when(s < 60, F.concat(whole.cast("string"), F.lit("s"))).otherwise(
        F.format_string("%dm %02ds", F.expr("0L") + F.floor(whole / 60), whole % 60)
    )
