"""Where field values lie: in page text, or in a model's boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import general_format
from ..functions.text import let, strip
from .joins import lookup_join

# Shortest term, hits kept on the first page that has any, page cap,
# characters of embedded text that make a file "digital", and the box span limit.
MIN_TERM = 2
MAX_HITS = 3
MAX_PAGES = 15
TEXT_LAYER_CHARS = 40
BOX_SPAN = 1.5


def search_terms(value: Column, json_type: Column) -> Column:
    """Distinct terms of a value, most specific first."""
    text = strip(value)
    first_line = strip(F.get(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), 0))
    number = value.try_cast("double")
    is_int = value.rlike(r"^-?\d+$")
    whole = number == F.rint(number)  # floor would stop at the largest long
    number_terms = F.when(is_int, F.array(value)).otherwise(
        F.array(
            F.when(whole, number.try_cast("decimal(38,0)").cast("string")), general_format(number)
        )
    )
    terms = (
        F.when(json_type == "number", number_terms)
        .when(json_type == "string", F.array(text, first_line))
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= MIN_TERM))


def _positions(page: Column, term: Column) -> Column:
    """Up to three places of a term on a page (1-based, not overlapping)."""


    def following(found: Column, left: int) -> Column:
        if left == 0:
            return found
        last = F.element_at(found, -1)
        again = F.call_function("locate", term, page, last + F.length(term))
        more = F.when(last > 0, F.concat(found, F.array(again))).otherwise(found)
        return let(more, lambda f: following(f, left - 1))

    first = F.array(F.call_function("locate", term, page, F.lit(1)))
    return F.filter(let(first, lambda f: following(f, MAX_HITS - 1)), lambda p: p > 0)


def locate(pages: Column, value: Column, json_type: Column) -> Column:
    """``struct<term, page, positions>`` of the first term found, on its first page.

    Works inside the document row on its page texts, ignoring case: the text is not
    exploded and not shuffled. NULL when no term is found.
    """

    def in_pages(low: Column) -> Column:
        def hit(term: Column) -> Column:
            needle = F.lower(term)
            first = F.array_position(F.transform(low, lambda p: F.contains(p, needle)), F.lit(True))
            return let(
                first,
                lambda n: F.struct(
                    term.alias("term"),
                    F.when(n > 0, n - 1).cast("int").alias("page"),
                    F.when(n > 0, _positions(F.get(low, n - 1), needle)).alias("positions"),
                ),
            )

        hits = F.transform(search_terms(value, json_type), hit)
        return F.get(F.filter(hits, lambda h: h.page.isNotNull()), 0)

    return let(F.transform(pages, F.lower), in_pages)


def text_layer(pages: Column) -> Column:
    """``digital`` when the trimmed page texts hold at least 40 characters, else ``scanned``."""
    chars = F.aggregate(
        F.transform(pages, lambda p: F.length(strip(p))), F.lit(0), lambda acc, n: acc + n
    )
    return let(
        chars,
        lambda n: F.struct(
            n.alias("chars"),
            F.when(n >= TEXT_LAYER_CHARS, "digital").otherwise("scanned").alias("layer"),
        ),
    )


def first_pages(pages: Column, scanned: Column) -> Column:
    """Pages sent to a model: the first 15 of a scanned file, all of a digital one."""
    return F.when(scanned, F.slice(pages, 1, MAX_PAGES)).otherwise(pages)


def normalized_boxes(boxes: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Model boxes in page units.

    ``boxes(doc_id, path, page, box)`` with 1-based pages and four numbers;
    ``page_sizes(doc_id, page, width_px, height_px)``. A box beyond 0..1 is divided
    by its largest number, then clamped and its corners put in order. Rows with a
    missing path, page or number are dropped, as are pages below 1.
    """
    usable = boxes.where(
        (F.coalesce("path", F.lit("")) != "")
        & (F.size("box") == 4)
        & ~F.exists("box", lambda c: c.isNull())
        & (F.col("page") >= 1)
    )
    sized = lookup_join(
        usable, page_sizes, ["doc_id", "page"], "inner", measure_dim=False, probe=False
    )
    top = F.array_max("box")
    span = F.when(top == 0, 1.0).otherwise(top)
    fit = let(
        span,
        lambda s: F.transform(
            "box",
            lambda c: F.greatest(
                F.lit(0.0), F.least(F.lit(1.0), F.when(s > BOX_SPAN, c / s).otherwise(c))
            ),
        ),
    )
    f = [F.get("fit", i) for i in range(4)]
    return sized.withColumn("fit", fit).select(
        "doc_id", "path", (F.col("page") - 1).alias("page"),
        (F.least(f[0], f[2]) * F.col("width_px")).alias("x0"),
        (F.least(f[1], f[3]) * F.col("height_px")).alias("y0"),
        (F.greatest(f[0], f[2]) * F.col("width_px")).alias("x1"),
        (F.greatest(f[1], f[3]) * F.col("height_px")).alias("y1"),
    )


def merge_boxes(located: DataFrame, from_model: DataFrame) -> DataFrame:
    """Boxes by (doc_id, path); the model's answer replaces a text hit."""
    keys = ["doc_id", "path"]
    a = located.select(*keys, F.struct("page", "x0", "y0", "x1", "y1").alias("text_box"))
    b = from_model.select(*keys, F.struct("page", "x0", "y0", "x1", "y1").alias("model_box"))
    merged = a.join(b, keys, "full")
    return merged.select(
        *keys,
        F.coalesce("model_box", "text_box").alias("box"),
        F.when(F.col("model_box").isNotNull(), "model").otherwise("text").alias("origin"),
    ).select(*keys, "origin", "box.*")
