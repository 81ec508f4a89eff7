"""Where values lie in page text or in a model's boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locate
from ..plans import bindings as b
from .registry import query

# Values to look for: the first word of the last line, the source and the language.
_VALUES = """
tx AS (SELECT doc_id, lower(text) AS low, string_split(lower(text), chr(10)) AS pages, string_split(text, chr(10)) AS raw, lang, source FROM documents),
vals AS (SELECT doc_id, low, pages, 'last_word' AS path, split_part(trim(raw[-1]), ' ', 1) AS value FROM tx
  UNION ALL SELECT doc_id, low, pages, 'lang', lang FROM tx UNION ALL SELECT doc_id, low, pages, 'source', source FROM tx),
hit AS (SELECT doc_id, path, value, pages, list_position(list_transform(pages, lambda p: contains(p, lower(value))), TRUE) AS spot
  FROM vals WHERE length(value) >= 2)
"""


def _fields(spark, sf):
    pages = b.pages_of(F.col("text"))
    last = F.get(F.split(F.trim(F.element_at(pages, -1)), " "), 0)
    value = lambda p, v: F.struct(F.lit(p).alias("path"), v.alias("value"))
    return b.table(spark, sf, "documents").select(
        "doc_id", pages.alias("pages"),
        F.array(
            value("last_word", last), value("lang", F.col("lang")), value("source", F.col("source"))
        ).alias("fields"),
    )


def _located(spark, sf):
    """Fields with their hit, found inside each document's row."""
    found = F.transform(
        "fields",
        lambda f: F.struct(
            f.path.alias("path"),
            f.value.alias("value"),
            locate.locate(F.col("pages"), f.value, F.lit("string")).alias("hit"),
        ),
    )
    return _fields(spark, sf).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


@query("locate_terms", f"""
WITH {_VALUES}, g AS (SELECT *, pages[spot] AS page, lower(value) AS term, strpos(pages[spot], lower(value)) AS p1 FROM hit WHERE spot > 0),
g2 AS (SELECT *, CASE WHEN strpos(page[p1 + length(term):], term) > 0 THEN p1 + length(term) - 1 + strpos(page[p1 + length(term):], term) END AS p2 FROM g),
g3 AS (SELECT *, CASE WHEN p2 IS NOT NULL AND strpos(page[p2 + length(term):], term) > 0 THEN p2 + length(term) - 1 + strpos(page[p2 + length(term):], term) END AS p3 FROM g2)
SELECT doc_id, path, value AS term, CAST(spot - 1 AS INT) AS page, concat_ws(',', p1, p2, p3) AS positions FROM g3
""")
def locate_terms(spark, sf):
    return _located(spark, sf).where("hit IS NOT NULL").select(
        "doc_id", "path", "hit.term", "hit.page", F.array_join("hit.positions", ",").alias("positions")
    )


@query("unlocated_fields", f"""
WITH {_VALUES} SELECT doc_id, path, value FROM hit WHERE coalesce(spot, 0) = 0
""")
def unlocated_fields(spark, sf):
    """Fields that have a value but no place in the text."""
    return _located(spark, sf).where("hit IS NULL AND length(value) >= 2").select(
        "doc_id", "path", "value"
    )


_BOXES = """
bx AS (SELECT event_id AS doc_id, event_type AS path, CAST(user_id % 4 AS INT) AS page, value / 100 AS a, value / 50 AS c, (user_id % 10) / 10.0::DOUBLE AS e FROM events),
un AS (SELECT *, [c, e, a, 0.5::DOUBLE] AS box FROM bx WHERE path <> 'error' AND page >= 1),
sp AS (SELECT *, list_max(box) AS span FROM un),
ft AS (SELECT *, list_transform(box, lambda z: least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN span > 1.5 THEN z / span ELSE z END))) AS f FROM sp)
"""
_PIXELS = """SELECT doc_id, path, page - 1 AS page, least(f[1], f[3]) * (600 + doc_id % 3) AS x0, least(f[2], f[4]) * 800 AS y0,
  greatest(f[1], f[3]) * (600 + doc_id % 3) AS x1, greatest(f[2], f[4]) * 800 AS y1 FROM ft WHERE page <= 2"""


def _boxes(spark, sf):
    x = F.col("value")
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("path"),
        (F.col("user_id") % 4).cast("int").alias("page"),
        F.array(x / 50, (F.col("user_id") % 10) / 10.0, x / 100, F.lit(0.5)).alias("box"),
    )


def _page_sizes(spark, sf):
    """Two pages per document; a box on a third page has no size and is dropped."""
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("page"),
        (F.col("event_id") % 3 + 600).alias("width_px"),
        F.lit(800).alias("height_px"),
    )


@query("boxes_normalized", f"WITH {_BOXES} {_PIXELS}")
def boxes_normalized(spark, sf):
    return locate.normalized_boxes(_boxes(spark, sf), _page_sizes(spark, sf))


@query("boxes_merge", f"""
WITH {_BOXES}, ai AS ({_PIXELS}),
tx AS (SELECT event_id AS doc_id, 'click' AS path, 0 AS page, 1.0::DOUBLE AS x0, 2.0::DOUBLE AS y0, value AS x1, value AS y1 FROM events)
SELECT coalesce(ai.doc_id, tx.doc_id) AS doc_id, coalesce(ai.path, tx.path) AS path, CASE WHEN ai.doc_id IS NULL THEN 'text' ELSE 'model' END AS origin,
  CASE WHEN ai.doc_id IS NULL THEN tx.page ELSE ai.page END AS page, CASE WHEN ai.doc_id IS NULL THEN tx.x0 ELSE ai.x0 END AS x0,
  CASE WHEN ai.doc_id IS NULL THEN tx.y0 ELSE ai.y0 END AS y0, CASE WHEN ai.doc_id IS NULL THEN tx.x1 ELSE ai.x1 END AS x1,
  CASE WHEN ai.doc_id IS NULL THEN tx.y1 ELSE ai.y1 END AS y1
FROM ai FULL JOIN tx ON ai.doc_id = tx.doc_id AND ai.path = tx.path
""")
def boxes_merge(spark, sf):
    text = b.table(spark, sf, "events").select(
        F.col("event_id").alias("doc_id"), F.lit("click").alias("path"), F.lit(0).alias("page"),
        F.lit(1.0).alias("x0"), F.lit(2.0).alias("y0"), F.col("value").alias("x1"), F.col("value").alias("y1"),
    )
    return locate.merge_boxes(text, boxes_normalized(spark, sf))
