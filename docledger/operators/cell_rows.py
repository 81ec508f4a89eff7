"""Cells as table rows: the same repairs and scores in generated code.

Where cells are exploded anyway, or are summed per document afterwards, rows beat
arrays: each step is a plain projection of whole-stage code, and the sums combine
map-side, so no document is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import iso_date_of
from ..functions.scores import HIGH_MIN, REVIEW_MIN, heuristic_of, reported_score
from ..functions.text import strip


def explode(documents: DataFrame, keep: list[str] | None = None, cells: str = "cells") -> DataFrame:
    """``doc_id, <keep>, pos, path, kind, v, t, given`` of each cell."""
    keep = keep or []
    return documents.select("doc_id", *keep, F.posexplode(cells).alias("pos", "c")).select(
        "doc_id", *keep, "pos", "c.*"
    )


def repair(rows: DataFrame) -> DataFrame:
    """``v`` and ``t`` repaired by kind; ``old`` is set where the value changed."""
    v, kind = F.col("v"), F.col("kind")
    open_text = (F.col("t") == "string") & v.isNotNull()
    cleaned = rows.withColumn("_s", F.when(open_text & (kind != "number"), strip(v))).withColumn(
        "_n", F.when(open_text & (kind == "number"), F.regexp_replace(v, r"[^0-9.\-]", ""))
    )
    number = F.when(~F.col("_n").isin("", "-", ".", "-."), F.col("_n").try_cast("double"))
    fixed = cleaned.withColumn(
        "_new",
        F.when(kind == "number", number.cast("string"))
        .when(kind == "date", iso_date_of(F.col("_s")))
        .when(kind.isin("text", "long_text"), F.col("_s")),
    )
    new = F.col("_new")
    changed = new.isNotNull() & ((kind == "number") | (new != v))
    return (
        fixed.withColumn("old", F.when(changed, v))
        .withColumn("t", F.when(changed & (kind == "number"), "number").otherwise(F.col("t")))
        .withColumn("v", F.when(changed, new).otherwise(v))
        .drop("_s", "_n", "_new")
    )


def score(rows: DataFrame, reported: Column | None = None) -> DataFrame:
    """Rows with a ``score``; a model's own usable score wins over the heuristic."""
    shaped = rows.withColumn("_s", strip(F.col("v")))
    shape = heuristic_of(F.col("v"), F.col("t"), F.col("_s"))
    own = shape if reported is None else F.coalesce(reported_score(reported), shape)
    return shaped.withColumn("score", own).drop("_s")


def summaries() -> list[Column]:
    """Additive aggregates of scored rows, named like ``confidence.SUMMARY_FIELDS``."""
    s = F.col("score")
    return [
        F.count_if(s > 0).alias("scored"),
        F.coalesce(F.sum(s.cast("bigint")), F.lit(0)).alias("score_sum"),
        F.count_if(s >= HIGH_MIN).alias("high"),
        F.count_if((s >= REVIEW_MIN) & (s < HIGH_MIN)).alias("review"),
        F.count_if(s < REVIEW_MIN).alias("verify"),
    ]
