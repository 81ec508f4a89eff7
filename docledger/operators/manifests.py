"""Tables of manifests: parsing with defaults, field catalogs, order and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import jsondoc
from ..functions.numbers import optional_int
from ..functions.text import let, strip, title_from_key
from ..sources.specs import (
    CRITICAL_MARKERS, DEFAULT_DEPARTMENT_ORDER, DEFAULT_STATUS, KINDS, STATUSES,
)

FIELD = "STRUCT<path STRING, label STRING, kind STRING, required BOOLEAN>"
MANIFEST_SCHEMA = (
    "key STRING, document_type STRING, business_process STRING, status STRING, "
    "accuracy STRING, json_suffix STRING, prompt_version STRING, "
    "department STRUCT<key STRING, name STRING, `order` STRING>, keywords ARRAY<STRING>, "
    f"ai_description STRING, sections ARRAY<STRUCT<title STRING, fields ARRAY<{FIELD}>>>, "
    "line_items STRUCT<path STRING, columns ARRAY<STRUCT<key STRING, label STRING, kind STRING>>>, "
    f"sap STRUCT<required ARRAY<{FIELD}>>, "
    "export STRUCT<template STRING, sheet STRING, header_row INT, start_row INT, "
    "columns ARRAY<STRUCT<header STRING, path STRING, agg STRING>>>"
)

# The next lifecycle status, up and down.
PROMOTE = {"draft": "testing", "testing": "production"}
DEMOTE = {"production": "testing", "testing": "draft"}

# Schema keys that never become a section.
SKIPPED_KEYS = [
    "metadata", "remarks", "additional_information", "missing_fields", "warnings", "errors",
    "validation",
]


def _empty(c: Column, data_type: str) -> Column:
    return F.coalesce(c, F.array().cast(data_type))


def parse_manifests(texts: DataFrame) -> DataFrame:
    """Manifests of ``(raw)`` rows with every default; invalid ones are dropped.

    Invalid: not a JSON object, no key, a field without a path, an unknown kind.
    """
    m = F.from_json("raw", MANIFEST_SCHEMA)
    is_object = F.try_parse_json("raw").isNotNull() & strip(F.col("raw")).startswith("{")
    # the filter below stays above a generator; below a projection it would parse once a mention
    parsed = texts.where(is_object).select("*", F.explode(F.array(m)).alias("m"))

    def with_defaults(f: Column, name: Column, required: Column) -> Column:
        return F.struct(
            name.alias("path"),
            F.coalesce(f.label, name).alias("label"),
            F.coalesce(f.kind, F.lit("text")).alias("kind"),
            required.alias("required"),
        )

    no = F.lit(False)
    sections = F.transform(
        _empty(F.col("m.sections"), f"array<struct<title:string,fields:array<struct<path:string,label:string,kind:string,required:boolean>>>>"),
        lambda s: F.struct(
            F.coalesce(s.title, F.lit("")).alias("title"),
            F.transform(
                F.coalesce(s.fields, F.array().cast("array<struct<path:string,label:string,kind:string,required:boolean>>")),
                lambda f: with_defaults(f, f.path, F.coalesce(f.required, no)),
            ).alias("fields"),
        ),
    )
    items = F.transform(
        F.col("m.line_items.columns"), lambda c: with_defaults(c, c.key, no)
    )
    critical = F.transform(
        F.filter("m.sap.required", lambda f: F.coalesce(f.path, F.lit("")) != ""),
        lambda f: with_defaults(f, f.path, F.lit(True)),
    )
    exports = F.transform(
        F.col("m.export.columns"),
        lambda c: F.struct(
            F.coalesce(c.header, c.path).alias("header"),
            c.path.alias("path"),
            F.coalesce(c.agg, F.lit("first")).alias("agg"),
        ),
    )
    key = strip(F.col("m.key"))
    lower_keywords = F.transform(F.coalesce("m.keywords", F.array().cast("array<string>")), F.lower)
    typed = "array<struct<path:string,label:string,kind:string,required:boolean>>"
    out = parsed.select(
        key.alias("key"),
        F.coalesce("m.document_type", title_from_key(key)).alias("document_type"),
        F.coalesce("m.business_process", "m.document_type", F.lit("")).alias("business_process"),
        F.when(F.col("m.status").isin(STATUSES), F.col("m.status"))
        .otherwise(DEFAULT_STATUS)
        .alias("status"),
        optional_int(F.col("m.accuracy")).alias("accuracy"),
        F.coalesce("m.json_suffix", key).alias("json_suffix"),
        F.coalesce("m.prompt_version", F.lit("v1")).alias("prompt_version"),
        F.coalesce("m.department.key", F.lit("")).alias("department"),
        F.coalesce("m.department.name", F.lit("")).alias("department_name"),
        F.coalesce(strip(F.col("m.department.order")).try_cast("int"), F.lit(DEFAULT_DEPARTMENT_ORDER)).alias("department_order"),
        lower_keywords.alias("keywords"),
        F.coalesce("m.ai_description", F.lit("")).alias("ai_description"),
        sections.alias("sections"),
        F.col("m.line_items.path").alias("items_path"),
        _empty(items, typed).alias("item_columns"),
        _empty(critical, typed).alias("declared_critical"),
        _empty(exports, "array<struct<header:string,path:string,agg:string>>").alias("exports"),
    )
    every = F.concat(F.flatten(F.transform("sections", lambda s: s.fields)), "item_columns", "declared_critical")
    bad = F.exists(every, lambda f: f.path.isNull() | ~f.kind.isin(KINDS)) | F.exists(
        "exports", lambda c: c.path.isNull()
    )
    return out.where((F.coalesce("key", F.lit("")) != "") & ~bad)


def field_catalog(manifests: DataFrame) -> DataFrame:
    """Every declared entry as a row: fields, line items, exports, critical fields.

    Exploded inside the manifest's row; positions keep the declared order.
    """
    section_fields = F.flatten(
        F.transform(
            "sections",
            lambda s, i: F.transform(
                s.fields,
                lambda f, j: F.struct(
                    F.lit("field").alias("part"), i.alias("outer"), j.alias("inner"),
                    s.title.alias("title"), f.path.alias("path"), f.label.alias("label"),
                    f.kind.alias("kind"), f.required.alias("required"),
                ),
            ),
        )
    )

    def plain(column: str, part: str) -> Column:
        return F.transform(
            column,
            lambda f, j: F.struct(
                F.lit(part).alias("part"), F.lit(0).alias("outer"), j.alias("inner"),
                F.lit("").alias("title"), f.path.alias("path"), f.label.alias("label"),
                f.kind.alias("kind"), f.required.alias("required"),
            ),
        )

    exports = F.transform(
        "exports",
        lambda c, j: F.struct(
            F.lit("export").alias("part"), F.lit(0).alias("outer"), j.alias("inner"),
            F.lit("").alias("title"), c.path.alias("path"), c.header.alias("label"),
            c.agg.alias("kind"), F.lit(False).alias("required"),
        ),
    )
    rows = F.concat(
        section_fields, plain("item_columns", "item"), exports,
        plain("declared_critical", "critical"),
    )
    return manifests.select("key", F.explode(rows).alias("r")).select("key", "r.*")


def critical_fields(manifests: DataFrame) -> DataFrame:
    """Fields that decide readiness: the first tier of a type that is not empty.

    Declared, else required, else marked by a critical word, else all.
    """
    fields = F.flatten(F.transform("sections", lambda s: s.fields))
    markers = F.array(*[F.lit(m) for m in CRITICAL_MARKERS])
    required = F.filter(fields, lambda f: f.required)
    marked = F.filter(
        fields,
        lambda f: F.exists(
            markers, lambda m: F.contains(F.lower(f.path), m) | F.contains(F.lower(f.label), m)
        ),
    )
    tiers = F.array(F.col("declared_critical"), required, marked, fields)
    tier = F.array_position(F.transform(tiers, lambda t: F.size(t) > 0), F.lit(True))
    chosen = F.when(tier > 0, F.element_at(tiers, F.greatest(tier, F.lit(1)).cast("int")))
    return manifests.select("key", tier.cast("int").alias("tier"), F.posexplode(chosen).alias("pos", "f")).select(
        "key", "tier", "pos", "f.path", "f.label", "f.kind"
    )


def catalog_order(types: DataFrame) -> DataFrame:
    """Department order, then label without case (a sort of catalog rows)."""
    return types.orderBy("department_order", F.lower("business_process"), "key")


def default_pick(types: DataFrame, by: str = "department") -> DataFrame:
    """First live type of a department by label, else its first type."""
    rank = F.struct(
        (F.col("status") != "production").cast("int"), F.lower("business_process"), F.col("key")
    )
    return types.groupBy(by).agg(F.min_by("key", rank).alias("default_key"))


def can_process(status: Column, developer: bool) -> Column:
    return status.isin("production", "testing", "draft") if developer else status == "production"


def is_visible(status: Column, developer: bool) -> Column:
    return F.lit(True) if developer else status.isin("production", "coming_soon")


def next_status(status: Column, steps: dict[str, str]) -> Column:
    """Status after a promotion or demotion; unchanged when there is no next step."""
    out = status
    for a, b in steps.items():
        out = F.when(status == a, b).otherwise(out)
    return out


def derive_spec(samples: DataFrame, raw: str = "raw") -> DataFrame:
    """Fields and line items a sample JSON document implies, as rows.

    Top-level objects become sections of their scalar members; the first list of
    objects becomes the line items. Key order is that of the text, which VARIANT
    does not keep, so it comes from ``json_object_keys``.
    """
    v = F.try_parse_json(raw)
    top = F.filter(F.json_object_keys(raw), lambda k: ~k.isin(SKIPPED_KEYS))

    def entries(x: Column) -> Column:
        """Members of an object as ``key, t``: its entries are listed once, not searched by name."""
        members = F.map_entries(x.try_cast("map<string,variant>"))
        return F.transform(members, lambda e: F.struct(e.key.alias("key"), jsondoc.json_type(e.value).alias("t")))

    def kind(t: Column) -> Column:
        return F.when(t == "number", "number").otherwise("text")

    def block(k: Column, x: Column) -> Column:
        return let(F.try_variant_get(x, "$[0]", "variant"), lambda first: F.struct(
            k.alias("k"), entries(x).alias("members"), entries(first).alias("first"),
        ))

    blocks = let(
        v.try_cast("map<string,variant>"),
        lambda m: F.transform(top, lambda k: block(k, F.try_element_at(m, k))),
    )
    scalars = F.flatten(
        F.transform(
            F.filter(F.col("blocks"), lambda b: b.members.isNotNull()),
            lambda b: F.transform(
                F.filter(b.members, lambda e: ~e.t.isin("object", "array")),
                lambda e: F.struct(
                    F.lit("field").alias("part"), title_from_key(b.k).alias("section"),
                    F.concat(b.k, F.lit("."), e.key).alias("path"), title_from_key(e.key).alias("label"),
                    kind(e.t).alias("kind"),
                ),
            ),
        )
    )
    first = F.get(F.filter(F.col("blocks"), lambda b: b.first.isNotNull()), 0)
    items = F.transform(
        first.first,
        lambda e: F.struct(
            F.lit("item").alias("part"), first.k.alias("section"), e.key.alias("path"),
            title_from_key(e.key).alias("label"), kind(e.t).alias("kind"),
        ),
    )
    rows = F.concat(
        scalars,
        F.coalesce(items, F.array().cast("array<struct<part:string,section:string,path:string,label:string,kind:string>>")),
    )
    keep = [c for c in samples.columns if c != raw]
    prepared = samples.withColumn("blocks", blocks)
    return prepared.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")
