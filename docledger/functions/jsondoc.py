"""JSON documents held as VARIANT: parsing, path access and flattening."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .text import let, strip_long

CONFIDENCE_KEY = "_confidence"

_FENCE = "```"


def json_path(dotted: str) -> str:
    """JSON path of a dotted path; names that are not plain are quoted."""
    out = "$"
    for part in dotted.split("."):
        out += f".{part}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", part) else f"['{part}']"
    return out


def parse_response(raw: Column) -> Column:
    """Model text to a JSON object.

    Trims, strips a code fence, parses; failing that, parses from the first ``{``
    to the last ``}``. Anything that is not an object is an error, not a row drop.
    Gives ``struct<data, error, text>``; ``text`` is what was parsed.
    """
    return let(strip_long(raw), _parse_stripped)


def _parse_stripped(text: Column) -> Column:
    start = F.when(text.startswith(_FENCE + "json"), 7).otherwise(3)
    fenced = text.startswith(_FENCE) & text.endswith(_FENCE) & (F.length(text) >= 6)
    cleaned = F.when(fenced, strip_long(F.substring(text, start + 1, F.length(text) - start - 3))).otherwise(text)

    def parsed(t: Column) -> Column:
        return F.struct(F.try_parse_json(t).alias("data"), t.alias("text"))

    def parse(t: Column) -> Column:
        start = F.instr(t, "{")
        end = F.length(t) - F.length(F.substring_index(t, "}", -1))
        braces = F.when(
            (start > 0) & (end > start) & (end <= F.length(t)), F.substring(t, start, end - start + 1)
        )
        # no JSON text begins like a sentence, and a parser that fails is slow
        whole = F.when(~t.rlike("^[A-HJ-MO-Z]"), parsed(t))
        return let(whole, lambda w: F.when(w.data.isNotNull(), w).otherwise(parsed(braces)))

    def result(found: Column) -> Column:
        # the text is trimmed, so its first character tells; a schema would walk the whole document
        is_object = F.coalesce(found.data.isNotNull() & found.text.startswith("{"), F.lit(False))
        error = (
            F.when(F.coalesce(text, F.lit("")) == "", "empty output")
            .when(found.data.isNull(), "no JSON object found")
            .when(~is_object, "not a JSON object")
        )
        return F.struct(
            F.when(is_object, found.data).alias("data"), error.alias("error"),
            F.when(is_object, found.text).alias("text"),
        )

    return let(let(cleaned, parse), result)


def type_name(s: Column) -> Column:
    """``object array string number bool null`` of what ``schema_of_variant`` says; NULL for NULL."""
    return (
        F.when(s == "STRING", "string")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "BOOLEAN", "bool")
        .when(s == "VOID", "null")
        .when(s.isNotNull(), "number")
    )


def json_type(v: Column) -> Column:
    """``object array string number bool null`` of a VARIANT; NULL when it is missing."""
    return let(F.schema_of_variant(v), type_name)


def get_variant(v: Column, dotted: str) -> Column:
    """Value at a dotted path through objects only; NULL when a segment is missing."""
    return F.try_variant_get(v, json_path(dotted), "variant")


def get_text(v: Column, dotted: str) -> Column:
    return F.try_variant_get(v, json_path(dotted), "string")


def split_confidence(data: Column) -> Column:
    """The model's own ``path -> score`` map; empty when it is not an object."""
    scores = F.try_variant_get(data, f"$.{CONFIDENCE_KEY}", "map<string,variant>")
    texts = F.transform_values(scores, lambda _k, s: s.try_cast("string"))
    return F.coalesce(texts, F.create_map().cast("map<string,string>"))


_OPEN = "array<struct<path:string,place:string,at:string,members:map<string,variant>,elements:array<variant>>>"
_FOUND = "array<struct<path:string,v:string,t:string,place:string>>"


def json_depth(raw: Column) -> Column:
    """Deepest nesting of a JSON text: brackets outside strings, counted in one pass."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?s)\\.", ""), r'"[^"]*+"', "")
    brackets = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    deepest = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda acc, b: F.struct(
            (
                acc.now
                + F.when(b.isin("{", "["), 1).when(b.isin("}", "]"), -1).otherwise(0)
            ).alias("now"),
            F.greatest(
                acc.top, acc.now + F.when(b.isin("{", "["), 1).otherwise(0)
            ).alias("top"),
        ),
    )
    return deepest.top


def _listed(n: Column) -> Column:
    """A value with its members or elements if it is a container, else with its text and type.

    The type of a container comes from the cast that lists its members, because
    ``schema_of_variant`` would walk everything below it.
    """

    def read(c: Column) -> Column:
        scalar = c.members.isNull() & c.elements.isNull()
        return F.struct(
            n.path.alias("path"), n.place.alias("place"), n.at.alias("at"),
            c.members.alias("members"), c.elements.alias("elements"),
            F.when(scalar, n.x.try_cast("string")).alias("v"),
            F.when(scalar, json_type(n.x)).alias("t"),
        )

    listed = F.struct(
        n.x.try_cast("map<string,variant>").alias("members"), n.x.try_cast("array<variant>").alias("elements")
    )
    return let(listed, read)


def _below(n: Column, text: Column, ordered: bool, keep_confidence: bool) -> Column:
    """What lies in a container, one level down.

    Members come in the order of their names, or of the document if ``ordered``; only then
    is their place among all values kept.
    """

    def child(path: Column, i: Column, step: Column, x: Column) -> Column:
        if not ordered:
            return F.struct(path.alias("path"), n.place.alias("place"), n["at"].alias("at"), x.alias("x"))
        place, at = F.concat(n.place, F.lpad(i.cast("string"), 10, "0")), F.concat(n["at"], step)
        return F.struct(path.alias("path"), place.alias("place"), at.alias("at"), x.alias("x"))

    def member(e: Column, i: Column) -> Column:
        path = F.when(n.path == "", e.key).otherwise(F.concat(n.path, F.lit("."), e.key))
        return child(path, i, F.concat(F.lit("['"), e.key, F.lit("']")), e.value)

    def element(x: Column, i: Column) -> Column:
        index = F.concat(F.lit("["), i.cast("string"), F.lit("]"))
        return child(F.concat(n.path, index), i, index, x)

    members = F.map_entries(n.members)  # no search by name unless it must be
    if ordered:
        inside = F.json_object_keys(F.call_function("get_json_object", text, n["at"]))
        in_text = F.transform(
            F.array_distinct(inside), lambda k: F.struct(k.alias("key"), F.try_element_at(n.members, k).alias("value")))
        members = F.coalesce(in_text, members)
    if not keep_confidence:
        members = F.filter(members, lambda e: e.key != CONFIDENCE_KEY)
    return F.coalesce(F.transform(members, member), F.transform(n.elements, element))


def _walk(data: Column, text: Column, ordered: bool, keep_confidence: bool) -> Column:
    """Scalars of a document as ``array<struct<path, v, t, place>>``; ``place`` sorts them.

    One fold over as many levels as the row's own document has: containers that are still
    open are replaced by what lies in them, so there is no bound on depth, no explode and
    no shuffle.
    """

    def sorted_out(found: Column, values: Column) -> Column:
        closed = F.transform(
            F.filter(values, lambda n: n.t.isNotNull()),
            lambda n: F.struct(n.path.alias("path"), n.v.alias("v"), n.t.alias("t"), n.place.alias("place")),
        )
        left = F.transform(
            F.filter(values, lambda n: n.t.isNull()),
            lambda n: F.struct(*[n[c].alias(c) for c in ("path", "place", "at", "members", "elements")]),
        )
        return F.struct(
            F.concat(found, closed).cast(_FOUND).alias("found"), left.cast(_OPEN).alias("open")
        )

    def level(acc: Column, depth: Column) -> Column:
        root = F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("place"), F.lit("$").alias("at"), data.alias("x")))
        below = F.flatten(F.transform(acc.open, lambda n: _below(n, text, ordered, keep_confidence)))
        values = F.transform(F.when(depth == 0, root).otherwise(below), _listed)
        return let(values, lambda v: sorted_out(acc.found, v))

    start = F.struct(F.array().cast(_FOUND).alias("found"), F.array().cast(_OPEN).alias("open"))
    return F.aggregate(F.sequence(F.lit(0), json_depth(text)), start, level).found


def flatten(data: Column, text: Column | None = None, keep_confidence: bool = False) -> Column:
    """All scalars of a document as ``array<struct<path, v, t>>``, each path once.

    Documents may nest to any depth the parser takes. Where a name with dots or brackets
    spells the path of another value, the last of them in the document counts, so its
    ``text`` is read for the order of names; without it they come in the order of names.
    ``_confidence`` keys are dropped at any level for scoring and kept for the audit.
    """
    raw = F.to_json(data) if text is None else text

    def cells(found: Column) -> Column:
        return F.transform(found, lambda c: F.struct(c.path.alias("path"), c.v.alias("v"), c.t.alias("t")))

    def unique(found: Column) -> Column:
        paths = found["path"]
        return F.size(F.array_distinct(paths)) == F.size(paths)

    def last(found: Column) -> Column:
        ordered = F.array_sort(
            F.transform(found, lambda c: F.struct(c.path.alias("path"), c.place.alias("place"), c.v.alias("v"), c.t.alias("t")))
        )
        return cells(let(ordered, lambda rows: F.filter(
            rows, lambda c, i: F.coalesce(F.get(rows, i + 1).path != c.path, F.lit(True)))))

    # the second walk, in the order of the document, is taken only by documents that need it
    found = _walk(data, raw, False, keep_confidence)
    again = lambda: let(_walk(data, raw, True, keep_confidence), last)
    return F.when(data.isNotNull(), let(found, lambda f: F.when(unique(f), cells(f)).otherwise(again())))


def bracket_count(text: Column) -> Column:
    """Opening brackets of a JSON text, those in strings as well: no document nests deeper."""
    size = F.octet_length(text)
    return 2 * size - F.octet_length(F.replace(text, F.lit("{"), F.lit(""))) - F.octet_length(F.replace(text, F.lit("["), F.lit("")))


#: The parser's own bound on nesting.
MAX_DEPTH = 1000
_NODES = "array<struct<path:string,root:string,members:map<string,variant>,elements:array<variant>,v:string,t:string>>"


def _node(path: Column, root: Column, x: Column) -> Column:
    """A value with its members or elements if it is a container, else with its text and type."""

    def read(c: Column) -> Column:
        scalar = c.members.isNull() & c.elements.isNull()
        return F.struct(
            path.alias("path"), root.alias("root"), c.members.alias("members"), c.elements.alias("elements"),
            F.when(scalar, x.try_cast("string")).alias("v"), F.when(scalar, json_type(x)).alias("t"),
        )

    return let(F.struct(x.try_cast("map<string,variant>").alias("members"), x.try_cast("array<variant>").alias("elements")), read)


def _children(n: Column) -> Column:
    def member(e: Column) -> Column:
        return _node(F.when(n.path == "", e.key).otherwise(F.concat(n.path, F.lit("."), e.key)), n.root, e.value)

    def element(x: Column, i: Column) -> Column:
        return _node(F.concat(n.path, F.lit("["), i.cast("string"), F.lit("]")), n.root, x)

    members = F.filter(F.map_entries(n.members), lambda e: e.key != CONFIDENCE_KEY)
    return F.coalesce(F.transform(members, member), F.transform(n.elements, element))


def _sorted_out(found: Column, values: Column) -> Column:
    return F.struct(
        F.concat(found, F.filter(values, lambda n: n.t.isNotNull())).alias("found"),
        F.filter(values, lambda n: n.t.isNull()).alias("open"),
    )


def undeclared(data: Column, text: Column, leaves: list[str], prune: Column) -> Column:
    """``flatten`` without the scalars at ``leaves``: ``array<struct<path, v, t>>``, each path once.

    ``leaves`` are dotted paths that lead through objects. Where ``prune`` is true, none of them
    holds a container, so those of one or two names are left out before anything is read of them.
    A path spelled twice is that of the later member of the document; only if both lie below one
    member is the whole document walked in its order.
    """
    one = [p for p in leaves if "." not in p]
    two = [p for p in leaves if p.count(".") == 1]
    blocks = sorted({p.split(".")[0] for p in two})

    def known(path: Column, names: list[str]) -> Column:
        return path.isin(names) if names else F.lit(False)

    def top(e: Column) -> Column:
        def inside(members: Column) -> Column:
            left = F.filter(F.map_entries(members), lambda m: (m.key != CONFIDENCE_KEY) & ~known(F.concat(e.key, F.lit("."), m.key), two))
            own = F.transform(left, lambda m: _node(F.concat(e.key, F.lit("."), m.key), e.key, m.value))
            return F.coalesce(own, whole)

        whole = F.array(_node(e.key, e.key, e.value))
        held = F.when(prune & known(e.key, blocks), let(e.value.try_cast("map<string,variant>"), inside))
        return held.otherwise(whole)

    entries = F.filter(
        F.map_entries(data.try_cast("map<string,variant>")), lambda e: (e.key != CONFIDENCE_KEY) & ~(prune & known(e.key, one)))
    none = F.array().cast(_NODES)
    start = let(F.coalesce(F.flatten(F.transform(entries, top)), none), lambda v: _sorted_out(none, v))

    def level(acc: Column, _depth: Column) -> Column:
        below = F.flatten(F.transform(acc.open, _children))
        return F.when(F.size(acc.open) == 0, acc).otherwise(let(below, lambda v: _sorted_out(acc.found, v)))

    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(bracket_count(text), F.lit(MAX_DEPTH + 1))))
    found = F.aggregate(levels, start, level).found

    def cells(nodes: Column) -> Column:
        return F.transform(nodes, lambda c: F.struct(c.path.alias("path"), c.v.alias("v"), c.t.alias("t")))

    def unique(nodes: Column) -> Column:
        return F.size(F.array_distinct(nodes["path"])) == F.size(nodes)

    def one_root(nodes: Column) -> Column:
        both = F.transform(nodes, lambda c: F.struct(c.path.alias("path"), c.root.alias("root")))
        return F.size(F.array_distinct(both)) == F.size(nodes)

    def last(nodes: Column) -> Column:
        def placed(keys: Column) -> Column:
            rows = F.sort_array(F.transform(nodes, lambda c: F.struct(
                c.path.alias("path"), F.array_position(keys, c.root).alias("place"), c.v.alias("v"), c.t.alias("t"))))
            return let(rows, lambda r: F.filter(r, lambda c, i: F.coalesce(F.get(r, i + 1).path != c.path, F.lit(True))))

        return cells(let(F.array_distinct(F.json_object_keys(text)), placed))

    def settled(nodes: Column) -> Column:
        return F.when(unique(nodes), cells(nodes)).when(one_root(nodes), last(nodes)).otherwise(flatten(data, text))

    return F.when(data.isNotNull(), let(found, settled))
