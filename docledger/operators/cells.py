"""Document cells: one array of field values per document row.

A cell is ``struct<path, kind, v, t, given>``: the value as text, its JSON type, and
whether the source gave it (``false`` means that the schema default was filled in).
The array is built position by position from a spec, so a declared field is read by
its index, and a whole document is repaired, scored and checked inside its own row,
without an explode or a shuffle. Labels and sections stay in the spec.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, functions as F, types as T

from ..functions import jsondoc
from ..functions.text import let
from ..sources.specs import DocSpec, Field

CELLS = "array<struct<path:string,kind:string,v:string,t:string,given:boolean>>"
_CONSTANTS = "array<struct<path:string,kind:string,t:string,dv:string,dt:string>>"


def default_of(value: Any) -> tuple[str | None, str]:
    if value is None:
        return None, "null"
    if isinstance(value, bool):
        return ("true" if value else "false"), "bool"
    if isinstance(value, (int, float)):
        return str(value), "number"
    return value, "string"


def _literal(value: Any, data_type: str) -> Column:
    """A constant array or map; it is folded into one literal when planned."""
    return F.from_json(F.lit(json.dumps(value)), data_type)


def _constants(fields: list[Field], skeleton: dict[str, Any], types: dict[str, str]) -> Column:
    rows = []
    for f in fields:
        dv, dt = default_of(skeleton.get(f.path))
        t = types.get(f.path, "null")
        rows.append({"path": f.path, "kind": f.kind, "t": t, "dv": dv, "dt": dt})
    return _literal(rows, _CONSTANTS)


def _defaults(fields: list[Field], skeleton: dict[str, Any]) -> Column:
    """Cells of a document that gives nothing."""
    rows = []
    for f in fields:
        v, t = default_of(skeleton.get(f.path))
        rows.append({"path": f.path, "kind": f.kind, "v": v, "t": t, "given": False})
    return _literal(rows, CELLS)


def _cell(path: Column, kind: Column, v: Column, t: Column, given: Column) -> Column:
    return F.struct(
        path.alias("path"), kind.alias("kind"), v.alias("v"), t.alias("t"), given.alias("given")
    )


def header_from_columns(spec: DocSpec, values: dict[str, tuple[Column, str]]) -> Column:
    """Header cells from table columns; ``values`` maps a path to (value, JSON type).

    A missing or null value is filled from the skeleton; a given value stays.
    """
    fields = spec.header_fields()
    constants = _constants(fields, spec.skeleton, {p: t for p, (_, t) in values.items()})
    nothing = (F.lit(None), "null")
    texts = F.array(*[values.get(f.path, nothing)[0].cast("string") for f in fields])
    return F.zip_with(
        constants,
        texts,
        lambda k, v: _cell(
            k.path, k.kind, F.coalesce(v, k.dv), F.when(v.isNull(), k.dt).otherwise(k.t),
            v.isNotNull(),
        ),
    )


def leaf_tree(spec: DocSpec, data: Column) -> Column:
    """The declared paths of a VARIANT document as nested structs: one cast reads all of them.

    NULL where a path does not lead through objects. As a column of its own it is computed
    once, and a leaf is read without a copy of the document.
    """
    return data.try_cast(_tree([f.path.split(".") for f in spec.header_fields()]))


def _clash(paths: list[list[str]]) -> bool:
    """Whether a path leads through another, or names differ by case only: no struct holds both."""
    lowered = [tuple(name.lower() for name in path) for path in paths]
    through = {path[:i] for path in lowered for i in range(1, len(path))}
    spelled = {tuple(path[:i]) for path in paths for i in range(1, len(path) + 1)}
    return bool(through & set(lowered)) or len({tuple(n.lower() for n in x) for x in spelled}) < len(spelled)


def _tree(paths: list[list[str]]) -> T.DataType:
    heads: dict[str, list[list[str]]] = {}
    for path in paths:
        heads.setdefault(path[0], []).append(path[1:])
    return T.StructType([
        T.StructField(name, _tree(rest) if all(rest) else T.VariantType()) for name, rest in heads.items()
    ])


def has_tree(spec: DocSpec) -> bool:
    paths = [f.path.split(".") for f in spec.header_fields()]
    return bool(paths) and not _clash(paths)


def header_from_variant(
    spec: DocSpec, data: Column, filename: Column | None = None, tree: Column | None = None
) -> Column:
    """Header cells of a VARIANT document; the file name is overwritten.

    Each declared path is read through objects only, so a name with dots is no other path.
    A leaf that holds a container keeps it as JSON text: its members are extras. ``tree`` is
    the document's ``leaf_tree`` if it is at hand. Most declared fields are missing, so that is
    asked first.
    """
    fields = spec.header_fields()
    if not fields:
        return F.array().cast(CELLS)

    def leaf(path: str) -> Column:
        if tree is None:
            return jsondoc.get_variant(data, path)
        return reduce(lambda c, name: c[name], path.split("."), tree)

    def read(k: Column, x: Column) -> Column:
        def typed(t: Column) -> Column:
            return F.when(t == "null", k).otherwise(
                _cell(k.path, k.kind, x.try_cast("string"), t, F.lit(True))
            )

        filled = F.when(x.isNull(), k).otherwise(let(jsondoc.json_type(x), typed))
        if filename is None:
            return filled
        return F.when(
            k.path == "metadata.source.filename",
            _cell(k.path, k.kind, filename, F.lit("string"), F.lit(True)),
        ).otherwise(filled)

    # a default is a literal as a whole: a missing field costs no struct of its own
    return F.zip_with(_defaults(fields, spec.skeleton), F.array(*[leaf(f.path) for f in fields]), read)


def item_cells(
    spec: DocSpec, index: Column, values: dict[str, tuple[Column, str]]
) -> Column:
    """Cells of one line item held as a table row; only mapped columns exist."""
    fields = [f for f in spec.item_columns if f.path in values]
    constants = _constants(fields, {}, {p: t for p, (_, t) in values.items()})
    texts = F.array(*[values[f.path][0].cast("string") for f in fields])
    at = F.concat(F.lit(f"{spec.items_path}["), index.cast("string"), F.lit("]."))
    return let(
        at,
        lambda start: F.zip_with(
            constants,
            texts,
            lambda k, v: _cell(
                F.concat(start, k.path), k.kind, v,
                F.when(v.isNull(), "null").otherwise(k.t), v.isNotNull(),
            ),
        ),
    )


def other_cells(spec: DocSpec, flat: Column) -> Column:
    """Line items and extra keys of a flattened document.

    Extras are kept as they are. A scalar where the schema has an object or a list
    is dropped, as is an object where it has a list.
    """
    known = [f.path for f in spec.header_fields()]
    closed = known + sorted(spec.blocks()) + list(spec.skeleton_lists)
    closed_lists = [p + "." for p in spec.skeleton_lists]
    start = f"{spec.items_path}["
    kinds = _literal({f.path: f.kind for f in spec.item_columns}, "map<string,string>")

    def allowed(c: Column) -> Column:
        inside = F.lit(False)
        for prefix in closed_lists:
            inside = inside | c.path.startswith(prefix)
        return ~c.path.isin(closed) & ~inside

    def as_cell(c: Column) -> Column:
        direct = let(in_item(c.path, spec.items_path or ""), lambda at: at.key)
        kind = F.when(c.path.startswith(start), F.try_element_at(kinds, direct))
        return _cell(c.path, F.coalesce(kind, F.lit("")), c.v, c.t, c.t != "null")

    return F.transform(F.filter(flat, allowed), as_cell)


def rest_cells(spec: DocSpec, data: Column, text: Column, prune: Column) -> Column:
    """Line-item and extra cells of a VARIANT document, without its header cells; NULL without one.

    ``prune`` tells that no declared path holds a container, as most documents have it.
    """
    leaves = [f.path for f in spec.header_fields()]
    return F.when(data.isNotNull(), other_cells(spec, jsondoc.undeclared(data, text, leaves, prune)))


def in_item(path: Column, items_path: str) -> Column:
    """Where a path below the line items lies: ``struct<i, head, key, below>``.

    ``head`` is the item's own member and ``key`` is that, too, unless the value lies
    further down; ``below`` is then how (``.`` or ``[``).
    """

    def parts(rest: Column) -> Column:
        i = F.substring_index(rest, "]", 1)
        return let(F.substring(rest, F.length(i) + 2, F.length(rest)), lambda after: member(i, after))

    def member(i: Column, after: Column) -> Column:
        name = F.when(after.startswith("."), F.regexp_extract(after, r"^\.([^.\[]*)", 1))

        def placed(head: Column) -> Column:
            below = F.substring(after, F.length(head) + 2, F.lit(1))
            return F.struct(
                i.try_cast("int").alias("i"), head.alias("head"), F.when(below == "", head).alias("key"), below.alias("below"),
            )

        return let(name, placed)

    return let(F.substring(path, F.lit(len(items_path) + 2), F.length(path)), parts)


def document_cells(
    spec: DocSpec, data: Column, filename: Column | None = None, flat: Column | None = None,
    tree: Column | None = None,
) -> Column:
    """Header, line-item and extra cells of a VARIANT document; NULL without one.

    ``flat`` and ``tree`` are the document's ``jsondoc.flatten`` and ``leaf_tree`` if they are at hand.
    """
    found = jsondoc.flatten(data) if flat is None else flat
    cells = F.concat(header_from_variant(spec, data, filename, tree), other_cells(spec, found))
    return F.when(data.isNotNull(), cells)


def declared(spec: DocSpec, cells: Column) -> Column:
    """Cells of the declared fields: the first ones, in spec order."""
    return F.slice(cells, 1, len(spec.fields))


def label_of(spec: DocSpec, path: Column) -> Column:
    """Label of a cell's path; that of a line item keeps its place in the list."""
    header = _literal({f.path: f.label for f in spec.fields}, "map<string,string>")
    items = _literal({f.path: f.label for f in spec.item_columns}, "map<string,string>")
    key = F.substring_index(path, "].", -1)
    place = F.substring(path, F.lit(1), F.length(path) - F.length(key))
    return F.coalesce(
        F.try_element_at(header, path), F.concat(place, F.try_element_at(items, key)), path
    )


def position(spec: DocSpec, path: str) -> int:
    return [f.path for f in spec.header_fields()].index(path)


def at(cells: Column, spec: DocSpec, path: str) -> Column:
    """Cell of a declared path in header cells that were built from ``spec``."""
    return F.get(cells, position(spec, path))


def find(cells: Column, spec: DocSpec, path: str) -> Column:
    """Cell of a path: by position if the spec knows it, else by search."""
    if path in [f.path for f in spec.header_fields()]:
        return at(cells, spec, path)
    return F.get(F.filter(cells, lambda c: c.path == path), 0)


def given_text(cell: Column) -> Column:
    """Value as the source gave it; NULL when the default was filled in."""
    return F.when(cell.given, cell.v)


def truthy(cell: Column) -> Column:
    """Given, not empty, not zero and not false."""
    zero = (cell.t == "number") & (cell.v.try_cast("double") == 0)
    false = (cell.t == "bool") & (cell.v == "false")
    return F.coalesce(cell.given & (cell.v != "") & ~zero & ~false, F.lit(False))


def items(cells: Column, items_path: str) -> Column:
    """Line-item cells as ``array<struct<i, head, key, below, v, t, given>>``, in item order."""
    kept = F.filter(cells, lambda c: c.path.startswith(items_path + "["))

    def split(c: Column) -> Column:
        return let(
            in_item(c.path, items_path),
            lambda at: F.struct(
                at.i.alias("i"), at.head.alias("head"), at.key.alias("key"), at.below.alias("below"),
                c.v.alias("v"), c.t.alias("t"), c.given.alias("given"),
            ),
        )

    return F.sort_array(F.transform(kept, split))


def item_values(cells: Column, items_path: str, key: str) -> Column:
    """Values of one line-item key, in item order."""
    return F.filter(items(cells, items_path), lambda x: x.key == key)
