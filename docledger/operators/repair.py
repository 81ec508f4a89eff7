"""Deterministic repairs of cells, with a note for every change."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions.dates import iso_date
from ..functions.numbers import PLAIN_NUMBER, coerce_number, lenient_number, round_places
from ..functions.text import let, strip
from ..sources.live_types import SHIPPING_BILL
from ..sources.specs import DocSpec
from . import cells as cl
from .cells import label_of

# Reason and confidence of a repair by kind.
REASONS = {
    "number": "Parsed numeric value (removed currency/grouping symbols).",
    "date": "Normalized date to ISO format (YYYY-MM-DD).",
    "text": "Trimmed surrounding whitespace.",
    "long_text": "Trimmed surrounding whitespace.",
}
DATE_CONFIDENCE = 95
FIX_CONFIDENCE = 100

# What a gate pass repairs (text is not trimmed), and its reasons.
GATE_PASS_DATES = [
    "purchase_order.po_date", "delivery.document_date", "gate_pass.entry_date",
    "gate_pass.manual_igp_date", "transporter.gr_date", "permits.mf4_date",
]
GATE_PASS_VALUE = "value.net_value_doc_currency"
GATE_PASS_REASONS = {
    "date": "Normalized date to ISO (YYYY-MM-DD).",
    "number": "Parsed numeric value.",
    "quantity": "Parsed numeric quantity.",
}

# The derived drawback rate.
DERIVED_REASON = "Derived DBK Rate = DBK Amount / FOB(INR) x 100 (printed rate not found)."
DERIVED_CONFIDENCE = 80


def repairable(v: Column, t: Column, kind: Column) -> Column:
    """Only text that is not empty, of a field with a kind."""
    return (v != "") & (kind != "") & (t == "string")


def repaired_value(v: Column, t: Column, kind: Column) -> Column:
    """Repaired text of a value by kind; NULL when nothing changes.

    Only text can change: a JSON number already is one, and is no date.
    """
    return F.when(
        repairable(v, t, kind),
        F.when(kind == "number", coerce_number(v).cast("string"))
        .when(kind == "date", _unless_same(iso_date(v), v))
        .when(kind.isin("text", "long_text"), _unless_same(strip(v), v)),
    )


def _unless_same(new: Column, old: Column) -> Column:
    return let(new, lambda n: F.when(n != old, n))


def repair(cells: Column, kind_of: Callable[[Column], Column] | None = None) -> Column:
    """Cells with ``v`` and ``t`` repaired, and ``old`` set where the value changed.

    ``kind_of`` gives a cell another kind than its own; it is replaced in the same step.
    """

    def one(c: Column) -> Column:
        kind = c.kind if kind_of is None else kind_of(c)

        def cell(v: Column, t: Column, old: Column) -> Column:
            return F.struct(
                c.path.alias("path"), kind.alias("kind"), v.alias("v"), t.alias("t"), c.given.alias("given"), old.alias("old"),
            )

        def with_new(new: Column) -> Column:
            t = F.when(new.isNotNull() & (kind == "number"), "number").otherwise(c.t)
            return cell(F.coalesce(new, c.v), t, F.when(new.isNotNull(), c.v))

        # most cells are empty, typed or of no kind: they are told apart before anything costly
        return F.when(repairable(c.v, c.t, kind), let(repaired_value(c.v, c.t, kind), with_new)).otherwise(
            cell(c.v, c.t, F.lit(None).cast("string")))

    return F.transform(cells, one)


def notes(repaired: Column, spec: DocSpec) -> Column:
    """``array<struct<field, old, new, reason, confidence>>`` of the changed cells."""
    return F.transform(
        F.filter(repaired, lambda c: c.old.isNotNull()),
        lambda c: F.struct(
            label_of(spec, c.path).alias("field"),
            c.old.alias("old"),
            c.v.alias("new"),
            reason_for(c.kind).alias("reason"),
            confidence_for(c.kind).alias("confidence"),
        ),
    )


def reason_for(kind: Column) -> Column:
    return (
        F.when(kind == "number", REASONS["number"])
        .when(kind == "date", REASONS["date"])
        .otherwise(REASONS["text"])
    )


def confidence_for(kind: Column) -> Column:
    return F.when(kind == "date", DATE_CONFIDENCE).otherwise(FIX_CONFIDENCE)


def gate_pass_kind(c: Column) -> Column:
    """The kind of a cell that a gate pass repairs; all others are left alone."""
    number = (c.path == GATE_PASS_VALUE) | c.path.startswith("items[") & c.path.rlike(r"^items\[\d+\]\.quantity$")
    return F.when(c.path.isin(GATE_PASS_DATES), "date").when(number, "number").otherwise("")


def gate_pass_repair(cells: Column) -> Column:
    return repair(cells, gate_pass_kind)


def gate_pass_notes(repaired: Column) -> Column:
    """Notes of a gate pass name the path and carry their own reasons."""
    return F.transform(
        F.filter(repaired, lambda c: c.old.isNotNull()),
        lambda c: F.struct(
            c.path.alias("field"),
            c.old.alias("old"),
            c.v.alias("new"),
            F.when(c.kind == "date", GATE_PASS_REASONS["date"])
            .when(c.path == GATE_PASS_VALUE, GATE_PASS_REASONS["number"])
            .otherwise(GATE_PASS_REASONS["quantity"])
            .alias("reason"),
            confidence_for(c.kind).alias("confidence"),
        ),
    )


def local_fob(invoice_fob: Column, summary_fob: Column, exchange_rate: Column) -> Column:
    """First positive FOB in local currency; a missing rate leaves it as it is."""
    a, b, rate = (lenient_number(c) for c in (invoice_fob, summary_fob, exchange_rate))
    fob = F.coalesce(F.when(a > 0, a), F.when(b > 0, b))
    return fob * F.when(rate > 0, rate).otherwise(1.0)


def derived_drawback_rate(rate: Column, amount: Column, fob: Column) -> Column:
    """Percent of FOB to two places when no rate is printed and 0 < result < 100."""
    claimed = lenient_number(amount)
    derived = round_places(claimed / F.nullif(fob, F.lit(0.0)) * 100.0, 2)
    return F.when(
        rate.isNull() & (claimed > 0) & (fob > 0) & (derived > 0) & (derived < 100), derived
    )


def with_drawback_rate(spec: DocSpec, cells: Column) -> Column:
    """``struct<cells, notes>``: the missing drawback rate of repaired shipping-bill cells, derived."""
    path = "drawback.dbk_rate"

    def value(at: str) -> Column:
        return cl.find(cells, SHIPPING_BILL, at).v

    fob = local_fob(
        value("invoice.fob_value"), value("summary.total_fob_value"), value("invoice.exchange_rate")
    )

    def replaced(rate: Column) -> Column:
        changed = F.transform(
            cells,
            lambda c: F.when(
                rate.isNotNull() & (c.path == path),
                F.struct(
                    c.path.alias("path"), c.kind.alias("kind"), rate.alias("v"),
                    F.lit("number").alias("t"), F.lit(True).alias("given"), c.old.alias("old"),
                ),
            ).otherwise(c),
        )
        note = F.struct(
            F.lit(path).alias("field"), F.lit(None).cast("string").alias("old"), rate.alias("new"),
            F.lit(DERIVED_REASON).alias("reason"), F.lit(DERIVED_CONFIDENCE).alias("confidence"),
        )
        return F.struct(
            changed.alias("cells"), F.filter(F.array(note), lambda n: n.new.isNotNull()).alias("notes")
        )

    rate = derived_drawback_rate(value(path), value("drawback.dbk_amount"), fob)
    return let(rate.cast("string"), replaced)


@dataclass(frozen=True)
class Repair:
    """What a type does to its cells: ``fix`` them, tell the ``notes``, then ``derive`` others.

    ``fix(spec, cells)`` gives cells with ``old``, ``notes(spec, fixed)`` an array of notes, and
    ``derive(spec, fixed)`` a struct of the cells and further notes.
    """

    fix: Callable[[DocSpec, Column], Column] = lambda spec, cells: repair(cells)
    notes: Callable[[DocSpec, Column], Column] = lambda spec, fixed: notes(fixed, spec)
    derive: Callable[[DocSpec, Column], Column] | None = None
    columns: Columns | None = None


@dataclass(frozen=True)
class Columns:
    """The same for header fields held as columns (``json_columns``): a type's repair may have it.

    ``kinds(spec)`` maps paths to the kinds they are repaired by, ``note(spec)`` gives a function of
    path and kind to the field, reason and confidence of a note. ``derive(value)``, with ``value``
    the text of a path, gives steps of new columns, the path that the last of them is written to
    as text where it is not NULL, and the reason and confidence of its note.
    """

    kinds: Callable[[DocSpec], dict[str, str]] = lambda spec: {f.path: f.kind for f in spec.header_fields()}
    note: Callable[[DocSpec], Callable[[str, str], tuple[str, str, int]]] = lambda spec: _generic_note(spec)
    derive: Callable[[Callable[[str], Column]], tuple[list[dict[str, Column]], str, str, int]] | None = None


def _generic_note(spec: DocSpec) -> Callable[[str, str], tuple[str, str, int]]:
    labels = {f.path: f.label for f in spec.fields}
    return lambda path, kind: (labels.get(path, path), REASONS[kind], DATE_CONFIDENCE if kind == "date" else FIX_CONFIDENCE)


def _gate_pass_note(_spec: DocSpec) -> Callable[[str, str], tuple[str, str, int]]:
    return lambda path, kind: (path, GATE_PASS_REASONS[kind], DATE_CONFIDENCE if kind == "date" else FIX_CONFIDENCE)


def _gate_pass_kinds(_spec: DocSpec) -> dict[str, str]:
    return {p: "date" for p in GATE_PASS_DATES} | {GATE_PASS_VALUE: "number"}


def _drawback_columns(value: Callable[[str], Column]) -> tuple[list[dict[str, Column]], str, str, int]:
    """The steps of ``with_drawback_rate``, each a projection of plain columns."""
    texts = {
        "_rate": value("drawback.dbk_rate"), "_amount": value("drawback.dbk_amount"), "_fob": value("invoice.fob_value"),
        "_total": value("summary.total_fob_value"), "_exchange": value("invoice.exchange_rate"),
    }
    trimmed = {n: strip(F.translate(v, ",%", "")) for n, v in texts.items() if n != "_rate"}
    numbers = {n: F.when(F.col(n).rlike(PLAIN_NUMBER), F.col(n).try_cast("double")) for n in trimmed}
    a, b, rate, claimed = F.col("_fob"), F.col("_total"), F.col("_exchange"), F.col("_amount")
    fob = F.coalesce(F.when(a > 0, a), F.when(b > 0, b)) * F.when(rate > 0, rate).otherwise(1.0)
    percent = round_places(claimed / F.nullif(F.col("_local"), F.lit(0.0)) * 100.0, 2)
    found = F.when(
        texts["_rate"].isNull() & (claimed > 0) & (F.col("_local") > 0) & (F.col("_percent") > 0) & (F.col("_percent") < 100),
        F.col("_percent"),
    )
    steps = [trimmed, numbers, {"_local": fob}, {"_percent": percent}, {"_found": found.cast("string")}]
    return steps, "drawback.dbk_rate", DERIVED_REASON, DERIVED_CONFIDENCE


GENERIC = Repair(columns=Columns())

#: Repairs by type key; a user may add more. A type without one gets the generic repair.
REPAIRS: dict[str, Repair] = {
    "igp": Repair(
        lambda spec, cells: gate_pass_repair(cells), lambda spec, fixed: gate_pass_notes(fixed),
        columns=Columns(_gate_pass_kinds, _gate_pass_note),
    ),
    "shipping_bill": Repair(derive=with_drawback_rate, columns=Columns(derive=_drawback_columns)),
}


def attempt(spec: DocSpec, own: Callable[[], Column], generic: Callable[[], Column]) -> Column:
    """A type's own expression, or the generic one if its function fails while it is built."""
    try:
        return own()
    except Exception:  # noqa: BLE001 - a user's function must not take the other types down
        logging.getLogger(__name__).exception("Using the generic function for type %s.", spec.key)
        return generic()
