"""Validation rule packs: one array of issues per document row.

Each pack takes named facts of a document, so it runs alike on nested documents
(facts by higher-order functions) and on header and line tables (facts by partial
aggregates). An issue is ``struct<rule, message, a, b>``: compare the rule and the
two amounts, not the formatted text.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, functions as F

from ..functions.numbers import exact_total, round_places, to_double
from ..functions.text import let
from ..sources.specs import DocSpec
from . import cells as cl
from .repair import attempt

TOLERANCE = 1.0
WEIGHT_TOLERANCE = 0.01

# Sections every document of a type must have.
ORDER_SECTIONS = ["metadata", "buyer", "supplier", "purchase_order", "items", "summary"]
GATE_PASS_SECTIONS = ["metadata", "gate_pass", "purchase_order", "vendor", "delivery", "items"]
SHIPPING_SECTIONS = [
    "metadata", "shipping_bill", "exporter", "consignee", "invoice", "items", "summary",
]


def issue(rule: str, message: Column | str, a: Column | None = None, b: Column | None = None):
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(
        F.lit(rule).alias("rule"),
        text.alias("message"),
        (F.lit(None) if a is None else a).cast("double").alias("a"),
        (F.lit(None) if b is None else b).cast("double").alias("b"),
    )


def _no_issues() -> Column:
    return F.array().cast("array<struct<rule:string,message:string,a:double,b:double>>")


def collect(checks: list[tuple[Column, Column]], extra: list[Column] | None = None) -> Column:
    """Issues whose condition is true (NULL counts as false), in the given order."""
    none = _no_issues()
    found = [F.when(F.coalesce(cond, F.lit(False)), F.array(out)).otherwise(none) for cond, out in checks]
    return F.concat(*found, *(extra or []))


def missing_sections(present: Column | None, sections: list[str]) -> list[Column]:
    """One issue per required section that the source does not have at all."""
    if present is None:
        return []
    # plain columns, no lambdas: the sections are known when the query is built
    return [
        F.when(~F.array_contains(present, s), F.array(
            issue("section_missing", f"Missing required section: '{s}'."))).otherwise(_no_issues())
        for s in sections
    ]


def _money_text(x: Column) -> Column:
    return F.call_function("format_number", x.cast("double"), F.lit("0.00"))


def cross_check(rule: str, line_sum: Column, total: Column, what: str, against: str):
    """Sum of lines against a header total that is not zero, tolerance 1.0."""
    line_sum, total = line_sum.cast("double"), total.cast("double")
    off = (F.coalesce(total, F.lit(0.0)) != 0) & (F.abs(line_sum - total) > TOLERANCE)
    text = F.concat(
        F.lit(f"{what} mismatch: line items sum to "), _money_text(line_sum),
        F.lit(f" but {against} is "), _money_text(total), F.lit("."),
    )
    return off, issue(rule, text, round_places(line_sum, 2), round_places(total, 2))


def unread(what: str, facts: dict[str, Column]) -> list[tuple[Column, Column]]:
    """The check that amounts could be read; fact ``unread`` says why one could not."""
    why = facts.get("unread")
    if why is None:
        return []
    return [(why.isNotNull(), issue("unread", F.concat(F.lit(f"Could not verify {what} totals: "), why)))]


def order_issues(f: dict[str, Column]) -> Column:
    """Facts: po_number (bool), item_count, line_sum, subtotal; optional sections, unread."""
    return collect(
        [
            (~f["po_number"], issue("order_number", "Order number is missing.")),
            (f["item_count"] == 0, issue("no_items", "No line items were extracted.")),
            cross_check("subtotal", f["line_sum"], f["subtotal"], "Subtotal", "summary subtotal"),
            *unread("numeric", f),
        ],
        missing_sections(f.get("sections"), ORDER_SECTIONS),
    )


def gate_pass_issues(f: dict[str, Column]) -> Column:
    """Facts: identified, vendor, vehicle (bool), real_items, quantities (counts)."""
    return collect(
        [
            (
                ~f["identified"],
                issue(
                    "identifier",
                    "No PO number or gate pass / material document number was found.",
                ),
            ),
            (
                ~f["vendor"],
                issue("vendor", "Vendor is not identified (no vendor code or name)."),
            ),
            (f["real_items"] == 0, issue("no_items", "No material line items were extracted.")),
            (
                (f["real_items"] > 0) & (f["quantities"] == 0),
                issue("no_quantity", "No material quantity was extracted."),
            ),
            (~f["vehicle"], issue("vehicle", "Vehicle number is missing.")),
        ],
        missing_sections(f.get("sections"), GATE_PASS_SECTIONS),
    )


def weight_violation(gross: Column, net: Column) -> Column:
    """Both weights given and not zero, and net above gross by more than 0.01."""
    return F.coalesce((gross != 0) & (net != 0) & (net > gross + WEIGHT_TOLERANCE), F.lit(False))


def weight_issue(line: Column, gross: Column, net: Column) -> Column:
    text = F.concat(
        F.lit("Line "), F.coalesce(F.nullif(line, F.lit("")), F.lit("?")),
        F.lit(": net weight ("), net.cast("string"),
        F.lit(") exceeds gross weight ("), gross.cast("string"), F.lit(")."),
    )
    return issue("line_weight", text, net, gross)


def shipping_issues(f: dict[str, Column]) -> Column:
    """Facts: number, exporter_code, leo_date, scheme, exchange_rate, hs_code (bool,
    true when usable); commission, dbk_rate, dbk_amount, rodtep (bool, true when
    given, zero included); item_count, line_fob, total_fob; optional sections, unread."""
    advisory = " is blank — confirm it is truly absent (0 is a valid value)."
    review = " is missing — please review."
    return collect(
        [
            (~f["number"], issue("bill_number", "Shipping Bill number is missing.")),
            (~f["exporter_code"], issue("exporter_code", "Exporter IEC number is missing.")),
            (f["item_count"] == 0, issue("no_items", "No product line items were extracted.")),
            (~f["commission"], issue("commission", "Commission" + advisory)),
            (~f["exchange_rate"], issue("exchange_rate", "Customs Exchange Rate" + review)),
            (
                ~f["hs_code"],
                issue("hs_code", "HS Code is missing on every line item — please review."),
            ),
            (~f["leo_date"], issue("leo_date", "LEO Date" + review)),
            (~f["dbk_rate"], issue("dbk_rate", "DBK Rate (%) is blank — please review.")),
            (~f["dbk_amount"], issue("dbk_amount", "DBK Amount" + advisory)),
            (~f["rodtep"], issue("rodtep", "RODTEP Amount" + advisory)),
            (~f["scheme"], issue("scheme", "Scheme Description" + review)),
            cross_check("fob", f["line_fob"], f["total_fob"], "FOB", "summary total FOB value"),
            *unread("FOB", f),
        ],
        missing_sections(f.get("sections"), SHIPPING_SECTIONS),
    )


def _nothing() -> Column:
    return F.array(issue("no_data", "No data was extracted from the document."))


def generic_issues(missing: dict[str, Column], spec: DocSpec, item_count: Column, empty=None):
    """Required fields that are empty, then no line items; one issue if no data at all."""
    labels = {f.path: f.label for f in spec.fields if f.required}
    checks = [
        (missing[p], issue(f"required:{p}", f"Required field missing: {label}."))
        for p, label in labels.items()
    ]
    if spec.items_path:
        checks.append((item_count == 0, issue("no_items", "No line items were extracted.")))
    if not checks:
        checks = [(F.lit(False), issue("none", ""))]
    found = collect(checks)
    return found if empty is None else F.when(empty, _nothing()).otherwise(found)


class NestedFacts:
    """Facts of a document whose header and line items are cells of one array.

    ``listed`` is the number of items the source lists, which may hold no value at all.
    """

    def __init__(
        self, spec: DocSpec, cells: Column, sections: Column, items: Column, listed: Column | None = None,
        header: Callable[[str], Any] | None = None,
    ):
        self.spec, self.cells, self.sections, self.items, self.header = spec, cells, sections, items, header
        self.listed = F.lit(0) if listed is None else F.coalesce(listed, F.lit(0))

    def find(self, path: str):
        """The cell of a path: plain columns if the document's header fields are held so."""
        held = None if self.header is None else self.header(path)
        return cl.find(self.cells, self.spec, path) if held is None else held

    def ok(self, path: str) -> Column:
        return F.coalesce(cl.truthy(self.find(path)), F.lit(False))

    def given(self, path: str) -> Column:
        return F.coalesce(self.find(path).given, F.lit(False))

    def blank(self, path: str) -> Column:
        c = self.find(path)
        return ~F.coalesce(c.given & (c.v != ""), F.lit(False))

    def amount(self, path: str) -> Column:
        text = cl.given_text(self.find(path))
        return F.coalesce(to_double(text), F.lit(0.0))

    def item_count(self) -> Column:
        return F.greatest(F.size(F.array_distinct(F.transform(self.items, lambda x: x.i))), self.listed)

    def real_items(self) -> Column:
        """Items with any value that is not null or empty; a container is a value."""
        filled = F.filter(
            self.items, lambda x: x.head.isNotNull() & ((x.below != "") | (x.given & (x.v != "")))
        )
        return F.size(F.array_distinct(F.transform(filled, lambda x: x.i)))

    def values(self, key: str) -> Column:
        return F.filter(self.items, lambda x: x.key == key)

    def count_of(self, key: str) -> Column:
        filled = F.filter(
            self.items, lambda x: (x.head == key) & ((x.below != "") | (x.given & (x.v != "")))
        )
        return F.size(F.array_distinct(F.transform(filled, lambda x: x.i)))

    def sum_of(self, key: str) -> Column:
        """Sum over items; a blank counts as 0, an unreadable value makes the sum NULL."""
        numbers = F.transform(self.values(key), _amount)
        return F.when(self.unread_item(key).isNull(), exact_total(numbers))

    def unread_item(self, key: str) -> Column:
        """Why the first unreadable value of a line-item key cannot be read, or NULL."""
        own = F.filter(self.items, lambda x: (x.head == key) & ((x.below != "") | _amount(x).isNull()))
        return let(F.get(own, 0), lambda x: F.when(x.isNotNull(), _why(x.v, x.below)))

    def unread(self, key: str, path: str) -> Column:
        """Why an amount of the line items, or else of the header, cannot be read."""
        def of(c) -> Column:
            return F.when(c.given & _amount(c).isNull(), _why(
                c.v, F.when(c.t == "object", ".").when(c.t == "array", "[").otherwise("")))

        total = self.find(path)
        header = let(total, of) if isinstance(total, Column) else of(total)
        return F.coalesce(self.unread_item(key), header)

    def weight_issues(self) -> Column:
        def first_of(key: str, i: Column) -> Column:
            return F.get(F.filter(self.values(key), lambda x: x.i == i), 0).v

        def weighed(n: Column) -> Column:
            return F.struct(
                n.i.alias("i"), to_double(first_of("gross_weight", n.i)).alias("gross"), to_double(n.v).alias("net"),
            )

        found = F.filter(
            F.transform(self.values("net_weight"), weighed), lambda w: weight_violation(w.gross, w.net)
        )
        return F.transform(found, lambda w: weight_issue(first_of("line_number", w.i), w.gross, w.net))


def _amount(c: Column) -> Column:
    """A cell as a number, blank and false as 0; NULL if it cannot be read."""
    return (
        F.when(F.coalesce(c.v, F.lit("")) == "", 0.0)
        .when(c.t == "bool", F.when(c.v == "true", 1.0).otherwise(0.0))
        .otherwise(to_double(c.v))
    )


def _why(v: Column, below: Column) -> Column:
    """Fixed texts: why a value is no number."""
    kind = F.when(below == ".", "dict").when(below == "[", "list")
    quote = F.when(F.contains(v, F.lit("'")), '"').otherwise("'")
    return F.coalesce(
        F.concat(F.lit("float() argument must be a string or a real number, not '"), kind, F.lit("'")),
        F.concat(F.lit("could not convert string to float: "), quote, v, quote),
    )


def order_pack(spec: DocSpec, d: NestedFacts) -> Column:
    return order_issues(
        {
            "sections": d.sections,
            "po_number": d.ok("purchase_order.po_number"),
            "item_count": d.item_count(),
            "line_sum": d.sum_of("taxable_amount"),
            "subtotal": d.amount("summary.subtotal"),
            "unread": d.unread("taxable_amount", "summary.subtotal"),
        }
    )


def gate_pass_pack(spec: DocSpec, d: NestedFacts) -> Column:
    return gate_pass_issues(
        {
            "sections": d.sections,
            "identified": d.ok("purchase_order.po_number")
            | d.ok("gate_pass.gate_pass_number")
            | d.ok("gate_pass.material_document_number"),
            "vendor": d.ok("vendor.code") | d.ok("vendor.name"),
            "vehicle": d.ok("delivery.vehicle_number"),
            "real_items": d.real_items(),
            "quantities": d.count_of("quantity"),
        }
    )


def shipping_pack(spec: DocSpec, d: NestedFacts) -> Column:
    found = shipping_issues(
        {
            "sections": d.sections,
            "number": d.ok("shipping_bill.shipping_bill_number"),
            "exporter_code": d.ok("exporter.iec_number"),
            "item_count": d.item_count(),
            "commission": d.given("invoice.commission"),
            "exchange_rate": d.ok("invoice.exchange_rate"),
            "hs_code": d.count_of("hs_code") > 0,
            "leo_date": d.ok("shipping_bill.leo_date"),
            "dbk_rate": d.given("drawback.dbk_rate"),
            "dbk_amount": d.given("drawback.dbk_amount"),
            "rodtep": d.given("drawback.rodtep_amount"),
            "scheme": d.ok("drawback.scheme_description"),
            "line_fob": d.sum_of("fob_value"),
            "total_fob": d.amount("summary.total_fob_value"),
            "unread": d.unread("fob_value", "summary.total_fob_value"),
        }
    )
    return F.concat(found, d.weight_issues())


def generic_pack(spec: DocSpec, d: NestedFacts) -> Column:
    missing = {f.path: d.blank(f.path) for f in spec.fields if f.required}
    return generic_issues(missing, spec, d.item_count(), F.size(d.sections) == 0)


Pack = Callable[[DocSpec, NestedFacts], Column]

#: Packs by type key; a user may add more. A type without one gets the generic pack.
PACKS: dict[str, Pack] = {
    "purchase_order": order_pack,
    "igp": gate_pass_pack,
    "shipping_bill": shipping_pack,
}


def issues_for(
    spec: DocSpec, cells: Column, sections: Column, listed: Column | None = None, items: Column | None = None,
    header: Callable[[str], Any] | None = None,
) -> Column:
    """Issues of nested cells by the type's own pack or the generic one.

    ``items`` are the document's ``cells.items`` if they are a column: packs are then generated code.
    ``header`` gives the cell of a header path as columns, or None.
    """

    def by(pack: Pack) -> Column:
        if items is not None:
            return pack(spec, NestedFacts(spec, cells, sections, items, listed, header))
        held = cl.items(cells, spec.items_path or "items")
        return let(held, lambda found: pack(spec, NestedFacts(spec, cells, sections, found, listed)))

    own = PACKS.get(spec.key, generic_pack)
    return attempt(spec, lambda: by(own), lambda: by(generic_pack))
