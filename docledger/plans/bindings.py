"""Adapters: the star-schema, event and text tables as document data.

Each adapter reads whole tables and derives the domain columns from their own
values; only the columns it needs are selected, so scans stay pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.costs import cost, total_or_sum
from ..functions.dates import day_key, month_key
from ..operators import cells as cl
from ..operators.joins import lookup_join, spread
from ..sources.live_types import ORDER
from ..sources.specs import DocSpec


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def choose(selector: Column, options: dict[int, Column | str | None], default=None) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)

    out = lit(default).cast("string") if default is None else lit(default)
    for k, x in options.items():
        out = F.when(selector == k, lit(x)).otherwise(out)
    return out


# ---- files and documents ------------------------------------------------------


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as uploaded files; the suffix follows the language."""
    sfx = (
        F.when(F.col("source") == "src19", ".txt")
        .when(F.col("lang") == "en", ".pdf")
        .when(F.col("lang") == "fr", ".png")
        .when(F.col("lang") == "de", ".TIF")
        .otherwise(".jpeg")
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("doc"), text_of("doc_id"), sfx).alias("filename"),
        F.col("text").alias("content"),
        "lang", "source",
    )


def pages_of(text: Column) -> Column:
    return F.split(text, "\n")


CANDIDATES = [
    DocSpec("order_note", "Order Note", keywords=("the", "ing", "wh", "and")),
    DocSpec("notice", "Notice", keywords=("tion", "que", "eau", "aux")),
    DocSpec("permit", "Permit", keywords=("sch", "und", "der", "ich")),
    DocSpec("receipt", "Receipt", keywords=("ción", "los", "gst", "ent")),
]
EVENT_TYPES = [
    DocSpec("view", "Viewed Page"),
    DocSpec("click", "Clicked Page"),
    DocSpec("purchase", "Purchase"),
]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """A model's classification answers for the labelled documents."""
    answer = (
        F.when(F.col("toxic") == 1, '{"use_case_key": null, "document_type": "Memo"}')
        .when(F.col("quality") == 0, "no idea")
        .otherwise('{"use_case_key": "order_note", "confidence": 88}')
    )
    return table(spark, sf, "labels").select("doc_id", answer.alias("answer"))


def doc_status(spark: SparkSession, sf: str) -> DataFrame:
    """Session documents: status by label, issues by the toxic flag."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = table(spark, sf, "labels")
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "error").otherwise(
        "pending"
    )
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("lang").alias("key"),
        F.col("lang").alias("label"),
        F.col("source").alias("batch_id"),
        status.alias("status"),
        F.coalesce("toxic", F.lit(0)).alias("n_issues"),
        F.when(F.col("quality") == 1, F.pmod(F.col("n_chars"), F.lit(51)) + 50).alias("confidence"),
        (F.col("n_chars") / 100.0).alias("seconds"),
    )


# ---- usage --------------------------------------------------------------------


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Events as usage records."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    inp, out = k * 10, F.floor("value").cast("bigint")
    reported = F.when(F.col("event_id") % 4 == 0, F.lit(0).cast("bigint")).otherwise(
        inp + out + F.col("event_id") % 3
    )
    department = (
        F.when(F.col("event_type") == "purchase", "marketing")
        .when(F.col("event_type").isin("view", "click"), "store")
        .when(F.col("event_type") == "signup", "hr")
    )
    retry = F.col("event_type") == "error"
    return table(spark, sf, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        day_key(F.col("ts")).alias("date"),
        month_key(F.col("ts")).alias("month"),
        F.when(~retry, F.col("event_type")).alias("processor"),
        department.alias("department"),
        F.concat(F.lit("model-"), text_of(F.col("user_id") % 3)).alias("model"),
        F.when(retry, "retry").otherwise("default").alias("model_role"),
        retry.alias("is_retry"),
        F.floor(F.col("value") * 100).cast("bigint").alias("proc_ms"),
        inp.alias("input_tokens"),
        out.alias("output_tokens"),
        total_or_sum(reported, inp, out).alias("total_tokens"),
        cost(inp, out).alias("cost_inr"),
    )


# ---- orders -------------------------------------------------------------------


def printed_date(ts: Column, form: Column) -> Column:
    """A date printed in one of eight forms, the last one unreadable."""
    f = lambda p: F.date_format(ts, p)
    return choose(
        form,
        {
            0: f("yyyy-MM-dd"), 1: f("dd/MM/yyyy"), 2: f("dd-MM-yyyy"), 3: f("dd.MM.yyyy"),
            4: f("dd-MMM-yyyy"), 5: f("dd MMMM yyyy"), 6: f("dd/MM/yy"),
        },
        "n/a",
    )


def rupees(x: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(x, 2))


def orders_with_customer(spark: SparkSession, sf: str) -> DataFrame:
    orders = spread(table(spark, sf, "orders"), "o_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return lookup_join(orders, customer, "c_custkey", "left")


def order_values() -> dict[str, tuple[Column, str]]:
    """Order type paths from an order row and its customer."""
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    four = lambda x: F.lpad(text_of(x % 10000), 4, "0")
    gst = F.concat(
        F.lpad(text_of(c % 37), 2, "0"), F.lit("ABCDE"), four(c), F.lit("F1Z"), text_of(c % 10)
    )
    ref = F.concat(F.lit("REF-"), text_of(c))
    return {
        "purchase_order.po_number": (
            F.when(o % 11 == 0, "").when(o % 13 != 0, F.concat(F.lit("PO-"), text_of(o))), "string",
        ),
        "purchase_order.po_date": (printed_date(F.col("o_orderdate"), o % 8), "string"),
        "purchase_order.supplier_reference": (
            F.when(o % 3 == 0, F.concat(F.lit("  "), ref, F.lit(" \t"))).otherwise(ref), "string",
        ),
        "purchase_order.payment_terms": (F.col("o_orderpriority"), "string"),
        "purchase_order.currency": (F.when(o % 17 != 0, "INR"), "string"),
        "purchase_order.nature_of_supply": (F.col("o_orderstatus"), "string"),
        "buyer.company_name": (
            F.when(c % 5 == 0, F.concat("c_name", F.lit("\t"))).otherwise(F.col("c_name")), "string",
        ),
        "buyer.gst_number": (F.when(c % 4 == 1, "X1").when(c % 4 != 0, gst), "string"),
        "buyer.pan_number": (F.concat(F.lit("ABCDE"), four(c), F.lit("F")), "string"),
        "buyer.address": (F.concat("c_mktsegment", F.lit(" ROAD")), "string"),
        "supplier.gst_number": (
            F.concat(F.lit("27aaaaa"), four(o), F.lit("a1z5")), "string",
        ),
        "summary.subtotal": (F.col("o_totalprice"), "number"),
        "summary.igst": (F.when(o % 2 == 0, rupees(F.col("o_totalprice") / 8)), "string"),
        "summary.grand_total": (
            F.when(o % 4 == 3, "N/A").otherwise(rupees(F.col("o_totalprice"))), "string",
        ),
    }


def order_headers(spark: SparkSession, sf: str, keep: list[Column] | None = None) -> DataFrame:
    """``(doc_id, cells)`` of every order, normalized to the order type."""
    return orders_with_customer(spark, sf).select(
        F.col("o_orderkey").alias("doc_id"),
        *(keep or []),
        cl.header_from_columns(ORDER, order_values()).alias("cells"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def line_order() -> Column:
    """Line numbers repeat, so the order of an order's lines needs the other columns."""
    return F.struct(*LINE_ORDER)


def line_values() -> dict[str, tuple[Column, str]]:
    return {
        "line_number": (F.col("l_linenumber"), "string"),
        "material_code": (F.concat(F.lit(" P"), text_of("l_partkey")), "string"),
        "hsn_code": (F.lpad(text_of(F.col("l_suppkey")), 6, "0"), "string"),
        "quantity": (F.col("l_quantity"), "number"),
        "unit": (F.col("l_returnflag"), "string"),
        "unit_price": (
            F.when(F.col("l_discount") > 0.08, F.lit("free")).otherwise(
                rupees(F.col("l_extendedprice") / F.col("l_quantity"))
            ),
            "string",
        ),
        "taxable_amount": (F.col("l_extendedprice"), "number"),
        "gst_percent": (F.col("l_tax"), "number"),
    }


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, cells, amount)`` of every order line."""
    return spread(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey").select(
        F.col("l_orderkey").alias("doc_id"),
        cl.item_cells(ORDER, F.col("l_linenumber"), line_values()).alias("cells"),
        F.col("l_extendedprice").alias("amount"),
    )


def ai_scores() -> Column:
    """A model's own scores per path: in range, beyond it, and not a number."""
    o = F.col("o_orderkey")
    return F.create_map(
        F.lit("purchase_order.po_number"), choose(o % 5, {0: "94.5", 1: "95.5", 2: "-5", 3: "120"}, "x"),
        F.lit("buyer.gst_number"), choose(o % 3, {0: "60", 1: "inf"}, None),
        F.lit("summary.grand_total"), text_of(o % 101),
        F.lit("no.such.path"), F.lit("50"),
    )


# ---- orders as nested documents -----------------------------------------------


def nested_struct(values: dict[str, Column]) -> Column:
    """Dotted paths as nested structs."""
    blocks: dict[str, dict[str, Column]] = {}
    fields = []
    for path, value in values.items():
        head, _, rest = path.partition(".")
        if rest:
            blocks.setdefault(head, {})[rest] = value
        else:
            fields.append(value.alias(head))
    return F.struct(*fields, *[nested_struct(inner).alias(head) for head, inner in blocks.items()])


def json_of(values: dict[str, Column]) -> Column:
    return F.to_json(nested_struct(values), {"ignoreNullFields": "false"})


def with_members(raw: Column, members: Column) -> Column:
    """JSON text of an object with more members (``"name": value, ...``) at its end."""
    return F.concat(F.substring(raw, F.lit(1), F.length(raw) - 1), F.lit(", "), members, F.lit("}"))


def lines_json(spark: SparkSession, sf: str, item: Column) -> DataFrame:
    """``doc_id, items``: the JSON array of each order's lines, in line order.

    A nested document is one row, so an order's lines meet here as they would in a file.
    """
    order = F.struct(*LINE_ORDER, "l_quantity", "l_discount", "l_tax")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), order.alias("at"), item.alias("item")
    )
    whole = F.array_sort(F.collect_list(F.struct("at", "item")))
    texts = F.array_join(F.transform(whole, lambda x: x.item), ",")
    return rows.groupBy("doc_id").agg(F.concat(F.lit("["), texts, F.lit("]")).alias("items"))


def order_item_json() -> Column:
    """A line with a nested list that repeats the name of an amount."""
    values = {k: text_of(v) if t == "string" else v for k, (v, t) in line_values().items()}
    taxes = '"taxes": [{"taxable_amount": %s, "kind": "vat"}]'
    return with_members(json_of(values), F.format_string(taxes, text_of("l_tax")))


#: Members that no schema has: names with dots, and twenty levels.
DOTS = {0: '"note.a": "x", "note": {"a": 5}', 1: '"note": {"a": 5}, "note.a": "x"'}
DEEP = '"deep": ' + '{"d": ' * 20 + "true" + "}" * 20


def nested_orders(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, filename, raw)``: every order with all its lines as one JSON text."""
    o = F.col("o_orderkey")
    lines = lines_json(spark, sf, order_item_json())
    # the first line's amount cannot be read in one order of ten, and is text in another
    amount = r'("taxable_amount":)[0-9.E]+'
    odd = choose(F.col("doc_id") % 10, {3: '$1"free"', 7: '$1"1e3"'})
    first = F.regexp_extract(F.col("items"), r"^.*?" + amount, 0)
    rest = F.substring(F.col("items"), F.length(first) + 1, F.length("items"))
    changed = F.concat(F.regexp_replace(first, F.lit(amount), odd), rest)
    lines = lines.withColumn("items", F.when(odd.isNotNull(), changed).otherwise(F.col("items")))
    header = json_of({p: v for p, (v, _) in order_values().items()} | {"metadata.source.pages": F.lit(1)})
    without = F.regexp_replace(header, r'"supplier":\{[^}]*\},', "")
    orders = orders_with_customer(spark, sf).select(
        o.alias("doc_id"), F.concat(F.lit("order"), text_of(o), F.lit(".pdf")).alias("filename"),
        F.when(o % 6 == 1, without).otherwise(header).alias("header"),
    )
    both = orders.join(lines, "doc_id", "left")
    k = F.col("doc_id")
    members = F.concat_ws(
        ", ", choose(k % 2, DOTS), F.when(k % 3 == 0, DEEP),
        F.concat(F.lit('"items": '), F.coalesce("items", F.lit("[]"))),
    )
    return both.select("doc_id", "filename", with_members(F.col("header"), members).alias("raw"))


def mixed_batch(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Every order as an uploaded document of one of three types, with all its lines.

    ``documents(doc_id, filename, page)``, ``answers(doc_id, answer)`` of a classifying model,
    ``responses(doc_id, raw_text, error)`` of an extracting one. Some documents have no
    answer, some answers cannot be used, some responses fail or are missing.
    """
    k = F.col("l_orderkey")
    quantity = F.when(F.col("l_partkey") % 13 != 0, F.concat(text_of("l_quantity"), F.lit(" KG")))
    order_item = {p: text_of(v) if t == "string" else v for p, (v, t) in line_values().items()}
    gate_item = {"line_number": text_of("l_linenumber"), "quantity": quantity, "unit": F.col("l_returnflag")}
    ship_item = {
        "line_number": text_of("l_linenumber"), "fob_value": F.col("l_extendedprice"),
        "hs_code": F.when(F.col("l_returnflag") == "R", F.lpad(text_of("l_partkey"), 6, "0")),
        "gross_weight": F.col("l_quantity"), "net_weight": net_weight(),
    }
    items = lines_json(spark, sf, choose(k % 3, {0: json_of(order_item), 1: json_of(gate_item)}, json_of(ship_item)))

    o, n = F.col("o_orderkey"), text_of("o_orderkey")
    gate = {
        "metadata.document_type": F.lit("IGP"),
        "gate_pass.gate_pass_number": F.when(o % 7 != 0, F.concat(F.lit("GP"), n)),
        "gate_pass.entry_date": F.date_format("o_orderdate", "dd.MM.yyyy"),
        "purchase_order.po_number": F.when(o % 5 != 0, F.concat(F.lit("PO"), n)).otherwise(""),
        "vendor.code": F.when(o % 4 != 0, text_of("c_custkey")),
        "delivery.vehicle_number": F.when(o % 6 != 0, F.concat(F.lit("KA"), n)),
    }
    bill = ship_columns()
    paths = {
        "sb_number": "shipping_bill.shipping_bill_number", "leo_date": "shipping_bill.leo_date", "iec": "exporter.iec_number",
        "invoice_fob": "invoice.fob_value", "exchange_rate": "invoice.exchange_rate", "commission": "invoice.commission",
        "summary_fob": "summary.total_fob_value", "dbk_rate": "drawback.dbk_rate", "dbk_amount": "drawback.dbk_amount",
        "rodtep": "drawback.rodtep_amount", "scheme": "drawback.scheme_description",
    }
    ship = {"metadata.source.pages": F.lit(1), "consignee.name": F.lit("Port Co")} | {paths[c]: v for c, v in bill.items() if c in paths}
    order = {p: v for p, (v, _) in order_values().items()} | {"metadata.source.pages": F.lit(1)}
    orders = orders_with_customer(spark, sf)
    raw = choose(o % 3, {0: json_of(order), 1: json_of(gate)}, json_of(ship))
    page = F.when(o % 9 == 4, "Nothing known").otherwise(
        choose(o % 3, {0: "Purchase Order for the buyer", 1: "Inward Gate Pass, vehicle no. 5"}, "Shipping Bill, customs, drawback")
    )
    key = choose(o % 3, {0: "purchase_order", 1: "igp"}, "shipping_bill")
    answer = choose(o % 20, {
        0: F.concat(F.lit('{"use_case_key": "'), key, F.lit('"}')),
        1: '{"use_case_key": "memo", "document_type": "Memo"}', 5: "no idea",
    })
    headers = orders.select(o.alias("doc_id"), raw.alias("header"))
    d = F.col("doc_id")
    whole = with_members(F.col("header"), F.concat(F.lit('"items": '), F.coalesce("items", F.lit("[]"))))
    failed = choose(d % 13, {1: "AI service temporarily unavailable."})
    text = choose(d % 13, {1: None, 2: F.substring(whole, F.lit(1), F.length(whole) - 9), 3: "[1]", 4: F.concat(F.lit("```json\n"), whole, F.lit("\n```"))}, whole)
    return {
        "documents": table(spark, sf, "orders").select(o.alias("doc_id"), F.concat(F.lit("doc"), n, F.lit(".pdf")).alias("filename"), page.alias("page")),
        "answers": table(spark, sf, "orders").select(o.alias("doc_id"), answer.alias("answer")).where("answer IS NOT NULL"),
        "responses": headers.where(d % 13 != 0).join(items, "doc_id", "left").select("doc_id", text.alias("raw_text"), failed.alias("error")),
    }


def fenced(raw: Column, key: Column) -> Column:
    """A model's answer around a JSON text; one in eight is cut short."""
    return choose(
        key % 8,
        {
            1: F.concat(F.lit("```json\n"), raw, F.lit("\n```")),
            2: F.concat(F.lit("Here it is:\n"), raw, F.lit("\nDone.")),
            5: F.substring(raw, F.lit(1), F.length(raw) - 9),
        },
        raw,
    )


# ---- shipping bills and gate passes -------------------------------------------


def ship_columns() -> dict[str, Column]:
    """Shipping-bill facts of an order row."""
    o = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return {
        "sb_number": F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("SB"), text_of(o))),
        "iec": F.when(o % 9 != 0, text_of(o)),
        "commission": F.when(o % 7 != 0, price / 1000),
        "exchange_rate": choose(o % 5, {0: None, 1: "0"}, "83.5"),
        "leo_date": F.when(F.col("o_orderpriority") != "5-LOW", day_key(F.col("o_orderdate"))),
        "dbk_rate": F.when(o % 6 == 0, F.lit("1.5")),
        "dbk_amount": F.when(o % 10 != 3, text_of(price / 50)),
        "rodtep": F.when(o % 8 != 0, F.lit("0")),
        "scheme": F.when(o % 4 != 0, F.col("o_orderpriority")).otherwise(""),
        "invoice_fob": F.when(o % 4 == 0, "0").otherwise(text_of(price)),
        "summary_fob": text_of(price * 2),
        "shift": o % 5,
    }


def ship_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Shipping-bill facts of every order."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), *[c.alias(n) for n, c in ship_columns().items()]
    )


def net_weight() -> Column:
    """Net weight of a line: above the gross weight, its quantity, at high discounts."""
    off = F.when(F.col("l_discount") >= 0.1, 0.5).when(F.col("l_discount") >= 0.09, 0.01).otherwise(-0.5)
    return F.col("l_quantity") + off


def ship_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Shipping-bill lines: gross weight is the quantity, net exceeds it at high discounts."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", F.lpad(text_of("l_partkey"), 6, "0")).alias("hs_code"),
        F.col("l_extendedprice").alias("fob_value"),
        F.col("l_quantity").alias("gross"),
        net_weight().alias("net"),
    )


# ---- catalogs -----------------------------------------------------------------


def departments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(
        F.concat(F.lit("d_"), text_of("r_regionkey")).alias("key"),
        F.initcap("r_name").alias("name"),
        F.col("r_regionkey").alias("department_order"),
    )


def types(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as document types of four of the five departments (regions)."""
    n = F.col("n_nationkey")
    status = choose(
        n % 4, {0: "production", 1: "testing", 2: "draft"}, "coming_soon"
    )
    region = F.when(F.col("n_regionkey") == 4, F.lit(9)).otherwise(F.col("n_regionkey"))
    return table(spark, sf, "nation").select(
        F.lower("n_name").alias("key"),
        F.when(n % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("business_process"),
        F.initcap(F.replace(F.col("n_name"), F.lit("_"), F.lit(" "))).alias("label"),
        F.concat(F.lit("d_"), text_of(region)).alias("department"),
        region.alias("department_order"),
        status.alias("status"),
    )


def manifest_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as manifest texts: minimal, full, with bad status, kind, key or JSON."""
    p = F.col("p_partkey")
    kind = choose(p % 50, {7: "bogus"}, "number")
    fld = lambda path, label, k, req: F.struct(
        F.lit(path).alias("path"), F.lit(label).cast("string").alias("label"),
        (k if isinstance(k, Column) else F.lit(k).cast("string")).alias("kind"),
        F.lit(req).cast("boolean").alias("required"),
    )
    sections = F.array(
        F.struct(
            F.lit("Main").alias("title"),
            F.array(
                fld("head.name", "Name", None, None),
                F.when(p % 3 == 0, fld("head.code", "Code", "text", True)).otherwise(
                    fld("head.code", "Code", "text", None)
                ),
            ).alias("fields"),
        ),
        F.struct(
            F.lit(None).cast("string").alias("title"),
            F.array(
                F.when(p % 2 == 0, fld("sum.total", None, kind, None)).otherwise(
                    fld("sum.rest", None, kind, None)
                )
            ).alias("fields"),
        ),
    )
    body = F.struct(
        F.when(p % 10 == 9, F.lit("  "))
        .when(p % 10 != 8, F.concat(F.lit("part_"), text_of(p)))
        .alias("key"),
        F.when(p % 3 != 0, F.col("p_name")).alias("document_type"),
        F.when(p % 4 != 0, F.col("p_brand")).alias("business_process"),
        choose(
            p % 6, {0: "production", 1: "testing", 2: "draft", 3: "coming_soon", 4: "retired"}
        ).alias("status"),
        choose(p % 7, {0: "", 1: "abc", 2: F.concat(text_of("p_size"), F.lit(".5")), 3: text_of("p_size")}).alias(
            "accuracy"
        ),
        F.when(
            p % 9 != 0,
            F.struct(
                F.concat(F.lit("dept_"), text_of(F.col("p_size") % 8)).alias("key"),
                F.col("p_type").alias("name"),
                (F.col("p_size") % 8).alias("order"),
            ),
        ).alias("department"),
        F.split(F.upper("p_name"), " ").alias("keywords"),
        F.when(p % 11 != 0, sections).alias("sections"),
        F.when(
            p % 2 == 0,
            F.struct(
                F.lit("items").alias("path"),
                F.array(
                    F.struct(F.lit("qty").alias("key"), F.lit(None).cast("string").alias("label"), F.lit("number").alias("kind")),
                    F.struct(F.lit("unit").alias("key"), F.lit("Unit").alias("label"), F.lit(None).cast("string").alias("kind")),
                ).alias("columns"),
            ),
        ).alias("line_items"),
        F.when(
            p % 5 == 0,
            F.struct(F.array(fld("head.name", None, None, None), fld("", "Void", None, None)).alias("required")),
        ).alias("sap"),
        F.when(
            p % 4 == 1,
            F.struct(
                F.array(
                    F.struct(F.lit(None).cast("string").alias("header"), F.lit("head.name").alias("path"), F.lit(None).cast("string").alias("agg")),
                    F.struct(F.lit("Qty").alias("header"), F.lit("items.qty").alias("path"), F.lit("sum").alias("agg")),
                ).alias("columns")
            ),
        ).alias("export"),
    )
    text = F.to_json(body)
    broken = F.substring(text, F.lit(1), F.length(text) - 5)
    return spread(table(spark, sf, "part"), "p_partkey").select(
        F.when(p % 25 == 24, broken).otherwise(text).alias("raw")
    )
