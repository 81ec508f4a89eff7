"""Header and line tables: cross-checks, rule packs, registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import register, rules
from ..operators.joins import lookup_join
from ..plans import bindings as b
from .registry import query
from .scalars import _SHIP

_SUMS = """
li AS (SELECT l_orderkey AS doc_id, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_sum FROM lineitem GROUP BY 1),
od AS (SELECT o_orderkey AS doc_id, coalesce(n, 0) AS n, coalesce(line_sum, 0)::DOUBLE AS line_sum,
  CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE round(coalesce(line_sum, 0)::DOUBLE + (o_orderkey % 5) * 0.4::DOUBLE, 2) END AS subtotal, o_orderkey % 11 <> 0 AS has_po
  FROM orders LEFT JOIN li ON o_orderkey = li.doc_id)
"""


def _order_facts(spark, sf):
    """Orders with the exact sum and count of their lines (one combined aggregate)."""
    sums = (
        b.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"),
        )
    )
    o = F.col("doc_id")
    joined = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id")).join(
        sums, "doc_id", "left"
    )
    line_sum = F.coalesce(F.col("s").cast("double"), F.lit(0.0))
    subtotal = F.when(o % 19 == 0, 0.0).otherwise(F.round(line_sum + (o % 5) * 0.4, 2))
    return joined.select(
        "doc_id", F.coalesce("n", F.lit(0)).alias("n"), line_sum.alias("line_sum"),
        subtotal.alias("subtotal"), (o % 11 != 0).alias("has_po"),
    )


@query("order_crosscheck", f"""
WITH {_SUMS}
SELECT doc_id, round(line_sum, 2) AS line_sum, round(subtotal, 2) AS subtotal FROM od
WHERE subtotal <> 0 AND abs(line_sum - subtotal) > 1.0
""")
def order_crosscheck(spark, sf):
    off, found = rules.cross_check(
        "subtotal", F.col("line_sum"), F.col("subtotal"), "Subtotal", "summary subtotal"
    )
    return _order_facts(spark, sf).where(off).select("doc_id", found.alias("i")).select(
        "doc_id", F.col("i.a").alias("line_sum"), F.col("i.b").alias("subtotal")
    )


@query("validate_order", f"""
WITH {_SUMS}
SELECT doc_id, 'order_number' AS rule, 'Order number is missing.' AS message FROM od WHERE NOT has_po
UNION ALL SELECT doc_id, 'no_items', 'No line items were extracted.' FROM od WHERE n = 0
UNION ALL SELECT doc_id, 'subtotal', 'Subtotal mismatch: line items sum to ' || printf('%.2f', line_sum) ||
  ' but summary subtotal is ' || printf('%.2f', subtotal) || '.' FROM od WHERE subtotal <> 0 AND abs(line_sum - subtotal) > 1.0
""")
def validate_order(spark, sf):
    found = rules.order_issues(
        {
            "po_number": F.col("has_po"), "item_count": F.col("n"),
            "line_sum": F.col("line_sum"), "subtotal": F.col("subtotal"),
        }
    )
    return _issue_rows(_order_facts(spark, sf), found)


def _issue_rows(docs, found):
    return docs.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.rule", "i.message")


_FOB = f"""
{_SHIP},
sl AS (SELECT l_orderkey AS doc_id, l_linenumber, l_quantity AS gross,
  l_quantity + CASE WHEN l_discount >= 0.1::DOUBLE THEN 0.5::DOUBLE WHEN l_discount >= 0.09::DOUBLE THEN 0.01::DOUBLE ELSE -0.5::DOUBLE END AS net,
  l_returnflag = 'R' AS hs, l_extendedprice FROM lineitem),
sa AS (SELECT doc_id, count(*) AS n, bool_or(hs) AS hs, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS fob FROM sl GROUP BY 1),
sf AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(hs, FALSE) AS hs, coalesce(fob, 0) AS line_fob,
  round(coalesce(fob, 0) + shift * 0.4::DOUBLE, 2) AS total_fob FROM s LEFT JOIN sa ON s.doc_id = sa.doc_id)
"""


def _ship_facts(spark, sf):
    lines = b.ship_lines(spark, sf)
    sums = lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("hs_code").isNotNull()).alias("hs"),
        F.sum(F.col("fob_value").cast("decimal(18,2)")).cast("double").alias("fob"),
    )
    zero = F.lit(0.0)
    return b.ship_headers(spark, sf).join(sums, "doc_id", "left").select(
        "*",
        F.coalesce("fob", zero).alias("line_fob"),
        F.round(F.coalesce("fob", zero) + F.col("shift") * 0.4, 2).alias("total_fob"),
    )


@query("fob_crosscheck", f"""
WITH {_FOB} SELECT doc_id, round(line_fob, 2) AS line_fob, round(total_fob, 2) AS total_fob FROM sf
WHERE total_fob <> 0 AND abs(line_fob - total_fob) > 1.0
""")
def fob_crosscheck(spark, sf):
    off, found = rules.cross_check(
        "fob", F.col("line_fob"), F.col("total_fob"), "FOB", "summary total FOB value"
    )
    return _ship_facts(spark, sf).where(off).select("doc_id", found.alias("i")).select(
        "doc_id", F.col("i.a").alias("line_fob"), F.col("i.b").alias("total_fob")
    )


_SHIP_RULES = [
    ("bill_number", "sb_number IS NULL"), ("exporter_code", "iec IS NULL"), ("no_items", "n = 0"),
    ("commission", "commission IS NULL"), ("exchange_rate", "exchange_rate IS NULL OR exchange_rate = '0'"),
    ("hs_code", "NOT hs"), ("leo_date", "leo_date IS NULL"), ("dbk_rate", "dbk_rate IS NULL"),
    ("dbk_amount", "dbk_amount IS NULL"), ("rodtep", "rodtep IS NULL"), ("scheme", "scheme = ''"),
    ("fob", "total_fob <> 0 AND abs(line_fob - total_fob) > 1.0"),
]


@query("validate_shipping", f"WITH {_FOB}\n" + "\nUNION ALL ".join(
    f"SELECT doc_id, NULL::INT AS line, '{r}' AS rule, NULL::DOUBLE AS net, NULL::DOUBLE AS gross FROM sf WHERE {w}"
    for r, w in _SHIP_RULES if r != "fob"
) + """
UNION ALL SELECT doc_id, NULL, 'fob', round(line_fob, 2), round(total_fob, 2) FROM sf WHERE total_fob <> 0 AND abs(line_fob - total_fob) > 1.0
UNION ALL SELECT doc_id, l_linenumber, 'line_weight', net, gross FROM sl WHERE net > gross + 0.01::DOUBLE AND gross <> 0 AND net <> 0
""")
def validate_shipping(spark, sf):
    """Document rules from summed facts; each weight violation from its own line row."""
    c = F.col
    zero_rate = c("exchange_rate").isNotNull() & (c("exchange_rate") != "0")
    facts = {
        "number": c("sb_number").isNotNull(), "exporter_code": c("iec").isNotNull(),
        "item_count": F.coalesce("n", F.lit(0)), "commission": c("commission").isNotNull(),
        "exchange_rate": zero_rate, "hs_code": F.coalesce("hs", F.lit(False)),
        "leo_date": c("leo_date").isNotNull(), "dbk_rate": c("dbk_rate").isNotNull(),
        "dbk_amount": c("dbk_amount").isNotNull(), "rodtep": c("rodtep").isNotNull(),
        "scheme": c("scheme") != "", "line_fob": c("line_fob"), "total_fob": c("total_fob"),
    }
    per_doc = _ship_facts(spark, sf).select(
        "doc_id", F.lit(None).cast("int").alias("line"),
        F.explode(rules.shipping_issues(facts)).alias("i"),
    )
    weight = rules.weight_issue(c("l_linenumber").cast("string"), c("gross"), c("net"))
    per_line = b.ship_lines(spark, sf).where(rules.weight_violation(c("gross"), c("net"))).select(
        "doc_id", c("l_linenumber").alias("line"), weight.alias("i")
    )
    return per_doc.unionByName(per_line).select(
        "doc_id", "line", "i.rule", F.col("i.a").alias("net"), F.col("i.b").alias("gross")
    )


_GATE = """
gl AS (SELECT l_orderkey AS doc_id, l_quantity > 25 AS qty, l_quantity > 5 AS filled,
  CASE WHEN s_suppkey % 7 <> 0 THEN s_name END AS vendor FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey),
ga AS (SELECT doc_id, count(*) FILTER (filled) AS real_items, count(*) FILTER (qty) AS quantities, bool_or(vendor IS NOT NULL) AS vendor FROM gl GROUP BY 1),
gf AS (SELECT o_orderkey AS doc_id, coalesce(real_items, 0) AS real_items, coalesce(quantities, 0) AS quantities,
  coalesce(vendor, FALSE) AS vendor, o_orderkey % 11 <> 0 OR o_orderstatus = 'F' AS identified, o_orderpriority <> '5-LOW' AS vehicle
  FROM orders LEFT JOIN ga ON o_orderkey = ga.doc_id)
"""
_GATE_RULES = """
SELECT doc_id, 'identifier' AS rule, 'No PO number or gate pass / material document number was found.' AS message FROM gf WHERE NOT identified
UNION ALL SELECT doc_id, 'vendor', 'Vendor is not identified (no vendor code or name).' FROM gf WHERE NOT vendor
UNION ALL SELECT doc_id, 'no_items', 'No material line items were extracted.' FROM gf WHERE real_items = 0
UNION ALL SELECT doc_id, 'no_quantity', 'No material quantity was extracted.' FROM gf WHERE real_items > 0 AND quantities = 0
UNION ALL SELECT doc_id, 'vehicle', 'Vehicle number is missing.' FROM gf WHERE NOT vehicle
"""


def _gate_facts(spark, sf):
    suppliers = b.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_name")).alias("vendor"),
    )
    lines = b.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    q = F.col("l_quantity")
    sums = (
        lookup_join(lines, suppliers, "l_suppkey", "left")
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(
            F.count_if(q > 5).alias("real_items"),
            F.count_if(q > 25).alias("quantities"),
            F.bool_or(F.col("vendor").isNotNull()).alias("vendor"),
        )
    )
    zero = F.lit(0).cast("bigint")
    orders = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        ((F.col("o_orderkey") % 11 != 0) | (F.col("o_orderstatus") == "F")).alias("identified"),
        (F.col("o_orderpriority") != "5-LOW").alias("vehicle"),
    )
    return orders.join(sums, "doc_id", "left").select(
        "doc_id", "identified", "vehicle",
        F.coalesce("vendor", F.lit(False)).alias("vendor"),
        F.coalesce("real_items", zero).alias("real_items"),
        F.coalesce("quantities", zero).alias("quantities"),
    )


_GATE_FACTS = ("identified", "vehicle", "vendor", "real_items", "quantities")


@query("validate_gate_pass", f"WITH {_GATE} {_GATE_RULES}")
def validate_gate_pass(spark, sf):
    found = rules.gate_pass_issues({k: F.col(k) for k in _GATE_FACTS})
    return _issue_rows(_gate_facts(spark, sf), found)


@query("validate_all", f"""
WITH {_SUMS}, {_GATE}, {_FOB},
every AS (SELECT 'purchase_order' AS type_key, doc_id, 'order_number' AS rule FROM od WHERE NOT has_po
  UNION ALL SELECT 'purchase_order', doc_id, 'no_items' FROM od WHERE n = 0
  UNION ALL SELECT 'purchase_order', doc_id, 'subtotal' FROM od WHERE subtotal <> 0 AND abs(line_sum - subtotal) > 1.0
  UNION ALL SELECT 'igp', doc_id, rule FROM ({_GATE_RULES})
""" + "\n".join(
    f"UNION ALL SELECT 'shipping_bill', doc_id, '{r}' FROM sf WHERE {w}" for r, w in _SHIP_RULES
) + """
  UNION ALL SELECT 'shipping_bill', doc_id, 'line_weight' FROM sl WHERE net > gross + 0.01::DOUBLE AND gross <> 0 AND net <> 0)
SELECT type_key, rule, count(*) AS n FROM every GROUP BY ALL
""")
def validate_all(spark, sf):
    """Every pack on its own documents, counted by type and rule."""
    parts = {
        "purchase_order": validate_order(spark, sf),
        "igp": validate_gate_pass(spark, sf),
        "shipping_bill": validate_shipping(spark, sf),
    }
    rows = None
    for key, issues in parts.items():
        part = issues.select(F.lit(key).alias("type_key"), "rule")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("type_key", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("real_items", """
WITH v AS (SELECT l_orderkey AS doc_id, l_quantity > 40 AND l_discount > 0.05::DOUBLE AS blank, l_returnflag = 'R' AS hs FROM lineitem)
SELECT doc_id, count(*) AS n_items, count(*) FILTER (NOT blank) AS n_real, bool_or(NOT blank) AS any_quantity,
  bool_or(hs) AS any_code FROM v GROUP BY doc_id
""")
def real_items(spark, sf):
    blank = (F.col("l_quantity") > 40) & (F.col("l_discount") > 0.05)
    values = F.array(
        F.when(~blank, F.col("l_quantity").cast("string")), F.when(blank, F.lit(""))
    )
    real = F.exists(values, lambda v: v.isNotNull() & (v != ""))
    rows = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), real.alias("real"),
        (F.col("l_returnflag") == "R").alias("hs"),
    )
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("real").alias("n_real"),
        F.bool_or("real").alias("any_quantity"), F.bool_or("hs").alias("any_code"),
    )


_TEXTS = """
t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn,
  CASE WHEN l_linenumber > 1 THEN 'P' || l_partkey ELSE '' END AS material, l_returnflag AS unit,
  CASE WHEN l_tax > 0.06::DOUBLE THEN 'n/a' ELSE l_quantity::VARCHAR END AS quantity FROM lineitem)
"""


def _line_texts(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        *b.LINE_ORDER,
        F.when(F.col("l_linenumber") > 1, F.concat(F.lit("P"), b.text_of("l_partkey"))).otherwise("").alias(
            "material"
        ),
        F.col("l_returnflag").alias("unit"),
        F.when(F.col("l_tax") > 0.06, "n/a").otherwise(b.text_of("l_quantity")).alias("quantity"),
    )


@query("register_orders", f"""
WITH {_TEXTS}, f AS (SELECT doc_id, arg_min(material, rn) FILTER (material <> '') AS material, arg_min(unit, rn) AS unit,
  coalesce(sum(TRY_CAST(quantity AS DECIMAL(28,6))), 0)::DOUBLE AS quantity FROM t GROUP BY doc_id)
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'PO-' || o_orderkey END AS "PO NO",
  strftime(o_orderdate, '%Y-%m-%d') AS "PO DATE", c_name AS "VENDOR NAME", f.material AS "MATERIAL NO.", f.unit AS "UNIT",
  f.quantity AS "QUANTITY", o_totalprice AS "NET VAL IN DOC CURR"
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN f ON o_orderkey = f.doc_id
""")
def register_orders(spark, sf):
    """One register row per order: header values, first and summed line values."""
    columns = [
        ("MATERIAL NO.", "material", "first"), ("UNIT", "unit", "first"), ("QUANTITY", "quantity", "sum"),
    ]
    items = register.line_aggregates(_line_texts(spark, sf), "doc_id", b.line_order(), columns)
    o = F.col("o_orderkey")
    headers = b.orders_with_customer(spark, sf).select(
        o.alias("doc_id"),
        F.when(o % 11 != 0, F.concat(F.lit("PO-"), b.text_of(o))).alias("PO NO"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("PO DATE"),
        F.col("c_name").alias("VENDOR NAME"),
        F.col("o_totalprice").alias("NET VAL IN DOC CURR"),
    )
    return headers.join(items, "doc_id", "left")


@query("register_join", f"""
WITH {_TEXTS}, d AS (SELECT doc_id, unit, min(rn) AS spot FROM t GROUP BY ALL),
m AS (SELECT doc_id, material, min(rn) AS spot FROM t WHERE material <> '' GROUP BY ALL),
u AS (SELECT doc_id, string_agg(unit, ', ' ORDER BY spot) AS units FROM d GROUP BY 1),
w AS (SELECT doc_id, string_agg(material, ', ' ORDER BY spot) AS materials FROM m GROUP BY 1)
SELECT u.doc_id, units, materials FROM u LEFT JOIN w ON u.doc_id = w.doc_id
""")
def register_join(spark, sf):
    return register.line_aggregates(
        _line_texts(spark, sf), "doc_id", b.line_order(),
        [("units", "unit", "join"), ("materials", "material", "join")],
    )


@query("export_items", """
SELECT l_orderkey AS doc_id, l_linenumber AS line_number, p_name AS description, lpad(l_suppkey::VARCHAR, 6, '0') AS hsn_code,
  l_quantity AS quantity, l_returnflag AS unit, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS taxable_amount,
  NULL::VARCHAR AS gst_type, l_tax AS gst_percent
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
""")
def export_items(spark, sf):
    parts = b.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    lines = b.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_tax", "l_returnflag",
    )
    return lookup_join(lines, parts, "l_partkey", "left").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("p_name").alias("description"),
        F.lpad(b.text_of("l_suppkey"), 6, "0").alias("hsn_code"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_returnflag").alias("unit"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        F.col("l_extendedprice").alias("taxable_amount"),
        F.lit(None).cast("string").alias("gst_type"),
        F.col("l_tax").alias("gst_percent"),
    )
