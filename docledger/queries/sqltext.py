"""SQL fragments of the checking queries, written apart from the Spark operators."""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(13)"

FILES = """
files AS (
  SELECT doc_id, text, lang, source, sha1(text) AS sha1,
    'doc' || doc_id || CASE WHEN source = 'src19' THEN '.txt' WHEN lang = 'en' THEN '.pdf'
      WHEN lang = 'fr' THEN '.png' WHEN lang = 'de' THEN '.TIF' ELSE '.jpeg' END AS filename
  FROM documents)
"""

USAGE = """
usage0 AS (
  SELECT event_id, ts, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m') AS month,
    CASE WHEN event_type <> 'error' THEN event_type END AS processor,
    CASE event_type WHEN 'purchase' THEN 'marketing' WHEN 'view' THEN 'store'
      WHEN 'click' THEN 'store' WHEN 'signup' THEN 'hr' END AS department,
    'model-' || (user_id % 3) AS model,
    CASE WHEN event_type = 'error' THEN 'retry' ELSE 'default' END AS model_role,
    event_type = 'error' AS is_retry,
    CAST(floor(value * 100) AS BIGINT) AS proc_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS input_tokens,
    CAST(floor(value) AS BIGINT) AS output_tokens
  FROM events),
usage AS (
  SELECT *, CASE WHEN event_id % 4 = 0 THEN input_tokens + output_tokens
      ELSE input_tokens + output_tokens + event_id % 3 END AS total_tokens,
    CAST(printf('%.4f', input_tokens / 1000.0::DOUBLE * 0.03::DOUBLE
      + output_tokens / 1000.0::DOUBLE * 0.12::DOUBLE) AS DECIMAL(18,4)) AS cost_inr
  FROM usage0)
"""

STATUS = """
docs AS (
  SELECT d.doc_id, d.lang AS key, d.source AS batch_id, d.n_chars,
    CASE l.quality WHEN 1 THEN 'done' WHEN 0 THEN 'error' ELSE 'pending' END AS status,
    coalesce(l.toxic, 0) AS n_issues,
    CASE WHEN l.quality = 1 THEN d.n_chars % 51 + 50 END AS confidence,
    d.n_chars / 100.0::DOUBLE AS seconds
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
"""

TYPES = """
types AS (
  SELECT lower(n_name) AS key,
    CASE WHEN n_nationkey % 3 = 0 THEN lower(n_name) ELSE n_name END AS business_process,
    'Nation ' || split_part(n_name, '_', 2) AS label,
    'd_' || CASE WHEN n_regionkey = 4 THEN 9 ELSE n_regionkey END AS department,
    CASE WHEN n_regionkey = 4 THEN 9 ELSE n_regionkey END AS department_order,
    CASE n_nationkey % 4 WHEN 0 THEN 'production' WHEN 1 THEN 'testing' WHEN 2 THEN 'draft'
      ELSE 'coming_soon' END AS status
  FROM nation)
"""


def iso(v: str) -> str:
    """ISO date text of ``v`` by explicit formats behind full-match guards."""
    x = f"regexp_replace(trim({v}, {WS}), '\\s+', ' ', 'g')"
    forms = [
        (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
        (r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
        (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"),
        (r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"),
        (r"\d{1,2}/\d{1,2}/\d{2}", "%d/%m/%y"),
        (r"\d{1,2}-\d{1,2}-\d{2}", "%d-%m-%y"),
        (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "%d-%b-%Y"),
        (r"\d{1,2}-[A-Za-z]{3}-\d{2}", "%d-%b-%y"),
        (r"\d{1,2} [A-Za-z]{3} \d{4}", "%d %b %Y"),
        (r"\d{1,2} [A-Za-z]{3,} \d{4}", "%d %B %Y"),
        (r"\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"),
    ]
    whens = " ".join(
        f"WHEN regexp_full_match({x}, '{p}') AND try_strptime({x}, '{f}') IS NOT NULL "
        f"THEN strftime(try_strptime({x}, '{f}'), '%Y-%m-%d')"
        for p, f in forms
    )
    return f"(CASE {whens} END)"


def number(v: str) -> str:
    return f"TRY_CAST(nullif(regexp_replace({v}, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE)"


def heuristic(v: str, t: str) -> str:
    s = f"trim({v}, {WS})"
    return f"""(CASE WHEN {v} IS NULL OR {t} = 'null' THEN 0 WHEN {t} = 'bool' THEN 99
      WHEN {t} = 'number' THEN CASE WHEN CAST({v} AS DOUBLE) = 0 THEN 80 ELSE 97 END
      WHEN {s} = '' THEN 0
      WHEN regexp_full_match(upper({s}), '[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}[A-Z][0-9A-Z]Z[0-9A-Z]')
        OR regexp_full_match(upper({s}), '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 99
      WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}[/-]\\d{{2}}[/-]\\d{{2,4}}') THEN 96
      WHEN regexp_full_match({s}, '\\d{{4,8}}') THEN 98
      WHEN length({s}) <= 2 THEN 78 ELSE 92 END)"""


def band(score: str) -> str:
    return f"(CASE WHEN {score} >= 95 THEN 'high' WHEN {score} >= 75 THEN 'review' ELSE 'verify' END)"


def printed(ts: str, form: str) -> str:
    return f"""(CASE {form} WHEN 0 THEN strftime({ts}, '%Y-%m-%d') WHEN 1 THEN strftime({ts}, '%d/%m/%Y')
      WHEN 2 THEN strftime({ts}, '%d-%m-%Y') WHEN 3 THEN strftime({ts}, '%d.%m.%Y')
      WHEN 4 THEN strftime({ts}, '%d-%b-%Y') WHEN 5 THEN strftime({ts}, '%d %B %Y')
      WHEN 6 THEN strftime({ts}, '%d/%m/%y') ELSE 'n/a' END)"""


# path, label, section, kind, critical position, value, type, default, default type
ORDER_ROWS = [
    ("purchase_order.po_number", "Order Number", "Order", "text", 1,
     "CASE WHEN o % 11 = 0 THEN '' WHEN o % 13 <> 0 THEN 'PO-' || o END", "string", "''", "string"),
    ("purchase_order.po_date", "Order Date", "Order", "date", 2,
     printed("o_orderdate", "o % 8"), "string", "''", "string"),
    ("purchase_order.supplier_reference", "Supplier Reference", "Order", "text", 0,
     "CASE WHEN o % 3 = 0 THEN '  REF-' || c || ' ' || chr(9) ELSE 'REF-' || c END",
     "string", "''", "string"),
    ("purchase_order.payment_terms", "Payment Terms", "Order", "text", 0,
     "o_orderpriority", "string", "''", "string"),
    ("purchase_order.currency", "Currency", "Order", "text", 5,
     "CASE WHEN o % 17 <> 0 THEN 'INR' END", "string", "''", "string"),
    ("purchase_order.nature_of_supply", "Nature of Supply", "Order", "text", 0,
     "o_orderstatus", "string", "''", "string"),
    ("buyer.company_name", "Buyer Company", "Buyer", "text", 0,
     "CASE WHEN c % 5 = 0 THEN c_name || chr(9) ELSE c_name END", "string", "''", "string"),
    ("buyer.gst_number", "Buyer GST", "Buyer", "text", 3,
     "CASE WHEN c % 4 = 1 THEN 'X1' WHEN c % 4 <> 0 THEN lpad((c % 37)::VARCHAR, 2, '0') || 'ABCDE' "
     "|| lpad((c % 10000)::VARCHAR, 4, '0') || 'F1Z' || (c % 10) END", "string", "''", "string"),
    ("buyer.pan_number", "Buyer PAN", "Buyer", "text", 0,
     "'ABCDE' || lpad((c % 10000)::VARCHAR, 4, '0') || 'F'", "string", "''", "string"),
    ("buyer.address", "Buyer Address", "Buyer", "long_text", 0,
     "c_mktsegment || ' ROAD'", "string", "''", "string"),
    ("supplier.company_name", "Supplier Company", "Supplier", "text", 0, "NULL", "string", "''", "string"),
    ("supplier.gst_number", "Supplier GST", "Supplier", "text", 4,
     "'27aaaaa' || lpad((o % 10000)::VARCHAR, 4, '0') || 'a1z5'", "string", "''", "string"),
    ("supplier.pan_number", "Supplier PAN", "Supplier", "text", 0, "NULL", "string", "''", "string"),
    ("supplier.address", "Supplier Address", "Supplier", "long_text", 0, "NULL", "string", "''", "string"),
    ("summary.subtotal", "Subtotal", "Summary", "number", 0,
     "o_totalprice::VARCHAR", "number", "'0'", "number"),
    ("summary.cgst", "CGST", "Summary", "number", 0, "NULL", "string", "'0'", "number"),
    ("summary.sgst", "SGST", "Summary", "number", 0, "NULL", "string", "'0'", "number"),
    ("summary.igst", "IGST", "Summary", "number", 0,
     "CASE WHEN o % 2 = 0 THEN '₹' || format('{:,.2f}', o_totalprice / 8) END", "string", "'0'", "number"),
    ("summary.grand_total", "Grand Total", "Summary", "number", 6,
     "CASE WHEN o % 4 = 3 THEN 'N/A' ELSE '₹' || format('{:,.2f}', o_totalprice) END",
     "string", "'0'", "number"),
    ("summary.amount_in_words", "Amount in Words", "Summary", "text", 0, "NULL", "string", "''", "string"),
    ("metadata.document_type", "", "", "", 0, "NULL", "string", "'PurchaseOrder'", "string"),
    ("metadata.department", "", "", "", 0, "NULL", "string", "'Procurement'", "string"),
    ("metadata.document_subtype", "", "", "", 0, "NULL", "string", "'MaterialPurchaseOrder'", "string"),
    ("metadata.source.filename", "", "", "", 0, "NULL", "string", "''", "string"),
    ("metadata.source.file_type", "", "", "", 0, "NULL", "string", "'pdf'", "string"),
    ("purchase_order.contract_number", "", "", "", 0, "NULL", "string", "NULL", "null"),
    ("purchase_order.delivery_date", "", "", "", 0, "NULL", "string", "NULL", "null"),
    ("purchase_order.bill_to", "", "", "", 0, "NULL", "string", "''", "string"),
    ("purchase_order.ship_to", "", "", "", 0, "NULL", "string", "''", "string"),
    ("validation.subtotal_matches", "", "", "", 0, "NULL", "string", "'true'", "bool"),
    ("validation.gst_matches", "", "", "", 0, "NULL", "string", "'true'", "bool"),
    ("validation.grand_total_matches", "", "", "", 0, "NULL", "string", "'true'", "bool"),
    ("validation.mandatory_fields_complete", "", "", "", 0, "NULL", "string", "'true'", "bool"),
    ("validation.line_item_count", "", "", "", 0, "NULL", "string", "'0'", "number"),
]


def _order_cells() -> str:
    rows = ",\n    ".join(
        f"{{'pos': {i}, 'path': '{p}', 'label': '{lb}', 'section': '{s}', 'kind': '{k}', "
        f"'critical': {cr}, 'raw': {v}::VARCHAR, 'rt': '{t}', 'dv': {d}::VARCHAR, 'dt': '{dt}'}}"
        for i, (p, lb, s, k, cr, v, t, d, dt) in enumerate(ORDER_ROWS)
    )
    return f"""
ord AS (
  SELECT o_orderkey AS o, o_custkey AS c, orders.*, c_name, c_mktsegment
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
spread AS (SELECT o AS doc_id, unnest([
    {rows}
  ]) AS x FROM ord),
cells AS (
  SELECT doc_id, x.pos AS pos, x.path AS path, x.label AS label, x.section AS section,
    x.kind AS kind, x.critical AS critical, x.raw IS NOT NULL AS given,
    CASE WHEN x.raw IS NULL THEN x.dv ELSE x.raw END AS v,
    CASE WHEN x.raw IS NULL THEN x.dt ELSE x.rt END AS t
  FROM spread)
"""


ORDER_CELLS = _order_cells()

LINE_ROWS = """
    {'key': 'line_number', 'label': 'Line #', 'kind': 'text', 'v': l_linenumber::VARCHAR, 't': 'string'},
    {'key': 'material_code', 'label': 'Material Code', 'kind': 'text', 'v': ' P' || l_partkey, 't': 'string'},
    {'key': 'hsn_code', 'label': 'HSN Code', 'kind': 'text', 'v': lpad(l_suppkey::VARCHAR, 6, '0'), 't': 'string'},
    {'key': 'quantity', 'label': 'Quantity', 'kind': 'number', 'v': l_quantity::VARCHAR, 't': 'number'},
    {'key': 'unit', 'label': 'Unit', 'kind': 'text', 'v': l_returnflag, 't': 'string'},
    {'key': 'unit_price', 'label': 'Unit Price', 'kind': 'number',
     'v': CASE WHEN l_discount > 0.08::DOUBLE THEN 'free' ELSE '₹' || format('{:,.2f}', l_extendedprice / l_quantity) END, 't': 'string'},
    {'key': 'taxable_amount', 'label': 'Taxable Amount', 'kind': 'number', 'v': l_extendedprice::VARCHAR, 't': 'number'},
    {'key': 'gst_percent', 'label': 'GST %', 'kind': 'number', 'v': l_tax::VARCHAR, 't': 'number'}"""

# Line-item cells of an order; one row per cell.
LINE_CELLS = f"""
lspread AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, unnest([{LINE_ROWS}]) AS x FROM lineitem),
lcells AS (
  SELECT doc_id, 'items[' || n || '].' || x.key AS path, 'items[' || n || '].' || x.label AS label,
    x.kind AS kind, x.v AS v, x.t AS t FROM lspread)
"""


def repaired(source: str, target: str) -> str:
    """CTE of cells after repair: ``nv``, ``nt`` and ``changed``."""
    return f"""
{target} AS (
  SELECT *, CASE WHEN changed THEN new ELSE v END AS nv,
    CASE WHEN changed AND kind = 'number' THEN 'number' ELSE t END AS nt
  FROM (
    SELECT *, new IS NOT NULL AND v IS NOT NULL AND t = 'string'
        AND (kind = 'number' OR new <> v) AS changed
    FROM (
      SELECT *, CASE WHEN t <> 'string' THEN NULL
        WHEN kind = 'number' THEN {number('v')}::VARCHAR
        WHEN kind = 'date' THEN {iso('v')}
        WHEN kind IN ('text', 'long_text') THEN trim(v, {WS}) END AS new
      FROM {source})))
"""
