"""Normalization, repair, scores and readiness of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsondoc, scores
from ..operators import audit, cell_columns, confidence, readiness, register, repair, rules
from ..operators import cells as cl
from ..operators.joins import spread
from ..plans import bindings as b
from ..plans import finalize
from ..sources import tables
from ..sources.live_types import GATE_PASS, ORDER, SHIPPING_BILL
from .registry import query
from .sqltext import LINE_CELLS, ORDER_CELLS, band, heuristic, repaired


# ---- cells of orders ----------------------------------------------------------


@query("normalize_defaults", f"""
WITH {ORDER_CELLS}
SELECT doc_id, path, CASE WHEN path = 'metadata.source.filename' THEN 'order' || doc_id || '.pdf' ELSE v END AS value,
  CASE WHEN path = 'metadata.source.filename' THEN 'string' ELSE t END AS json_type FROM cells
""")
def normalize_defaults(spark, sf):
    values = b.order_values()
    o = F.col("o_orderkey").cast("string")
    values["metadata.source.filename"] = (F.concat(F.lit("order"), o, F.lit(".pdf")), "string")
    docs = b.orders_with_customer(spark, sf).select(
        F.col("o_orderkey").alias("doc_id"),
        F.explode(cl.header_from_columns(ORDER, values)).alias("c"),
    )
    return docs.select("doc_id", "c.path", F.col("c.v").alias("value"), F.col("c.t").alias("json_type"))


@query("heuristic_scores", f"""
WITH {ORDER_CELLS} SELECT doc_id, path, {heuristic('v', 't')} AS score FROM cells
""")
def heuristic_scores(spark, sf):
    cells, rows = _order_columns(spark, sf)
    return rows.select("doc_id", F.explode(cells.scored_rows()).alias("c")).select("doc_id", "c.*")


def _order_columns(spark, sf, *keep, repair=False):
    cells = cell_columns.header(ORDER, b.order_values())
    return cells, cells.read(b.orders_with_customer(spark, sf), F.col("o_orderkey").alias("doc_id"), *keep, repair=repair)


_REPORTED = f"""
own AS (SELECT doc_id, path, CASE path
    WHEN 'purchase_order.po_number' THEN CASE doc_id % 5 WHEN 0 THEN 94 WHEN 1 THEN 96 WHEN 2 THEN 0 WHEN 3 THEN 100 END
    WHEN 'buyer.gst_number' THEN CASE WHEN doc_id % 3 = 0 THEN 60 END
    WHEN 'summary.grand_total' THEN doc_id % 101 END AS reported,
  {heuristic('v', 't')} AS shape, v, t, critical, label FROM cells),
scored AS (SELECT *, coalesce(reported, shape) AS score FROM own)
"""


def _reported_columns(spark, sf):
    """Cells of orders as columns, and the model's own usable scores beside them."""
    return _order_columns(spark, sf, cell_columns.usable_scores(b.ai_scores()).alias("reported"))


def _summaries(spark, sf):
    cells, rows = _reported_columns(spark, sf)
    scored = rows.select("doc_id", cells.scores(F.col("reported")).alias("scores"))
    return scored.select("doc_id", confidence.summary_of(F.col("scores")).alias("s"))


@query("confidence_scores", f"WITH {ORDER_CELLS}, {_REPORTED} SELECT doc_id, path, score FROM scored")
def confidence_scores(spark, sf):
    cells, rows = _reported_columns(spark, sf)
    found = cells.scored_rows(F.col("reported"))
    return rows.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


@query("band_counts", f"""
WITH {ORDER_CELLS}, {_REPORTED}
SELECT doc_id, count(*) FILTER (score >= 95) AS high, count(*) FILTER (score >= 75 AND score < 95) AS review,
  count(*) FILTER (score < 75) AS verify FROM scored GROUP BY doc_id
""")
def band_counts(spark, sf):
    return _summaries(spark, sf).select("doc_id", "s.high", "s.review", "s.verify")


@query("overall_confidence", f"""
WITH {ORDER_CELLS}, {_REPORTED}
SELECT doc_id, CAST(coalesce(round_even(avg(score) FILTER (score > 0), 0), 0) AS INT) AS overall,
  {band('coalesce(round_even(avg(score) FILTER (score > 0), 0), 0)')} AS band FROM scored GROUP BY doc_id
""")
def overall_confidence(spark, sf):
    s = _summaries(spark, sf)
    whole = confidence.overall(F.col("s.scored"), F.col("s.score_sum"))
    return s.select("doc_id", whole.alias("overall"), scores.band(whole).alias("band"))


_READY = """
crit AS (SELECT *, v IS NOT NULL AND t <> 'null' AND NOT (t = 'string' AND trim(v) = '') AS present FROM scored WHERE critical > 0),
con AS (SELECT *, CASE WHEN present THEN least(score, 100) ELSE 0 END AS conf FROM crit),
rdy AS (SELECT doc_id, CAST(round_even(sum(conf) / 6.0::DOUBLE, 0) AS INT) AS score, count(*) FILTER (present) AS present,
  coalesce(string_agg(CASE WHEN NOT present THEN label || ' missing' WHEN conf < 75 THEN label || ' low confidence' END, '; ' ORDER BY critical), '') AS reasons
  FROM con GROUP BY doc_id)
"""
_READY_COLUMNS = """rdy.score AS score, CASE WHEN rdy.score >= 95 THEN 'ready' WHEN rdy.score >= 75 THEN 'review' ELSE 'error' END AS status,
  CASE WHEN rdy.score >= 95 THEN 'Ready for SAP' WHEN rdy.score >= 75 THEN 'Needs Review' ELSE 'Not Ready' END AS label"""


@query("readiness", f"""
WITH {ORDER_CELLS}, {_REPORTED}, {_READY}
SELECT doc_id, {_READY_COLUMNS}, present, 6 AS total, reasons FROM rdy
""")
def readiness_query(spark, sf):
    cells, rows = _reported_columns(spark, sf)
    r = rows.select("doc_id", readiness.assess_cells(ORDER, lambda path: cells.at(path, F.col("reported"))).alias("r"))
    return r.select(
        "doc_id", "r.score", "r.status", "r.label", F.col("r.present").cast("bigint").alias("present"),
        "r.total", F.array_join("r.reasons", "; ").alias("reasons"),
    )


@query("validate_generic", f"""
WITH {ORDER_CELLS}, n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT doc_id, 'required:purchase_order.po_number' AS rule FROM cells
  WHERE path = 'purchase_order.po_number' AND (NOT given OR v = '')
UNION ALL SELECT o_orderkey, 'no_items' FROM orders LEFT JOIN n ON o_orderkey = l_orderkey WHERE n IS NULL
""")
def validate_generic(spark, sf):
    counts = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    docs = b.order_headers(spark, sf).join(counts, "doc_id", "left")
    po = cl.at(F.col("cells"), ORDER, "purchase_order.po_number")
    missing = {"purchase_order.po_number": ~po.given | (po.v == "")}
    found = rules.generic_issues(missing, ORDER, F.coalesce("n", F.lit(0)))
    return docs.select("doc_id", F.explode(found).alias("i")).select("doc_id", "i.rule")


@query("auto_fix_notes", f"""
WITH {ORDER_CELLS}, {LINE_CELLS},
every AS (SELECT doc_id, label, kind, v, t FROM cells WHERE kind <> '' UNION ALL SELECT doc_id, label, kind, v, t FROM lcells),
{repaired('every', 'fixed')}
SELECT doc_id, label AS field, v AS old, nv AS new,
  CASE kind WHEN 'number' THEN 'Parsed numeric value (removed currency/grouping symbols).'
    WHEN 'date' THEN 'Normalized date to ISO format (YYYY-MM-DD).' ELSE 'Trimmed surrounding whitespace.' END AS reason,
  CASE WHEN kind = 'date' THEN 95 ELSE 100 END AS confidence
FROM fixed WHERE changed
""")
def auto_fix_notes(spark, sf):
    """Header and line notes: each side stays in its own table, no join is needed."""
    cells, headers = _order_columns(spark, sf, repair=True)
    items, lines = _line_columns(spark, sf)
    place = lambda f: F.concat(F.col("place"), F.lit(f.label))
    notes = headers.select("doc_id", F.explode(cells.notes()).alias("n")).unionByName(
        lines.select("doc_id", F.explode(items.notes(place)).alias("n")))
    return notes.select("doc_id", "n.*")


def _line_columns(spark, sf):
    """Repaired cells of order lines as columns, with ``place`` (the path of the line) and ``amount``."""
    items = cell_columns.item(ORDER, b.line_values())
    start = F.concat(F.lit(f"{ORDER.items_path}["), F.col("l_linenumber").cast("string"), F.lit("]."))
    rows = spread(b.table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    return items, items.read(
        rows, F.col("l_orderkey").alias("doc_id"), start.alias("place"), F.col("l_extendedprice").alias("amount"), repair=True)


@query("export_summary", f"""
WITH {ORDER_CELLS} SELECT doc_id, pos, section, label, v AS value FROM cells WHERE section <> ''
""")
def export_summary(spark, sf):
    return register.summary_rows(b.order_headers(spark, sf), ORDER)


_LINE_SCORES = f"""
ls AS (SELECT doc_id, changed, {heuristic('nv', 'nt')} AS score FROM lfixed)
"""


@query("finalize_documents", f"""
WITH {ORDER_CELLS}, {LINE_CELLS}, {repaired('cells', 'hfixed')}, {repaired('lcells', 'lfixed')},
scored AS (SELECT doc_id, nv AS v, nt AS t, critical, label, changed, {heuristic('nv', 'nt')} AS score FROM hfixed),
{_LINE_SCORES}, {_READY},
every AS (SELECT doc_id, changed, score FROM scored UNION ALL SELECT doc_id, changed, score FROM ls),
conf AS (SELECT doc_id, count(*) FILTER (changed) AS n_fixes,
  CAST(coalesce(round_even(avg(score) FILTER (score > 0), 0), 0) AS INT) AS overall,
  count(*) FILTER (score >= 95) AS high, count(*) FILTER (score >= 75 AND score < 95) AS review,
  count(*) FILTER (score < 75) AS verify FROM every GROUP BY doc_id),
li AS (SELECT l_orderkey AS doc_id, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS line_sum FROM lineitem GROUP BY 1),
po AS (SELECT doc_id FROM cells WHERE path = 'purchase_order.po_number' AND given AND v <> ''),
iss AS (SELECT o_orderkey AS doc_id, concat_ws(',', CASE WHEN po.doc_id IS NULL THEN 'order_number' END,
    CASE WHEN li.n IS NULL THEN 'no_items' END,
    CASE WHEN o_totalprice <> 0 AND abs(coalesce(line_sum, 0)::DOUBLE - o_totalprice) > 1.0 THEN 'subtotal' END) AS issues
  FROM orders LEFT JOIN li ON o_orderkey = li.doc_id LEFT JOIN po ON o_orderkey = po.doc_id)
SELECT conf.doc_id, 'purchase_order' AS type_key, n_fixes, issues, overall, high, review, verify,
  {_READY_COLUMNS}, rdy.present AS present, rdy.reasons AS reasons
FROM conf JOIN rdy ON conf.doc_id = rdy.doc_id JOIN iss ON conf.doc_id = iss.doc_id
""")
def finalize_documents(spark, sf):
    """Flagship: every order with its customer and lines, normalized to scored."""

    def header_facts(cells):
        return {
            "po_number": cl.truthy(cells.at("purchase_order.po_number")),
            "subtotal": cl.given_text(cells.at("summary.subtotal")).try_cast("double"),
        }

    cells, headers = _order_columns(spark, sf, repair=True)
    items, lines = _line_columns(spark, sf)
    out = finalize.finalize_columns(
        headers, cells, lines, items, ORDER, header_facts,
        {"line_sum": F.col("amount").cast("decimal(18,2)")}, rules.order_issues,
    )
    return out.select(
        "doc_id", "type_key", "n_fixes",
        F.array_join(F.transform("issues", lambda i: i.rule), ",").alias("issues"),
        "overall", "high", "review", "verify",
        "readiness.score", "readiness.status", "readiness.label",
        F.col("readiness.present").cast("bigint").alias("present"),
        F.array_join("readiness.reasons", "; ").alias("reasons"),
    )


# ---- JSON documents -----------------------------------------------------------


def _gate_pass_json():
    """One gate pass per order line, as a model would print it."""
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    s = lambda c: c.cast("string")
    body = F.struct(
        F.struct(F.lit("IGP").alias("document_type")).alias("metadata"),
        F.struct(
            F.when(p % 7 != 0, F.concat(F.lit("GP"), s(o))).alias("gate_pass_number"),
            F.date_format("l_shipdate", "dd.MM.yyyy").alias("entry_date"),
            F.lit(" stores ").alias("purpose"),
        ).alias("gate_pass"),
        F.struct(
            F.when(p % 7 != 0, F.concat(F.lit("PO"), s(o))).otherwise("").alias("po_number"),
            F.date_format("l_shipdate", "dd-MMM-yyyy").alias("po_date"),
        ).alias("purchase_order"),
        F.struct(
            F.when(F.col("l_suppkey") % 5 != 0, s(F.col("l_suppkey"))).alias("code"),
        ).alias("vendor"),
        F.when(p % 11 != 0, F.struct(F.when(p % 3 != 0, F.concat(F.lit("KA"), s(p))).alias("vehicle_number"))).alias(
            "delivery"
        ),
        F.struct(b.rupees(F.col("l_extendedprice")).alias("net_value_doc_currency")).alias("value"),
        F.array(
            F.struct(
                s(F.col("l_linenumber")).alias("line_number"),
                F.when(p % 13 != 0, F.concat(s(F.col("l_quantity")), F.lit(" KG"))).alias("quantity"),
                F.col("l_returnflag").alias("unit"),
            )
        ).alias("items"),
        F.struct(
            F.struct(F.col("l_tax").alias("rate"), F.lit(None).cast("string").alias("note")).alias("tax"),
        ).alias("additional_information"),
        F.map_from_arrays(
            F.array(F.lit("vendor.code"), F.lit("value.net_value_doc_currency")),
            F.array((p % 101).cast("double"), F.lit(88.5)),
        ).alias("_confidence"),
    )
    return F.to_json(body, {"ignoreNullFields": "false"})


def _fenced(raw, form):
    return b.choose(
        form,
        {
            0: raw,
            1: F.concat(F.lit("```json\n"), raw, F.lit("\n```")),
            2: F.concat(F.lit("Here it is:\n"), raw, F.lit("\nDone.")),
        },
        F.substring(raw, F.lit(1), F.length(raw) - 9),
    )


@query("finalize_gate_pass", r"""
WITH g AS (SELECT *, l_partkey AS p, l_suppkey AS s, (l_orderkey + l_linenumber) % 4 AS form FROM lineitem),
ok AS (SELECT *, p % 7 <> 0 AS id, s % 5 <> 0 AS vendor, p % 11 <> 0 AS del, p % 11 <> 0 AND p % 3 <> 0 AS veh, p % 13 <> 0 AS qty FROM g WHERE form <> 3),
sc AS (SELECT *,
  CASE WHEN id THEN CASE WHEN length('GP' || l_orderkey) <= 2 THEN 78 ELSE 92 END ELSE 0 END AS gp,
  CASE WHEN id THEN 92 ELSE 0 END AS po,
  CASE WHEN vendor THEN p % 101 ELSE p % 101 END AS vc,
  CASE WHEN veh THEN 92 ELSE 0 END AS ve,
  CASE WHEN qty THEN 97 ELSE 0 END AS q FROM ok),
cells AS (SELECT *, [92, gp, 96, 92, po, 96, vc, ve, 88, 92, 78, q, 78, CASE WHEN l_tax = 0 THEN 80 ELSE 97 END, 92, 0] AS parts FROM sc)
SELECT l_orderkey, l_linenumber, l_partkey, 'done' AS status,
  CAST(3 + qty::INT AS BIGINT) AS n_fixes,
  concat_ws(',', CASE WHEN NOT id THEN 'identifier' END, CASE WHEN NOT vendor THEN 'vendor' END,
    CASE WHEN NOT qty THEN 'no_quantity' END, CASE WHEN NOT veh THEN 'vehicle' END) AS issues,
  CAST(round_even(((CASE WHEN id THEN 92 ELSE 0 END) + (CASE WHEN id THEN 92 ELSE 0 END) + 96 + (CASE WHEN vendor THEN p % 101 ELSE 0 END)
    + (CASE WHEN veh THEN 92 ELSE 0 END)) / 6.0::DOUBLE, 0) AS INT) AS readiness
FROM cells
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'error', NULL, NULL, NULL FROM g WHERE form = 3
""")
def finalize_gate_pass(spark, sf):
    """Model answers to finalized gate passes: one narrow plan over JSON documents."""
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    raw = _fenced(_gate_pass_json(), (F.col("l_orderkey") + F.col("l_linenumber")) % 4)
    responses = spread(b.table(spark, sf, "lineitem"), "l_orderkey", "l_partkey").select(
        *ids, F.lit("pass.pdf").alias("filename"), raw.alias("raw_text")
    )
    parsed = finalize.parse_documents(responses)
    out = finalize.finalize_json(parsed, GATE_PASS)
    done = F.col("status") == "done"
    return out.select(
        *ids, "status",
        F.when(done, F.size("notes").cast("bigint")).alias("n_fixes"),
        F.when(done, F.array_join(F.transform("issues", lambda i: i.rule), ",")).alias("issues"),
        F.when(done, F.col("readiness.score")).alias("readiness"),
    )


@query("auto_fix_gate_pass", r"""
WITH g AS (SELECT *, 'items[0].quantity' AS qf FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, 'purchase_order.po_date' AS field, strftime(l_shipdate, '%d-%b-%Y') AS old,
  strftime(l_shipdate, '%Y-%m-%d') AS new, 'Normalized date to ISO (YYYY-MM-DD).' AS reason, 95 AS confidence FROM g
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'gate_pass.entry_date', strftime(l_shipdate, '%d.%m.%Y'),
  strftime(l_shipdate, '%Y-%m-%d'), 'Normalized date to ISO (YYYY-MM-DD).', 95 FROM g
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'value.net_value_doc_currency', '₹' || format('{:,.2f}', l_extendedprice),
  l_extendedprice::VARCHAR, 'Parsed numeric value.', 100 FROM g
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, qf, l_quantity::VARCHAR || ' KG', l_quantity::VARCHAR,
  'Parsed numeric quantity.', 100 FROM g WHERE l_partkey % 13 <> 0
""")
def auto_fix_gate_pass(spark, sf):
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    docs = spread(b.table(spark, sf, "lineitem"), "l_orderkey", "l_partkey").select(*ids, _gate_pass_json().alias("raw"))
    docs = docs.withColumn("data", F.try_parse_json("raw"))
    docs = docs.withColumns({"flat": jsondoc.flatten(F.col("data"), F.col("raw")), "tree": cl.leaf_tree(GATE_PASS, F.col("data"))})
    read = cl.document_cells(GATE_PASS, F.col("data"), flat=F.col("flat"), tree=F.col("tree"))
    cells = docs.select(*ids, read.alias("cells"))
    fixed = repair.gate_pass_repair(F.col("cells"))
    return cells.select(*ids, F.explode(repair.gate_pass_notes(fixed)).alias("n")).select(*ids, "n.*")


@query("parse_responses", """
SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'no JSON object found' WHEN 4 THEN 'empty output' WHEN 5 THEN 'not a JSON object' END AS error,
  CASE WHEN event_id % 6 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events
""")
def parse_responses(spark, sf):
    p = F.col("props")
    raw = b.choose(
        F.col("event_id") % 6,
        {
            0: p,
            1: F.concat(F.lit("```json\n"), p, F.lit("\n```")),
            2: F.concat(F.lit("Sure! "), p, F.lit(" Anything else?")),
            3: F.rtrim(F.replace(p, F.lit("}"), F.lit(""))),
            4: " \n ",
        },
        F.concat(F.lit("["), p, F.lit("]")),
    )
    rows = b.table(spark, sf, "events").select("event_id", jsondoc.parse_response(raw).alias("r"))
    return rows.select(
        "event_id", "r.error", F.try_variant_get("r.data", "$.k", "bigint").alias("k")
    )


def _nested_event():
    """An event as a nested document with every JSON type and empty containers."""
    return F.format_string(
        '{"id": %d, "who": {"user": {"key": "u%d", "vip": %s}, "note": null}, '
        '"tags": ["%s", {"v": %s}, [], {}], "props": %s, "_confidence": {"id": %d}}',
        F.col("event_id"), F.col("user_id"), (F.col("user_id") % 2 == 0).cast("string"),
        F.col("event_type"), F.col("value").cast("string"), F.col("props"), F.col("user_id") % 120,
    )


@query("flatten_json", """
WITH e AS (SELECT event_id, unnest([
  {'path': 'id', 'value': event_id::VARCHAR, 'json_type': 'number'},
  {'path': 'who.user.key', 'value': 'u' || user_id, 'json_type': 'string'},
  {'path': 'who.user.vip', 'value': CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END, 'json_type': 'bool'},
  {'path': 'who.note', 'value': NULL, 'json_type': 'null'},
  {'path': 'tags[0]', 'value': event_type, 'json_type': 'string'},
  {'path': 'tags[1].v', 'value': value::VARCHAR, 'json_type': 'number'},
  {'path': 'props.k', 'value': json_extract_string(props, '$.k'), 'json_type': 'number'}]) AS x FROM events)
SELECT event_id, x.path AS path, CASE WHEN x.path = 'tags[1].v' THEN NULL ELSE x.value END AS value, x.json_type AS json_type,
  CASE WHEN x.json_type = 'number' THEN round(TRY_CAST(x.value AS DOUBLE), 4) END AS amount FROM e
""")
def flatten_json(spark, sf):
    raw = spread(b.table(spark, sf, "events"), "event_id").select("event_id", _nested_event().alias("raw"))
    flat = jsondoc.flatten(F.try_parse_json("raw"), F.col("raw"))
    rows = raw.select("event_id", F.explode(flat).alias("c"))
    return rows.select(
        "event_id", "c.path",
        F.when(F.col("c.path") != "tags[1].v", F.col("c.v")).alias("value"),
        F.col("c.t").alias("json_type"),
        F.when(F.col("c.t") == "number", F.round(F.col("c.v").try_cast("double"), 4)).alias("amount"),
    )


@query("path_get", """
SELECT event_id, 'u' || user_id AS who_key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  NULL::VARCHAR AS through_scalar, NULL::VARCHAR AS missing, user_id % 2 = 0 AS vip FROM events
""")
def path_get(spark, sf):
    docs = b.table(spark, sf, "events").select("event_id", F.try_parse_json(_nested_event()).alias("v"))
    v = F.col("v")
    return docs.select(
        "event_id",
        jsondoc.get_text(v, "who.user.key").alias("who_key"),
        jsondoc.get_text(v, "props.k").cast("bigint").alias("k"),
        jsondoc.get_text(v, "id.deeper").alias("through_scalar"),
        jsondoc.get_text(v, "who.none.key").alias("missing"),
        jsondoc.get_text(v, "who.user.vip").cast("boolean").alias("vip"),
    )


@query("path_set", """
SELECT event_id, 'props.k' AS path, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') ELSE '7' END AS value FROM events
UNION ALL SELECT event_id, 'new.block.key', event_type FROM events WHERE event_type <> 'error'
""")
def path_set(spark, sf):
    e = F.col("event_type")
    cell = lambda v, t: F.struct(v.alias("v"), F.lit(t).alias("t"))
    edits = F.when(
        e != "error",
        F.create_map(
            F.lit("props.k"), cell(F.lit("7"), "number"), F.lit("new.block.key"), cell(e, "string")
        ),
    )
    raw = F.format_string('{"props": %s}', F.col("props"))
    flat = jsondoc.flatten(F.try_parse_json(raw), raw)
    docs = b.table(spark, sf, "events").select("event_id", audit.set_paths(flat, edits).alias("f"))
    return docs.select("event_id", F.explode("f").alias("c")).select(
        "event_id", "c.path", F.col("c.v").alias("value")
    )


@query("ai_scores_split", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'id' END AS path,
  CASE WHEN event_type = 'error' THEN NULL ELSE least(user_id % 120, 100) END::INT AS score,
  event_type = 'error' AS dropped FROM events
""")
def ai_scores_split(spark, sf):
    """The model's score map; a map that is not an object is dropped."""
    odd = F.regexp_replace(_nested_event(), r'"_confidence": \{.*\}\}$', '"_confidence": 5}')
    raw = F.when(F.col("event_type") == "error", odd).otherwise(_nested_event())
    m = b.table(spark, sf, "events").select(
        "event_id", jsondoc.split_confidence(F.try_parse_json(raw)).alias("m")
    )
    return m.select("event_id", F.explode_outer("m").alias("path", "s")).select(
        "event_id", "path", scores.reported_score(F.col("s")).alias("score"),
        F.col("path").isNull().alias("dropped"),
    )


@query("audit_diff", """
WITH d AS (SELECT o_orderkey AS doc_id, o_totalprice, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT doc_id, 'buyer.tier' AS field, p AS ai_value, 'X' AS user_value, 'reviewer' AS "user" FROM d WHERE s = 'F'
UNION ALL SELECT doc_id, 'items[1].q', '2', NULL, 'reviewer' FROM d WHERE s = 'O'
UNION ALL SELECT doc_id, 'extra', NULL, 'new', 'reviewer' FROM d WHERE s = 'P'
""")
def audit_diff(spark, sf):
    """Edits of every order: one change per status; 5 and 5.0, null and missing are equal."""
    o, s, p = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    before = F.format_string(
        '{"buyer": {"tier": "%s", "n": 5, "gone": null}, "items": [{"q": 1}, {"q": 2}], "ok": true}', p
    )
    after = F.when(
        s == "F",
        '{"buyer": {"tier": "X", "n": 5.0}, "items": [{"q": 1}, {"q": 2}], "ok": 1}',
    ).when(
        s == "O", F.format_string('{"buyer": {"tier": "%s", "n": 5}, "items": [{"q": 1}], "ok": true}', p)
    ).otherwise(
        F.format_string(
            '{"buyer": {"tier": "%s", "n": 5}, "items": [{"q": 1}, {"q": 2}], "ok": true, "extra": "new"}', p
        )
    )

    def flat(text):
        return jsondoc.flatten(F.try_parse_json(text), text, keep_confidence=True)

    docs = spread(b.table(spark, sf, "orders"), "o_orderkey").select(
        o.alias("doc_id"), flat(before).alias("before"), flat(after).alias("after")
    )
    return audit.audit_rows(docs)


# ---- shipping bills -----------------------------------------------------------


def _shipping_json():
    c = F.col
    return F.to_json(
        F.struct(
            F.struct(c("sb_number").alias("shipping_bill_number"), c("leo_date")).alias("shipping_bill"),
            F.struct(c("iec").alias("iec_number")).alias("exporter"),
            F.struct(F.lit("Port Co").alias("name")).alias("consignee"),
            F.struct(
                c("invoice_fob").alias("fob_value"), c("exchange_rate"), c("commission")
            ).alias("invoice"),
            F.struct(c("summary_fob").alias("total_fob_value")).alias("summary"),
            F.struct(
                c("dbk_rate"), c("dbk_amount"), c("rodtep").alias("rodtep_amount"),
                c("scheme").alias("scheme_description"),
            ).alias("drawback"),
            F.array(
                F.struct(
                    F.lit("1").alias("line_number"), F.lit("100200").alias("hs_code"),
                    c("summary_fob").try_cast("double").alias("fob_value"),
                    F.lit(10.0).alias("gross_weight"),
                    F.when(c("shift") == 4, 10.5).otherwise(9.5).alias("net_weight"),
                )
            ).alias("items"),
        ),
        {"ignoreNullFields": "false"},
    )


@query("finalize_shipping", """
WITH s AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS st, o_orderpriority AS pr FROM orders),
d AS (SELECT *, k % 5 IN (2, 3, 4) AS rated, k % 6 = 0 AS printed, k % 10 <> 3 AS amount FROM s),
r AS (SELECT *, CASE WHEN NOT printed AND amount THEN CAST(printf('%.2f', (price / 50) /
    ((CASE WHEN k % 4 = 0 THEN price * 2 ELSE price END) * CASE WHEN rated THEN 83.5::DOUBLE ELSE 1 END) * 100.0::DOUBLE) AS DOUBLE) END AS rate FROM d),
f AS (SELECT *, rate > 0 AND rate < 100 AS derived FROM r)
SELECT k AS doc_id, concat_ws(',',
  CASE WHEN st = 'P' THEN 'bill_number' END, CASE WHEN k % 9 = 0 THEN 'exporter_code' END,
  CASE WHEN k % 7 = 0 THEN 'commission' END, CASE WHEN NOT rated THEN 'exchange_rate' END,
  CASE WHEN pr = '5-LOW' THEN 'leo_date' END, CASE WHEN NOT printed AND NOT coalesce(derived, FALSE) THEN 'dbk_rate' END,
  CASE WHEN NOT amount THEN 'dbk_amount' END, CASE WHEN k % 8 = 0 THEN 'rodtep' END,
  CASE WHEN k % 4 = 0 THEN 'scheme' END, CASE WHEN k % 5 = 4 THEN 'line_weight' END) AS issues,
  CASE WHEN derived THEN rate WHEN printed THEN 1.5 END::DOUBLE AS dbk_rate,
  CAST(coalesce(derived, FALSE) AS INT) AS derived FROM f
""")
def finalize_shipping(spark, sf):
    """Shipping bills as JSON: repair with the derived rate, rules and line weights."""
    docs = spread(b.ship_headers(spark, sf), "doc_id").select(
        "doc_id", F.lit("bill.pdf").alias("filename"), _shipping_json().alias("raw_text")
    )
    out = finalize.finalize_json(finalize.parse_documents(docs), SHIPPING_BILL)
    kept = F.filter("issues", lambda i: i.rule != "section_missing")
    return out.select(
        "doc_id", F.array_join(F.transform(kept, lambda i: i.rule), ",").alias("issues"),
        cl.find(F.col("cells"), SHIPPING_BILL, "drawback.dbk_rate").v.try_cast("double").alias("dbk_rate"),
        F.size(F.filter("notes", lambda n: n.confidence == repair.DERIVED_CONFIDENCE)).alias("derived"),
    )


# ---- sinks --------------------------------------------------------------------


@query("sink_all", """
WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'PO-' || o_orderkey END AS po FROM orders)
SELECT doc_id, 'order_' || doc_id || '_sales_order.json' AS name, 'json' AS kind, '{"doc_id":' || doc_id || ',"po":"' || po || '"}' AS value FROM d
UNION ALL SELECT doc_id, 'order_' || doc_id || '_sales_order.csv', 'sheet', 'Order Number,' || po FROM d
""")
def sink_all(spark, sf):
    """Both exports of every order, as the rows that would be written."""
    o = F.col("o_orderkey")
    po = F.when(o % 11 == 0, "").otherwise(F.concat(F.lit("PO-"), b.text_of(o)))
    docs = b.table(spark, sf, "orders").select(
        o.alias("doc_id"), po.alias("po"),
        F.concat(F.lit("order "), b.text_of(o), F.lit(".pdf")).alias("filename"),
        F.lit(ORDER.json_suffix).alias("json_suffix"),
    )
    ready = docs.withColumn("data_json", F.to_json(F.struct("doc_id", "po"))).withColumn(
        "summary_json", F.concat(F.lit("Order Number,"), F.col("po"))
    )
    return tables.export_all(ready)


@query("sink_json_roundtrip", """
SELECT o_orderkey AS doc_id, o_totalprice AS total, CASE WHEN o_orderkey % 17 <> 0 THEN 'INR' END AS currency, o_orderkey % 17 = 0 AS null_kept
FROM orders
""")
def sink_json_roundtrip(spark, sf):
    """Documents to JSON text and back: nulls are written, so no key is lost."""
    o = F.col("o_orderkey")
    docs = b.table(spark, sf, "orders").select(
        o.alias("name"), o.alias("doc_id"), F.col("o_totalprice").alias("total"),
        F.when(o % 17 != 0, "INR").alias("currency"),
    )
    lines = tables.document_json(docs, ["doc_id", "total", "currency"])
    back = F.from_json("value", "doc_id BIGINT, total DOUBLE, currency STRING")
    return lines.select(back.alias("d"), F.contains("value", F.lit('"currency":null')).alias("null_kept")).select(
        "d.*", "null_kept"
    )
