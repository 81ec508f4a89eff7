"""Scalar functions over whole table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import costs, dates, errors, numbers, text
from ..operators import locate, repair
from ..plans.bindings import choose, order_values, orders_with_customer, rupees, ship_headers, table, text_of
from .registry import query
from .sqltext import ORDER_CELLS, WS, iso, number

_DATES = """
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 16
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
    WHEN 2 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y')
    WHEN 4 THEN strftime(o_orderdate, '%d/%m/%y') WHEN 5 THEN strftime(o_orderdate, '%d-%m-%y')
    WHEN 6 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 7 THEN strftime(o_orderdate, '%d-%b-%y')
    WHEN 8 THEN strftime(o_orderdate, '%d %b %Y') WHEN 9 THEN strftime(o_orderdate, '%d %B %Y')
    WHEN 10 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 11 THEN upper(strftime(o_orderdate, '%d-%b-%Y'))
    WHEN 12 THEN strftime(o_orderdate, '%Y-%-m-%-d') WHEN 13 THEN '31/02/' || strftime(o_orderdate, '%Y')
    WHEN 14 THEN strftime(o_orderdate, '%m/%d/%Y')
    ELSE '  ' || strftime(o_orderdate, '%d  %b  %Y') || ' ' END AS printed FROM orders)
SELECT o_orderkey, printed, """ + iso("printed") + """ AS iso FROM p
"""


@query("normalize_dates", _DATES)
def normalize_dates(spark, sf):
    d = F.col("o_orderdate")
    f = lambda p: F.date_format(d, p)
    printed = choose(
        F.col("o_orderkey") % 16,
        {
            0: f("yyyy-MM-dd"), 1: f("dd/MM/yyyy"), 2: f("dd-MM-yyyy"), 3: f("dd.MM.yyyy"),
            4: f("dd/MM/yy"), 5: f("dd-MM-yy"), 6: f("dd-MMM-yyyy"), 7: f("dd-MMM-yy"),
            8: f("dd MMM yyyy"), 9: f("dd MMMM yyyy"), 10: f("yyyy/MM/dd"),
            11: F.upper(f("dd-MMM-yyyy")), 12: f("yyyy-M-d"),
            13: F.concat(F.lit("31/02/"), f("yyyy")), 14: f("MM/dd/yyyy"),
        },
        F.concat(F.lit("  "), f("dd"), F.lit("  "), f("MMM"), F.lit("  "), f("yyyy"), F.lit(" ")),
    )
    out = table(spark, sf, "orders").select("o_orderkey", printed.alias("printed"))
    return out.withColumn("iso", dates.iso_date(F.col("printed")))


_NUMBERS = f"""
WITH p AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 8
    WHEN 0 THEN l_extendedprice::VARCHAR WHEN 1 THEN '₹' || format('{{:,.2f}}', l_extendedprice)
    WHEN 2 THEN '-' || l_extendedprice::VARCHAR WHEN 3 THEN (l_suppkey::VARCHAR || '-' || l_partkey)
    WHEN 4 THEN 'Rs. ' || format('{{:,.2f}}', l_extendedprice) WHEN 5 THEN l_suppkey || 'e5'
    WHEN 6 THEN '  ' ELSE '.5 INR' END AS printed FROM lineitem)
SELECT l_orderkey, l_linenumber, printed, {number('printed')} AS number FROM p
"""


@query("coerce_numbers", _NUMBERS)
def coerce_numbers(spark, sf):
    x = F.col("l_extendedprice")
    printed = choose(
        F.col("l_partkey") % 8,
        {
            0: text_of(x), 1: rupees(x), 2: F.concat(F.lit("-"), text_of(x)),
            3: F.concat(text_of("l_suppkey"), F.lit("-"), text_of("l_partkey")),
            4: F.concat(F.lit("Rs. "), F.format_number(x, 2)),
            5: F.concat(text_of("l_suppkey"), F.lit("e5")), 6: "  ",
        },
        ".5 INR",
    )
    out = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", printed.alias("printed"))
    return out.withColumn("number", numbers.coerce_number(F.col("printed")))


_SHIP = """
s AS (
  SELECT o_orderkey AS doc_id, o_totalprice AS price,
    CASE WHEN o_orderstatus <> 'P' THEN 'SB' || o_orderkey END AS sb_number,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey::VARCHAR END AS iec,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000 END AS commission,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '0' ELSE '83.5' END AS exchange_rate,
    CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') END AS leo_date,
    CASE WHEN o_orderkey % 6 = 0 THEN '1.5' END AS dbk_rate,
    CASE WHEN o_orderkey % 10 <> 3 THEN o_totalprice / 50 END AS dbk_amount,
    CASE WHEN o_orderkey % 8 <> 0 THEN 0 END AS rodtep,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority ELSE '' END AS scheme,
    CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_totalprice END AS invoice_fob,
    o_totalprice * 2 AS summary_fob, o_orderkey % 5 AS shift
  FROM orders)
"""

_RATE = "WITH " + _SHIP + """,
f AS (SELECT *, CASE WHEN invoice_fob > 0 THEN invoice_fob WHEN summary_fob > 0 THEN summary_fob END
    * CASE WHEN CAST(exchange_rate AS DOUBLE) > 0 THEN CAST(exchange_rate AS DOUBLE) ELSE 1 END AS fob FROM s),
r AS (SELECT *, CASE WHEN dbk_rate IS NULL AND dbk_amount > 0 AND fob > 0
    THEN CAST(printf('%.2f', dbk_amount / fob * 100.0::DOUBLE) AS DOUBLE) END AS rate FROM f)
SELECT doc_id, fob, CASE WHEN rate > 0 AND rate < 100 THEN rate END AS derived,
  coalesce(CAST(dbk_rate AS DOUBLE), CASE WHEN rate > 0 AND rate < 100 THEN rate END) AS dbk_rate FROM r
"""


@query("dbk_rate", _RATE)
def dbk_rate(spark, sf):
    s = ship_headers(spark, sf).withColumn(
        "fob", repair.local_fob(F.col("invoice_fob"), F.col("summary_fob"), F.col("exchange_rate"))
    )
    derived = repair.derived_drawback_rate(F.col("dbk_rate"), F.col("dbk_amount"), F.col("fob"))
    return s.select(
        "doc_id", "fob", derived.alias("derived"),
        F.coalesce(numbers.lenient_number(F.col("dbk_rate")), derived).alias("dbk_rate"),
    )


_TRIM = f"""
SELECT p_partkey, trim(chr(9) || ' ' || p_name || chr(10) || '  ', {WS}) AS name,
  length(trim(chr(9) || ' ' || p_name || chr(10) || '  ', {WS})) AS n FROM part
"""


@query("trim_text", _TRIM)
def trim_text(spark, sf):
    padded = F.concat(F.lit("\t "), F.col("p_name"), F.lit("\n  "))
    out = table(spark, sf, "part").select("p_partkey", text.strip(padded).alias("name"))
    return out.withColumn("n", F.length("name").cast("bigint"))


_SLUGS = r"""
WITH p AS (SELECT p_partkey, p_brand, CASE p_partkey % 4 WHEN 0 THEN 'in/' || p_name || ' (é).v2.PDF'
    WHEN 1 THEN p_name WHEN 2 THEN '??.pdf' ELSE '.' || p_brand END AS filename FROM part),
b AS (SELECT *, regexp_extract(filename, '([^/]*)$', 1) AS base FROM p),
s AS (SELECT *, CASE WHEN regexp_matches(base, '^.+\.[^.]+$') THEN regexp_extract(base, '^(.+)\.[^.]+$', 1)
    ELSE base END AS stem FROM b),
g AS (SELECT *, coalesce(nullif(trim(regexp_replace(stem, '[^\p{L}\p{N}_\-]+', '_', 'g'), '_'), ''),
    'purchase_order') AS slug FROM s)
SELECT p_partkey, filename, slug, slug || '_sales_order.json' AS output_name,
  trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS key_slug,
  regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS header_key, base AS base_name FROM g
"""


@query("slugs", _SLUGS)
def slugs(spark, sf):
    filename = choose(
        F.col("p_partkey") % 4,
        {
            0: F.concat(F.lit("in/"), F.col("p_name"), F.lit(" (é).v2.PDF")),
            1: F.col("p_name"), 2: "??.pdf",
        },
        F.concat(F.lit("."), F.col("p_brand")),
    )
    p = table(spark, sf, "part").select("p_partkey", "p_brand", filename.alias("filename"))
    f, b = F.col("filename"), F.col("p_brand")
    return p.select(
        "p_partkey", "filename",
        text.file_slug(f).alias("slug"),
        text.output_name(f, F.lit("sales_order"), ".json").alias("output_name"),
        text.key_slug(b).alias("key_slug"),
        text.header_key(b).alias("header_key"),
        text.base_name(f).alias("base_name"),
    )


_CURRENCY = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '—'
  ELSE CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'INR ' END || format('{:,.2f}', o_totalprice) END AS shown
FROM orders
"""


@query("format_currency", _CURRENCY)
def format_currency(spark, sf):
    o = F.col("o_orderkey")
    value = F.when(o % 5 == 0, "n/a").otherwise(text_of("o_totalprice"))
    currency = F.when(o % 3 == 0, "").otherwise("INR")
    return table(spark, sf, "orders").select(
        "o_orderkey", numbers.format_currency(value, currency).alias("shown")
    )


_TERMS = """
WITH v AS (
  SELECT o_orderkey, o_totalprice AS x, CASE o_orderkey % 5 WHEN 0 THEN 'whole' WHEN 1 THEN 'int'
    WHEN 2 THEN 'text' WHEN 3 THEN 'bool' ELSE 'fraction' END AS form FROM orders)
SELECT o_orderkey, CASE form
    WHEN 'whole' THEN CASE WHEN floor(x) < 10 THEN '' ELSE CAST(CAST(floor(x) AS BIGINT) AS VARCHAR) END
    WHEN 'int' THEN CASE WHEN o_orderkey < 10 THEN '' ELSE o_orderkey::VARCHAR END
    WHEN 'text' THEN 'REF ' || o_orderkey || chr(10) || 'second|REF ' || o_orderkey
    WHEN 'bool' THEN ''
    ELSE printf('%g', x) END AS terms
FROM v
"""


@query("search_terms", _TERMS)
def search_terms(spark, sf):
    o, x = F.col("o_orderkey"), F.col("o_totalprice")
    ref = F.concat(F.lit(" REF "), text_of(o), F.lit("\nsecond "))
    value = choose(
        o % 5, {0: text_of(F.floor(x).cast("double")), 1: text_of(o), 2: ref, 3: "true"}, text_of(x)
    )
    kind = choose(o % 5, {2: "string", 3: "bool"}, "number")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.array_join(locate.search_terms(value, kind), "|").alias("terms")
    )


_EDITS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_totalprice::VARCHAR END AS shown,
  CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN o_totalprice ELSE 0 END::DOUBLE AS amount FROM orders
"""


@query("edit_coercion", _EDITS)
def edit_coercion(spark, sf):
    m, x = F.col("o_orderkey") % 3, F.col("o_totalprice")
    value = F.when(m != 0, text_of(x))
    number_text = F.when(m == 1, F.concat(F.lit(" "), text_of(x), F.lit(" "))).when(m == 2, "12 pcs")
    return table(spark, sf, "orders").select(
        "o_orderkey", numbers.edit_text(value).alias("shown"),
        numbers.edit_number(number_text).alias("amount"),
    )


_COSTS = """
WITH u AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 4 AS m FROM events),
t AS (SELECT event_id, m, CASE WHEN m = 3 THEN 0 ELSE k * 10 END AS i, CASE WHEN m = 3 THEN 0 ELSE k END AS o, k FROM u)
SELECT event_id, i AS input_tokens, o AS output_tokens,
  CASE WHEN m = 1 THEN 7 * k ELSE i + o END AS total_tokens,
  CAST(printf('%.4f', i / 1000.0::DOUBLE * 0.03::DOUBLE + o / 1000.0::DOUBLE * 0.12::DOUBLE) AS DOUBLE) AS cost_inr
FROM t
"""


@query("usage_costs", _COSTS)
def usage_costs(spark, sf):
    k = F.get_json_object("props", "$.k")
    body = choose(
        F.col("event_id") % 4,
        {
            0: F.format_string(
                '{"usage": {"prompt_tokens": %s0, "completion_tokens": %s}}', k, k
            ),
            1: F.format_string(
                '{"usage_metadata": {"prompt_token_count": %s0, "candidates_token_count": %s, '
                '"total_token_count": %d}}', k, k, k.cast("bigint") * 7,
            ),
            2: F.format_string(
                '{"usage": {"prompt_tokens": %s0, "completion_tokens": %s, "total_tokens": 0}}', k, k
            ),
        },
        '{"usage": null}',
    )
    u = table(spark, sf, "events").select("event_id", costs.response_usage(body).alias("u"))
    t = u.select("event_id", "u.*")
    return t.withColumn(
        "cost_inr", costs.cost(F.col("input_tokens"), F.col("output_tokens")).cast("double")
    )


_ERRORS = """
SELECT event_id, CASE WHEN user_id % 6 = 1 THEN 'fatal' WHEN user_id % 6 = 2 THEN 'retryable'
  WHEN event_type IN ('purchase', 'view') THEN 'fatal' ELSE 'retryable' END AS verdict FROM events
"""


@query("classify_errors", _ERRORS)
def classify_errors(spark, sf):
    u = F.col("user_id") % 6
    code = F.when(u == 1, 401).when(u == 2, 503).when(u == 3, 418)
    e = F.col("event_type")
    message = (
        F.when(e == "purchase", "Model NOT FOUND on server")
        .when(e == "view", "Invalid API key, quota exceeded")
        .when(e == "signup", "Rate limit hit: try again")
        .when(e == "error", "Odd failure")
    )
    return table(spark, sf, "events").select(
        "event_id", errors.error_verdict(code, message).alias("verdict")
    )


_HEADERS = "WITH " + ORDER_CELLS + """
SELECT doc_id, path, v AS value FROM cells WHERE section <> '' AND v IS NOT NULL AND v <> ''
"""


@query("nonempty_fields", _HEADERS)
def nonempty_fields(spark, sf):
    """Non-empty values of declared fields, by expression over each order's cells."""
    from ..operators import cells as cl
    from ..sources.live_types import ORDER

    docs = orders_with_customer(spark, sf).select(
        F.col("o_orderkey").alias("doc_id"),
        cl.header_from_columns(ORDER, order_values()).alias("cells"),
    )
    kept = F.filter(
        cl.declared(ORDER, F.col("cells")), lambda c: c.v.isNotNull() & (c.v != "")
    )
    return docs.select("doc_id", F.explode(kept).alias("c")).select(
        "doc_id", "c.path", F.col("c.v").alias("value")
    )
