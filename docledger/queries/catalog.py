"""Manifests, field catalogs, departments and lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, manifests, register
from ..operators.joins import spread
from ..plans import bindings as b
from .registry import query
from .sqltext import TYPES

# Parts that are valid manifests, with the values the manifest texts carry.
_PARTS = """
m AS (SELECT p_partkey AS p, 'part_' || p_partkey AS key, p_name, p_brand, p_type, p_size FROM part
  WHERE p_partkey % 10 NOT IN (8, 9) AND p_partkey % 25 <> 24 AND NOT (p_partkey % 50 = 7 AND p_partkey % 11 <> 0)),
d AS (SELECT *, CASE WHEN p % 3 <> 0 THEN p_name ELSE 'Part ' || p END AS document_type,
  CASE WHEN p % 4 <> 0 THEN p_brand WHEN p % 3 <> 0 THEN p_name ELSE '' END AS business_process,
  CASE p % 6 WHEN 1 THEN 'testing' WHEN 2 THEN 'draft' WHEN 3 THEN 'coming_soon' ELSE 'production' END AS status,
  CASE p % 7 WHEN 2 THEN CAST(round_even(p_size + 0.5::DOUBLE, 0) AS INT) WHEN 3 THEN p_size END AS accuracy,
  CASE WHEN p % 9 <> 0 THEN 'dept_' || (p_size % 8) ELSE '' END AS department,
  CASE WHEN p % 9 <> 0 THEN p_type ELSE '' END AS department_name,
  CASE WHEN p % 9 <> 0 THEN p_size % 8 ELSE 100 END AS department_order FROM m)
"""
_FIELDS = """
f AS (
  SELECT key, p, 'field' AS part, 0 AS outer, 0 AS inner, 'Main' AS title, 'head.name' AS path, 'Name' AS label, 'text' AS kind, FALSE AS required FROM d WHERE p % 11 <> 0
  UNION ALL SELECT key, p, 'field', 0, 1, 'Main', 'head.code', 'Code', 'text', p % 3 = 0 FROM d WHERE p % 11 <> 0
  UNION ALL SELECT key, p, 'field', 1, 0, '', CASE WHEN p % 2 = 0 THEN 'sum.total' ELSE 'sum.rest' END,
    CASE WHEN p % 2 = 0 THEN 'sum.total' ELSE 'sum.rest' END, 'number', FALSE FROM d WHERE p % 11 <> 0
  UNION ALL SELECT key, p, 'item', 0, 0, '', 'qty', 'qty', 'number', FALSE FROM d WHERE p % 2 = 0
  UNION ALL SELECT key, p, 'item', 0, 1, '', 'unit', 'Unit', 'text', FALSE FROM d WHERE p % 2 = 0
  UNION ALL SELECT key, p, 'export', 0, 0, '', 'head.name', 'head.name', 'first', FALSE FROM d WHERE p % 4 = 1
  UNION ALL SELECT key, p, 'export', 0, 1, '', 'items.qty', 'Qty', 'sum', FALSE FROM d WHERE p % 4 = 1
  UNION ALL SELECT key, p, 'critical', 0, 0, '', 'head.name', 'head.name', 'text', TRUE FROM d WHERE p % 5 = 0)
"""


def _manifests(spark, sf):
    return manifests.parse_manifests(b.manifest_texts(spark, sf))


@query("src_catalog", f"""
WITH {_PARTS} SELECT key, document_type, status, department FROM d ORDER BY department_order, lower(business_process), key
""")
def src_catalog(spark, sf):
    return manifests.catalog_order(_manifests(spark, sf)).select(
        "key", "document_type", "status", "department"
    )


@query("catalog_defaults", f"""
WITH {_PARTS} SELECT key, document_type, business_process, status, accuracy, key AS json_suffix, 'v1' AS prompt_version,
  department, department_name, department_order, replace(lower(p_name), ' ', ',') AS keywords,
  CASE WHEN p % 2 = 0 THEN 'items' END AS items_path FROM d
""")
def catalog_defaults(spark, sf):
    return _manifests(spark, sf).select(
        "key", "document_type", "business_process", "status", "accuracy", "json_suffix",
        "prompt_version", "department", "department_name", "department_order",
        F.array_join("keywords", ",").alias("keywords"), "items_path",
    )


@query("catalog_fields", f"""
WITH {_PARTS}, {_FIELDS} SELECT key, part, "outer", "inner", title, path, label, kind, required FROM f
""".replace("AS outer,", 'AS "outer",').replace("AS inner,", 'AS "inner",'))
def catalog_fields(spark, sf):
    return manifests.field_catalog(_manifests(spark, sf))


@query("critical_fields", f"""
WITH {_PARTS}, {_FIELDS},
t AS (SELECT key, 1 AS tier, "inner" AS pos, path, label, kind FROM f WHERE part = 'critical'
  UNION ALL SELECT key, 2, 0, path, label, kind FROM f WHERE part = 'field' AND required
  UNION ALL SELECT key, 3, 0, path, label, kind FROM f WHERE part = 'field' AND path = 'sum.total'
  UNION ALL SELECT key, 4, "outer" * 2 + "inner", path, label, kind FROM f WHERE part = 'field'),
k AS (SELECT *, min(tier) OVER (PARTITION BY key) AS best FROM t)
SELECT key, tier, pos, path, label, kind FROM k WHERE tier = best
""".replace("AS outer,", 'AS "outer",').replace("AS inner,", 'AS "inner",'))
def critical_fields(spark, sf):
    return manifests.critical_fields(_manifests(spark, sf))


@query("lifecycle_next", f"""
WITH {_PARTS} SELECT key, status,
  CASE status WHEN 'draft' THEN 'testing' WHEN 'testing' THEN 'production' ELSE status END AS promoted,
  CASE status WHEN 'production' THEN 'testing' WHEN 'testing' THEN 'draft' ELSE status END AS demoted FROM d
""")
def lifecycle_next(spark, sf):
    s = F.col("status")
    return _manifests(spark, sf).select(
        "key", "status", manifests.next_status(s, manifests.PROMOTE).alias("promoted"),
        manifests.next_status(s, manifests.DEMOTE).alias("demoted"),
    )


@query("catalog_active", f"""
WITH {TYPES} SELECT key, department, status, status = 'production' AS can_process, status <> 'coming_soon' AS dev_can_process,
  status IN ('production', 'coming_soon') AS visible FROM types
""")
def catalog_active(spark, sf):
    s = F.col("status")
    return b.types(spark, sf).select(
        "key", "department", "status",
        manifests.can_process(s, developer=False).alias("can_process"),
        manifests.can_process(s, developer=True).alias("dev_can_process"),
        manifests.is_visible(s, developer=False).alias("visible"),
    )


@query("candidates_fallback", f"""
WITH {TYPES}, a AS (SELECT * FROM types WHERE status = 'production')
SELECT 'd_1' AS asked, key FROM a WHERE department = 'd_1'
UNION ALL SELECT 'd_4', key FROM a
""")
def candidates_fallback(spark, sf):
    """A department with live types of its own, and one without (all live types)."""
    types = b.types(spark, sf)
    parts = [
        classify.candidates_for(types, d).select(F.lit(d).alias("asked"), "key")
        for d in ("d_1", "d_4")
    ]
    return parts[0].unionByName(parts[1])


@query("candidates_all", f"""
WITH {TYPES}, a AS (SELECT * FROM types WHERE status = 'production'),
d AS (SELECT department AS asked, count(*) FILTER (status = 'production') AS n FROM types GROUP BY 1)
SELECT asked, key FROM d JOIN a ON n = 0 OR department = asked
""")
def candidates_all(spark, sf):
    """Every department, with live types of its own or without."""
    return classify.candidates_by_department(b.types(spark, sf))


@query("catalog_order", f"""
WITH {TYPES}, r AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY CASE WHEN status = 'production' THEN 0 ELSE 1 END, lower(business_process), key) AS pick,
  row_number() OVER (PARTITION BY department ORDER BY lower(business_process), key) AS place FROM types)
SELECT key, department, department_order, business_process, pick = 1 AS default_pick FROM r ORDER BY department_order, lower(business_process), key
""")
def catalog_order(spark, sf):
    types = b.types(spark, sf)
    picks = manifests.default_pick(types).withColumnRenamed("default_key", "key").withColumn(
        "default_pick", F.lit(True)
    )
    marked = types.join(picks, ["department", "key"], "left")
    return manifests.catalog_order(marked).select(
        "key", "department", "department_order", "business_process",
        F.coalesce("default_pick", F.lit(False)).alias("default_pick"),
    )


@query("derive_spec", """
WITH o AS (SELECT o_orderkey AS doc_id, o_orderstatus AS s FROM orders)
SELECT doc_id, 'field' AS part, 'Zeta Block' AS section, 'zeta_block.order_id' AS path, 'Order Id' AS label, 'number' AS kind FROM o
UNION ALL SELECT doc_id, 'field', 'Zeta Block', 'zeta_block.flag', 'Flag', 'text' FROM o
UNION ALL SELECT doc_id, 'field', 'Head', 'head.status', 'Status', 'text' FROM o WHERE s <> 'P'
UNION ALL SELECT doc_id, 'item', CASE WHEN s = 'F' THEN 'rows' ELSE 'items' END, k, kl, kd FROM o,
  (VALUES ('unit_price', 'Unit Price', 'number'), ('name', 'Name', 'text')) AS v(k, kl, kd)
""")
def derive_spec(spark, sf):
    """Sample documents of three shapes: key order decides which list comes first."""
    o, s = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = '[{"unit_price": 2.5, "name": "x"}, {"other": 1}]'
    lists = F.when(s == "F", F.lit(f'"rows": {rows}, "items": [{{"z": 1}}]')).otherwise(
        F.lit(f'"tags": ["a"], "empty": [], "items": {rows}, "alist": [{{"z": 1}}]')
    )
    head = F.when(s == "P", '"head": {"status": []}').otherwise('"head": {"status": "ok"}')
    raw = F.concat(
        F.lit('{"metadata": {"a": 1}, "zeta_block": {"order_id": '), b.text_of(o),
        F.lit(', "flag": true, "deep": {"x": 1}}, '), head, F.lit(', "title": "t", '), lists, F.lit("}"),
    )
    samples = spread(b.table(spark, sf, "orders"), "o_orderkey").select(o.alias("doc_id"), raw.alias("raw"))
    return manifests.derive_spec(samples)


@query("header_match", """
WITH t AS (SELECT p_partkey // 40 AS sheet, p_partkey AS pos, p_name AS header FROM part),
h AS (SELECT sheet, replace(header, ' ', '') AS k, min(pos) AS pos FROM t GROUP BY ALL),
wd AS (SELECT sheet, max(pos) AS width FROM t GROUP BY 1),
w AS (SELECT p_partkey // 40 AS sheet, p_partkey AS ord, CASE WHEN p_size % 3 = 0 THEN upper(p_name) || ' (' || p_type || ')' ELSE upper(p_name) || '.' END AS header FROM part),
j AS (SELECT w.*, h.pos AS spot, wd.width FROM w LEFT JOIN h ON w.sheet = h.sheet AND h.k = regexp_replace(lower(w.header), '[^a-z0-9]', '', 'g')
  LEFT JOIN wd ON w.sheet = wd.sheet)
SELECT sheet, ord, header, CAST(coalesce(spot, width + row_number() OVER (PARTITION BY sheet, spot IS NULL ORDER BY ord)) AS INT) AS col, spot IS NOT NULL AS matched FROM j
""")
def header_match(spark, sf):
    """Forty parts as a sheet: their names as headers, and printed forms to place."""
    parts = b.table(spark, sf, "part").withColumn("sheet", F.floor(F.col("p_partkey") / 40))
    template = parts.select(
        "sheet", F.col("p_partkey").alias("pos"), F.col("p_name").alias("header")
    )
    name = F.upper("p_name")
    wanted = F.when(
        F.col("p_size") % 3 == 0, F.concat(name, F.lit(" ("), F.col("p_type"), F.lit(")"))
    ).otherwise(F.concat(name, F.lit(".")))
    return register.match_headers(
        template,
        parts.select(
            "sheet", F.col("p_partkey").alias("ord"), wanted.alias("header")
        ),
    )
