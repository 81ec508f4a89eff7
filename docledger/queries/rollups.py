"""Usage, batch history and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups
from ..plans import bindings as b
from ..sources import tables
from .registry import query
from .sqltext import STATUS, TYPES, USAGE

AS_OF = "2024-01-15"


def _plain(df):
    """Money as double at the edge, where results are compared or shown."""
    return df.select(
        *[
            F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query("src_usage", f"""
WITH {USAGE}
SELECT event_id, date, month, processor, department, model, model_role, is_retry, proc_ms, input_tokens, output_tokens,
  total_tokens, cost_inr::DOUBLE AS cost_inr FROM usage WHERE input_tokens <> 500
""")
def src_usage(spark, sf):
    """Usage log lines and back; only the lines that are cut off are dropped."""
    columns = [
        "event_id", "timestamp", "date", "month", "processor", "department", "model", "model_role",
        "is_retry", "proc_ms", "input_tokens", "output_tokens", "total_tokens", "cost_inr",
    ]
    line = F.to_json(F.struct(*columns))
    cut = F.when(F.col("input_tokens") == 500, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    log = b.usage(spark, sf).select(cut.alias("value"))
    return _plain(tables.parse_json_rows(log, tables.USAGE_SCHEMA).drop("timestamp"))


@query("usage_totals", f"""
WITH {USAGE}, t AS (SELECT count(*) AS docs, CAST(sum(total_tokens) AS BIGINT) AS tokens, sum(cost_inr)::DOUBLE AS cost_inr,
  CAST(sum(proc_ms) AS BIGINT) AS proc_ms, count(*) FILTER (is_retry) AS retry_count FROM usage)
SELECT *, CAST(printf('%.4f', cost_inr / docs) AS DOUBLE) AS avg_cost_inr, tokens // docs AS avg_tokens, proc_ms // docs AS avg_proc_ms FROM t
""")
def usage_totals(spark, sf):
    return _plain(rollups.usage_totals(b.usage(spark, sf)))


@query("usage_breakdowns", f"""
WITH {USAGE}, k AS (SELECT coalesce(processor, '?') AS processor, coalesce(department, '?') AS department, month, model,
  total_tokens, cost_inr, proc_ms FROM usage),
x AS (SELECT 'processor' AS dimension, processor AS key, * FROM k UNION ALL SELECT 'department', department, * FROM k
  UNION ALL SELECT 'month', month, * FROM k UNION ALL SELECT 'model', model, * FROM k)
SELECT dimension, key, count(*) AS docs, CAST(sum(total_tokens) AS BIGINT) AS tokens, sum(cost_inr)::DOUBLE AS cost_inr,
  CAST(sum(proc_ms) AS BIGINT) AS proc_ms FROM x GROUP BY dimension, key
""")
def usage_breakdowns(spark, sf):
    return _plain(rollups.usage_breakdowns(b.usage(spark, sf)))


@query("usage_today", f"""
WITH {USAGE} SELECT count(*) AS docs, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens,
  coalesce(sum(cost_inr), 0)::DOUBLE AS cost_inr, CAST(coalesce(sum(proc_ms), 0) AS BIGINT) AS proc_ms
FROM usage WHERE date = '{AS_OF}'
""")
def usage_today(spark, sf):
    return _plain(rollups.usage_of_day(b.usage(spark, sf), AS_OF))


_COUNTS = """SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'done') AS success,
  count(*) FILTER (n_issues > 0) AS warnings, count(*) FILTER (status = 'error') AS errors FROM docs GROUP BY batch_id"""


@query("batch_counts", f"WITH {STATUS} {_COUNTS}")
def batch_counts(spark, sf):
    return rollups.batch_counts(b.doc_status(spark, sf))


@query("batch_by_type", f"""
WITH {STATUS}, c AS (SELECT batch_id, key AS label, count(*) FILTER (status = 'done') AS n, count(*) FILTER (status <> 'done') AS m FROM docs GROUP BY ALL)
SELECT batch_id, coalesce(string_agg(label || '=' || n, ';' ORDER BY label) FILTER (n > 0), '') AS by_type,
  coalesce(string_agg(label || '=' || m, ';' ORDER BY label) FILTER (m > 0), '') AS other_by_type FROM c GROUP BY batch_id
""")
def batch_by_type(spark, sf):
    """Every document of every batch: the processed ones by type, and the others."""
    m = rollups.batch_by_type(b.doc_status(spark, sf), every=True)

    def shown(counts: str):
        entries = F.transform(F.map_entries(counts), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string")))
        return F.array_join(entries, ";").alias(counts)

    return m.select("batch_id", shown("by_type"), shown("other_by_type"))


_HISTORY = """
hist AS (SELECT strftime(ts, '%Y%m%d') || '-' || event_type AS id, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp,
  count(*) AS total, count(*) FILTER (value > 20) AS success, count(*) FILTER (value <= 5) AS errors
  FROM events GROUP BY strftime(ts, '%Y%m%d') || '-' || event_type)
"""


def _history(spark, sf):
    """Batch records: one per day and event type."""
    day = F.date_format("ts", "yyyyMMdd")
    return (
        b.table(spark, sf, "events")
        .groupBy(F.concat(day, F.lit("-"), F.col("event_type")).alias("id"))
        .agg(
            F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("value") > 20).alias("success"),
            F.count_if(F.col("value") <= 5).alias("errors"),
        )
    )


@query("batches_latest", f"""
WITH {_HISTORY} SELECT id, timestamp, total, success, errors FROM hist WHERE id NOT LIKE '%03-error' ORDER BY id DESC
""")
def batches_latest(spark, sf):
    """Records as JSON texts, read back newest first; a cut record is skipped."""
    text = F.to_json(F.struct("id", "timestamp", "total", "success", "errors"))
    cut = F.when(F.col("id").endswith("03-error"), F.substring(text, 1, 20)).otherwise(text)
    texts = _history(spark, sf).select(cut.alias("value"))
    records = tables.parse_json_rows(texts, tables.BATCH_SCHEMA)
    return tables.latest_batches(records).select("id", "timestamp", "total", "success", "errors")


@query("success_rate", f"""
WITH {STATUS}, c AS ({_COUNTS}), s AS (SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(success) AS BIGINT) AS success FROM c)
SELECT total, success, CAST(round_even(success / total * 100, 0) AS INT) AS success_rate FROM s
""")
def success_rate(spark, sf):
    return rollups.success_rate(rollups.batch_counts(b.doc_status(spark, sf)))




@query("processor_health", f"""
WITH {USAGE}, ty AS (SELECT DISTINCT event_type AS key, event_type <> 'signup' AS live FROM events),
dd AS (SELECT CASE d.lang WHEN 'en' THEN 'view' WHEN 'fr' THEN 'click' WHEN 'de' THEN 'purchase' ELSE 'signup' END AS key,
  l.quality, d.n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
da AS (SELECT key, count(*) AS n, count(*) FILTER (quality = 1) AS done, avg(n_chars % 51 + 50) FILTER (quality = 1) AS conf FROM dd GROUP BY key),
ua AS (SELECT processor AS key, CAST(sum(total_tokens) AS BIGINT) AS tokens FROM usage GROUP BY processor)
SELECT ty.key, upper(ty.key) AS label, 'production' AS status, coalesce(n, 0) AS session_docs,
  coalesce(CAST(printf('%.1f', done / n * 100.0::DOUBLE) AS DOUBLE), 100.0::DOUBLE) AS success_pct,
  coalesce(CAST(printf('%.1f', conf) AS DOUBLE), 0.0::DOUBLE) AS avg_confidence, coalesce(tokens, 0) AS total_tokens
FROM ty LEFT JOIN da ON ty.key = da.key LEFT JOIN ua ON ty.key = ua.key WHERE live
""")
def processor_health(spark, sf):
    key = (
        F.when(F.col("key") == "en", "view").when(F.col("key") == "fr", "click")
        .when(F.col("key") == "de", "purchase").otherwise("signup")
    )
    docs = b.doc_status(spark, sf).withColumn("key", key)
    types = b.table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(
        F.upper(F.first("event_type")).alias("label"),
    ).withColumn("status", F.when(F.col("key") == "signup", "draft").otherwise("production"))
    return rollups.processor_health(types, docs, b.usage(spark, sf))


@query("kpi_dashboard", f"""
WITH {TYPES}, {USAGE}, {STATUS}, {_HISTORY},
ct AS (SELECT count(DISTINCT department) FILTER (status = 'production') AS live_departments,
  count(*) FILTER (status = 'production') AS installed, count(*) AS registered,
  string_agg(DISTINCT label, ', ' ORDER BY label) FILTER (status = 'coming_soon') AS coming_soon FROM types),
us AS (SELECT sum(cost_inr)::DOUBLE AS cost_inr, count(*) FILTER (is_retry) AS retry_count,
  coalesce(sum(cost_inr) FILTER (date = '{AS_OF}'), 0)::DOUBLE AS today_cost_inr,
  CAST(coalesce(sum(total_tokens) FILTER (date = '{AS_OF}'), 0) AS BIGINT) AS today_tokens FROM usage),
hs AS (SELECT CAST(round_even(sum(success) / sum(total) * 100, 0) AS INT) AS success_rate,
  CAST(coalesce(sum(total) FILTER (timestamp LIKE '{AS_OF}%'), 0) AS BIGINT) AS today_documents FROM hist),
ds AS (SELECT CAST(round_even(avg(confidence) FILTER (status = 'done'), 0) AS INT) AS avg_confidence,
  CAST(printf('%.1f', avg(seconds) FILTER (status = 'done')) AS DOUBLE) AS avg_seconds, count(*) FILTER (status = 'pending') AS pending FROM docs)
SELECT * FROM ct, us, hs, ds
""")
def kpi_dashboard(spark, sf):
    out = rollups.dashboard(
        b.types(spark, sf), b.usage(spark, sf), _history(spark, sf), b.doc_status(spark, sf), AS_OF
    )
    return _plain(out)


@query("department_summary", f"""
WITH {TYPES}, per AS (SELECT department, count(*) FILTER (status = 'production') AS live, count(*) AS total FROM types GROUP BY 1)
SELECT 'd_' || r_regionkey AS key, CASE r_name WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(r_name[1]) || lower(r_name[2:]) END AS name,
  coalesce(live, 0) AS live, coalesce(total, 0) AS total FROM region LEFT JOIN per ON department = 'd_' || r_regionkey
""")
def department_summary(spark, sf):
    return rollups.department_summary(b.departments(spark, sf).select("key", "name"), b.types(spark, sf))
