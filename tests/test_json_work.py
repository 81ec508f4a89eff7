"""Steps of JSON documents that interpret no more than they must, with the results they had."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.functions.text import let
from docledger.plans import finalize
from docledger.sources.live_types import GATE_PASS


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_let_copies_no_result(spark):
    rows = spark.range(3).select(let(F.struct("id", F.sequence(F.lit(0), "id").alias("s")), lambda x: F.size(x.s) + x.id).alias("n"))
    assert sorted(r["n"] for r in rows.collect()) == [1, 3, 5]
    assert "transform(" not in plan_of(rows)


def test_readiness_scores_critical_cells_only(spark):
    raw = '{"vendor": {"code": "V1"}, "purchase_order": {"po_number": "PO7"}, "_confidence": {"vendor.code": 40}}'
    rows = spark.createDataFrame([(1, "a.pdf", raw)], "doc_id INT, filename STRING, raw_text STRING")
    out = finalize.finalize_json(finalize.parse_documents(rows), GATE_PASS)
    fields = {f.path: (f.present, f.confidence) for f in out.first().readiness.fields}
    assert fields["vendor.code"] == (True, 40) and fields["purchase_order.po_number"] == (True, 92)
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        assert " AS cells#" in plan_of(out.select("cells", "readiness"))
        assert " AS cells#" not in plan_of(out.select("readiness"))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
