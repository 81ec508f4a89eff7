"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import os
import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry_module
from docledger.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = db.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1500
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NARROW = ["finalize_gate_pass", "finalize_shipping", "classify_keywords", "flatten_json", "locate_terms", "text_layer"]


@pytest.mark.parametrize("name", NARROW)
def test_document_work_does_not_shuffle(spark, name):
    """Only the spread of a one-file input may move rows."""
    plan = plan_of(QUERIES[name](spark, SF))
    exchanges = re.findall(r"Exchange (?:hash|single|range|round)[^\n]*", plan, re.IGNORECASE)
    assert all("REPARTITION_BY_NUM" in ln for ln in exchanges)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"extract_plug", "cache_store", "registers_by_type"}))
def test_no_python_and_no_cross_join(spark, name):
    if name.startswith("stream_"):
        pytest.skip("the plan reads the stream's output")
    plan = plan_of(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert node not in plan


def test_scans_are_pruned(spark):
    plan = plan_of(QUERIES["order_crosscheck"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan
