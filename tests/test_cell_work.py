"""Cells, types and scores by less work per row, with the results they had."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docledger.functions import jsondoc
from docledger.operators import cells as cl
from docledger.operators import confidence
from docledger.sources.specs import DocSpec, Field


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_parsed_response_is_not_walked_for_its_type(spark):
    texts = ['{"a": 1}', " \n{}", "[1]", '"{"', "5", "```json\n{}\n```", "x [1] {\"b\": 2} y", "[{}", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, raw STRING")
    out = rows.select("i", jsondoc.parse_response(F.col("raw")).alias("r")).select("i", "r.error", "r.text")
    errors = [r["error"] for r in out.orderBy("i").collect()]
    no, bad = "no JSON object found", "not a JSON object"
    assert errors == [None, None, bad, bad, bad, None, None, None, "empty output"] and no not in errors
    assert "schema_of_variant" not in plan_of(out).lower() and "SchemaOfVariant" not in plan_of(out)


@pytest.mark.parametrize("paths", [["a.b", "a.c", "d"], ["a", "a.b", "d"], ["a.b", "A.b", "d"]])
def test_header_cells_by_tree(spark, paths):
    spec = DocSpec("x", "X", fields=[Field(p, p, "text") for p in paths], skeleton={p: "" for p in paths})
    raw = '{"a": {"b": {"x": 1}, "c": null}, "A": {"b": 2.0}, "a.b": "dots", "d": "5"}'
    rows = spark.createDataFrame([(raw,), ('{"a": 3, "d": [true]}',), ("{}",)], "raw STRING")
    rows = rows.withColumn("data", F.try_parse_json("raw"))
    tree = cl.leaf_tree(spec, F.col("data")) if cl.has_tree(spec) else None
    assert cl.has_tree(spec) == (paths == ["a.b", "a.c", "d"])
    if tree is not None:
        rows = rows.withColumn("tree", tree)
        tree = F.col("tree")
    read = lambda t: [r[0] for r in rows.select(cl.header_from_variant(spec, F.col("data"), tree=t)).collect()]
    assert read(tree) == read(None)
    if tree is not None:
        assert [(c.v, c.t, c.given) for c in read(tree)[0]] == [('{"x":1}', "object", True), ("", "string", False), ("5", "string", True)]


def test_summary_of_scores(spark):
    rows = spark.sql("SELECT transform(array(0, 50, 75, 94, 95, 100, NULL), x -> named_struct('score', x)) AS c")
    s = rows.select(confidence.summary(F.col("c")).alias("s")).first()["s"].asDict()
    assert s == {"scored": 5, "score_sum": 414, "high": 2, "review": 2, "verify": 2}


def test_members_are_not_searched_by_name(spark):
    texts = ['{"b": 1, "a": {"c": [2, {"d": "x"}], "_confidence": {"c": 9}}, "_confidence": {"b": 5}}', '{"a.b": 1, "a": {"b": 2}}', "{}"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, raw STRING").withColumn("data", F.try_parse_json("raw"))
    out = rows.select("i", jsondoc.flatten(F.col("data"), F.col("raw")).alias("f")).orderBy("i")
    got = [sorted((c.path, c.v) for c in r["f"]) for r in out.collect()]
    assert got == [[("a.c[0]", "2"), ("a.c[1].d", "x"), ("b", "1")], [("a.b", "2")], []]
    assert "map_entries(" in plan_of(out)
