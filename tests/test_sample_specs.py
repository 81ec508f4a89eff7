"""Specs derived from sample documents by less work per member."""

from __future__ import annotations

from docledger.operators import manifests


def test_members_of_samples_are_listed_once(spark):
    raw = '{"b": {"y": 1, "x": "t", "z": null, "o": {}}, "n": null, "e": [], "l": [null], "i": [{"q": 1, "r": []}], "j": [{"k": 2}]}'
    out = manifests.derive_spec(spark.createDataFrame([(1, raw)], "doc_id INT, raw STRING"))
    got = [(r.part, r.path, r.kind) for r in out.collect()]
    assert got == [("field", "b.x", "text"), ("field", "b.y", "number"), ("field", "b.z", "text"), ("item", "q", "number"), ("item", "r", "text")]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("map<string,variant>") <= 3
