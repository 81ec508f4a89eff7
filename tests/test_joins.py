"""Salted joins and the small faults of single rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docledger.functions.scores import reported_score
from docledger.operators import intake, joins, rollups


def test_hot_keys_and_salted_join(spark):
    fact = spark.range(2000).select(F.when(F.col("id") < 1200, 1).otherwise(F.col("id")).alias("k"), "id")
    dim = spark.range(0, 2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert [(r["k"], r["n"]) for r in joins.hot_keys(fact, ["k"], 1 / 64, 10)] == [(1, 1200)]
    out = joins.lookup_join(fact, dim, "k", measure_dim=False, hot_rows=10)
    assert out.count() == 2000 and out.where("v != 2 * k OR v IS NULL").count() == 0


@pytest.mark.parametrize("how", ["right", "full", "full_outer", "right_outer"])
def test_joins_that_would_repeat_rows_are_refused(spark, how):
    with pytest.raises(ValueError):
        joins.lookup_join(spark.range(3), spark.range(3), "id", how)


def test_batches_with_a_document_without_label(spark):
    rows = [("b", "x", "done", 0), ("b", None, "done", 2), ("b", "x", "error", 1), ("b", "y", "pending", None), ("c", "x", "error", 0)]
    docs = spark.createDataFrame(rows, "batch_id STRING, label STRING, status STRING, n_issues INT")
    assert rollups.batch_by_type(docs).first()["by_type"] == {"x": 1}
    got = {r.batch_id: r for r in rollups.batch_records(docs).collect()}
    assert (got["b"].total, got["b"].success, got["b"].warnings, got["b"].errors) == (4, 2, 2, 1)
    assert got["b"].by_type == {"x": 1} and got["b"].files == ["x_register.csv"]
    assert got["c"].by_type == {} and got["c"].files == []


def test_department_names(spark):
    keys = ["hr", "night_shift_2nd_line", "", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i INT, department STRING")
    want = ["Human Resources", "Night Shift 2Nd Line", "", ""]
    assert [r.department_name for r in rollups.department_names(rows).orderBy("i").collect()] == want
    own = spark.createDataFrame([("hr", "People")], "key STRING, name STRING")
    got = rollups.department_names(rows, own).orderBy("i").collect()
    assert [r.department_name for r in got] == ["People", *want[1:]]


def test_equal_rows_of_a_hot_key_are_salted(spark):
    """A thousand equal rows go through the join as one with a count, and come out again."""
    fact = spark.range(2000).select(F.when(F.col("id") < 1200, 1).otherwise(F.col("id")).alias("k"))
    dim = spark.range(0, 1500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = fact.join(dim, "k", how)
        got = joins.lookup_join(fact, dim, "k", how, measure_dim=False, hot_rows=10)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_cache_ties_do_not_depend_on_order(spark):
    rows = [("k", f'{{"a": {i}}}', 1) for i in range(20)]
    df = spark.createDataFrame(rows, "cache_key STRING, payload STRING, stored_at INT")
    assert len({intake.cache_entries(df.repartition(n)).first()["payload"] for n in (1, 3, 7)}) == 1


def test_large_reported_scores_are_clamped(values):
    assert values(reported_score, ["1e301", "-1e305", "50.4"]) == [100, 0, 50]
