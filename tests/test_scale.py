"""Work that must not be repeated for a row or land in one task."""

from __future__ import annotations

from pyspark.sql import functions as F

from docledger.operators import joins, manifests


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spread_of_one_row_group_in_many_splits(spark, tmp_path):
    path, slots = str(tmp_path / "one"), spark.sparkContext.defaultParallelism
    spark.range(0, 100_000, numPartitions=1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= slots  # all rows lie in one of them
        sizes = joins.spread(scan, "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) >= slots and max(r["count"] for r in sizes) < 100_000 / slots * 1.5


def test_manifests_are_parsed_once(spark):
    texts = spark.createDataFrame([('{"key": "a"}',), (' {"key": "b"}',), ("[]",), ("{",)], "raw STRING")
    out = manifests.parse_manifests(texts)
    assert sorted(r["key"] for r in out.collect()) == ["a", "b"]
    assert plan_of(out).count("from_json(") == 1
