"""Incremental jobs run to the end of the given tables; their results are tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.intake import uploads
from ..plans import bindings as b
from ..session import saved, scratch_folder
from ..streaming import jobs
from .registry import query
from .sqltext import FILES, USAGE


class _StreamTables:
    """Stands for a session whose ``read.parquet`` opens a table as a stream.

    The path is given as a pattern, so that a table may be one file or a folder.
    """

    def __init__(self, spark):
        self.read = self
        self._spark = spark

    def parquet(self, path):
        schema = self._spark.read.parquet(path).schema
        return self._spark.readStream.schema(schema).parquet(path[:-1] + f"[{path[-1]}]")


@query("stream_usage", f"""
WITH {USAGE} SELECT date, coalesce(processor, '?') AS processor, count(*) AS docs, CAST(sum(total_tokens) AS BIGINT) AS tokens,
  sum(cost_inr)::DOUBLE AS cost_inr FROM usage GROUP BY ALL
""")
def stream_usage(spark, sf):
    folder = scratch_folder(spark, "usage")
    usage = b.usage(_StreamTables(spark), sf)
    jobs.start_usage_rollup(usage, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return jobs.current_usage(spark, f"{folder}/out").withColumn(
        "cost_inr", F.col("cost_inr").cast("double")
    )


@query("stream_first_seen", f"""
WITH {FILES} SELECT sha1, min(doc_id) AS first_doc, arg_min(filename, doc_id) AS first_file FROM files GROUP BY sha1
""")
def stream_first_seen(spark, sf):
    folder = scratch_folder(spark, "first-seen")
    rows = b.files(_StreamTables(spark), sf).select(
        F.sha1("content").alias("sha1"), F.col("doc_id").alias("first_doc"),
        F.col("filename").alias("first_file"),
    )
    jobs.start_first_seen(
        rows, f"{folder}/out", f"{folder}/checkpoint", ["first_doc"], ["first_doc", "first_file"]
    ).awaitTermination()
    return jobs.current_index(spark, f"{folder}/out", jobs.index_schema(rows, ["first_doc", "first_file"]))


@query("stream_uploads", f"""
WITH {FILES} SELECT filename || ':' || substr(sha1, 1, 10) AS upload_id, doc_id, filename, sha1 FROM files WHERE filename NOT LIKE '%.txt'
""")
def stream_uploads(spark, sf):
    folder = scratch_folder(spark, "uploads")
    files = uploads(b.files(_StreamTables(spark), sf)).select(
        "upload_id", "doc_id", "filename", "sha1"
    )
    jobs.start_intake(files, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_first_seen_batches", f"""
WITH {FILES}, w AS (SELECT *, doc_id % 3 AS wave FROM files), f AS (SELECT sha1, min(wave) AS wave FROM w GROUP BY sha1)
SELECT w.sha1, min(doc_id) AS first_doc, arg_min(filename, doc_id) AS first_file FROM w JOIN f ON w.sha1 = f.sha1 AND w.wave = f.wave GROUP BY w.sha1
""")
def stream_first_seen_batches(spark, sf):
    """Documents arrive in three batches; the first batch that has a content names its first document."""
    folder, names = scratch_folder(spark, "first-seen"), ["first_doc", "first_file"]
    arrived = b.files(spark, sf).select(
        F.sha1("content").alias("sha1"), F.col("doc_id").alias("first_doc"), F.col("filename").alias("first_file"),
    )
    arrived = saved(arrived, "hashes")
    for wave in range(3):
        arrived.where(F.col("first_doc") % 3 == wave).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{folder}/in")
        jobs.start_first_seen(stream, f"{folder}/out", f"{folder}/checkpoint", ["first_doc"], names, every=2).awaitTermination()
    return jobs.current_index(spark, f"{folder}/out", jobs.index_schema(arrived, names))


@query("stream_usage_batches", f"""
WITH {USAGE}, t AS (SELECT *, CAST(ts AS DATE) - CAST((SELECT min(ts) FROM events) AS DATE) AS d FROM usage)
SELECT date, coalesce(processor, '?') AS processor, CAST(sum(CASE WHEN d = 19 AND hour(ts) >= 12 AND event_id % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS docs,
  CAST(sum(total_tokens * CASE WHEN d = 19 AND hour(ts) >= 12 AND event_id % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS tokens,
  sum(cost_inr * CASE WHEN d = 19 AND hour(ts) >= 12 AND event_id % 5 = 0 THEN 2 ELSE 1 END)::DOUBLE AS cost_inr
FROM t GROUP BY ALL
""")
def stream_usage_batches(spark, sf):
    """The log in three runs of ten days and the rest; the last brings old news with it.

    Repeated events of the day before count once, new late ones of that day are added, and
    events of the first week come too late for their windows, which are closed.
    """
    folder = scratch_folder(spark, "usage")
    usage = b.usage(spark, sf).select("event_id", "ts", "processor", "total_tokens", "cost_inr")
    first = b.table(spark, sf, "events").agg(F.min("ts")).first()[0]
    day = F.datediff(F.col("ts"), F.lit(first).cast("timestamp"))
    usage = saved(usage.withColumn("d", day), "log")
    late = usage.where((F.col("d") == 19) & (F.hour("ts") >= 12))
    renamed = (F.col("event_id") + (1 << 40)).alias("event_id")
    others = [c for c in usage.columns if c != "event_id"]
    last = usage.where("d >= 20").unionByName(late.where("event_id % 2 = 0"))
    last = last.unionByName(late.where("event_id % 5 = 0").select(renamed, *others)).unionByName(usage.where("d < 7").select(renamed, *others))
    for wave in (usage.where("d < 10"), usage.where("d >= 10 AND d < 20"), last):
        wave.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(usage.schema).parquet(f"{folder}/in")
        jobs.start_usage_rollup(stream, f"{folder}/out", f"{folder}/checkpoint", "event_id", every=2).awaitTermination()
    return jobs.current_usage(spark, f"{folder}/out").withColumn("cost_inr", F.col("cost_inr").cast("double"))
