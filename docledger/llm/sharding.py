"""Sharding: global byte-size prefix sums cut at equal targets.

Documents are ordered by id. Range-partitioned tasks sum their own bytes, the totals of
the tasks shift those sums into global ones, and a document goes to the shard in whose
equal slice of all bytes its midpoint lies: contiguous shards, whose sizes differ by no
more than one document on either border. Only id, size and checksum are shuffled.

Defined results: a null text has size 1 and the checksum of no bytes. Null ids come first.
Rows that tie (repeated rows) take places beside each other in any order. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .tables import numbered, save

SHARDS = 8


def assign_shards(docs: DataFrame, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row per document."""
    data = F.coalesce(F.col(text), F.lit(""))
    sized = docs.select(
        F.col(id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
    )
    rows = numbered(sized, ["doc_id", "text_crc32", "size"], "size", "shards")
    ends = rows.agg(F.max(F.col("before") + F.col("size")).alias("total")).first()
    total = ends["total"] or 1
    slice_of = F.expr(f"CAST(2 * before + size AS DECIMAL(38, 0)) * {shards} DIV {2 * total}")
    placed = rows.withColumn("shard", F.least(F.lit(shards - 1), slice_of).cast("int"))
    placed = save(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("pos").alias("first"))  # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("pos") - F.col("first")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write whole documents into one folder per shard, each ordered by slot inside its files.

    Documents are range-partitioned by id, as the shards are, into several tasks a shard.
    """
    places = save(assign_shards(docs, shards, id, text), "places").select(
        F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot"
    ).dropDuplicates(["_id", "_size", "_crc"])
    data = F.coalesce(F.col(text), F.lit(""))
    same = (F.col(id).eqNullSafe(F.col("_id")) & (F.octet_length(data) + 1 == F.col("_size"))
            & (F.crc32(data.cast("binary")) == F.col("_crc")))
    rows = docs.join(places, same).drop("_id", "_size", "_crc")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
