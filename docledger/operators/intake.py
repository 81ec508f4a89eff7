"""Uploads, fingerprints, the extraction cache and the document collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import mime_type
from .joins import lookup_join

#: Ids of one broadcast (8 bytes each) and broadcasts of one scan each that pick rows by id.
PICKED_IDS = 2_000_000
PICKED_SCANS = 8


def upload_id(filename: Column, sha1: Column) -> Column:
    return F.concat(filename, F.lit(":"), F.substring(sha1, 1, 10))


def uploads(files: DataFrame) -> DataFrame:
    """One row per supported file of ``(filename, content, ...)``; content is only hashed.

    The hash replaces the content, so no later shuffle carries it.
    """
    sha1 = F.sha1(F.col("content"))
    return (
        files.withColumn("mime_type", mime_type(F.col("filename")))
        .where("mime_type IS NOT NULL")
        .withColumn("sha1", sha1)
        .withColumn("upload_id", upload_id(F.col("filename"), F.col("sha1")))
        .drop("content")
    )


def first_seen(rows: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """First record per fingerprint, combined map-side, so copies never gather."""
    return rows.groupBy("sha1").agg(
        F.min_by(F.struct(*keep), F.struct(*order)).alias("first")
    ).select("sha1", *[F.col(f"first.{c}").alias(c) for c in keep])


def known_copies(new: DataFrame, index: DataFrame) -> DataFrame:
    """Uploads whose fingerprint is in the index, with the record of its first use."""
    return lookup_join(new, index, "sha1", "inner", measure_dim=False, probe=False)


def not_loaded(new: DataFrame, loaded: DataFrame) -> DataFrame:
    ids = loaded.select("upload_id").distinct()
    return lookup_join(new, ids, "upload_id", "left_anti", measure_dim=False, probe=False)


def extend_index(index: DataFrame, new: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """Rows to append to a first-wins index: the first copy of each unseen fingerprint."""
    return first_seen(new, order, keep).join(index.select("sha1"), "sha1", "left_anti")


def upsert(collection: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Replace rows by key and add new ones; ``changes`` is unique per key."""
    kept = collection.join(changes.select(key), key, "left_anti")
    return kept.unionByName(changes)


def cache_key(type_key: Column, prompt_version: Column, sha1: Column) -> Column:
    return F.concat_ws("_", type_key, prompt_version, sha1)


def cache_entries(cache: DataFrame) -> DataFrame:
    """Latest readable payload per key, of equally late ones that of the largest hash; a corrupt payload is a miss."""
    readable = cache.where(F.try_parse_json("payload").isNotNull())
    latest = F.max_by("payload", F.struct("stored_at", F.xxhash64("payload")))
    return readable.groupBy("cache_key").agg(latest.alias("payload"))


def cache_split(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """Documents with their cached payload and a ``hit`` flag."""
    entries = cache_entries(cache).withColumn("hit", F.lit(True))
    out = lookup_join(documents, entries, "cache_key", "left", measure_dim=False, probe=False)
    return out.withColumn("hit", F.coalesce("hit", F.lit(False)))


def latest_success(attempts: DataFrame, keep: list[str]) -> DataFrame:
    """Last attempt that succeeded, among the first run and its single retry.

    A document whose attempts all failed keeps a row with NULL results.
    """
    allowed = attempts.where(F.col("attempt") <= 1)
    return allowed.groupBy("doc_id").agg(
        F.max_by(
            F.when(F.col("ok"), F.struct("attempt", *keep)),
            F.when(F.col("ok"), F.col("attempt")),
        ).alias("last"),
        F.count(F.lit(1)).alias("attempts"),
    ).select("doc_id", "attempts", "last.attempt", *[F.col(f"last.{c}").alias(c) for c in keep])


def leaders(documents: DataFrame, cache: DataFrame) -> DataFrame:
    """``cache_key, doc_id``: the one document per key that is not in the cache to be extracted.

    ``documents``: ``doc_id, cache_key``. Copies within the batch are reduced map-side, so a
    content that a third of all documents share is one row per task.
    """
    first = documents.groupBy("cache_key").agg(F.min("doc_id").alias("doc_id"))
    return first.join(cache_entries(cache).select("cache_key"), "cache_key", "left_anti")


def pick(source: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of a wide source whose id is in ``ids``, filtered where they are scanned.

    Ids are counted, dealt into blocks that fit a broadcast, and each block is a scan of its
    own, so wide columns such as texts are in no exchange. Beyond ``PICKED_SCANS`` blocks one
    exchange of the picked rows costs less than so many scans, and takes their place.
    """
    ids = ids.select(key)
    blocks = max(1, -(-ids.count() // PICKED_IDS))
    if blocks > PICKED_SCANS:
        return source.join(ids, key, "left_semi")
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    parts = [source.join(F.broadcast(ids.where(block == k)), key, "left_semi") for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def payload(data: Column, ai_scores: Column) -> Column:
    """Cache payload of JSON texts: the extracted data beside the model's own scores."""
    empty = F.lit("{}")
    return F.concat(
        F.lit('{"data":'), F.coalesce(data, empty), F.lit(',"ai_scores":'), F.coalesce(ai_scores, empty), F.lit("}")
    )


def store(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with new payloads (``cache_key, payload, stored_at``), one row per key, the latest."""
    both = cache.select("cache_key", "payload", "stored_at").unionByName(fresh.select("cache_key", "payload", "stored_at"))
    latest = F.max_by(F.struct("payload", "stored_at"), F.struct("stored_at", F.xxhash64("payload")))
    return both.where(F.try_parse_json("payload").isNotNull()).groupBy("cache_key").agg(latest.alias("r")).select("cache_key", "r.*")


def append_cache(fresh: DataFrame, path: str) -> None:
    """Append payloads to a cache folder; ``cache_entries`` reads the latest per key."""
    fresh.select("cache_key", "payload", "stored_at").write.mode("append").parquet(path)


def served(documents: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every document with its payload and how it got it: ``cache``, ``extracted`` or ``copied``.

    ``fresh``: ``cache_key, payload, doc_id`` of the leaders that were extracted; documents of
    the same key take the leader's payload. A key whose extraction failed has none.
    """
    old = cache_entries(cache).select("cache_key", "payload", F.lit(None).cast("bigint").alias("leader"), F.lit(True).alias("old"))
    new = fresh.select("cache_key", "payload", F.col("doc_id").cast("bigint").alias("leader"), F.lit(False).alias("old"))
    # leaders are documents whose key the cache lacks, so a key is in one of both
    out = lookup_join(documents, old.unionByName(new), "cache_key", "left", measure_dim=False, probe=False)
    how = F.when(F.col("old"), "cache").when(F.col("leader") == F.col("doc_id"), "extracted").when(F.col("leader").isNotNull(), "copied")
    return out.withColumn("served", how).drop("leader", "old")


def extract_misses(misses: DataFrame, extractor, schema: str) -> DataFrame:
    """Run a user's extractor on cache misses only.

    ``extractor`` maps an iterator of pandas batches to batches of ``schema``: the
    one place where user Python code runs, streamed batch by batch.
    """
    return misses.mapInPandas(extractor, schema)
