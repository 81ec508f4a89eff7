"""Exact dedup: immutable snapshots with binary-fuse filters screen arriving digests.

Rows arrive in batches, largest ids first, so whatever an earlier snapshot holds is what
stays. Each batch is digested and its own duplicates are grouped by digest, combined
map-side. The distinct digests are then screened by the static filter of every earlier
snapshot; both lie in small hash buckets, so a task meets a few thousand digests and one
filter at a time. Positives join the exact rows of the snapshot. What no snapshot knows
becomes the next snapshot. At last the bytes decide: texts whose digest occurs more than
once are grouped by digest and whole text.

Defined results: null and empty text are equal. A null id is smaller than every other. Of
rows repeated with one id and one text one is kept. An empty table gives no rows. Other
columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fuse
from .tables import frugal, save, small, text_key, without
from .words import binary

BATCHES = 2
PRINTS = "doc_id LONG, text_key LONG, n_bytes LONG, digest BINARY, key LONG"


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def key_of(digest: bytes) -> int:
    """The first eight bytes as a signed long."""
    return int.from_bytes(digest[:8].ljust(8, b"\0"), "little", signed=True)


def _digests(batch, lower: bool, digest):
    texts = binary(batch.column("_text"))
    data = [t.lower() for t in texts.to_pylist()] if lower else texts.to_pylist()
    return data, [digest(d) for d in data]


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", lower: bool = True, digest=sha256) -> DataFrame:
    """``doc_id, text_key, n_bytes, digest, key`` of each row; bytes.lower() changes A-Z only."""

    def run(batches):
        for batch in batches:
            data, digests = _digests(batch, lower, digest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array([len(d) for d in data], pa.int64()),
                 pa.array(digests, pa.binary()), pa.array([key_of(d) for d in digests], pa.int64())],
                names=["doc_id", "text_key", "n_bytes", "digest", "key"],
            )

    return _narrow(docs, id, text).mapInArrow(frugal(run), PRINTS)


def _narrow(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_text"))


def screened(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Groups whose key the snapshot's filter may hold; bucket by bucket."""
    schema = groups.schema

    def probe(group, left, right):
        if not left.num_rows or not right.num_rows:
            return left.select(schema.names).slice(0, 0)
        row = right.to_pylist()[0] | {"bucket": 0}
        held = fuse.Screen([row], 1).contains(fuse.ids(left.column("key").combine_chunks()))
        return left.select(schema.names).filter(pa.array(held))

    arriving = fuse.with_bucket(groups, "key", buckets)
    return arriving.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, schema)


def _batches(prints: DataFrame, count: int) -> list[DataFrame]:
    """Ranges of the id, largest first; null ids come last."""
    id = F.col("doc_id")
    cuts = sorted({int(x) for x in prints.approxQuantile("doc_id", [k / count for k in range(1, count)], 0.01)}, reverse=True)
    if not cuts:
        return [prints]
    out = [prints.where(id > cuts[0])]
    out += [prints.where((id <= a) & (id > b)) for a, b in zip(cuts, cuts[1:])]
    return [*out, prints.where((id <= cuts[-1]) | id.isNull())]


def exact_dedup(
    docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES, digest=sha256
) -> DataFrame:
    """One row per document: ``doc_id, text_key, keep_id, group_size, kept, digest, n_bytes``.

    ``digest`` may be any function of bytes: a weak one costs time, never a wrong result.
    """
    prints = save(fingerprints(docs, id, text, digest=digest).withColumn("row", F.monotonically_increasing_id()), "prints")
    snapshots, known = [], []
    arrivals = _batches(prints, batches)
    for k, batch in enumerate(arrivals):
        top = F.max(F.struct("doc_id", "row")).alias("top")
        groups = save(batch.groupBy("key", "digest").agg(top, F.count(F.lit(1)).alias("n")), "groups")
        fresh = groups
        for rows, filters, buckets in snapshots:
            positive = screened(groups.select("key", "digest", "n"), filters, buckets)
            met = save(positive.join(rows.select("key", "digest", "top"), ["key", "digest"]), "met")
            known.append(met.select("key", "digest", "top", "n"))
            fresh = fresh.join(small(met.select("key", "digest")), ["key", "digest"], "left_anti")
        fresh = save(fresh, "snapshot") if snapshots else fresh
        known.append(fresh.select("key", "digest", "top", "n"))
        n = fresh.count() if k + 1 < len(arrivals) else 0  # nothing arrives after the last
        if n:
            buckets = max(1, -(-n // fuse.KEYS_PER_FILTER))
            filters = save(fuse.filters(fresh.select("key").distinct(), "key", buckets), "filters")
            snapshots.append((fresh, filters, buckets))
    parts = known[0]
    for k in known[1:]:
        parts = parts.unionByName(k)
    # rows per digest over all batches: one short row per batch and digest
    groups = save(parts.groupBy("key", "digest").agg(F.max("top").alias("top"), F.sum("n").alias("n")), "groups")
    repeated = groups.where("n > 1")
    exact = save(_equal_texts(_narrow(docs, id, text), repeated, digest).drop("data"), "exact")
    clashes = save(exact.groupBy("key", "digest").count().where("count > 1").select("key", "digest"), "clashes")
    rows = prints.join(groups, ["key", "digest"])
    if clashes.count():
        clashed = prints.join(clashes, ["key", "digest"], "left_semi")
        rows = rows.join(clashes, ["key", "digest"], "left_anti")
    out = rows.select(
        "doc_id", "text_key", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("top.row")).alias("kept"), "digest", "n_bytes",
    )
    return out.unionByName(_clashed(_narrow(docs, id, text), clashed, digest)) if clashes.count() else out


def _texts(docs: DataFrame, wanted: DataFrame, digest) -> DataFrame:
    """``key, digest, doc_id, data`` of the rows whose digest is wanted."""
    held = fuse.screen(wanted.select("key").distinct(), "key")

    def run(batches):
        for batch in batches:
            data, digests = _digests(batch, True, digest)
            keys = np.array([key_of(d) for d in digests], np.int64)
            pick = np.flatnonzero(held.value.contains(keys.view(np.uint64))) if held else np.arange(len(keys))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[pick], pa.int64()), pa.array([digests[i] for i in pick], pa.binary()),
                 batch.column("doc_id").take(pa.array(pick)), batch.column("text_key").take(pa.array(pick)),
                 pa.array([data[i] for i in pick], pa.binary())],
                names=["key", "digest", "doc_id", "text_key", "data"],
            )

    return docs.mapInArrow(frugal(run), "key LONG, digest BINARY, doc_id LONG, text_key LONG, data BINARY")


def _equal_texts(docs: DataFrame, repeated: DataFrame, digest) -> DataFrame:
    """The byte check: groups of equal digest and equal whole text, copies combined map-side."""
    texts = _texts(docs, repeated, digest)
    return texts.groupBy("key", "digest", "data").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def _clashed(docs: DataFrame, clashed: DataFrame, digest) -> DataFrame:
    """Results for rows whose digest stands for several texts, by their bytes."""
    from pyspark.sql import Window

    wanted = clashed.select("key", "digest").distinct()
    texts = _texts(docs, wanted, digest).join(wanted, ["key", "digest"], "left_semi")
    groups = texts.groupBy("digest", "data").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    first = F.row_number().over(Window.partitionBy("digest", "data", "doc_id").orderBy("key")) == 1
    rows = texts.withColumn("first", first).join(groups, ["digest", "data"])
    return rows.select(
        "doc_id", "text_key", "keep_id", "group_size", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest", F.octet_length("data").cast("long").alias("n_bytes"),
    )


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; rows move only if the dropped ids don't fit a broadcast."""
    result = save(exact_dedup(docs, id, text), "dedup")
    gone = result.where("NOT kept AND NOT doc_id <=> keep_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    out = without(docs, save(gone.distinct(), "gone"), id, text)
    twins = save(result.where("NOT kept AND doc_id <=> keep_id").select(F.col("doc_id").alias("_twin")).distinct(), "twins")
    if twins.count():
        same = F.col(id).eqNullSafe(F.col("_twin"))
        repeats = out.join(small(twins), same, "left_semi")
        norm = F.coalesce(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
        repeats = repeats.withColumn("_norm", norm).dropDuplicates([id, "_norm"]).drop("_norm")
        out = out.join(small(twins), same, "left_anti").unionByName(repeats)
    return out
