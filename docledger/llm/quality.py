"""Quality classifier by importance resampling.

Two generative models over hashed n-grams are counted: one on target text (labelled good
documents) and one on all raw text. A document's log importance weight is the sum over its
n-grams of log(target / raw). Adding Gumbel noise and keeping the k largest keys draws k
documents without replacement by those weights. k is not set by hand: it is the number of
documents whose weight is at least that of nearly all target documents.

Both models are taken without the document that is scored, else the words only it has would
speak for it or against it by whether it is labelled; and ``PRIOR`` expected counts are
added to either, so what is seen rarely says little. The n-grams of one text are far from
independent, so a weight is the sum over a text of ``EVIDENCE`` n-grams in its proportions.

An n-gram is a run of letters, a run of signs, two neighbours of those, or the fact that a
run repeats the one before. Counts cover all documents; only the target ids are a sample,
bounded by ``TARGETS``. The noise is a hash of id and text, so a task that runs again draws
the same. What reaches the driver is two arrays of ``BUCKETS`` counts.

Defined results: null and empty texts have weight 0. A null id is scored like any other.
Rows that tie (repeated rows) are kept or dropped together. Without target documents all
weights are 0 and everything is kept. An empty table gives no rows. Of the columns of
``docs`` only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import frugal, numbered, save, text_key, without
from .words import BLANK, chunks, grams, runs, span_hashes

BUCKETS = 1 << 16
#: Labelled good documents that make the target model, those of the smallest hashes.
TARGETS = 20_000
#: Share of the target documents that may weigh less than the last one counted in k.
MISSED = 0.003
#: Expected counts added to both models.
PRIOR = 20.0
#: N-grams that a text's weight stands for, if it has more.
EVIDENCE = 64
SEED = 11

_KIND = np.ones(256, np.uint8)
_KIND[BLANK] = 0
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = 2


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and document of each n-gram of a chunk."""
    kind = _KIND[data]
    pairs = [runs(kind == k, offsets) for k in (1, 2)]
    starts, ends = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    h = span_hashes(data, starts, ends)
    docs = np.searchsorted(offsets, starts, "right") - 1
    two = grams(h, 2)
    two[h[1:] == h[:-1]] = np.uint64(BUCKETS - 1)  # a repeat, whatever is repeated
    inside = docs[1:] == docs[:-1]
    buckets = np.concatenate([h, two[inside]]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([docs, docs[1:][inside]])


def target_ids(labels: DataFrame, id: str = "doc_id", limit: int = TARGETS) -> np.ndarray:
    good = labels.where((F.col("quality") == 1) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("x")).distinct()
    return np.array(sorted(r["x"] for r in good.orderBy(F.xxhash64("x"), "x").limit(limit).collect()), np.int64)


def _among(ids: np.ndarray, sorted_ids: np.ndarray) -> np.ndarray:
    if not len(sorted_ids):
        return np.zeros(len(ids), bool)
    return sorted_ids[np.minimum(np.searchsorted(sorted_ids, ids), len(sorted_ids) - 1)] == ids


def _long(column) -> np.ndarray:
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)


def fit(rows: DataFrame, targets) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts; ``rows``: ``doc_id, _text``; ``targets``: a broadcast of sorted ids."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            good = _among(_long(batch.column("doc_id")), targets.value)
            for a, b, data, offsets in chunks(batch.column("_text")):
                f, d = features(data, offsets)
                raw += np.bincount(f, minlength=BUCKETS)
                target += np.bincount(f[good[a:b][d]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (some, raw[some], target[some])], names=["bucket", "raw", "target"])

    counted = rows.mapInArrow(frugal(count), "bucket LONG, raw LONG, target LONG").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for bucket, r, t in counted:
        raw[bucket], target[bucket] = r, t
    return raw, target


def log_weights(f: np.ndarray, d: np.ndarray, count: int, good: np.ndarray, raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log importance weight of ``count`` documents from their n-grams ``f`` in documents ``d``."""
    if not target.sum():
        return np.zeros(count)
    at, own = np.unique(d * BUCKETS + f, return_counts=True)
    d, f = at // BUCKETS, at % BUCKETS
    n = np.bincount(d, own, count)
    rest_raw, rest_target = raw.sum() - n, np.maximum(target.sum() - n * good, 1)
    expected = (raw[f] - own) * (rest_target / np.maximum(rest_raw, 1))[d]
    ratio = np.log(target[f] - own * good[d] + PRIOR) - np.log(expected + PRIOR)
    return np.bincount(d, own * ratio, count) * np.minimum(1, EVIDENCE / np.maximum(n, 1))


def score(rows: DataFrame, counts, targets) -> DataFrame:
    """``doc_id, text_key, n_grams, log_weight, key, target`` per row."""
    names = "doc_id text_key n_grams log_weight key target".split()

    def run(batches):
        for batch in batches:
            n, logs = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            good = _among(_long(batch.column("doc_id")), targets.value)
            for a, b, data, offsets in chunks(batch.column("_text")):
                f, d = features(data, offsets)
                n[a:b] = np.bincount(d, minlength=b - a)
                logs[a:b] = log_weights(f, d, b - a, good[a:b], *counts.value)
            u = (batch.column("noise").to_numpy() + 0.5) / 2.0**53
            columns = [batch.column("doc_id"), batch.column("text_key"), *(pa.array(v) for v in (n, logs, logs - np.log(-np.log(u)), good))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    noise = F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", F.lit(SEED)), 11).alias("noise")
    return rows.select("*", noise).mapInArrow(frugal(run), "doc_id LONG, text_key LONG, n_grams LONG, log_weight DOUBLE, key DOUBLE, target BOOLEAN")


def resample(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", targets: int = TARGETS) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_grams, log_weight, key, kept``."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_text"))
    ids = sc.broadcast(target_ids(labels, id, targets))
    counts = sc.broadcast(fit(rows.select("doc_id", "_text"), ids))
    scored = save(score(rows, counts, ids), "scores")
    cut = scored.where("target").approxQuantile("log_weight", [MISSED], 0.0)  # at most TARGETS rows
    if not cut:
        return scored.drop("target").withColumn("kept", F.lit(True))
    k = scored.where(F.col("log_weight") >= cut[0]).count()
    order = numbered(scored.select("key"), [F.desc("key")], None, "keys")
    last = order.where(F.col("pos") == k - 1).first()["key"]
    return scored.drop("target").withColumn("kept", F.col("key") >= F.lit(last))


def kept_documents(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled documents with all their columns."""
    gone = resample(docs, labels, id, text).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return without(docs, save(gone.distinct(), "gone"), id, text)
