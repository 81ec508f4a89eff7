"""Static binary-fuse filters over 64-bit keys, built and probed in numpy.

A filter holds 8 bits and about 1.2 bytes per key: no false negative, one false positive in
256. Keys are spread over buckets of some thousand, each with a filter of its own, so
building one is a small group of a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .words import mix

KEYS_PER_FILTER = 2_000
#: Filters that may be broadcast: about 64 MB.
BROADCAST_KEYS = 50_000_000
SCHEMA = "bucket LONG, seed LONG, segment LONG, segments LONG, cells BINARY"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5BD1E995)) >> np.uint64(8)) % np.uint64(buckets)


def _positions(keys, seed, segment, segments):
    """Three cells per key, in consecutive segments, and its 8-bit print."""
    h = mix(keys + seed)
    span = segments * segment
    first = ((h >> np.uint64(32)) * span) >> np.uint64(32)
    mask = segment - np.uint64(1)
    second = (first + segment) ^ ((h >> np.uint64(18)) & mask)
    third = (first + segment + segment) ^ (h & mask)
    prints = (h ^ (h >> np.uint64(32)) ^ (h >> np.uint64(11))).astype(np.uint8)
    return np.stack([first, second, third]).astype(np.int64), prints


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """``(seed, segment, segments, cells)`` of distinct keys: peel, then fill in reverse."""
    keys = np.unique(keys)
    n = len(keys)
    segment = 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / segment) - 2)
    size = (segments + 2) * segment
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += 1
            size += segment
        at, prints = _positions(keys, np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)), np.uint64(segment), np.uint64(segments))
        count = np.bincount(at.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        for row in at:
            np.add.at(total, row, np.arange(n))
        layers, left = [], n
        while left:
            cells = np.flatnonzero(count == 1)
            if not len(cells):
                break
            chosen, where = np.unique(total[cells], return_index=True)
            layers.append((chosen, cells[where]))
            left -= len(chosen)
            for row in at:
                np.subtract.at(count, row[chosen], 1)
                np.subtract.at(total, row[chosen], chosen)
        if not left:
            break
    else:
        raise RuntimeError("no seed peels this set of keys")
    cells = np.zeros(size, np.uint8)
    for chosen, where in reversed(layers):
        others = cells[at[0][chosen]] ^ cells[at[1][chosen]] ^ cells[at[2][chosen]]
        cells[where] = prints[chosen] ^ others  # its own cell is still 0
    return seed, segment, segments, cells.tobytes()


class Screen:
    """All buckets of a filter side by side, for probing many keys at once."""

    def __init__(self, rows, buckets: int):
        self.buckets = buckets
        self.seed = np.zeros(buckets, np.uint64)
        self.segment = np.ones(buckets, np.uint64)
        self.segments = np.ones(buckets, np.uint64)
        self.base = np.full(buckets, -1, np.int64)
        parts, at = [], 0
        for r in rows:
            b = r["bucket"]
            self.seed[b] = np.uint64(r["seed"] * 0x9E3779B97F4A7C15 % (1 << 64))
            self.segment[b], self.segments[b], self.base[b] = r["segment"], r["segments"], at
            parts.append(np.frombuffer(r["cells"], np.uint8))
            at += len(parts[-1])
        self.cells = np.concatenate(parts) if parts else np.zeros(1, np.uint8)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """True for every key that was put in, and for one other in 256."""
        if not len(keys):
            return np.zeros(0, bool)
        b = bucket_of(keys, self.buckets).astype(np.int64)
        at, prints = _positions(keys, self.seed[b], self.segment[b], self.segments[b])
        some = self.base[b] >= 0
        at = np.where(some, at + self.base[b], 0)
        found = self.cells[at[0]] ^ self.cells[at[1]] ^ self.cells[at[2]]
        return some & (found == prints)


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Add the bucket of a long column."""

    def add(batches):
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.append_column("bucket", pa.array(bucket_of(keys, buckets).astype(np.int64), pa.int64()))

    return df.mapInArrow(add, T.StructType([*df.schema.fields, T.StructField("bucket", T.LongType())]))


def filters(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """One filter per bucket over distinct, not null long keys."""

    def one(group, table):
        seed, segment, segments, cells = build(table.column(key).to_numpy().astype(np.int64).view(np.uint64))
        row = [group[0].as_py(), seed, segment, segments, cells]
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int64(),) * 4 + (pa.binary(),))],
                        names=["bucket", "seed", "segment", "segments", "cells"])

    return with_bucket(keys.select(key), key, buckets).groupBy("bucket").applyInArrow(one, SCHEMA)


def screen(keys: DataFrame, key: str, limit: int = BROADCAST_KEYS):
    """A broadcast ``Screen`` over distinct keys, or None when they are more than ``limit``.

    Users must stay right without it: it only spares them rows that match nothing.
    """
    n = keys.count()
    if n > limit:
        return None
    buckets = max(1, -(-n // KEYS_PER_FILTER))
    rows = filters(keys, key, buckets).collect() if n else []
    return keys.sparkSession.sparkContext.broadcast(Screen(rows, buckets))


def ids(column: pa.Array) -> np.ndarray:
    """A long column as keys; null counts as the smallest long."""
    filled = column.cast(pa.int64()).fill_null(-(1 << 63))
    return filled.to_numpy(zero_copy_only=False).view(np.uint64)


