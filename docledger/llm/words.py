"""Byte-level words and hashes of whole Arrow batches, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text worked on at once; numpy holds some tens of bytes per byte of text.
CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 8 * CHUNK_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def binary(column: pa.Array) -> pa.Array:
    """A text column as bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def chunks(column: pa.Array, target: int = CHUNK_BYTES):
    """``(first, last, data, offsets)`` of row runs of about ``target`` bytes, or one long row."""
    values = binary(column)
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1] if n else None
    raw = values.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + target, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the true runs, cut at document borders."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n + 1)[starts]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64))


def all_spans(data: np.ndarray, size: int) -> np.ndarray:
    """``span_hashes`` of every span of ``size`` bytes, without a lookup per span."""
    n = len(data)
    values = _VALUES.take(data)
    values *= _powers(_BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    out = sums[size:] - sums[:-size]
    out *= _powers(_INVERSE, len(out))
    out += np.uint64(size)
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start of each word ``[^\\x20\\x09-\\x0D]+``."""
    starts, ends = runs(~BLANK[data], offsets)
    docs = np.searchsorted(offsets, starts, "right") - 1
    return span_hashes(data, starts, ends), docs, starts


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive words; the caller cuts at documents."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _BASE
        out += hashes[k : k + m]
    return mix(out + np.uint64(n))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its ``n``-word shingles, A-Z lower-cased.

    A document of fewer words has its whole sequence as one shingle, one without words none.
    """
    hashes, docs, _ = words(LOWER[data], offsets)
    count = len(offsets) - 1
    first = np.searchsorted(docs, np.arange(count + 1))
    every = grams(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            own = np.sort(every[a : b - n + 1])
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            out.append(own[fresh])
        elif b > a:
            out.append(grams(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
