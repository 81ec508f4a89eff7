"""Packing by minimum bin slack.

A document's ids are cut into full windows and a rest, all in the task that tokenizes it.
The multiset of remaining lengths is a histogram of at most 4096 lengths, whatever the
size of the corpus. On it, a bitset subset-sum dynamic programme looks for the multiset of
lengths that fills a window closest to its capacity and backtracks how many of each length
it took; that pattern is used as often as its lengths last, then the next one is sought.
Every pattern uses up a length, so there are at most 4096 of them. Pieces are ranked within
their length by range-partitioned numbering, and the rank alone says which window and
offset a piece gets: a join with the small table of patterns.

Defined results: null and empty text give the end id alone. A text of any length is
tokenized whole. Repeated rows are pieces like others. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import frugal, numbered, save
from .tokens import word_table
from .words import chunks

CAPACITY = 4096
END_ID = 2
PIECES = "doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG"


def pieces(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids into windows and a rest; with their checksum, and the ids if asked."""

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
    types = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids

    def run(batches):
        table = word_table(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            docs_of = batch.column(0).cast(pa.int64()).to_pylist()
            for a, b, data, offsets in chunks(batch.column(1)):
                out = []
                for doc, own in zip(docs_of[a:b], table.texts(data, offsets)):
                    ids = np.concatenate([own.astype("<u4"), end])
                    for at in range(0, len(ids), capacity):
                        part = ids[at : at + capacity]
                        row = (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids))
                        out.append(row + (part.astype(np.int32),) if with_ids else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return docs.select(id, text).mapInArrow(frugal(run), PIECES + (", ids ARRAY<INT>" if with_ids else ""))


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the lengths in ``counts`` whose sum is closest to ``capacity`` from below.

    Bit ``s`` of the set says that some sub-multiset sums to ``s``. Copies of a length are
    added in powers of two. The search ends as soon as the capacity itself is reached.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length], capacity // length), 1
        while left:
            take = min(copies, left)
            grown = (reach | reach << (take * length)) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, copies = left - take, copies * 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # only with this step is the sum reached
            taken[length] = taken.get(length, 0) + take
            total -= take * length
    return taken


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(copies per length, windows)`` until every length is used up."""
    left = {k: n for k, n in histogram.items() if n}
    out = []
    while left:
        taken = fill(left, capacity)
        times = min(left[k] // c for k, c in taken.items())
        out.append((taken, times))
        for k, c in taken.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
    return out


def places(found: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per pattern and length: ``length, from rank, to rank, first window, copies, offset``."""
    rows, window, used = [], 0, {}
    for taken, times in found:
        offset = 0
        for length, copies in sorted(taken.items(), reverse=True):
            at = used.get(length, 0)
            rows.append((length, at, at + copies * times, window, copies, offset))
            used[length] = at + copies * times
            offset += length * copies
        window += times
    return rows


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` ids.

    ``parts`` should be a saved table: it is read for the histogram and for the numbering.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    rows = places(patterns(counts, capacity))
    ahead, total = {}, 0
    for length in sorted(counts):
        ahead[length], total = total, total + counts[length]
    table = spark.createDataFrame(
        [(k, ahead[k] + a, ahead[k] + b, w, c, o) for k, a, b, w, c, o in rows],
        "_length LONG, _from LONG, _to LONG, _window LONG, _copies LONG, _offset LONG",
    )
    ranked = numbered(parts, ["length", "doc_id", "start", "ids_crc32"], None, "packed").drop("before")
    here = (F.col("length") == F.col("_length")) & (F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))
    nth = F.col("pos") - F.col("_from")
    return ranked.join(F.broadcast(table), here).select(
        *parts.columns,
        (F.col("_window") + F.floor(nth / F.col("_copies"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + nth % F.col("_copies") * F.col("_length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their window and offset."""
    return pack(save(pieces(docs, path, id, text, capacity, end_id, with_ids), "pieces"), capacity)
