"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document with a
smaller id. Suffixes of all documents do not fit one transform, so they are dealt out first:

* Every window of ``LENGTH`` bytes belongs to its minimizer, the least hash of the short
  grams in it, so equal windows meet wherever they occur. Runs of neighbouring windows with
  one minimizer are one string. Minimizers met in one document only are screened out: the
  first scan counts them, the second gives hashes of the others' strings.
* Equal strings are combined map-side by hash with their smallest document. A minimizer with
  one string needs no more. For the others a third scan gives each string once, out of its
  smallest document, and they are binned by minimizer.
* In a bin, shards of strings are sorted into suffix arrays and transforms of their own. The
  transforms are merged by refining their interleave: each round reads the symbols before
  the suffixes in the order so far and deals the suffixes they lead to by symbol, which
  sorts by that many more bytes (a symbol stands for ``GROUP`` bytes, so few rounds do).
  Blocks with no border between them after ``LENGTH`` bytes are the intervals of common
  prefixes at least that long, the repeated ones. No suffix is sorted again. The least
  document of a block decides over its windows.
* A minimizer with very many strings (one line that a great part of the documents hold,
  with something else behind it in each) is dealt out further by whole windows, as 128 bits
  of hash; windows that very many strings hold are salted.

Whole equal documents are found by digest first; only the one with the smallest id takes
part. Texts are shuffled only for documents that lose something.

Defined results: null text is empty; texts shorter than ``LENGTH`` lose nothing. A null id is
smaller than every other. Rows repeated under one id lose nothing to each other. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fuse
from .exact_dedup import fingerprints
from .passages import heavy_join
from .tables import save, text_key, without
from .words import all_spans, chunks, mix, span_hashes

LENGTH = 50
#: Bytes of a minimizer's gram: long enough that unrelated texts seldom share one.
GRAM = 24
#: Windows a string may have, so that texts of one repeated word give short strings too.
WINDOWS = 256
#: Distinct strings of one minimizer that are merged in one bin, strings in a bin and shard.
HOT = 256
BIN = 500
#: A minimizer may have one in ``SHARE`` of all strings, up to ``MOST``, before its windows are dealt
#: out: the rows that windows make then grow with the strings, and a bin stays some MB.
SHARE = 2000
MOST = 4096
SHARD = 128
#: Text scanned at once: its hashes fit a core's cache.
SCAN_BYTES = 1 << 16
#: Bytes of one symbol in suffix sorting and merging; nine bits each must fit 64.
GROUP = 7


def _least_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The least hash of the grams in each window of ``length`` bytes, as ``span_hashes`` gives them."""
    least = all_spans(data, GRAM)
    spare = np.empty_like(least)
    width, have = length - GRAM + 1, 1
    while have < width:
        step = min(have, width - have)
        n = len(least) - step
        np.minimum(least[:n], least[step:], out=spare[:n])
        least, spare = spare[:n], least
        have += step
    return least


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, document, start and end (in the chunk) of each string of a chunk."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none
    least = _least_hashes(data, length)
    sizes = np.diff(offsets)
    short = np.minimum(sizes, length - 1)  # the last places of a document start no window
    valid = np.repeat(np.tile([True, False], len(sizes)), np.stack([sizes - short, short], 1).ravel())[: len(least)]
    opens = valid.copy()
    opens[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    closes = valid.copy()
    closes[:-1] &= opens[1:] | ~valid[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    parts = -(-(ends - starts) // WINDOWS)
    if len(parts) and parts.max() > 1:
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + nth * WINDOWS
        ends = np.minimum(np.repeat(ends, parts), starts + WINDOWS)
    docs = np.searchsorted(offsets, starts, "right") - 1
    return least[starts], docs, starts, ends + (length - 1)


def _first_scan(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = fuse.ids(batch.column("doc_id")).view(np.int64)
            for a, b, data, offsets in chunks(batch.column("_text"), SCAN_BYTES):
                m, d, _, _ = minimizers(data, offsets, length)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(ids[a:b][d])], names=["m", "doc"])

    return docs.mapInArrow(run, "m LONG, doc LONG")


def _second_scan(docs: DataFrame, length: int, held) -> DataFrame:
    """Strings of the minimizers in ``held``; without it of all, with whole minimizers to join by."""
    names = ["m", "sid", "doc", "key", "start", "size"]  # m shortened: it only groups here

    def run(batches):
        for batch in batches:
            ids, keys = fuse.ids(batch.column("doc_id")).view(np.int64), batch.column("text_key").to_numpy()
            for a, b, data, offsets in chunks(batch.column("_text"), SCAN_BYTES):
                m, d, starts, ends = minimizers(data, offsets, length)
                pick = held.value.contains(m) if held else np.ones(len(m), bool)
                m, d, starts, ends = m[pick], d[pick], starts[pick], ends[pick]
                sid = span_hashes(data, starts, ends)
                columns = [_short(m) if held else m.view(np.int64), sid.view(np.int64), ids[a:b][d], keys[a:b][d], (starts - offsets[d]).astype(np.int32), (ends - starts).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.mapInArrow(run, f"m {'INT' if held else 'LONG'}, sid LONG, doc LONG, key LONG, start INT, size INT")


def _short(m: np.ndarray) -> np.ndarray:
    """Half of a minimizer, which is all that grouping needs: strings are told apart by ``sid``."""
    return (m >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _third_scan(docs: DataFrame, length: int, held, hot, want_hot: bool) -> DataFrame:
    """``m, sid, least, string`` where the pair of string and document is in ``held``: each string
    out of its smallest document, and some others out of any. Only of ``hot`` minimizers, or
    only of the others."""

    def run(batches):
        for batch in batches:
            ids = fuse.ids(batch.column("doc_id")).view(np.int64)
            for a, b, data, offsets in chunks(batch.column("_text"), SCAN_BYTES):
                m, d, starts, ends = minimizers(data, offsets, length)
                m, sid, doc = _short(m), span_hashes(data, starts, ends), ids[a:b][d]
                pick = held.value.contains(sid ^ mix(doc.view(np.uint64))) if held else np.ones(len(m), bool)
                if hot:
                    pick &= hot.value.contains(m.astype(np.int64).view(np.uint64)) == want_hot
                m, sid, doc, starts, ends = m[pick], sid[pick], doc[pick], starts[pick], ends[pick]
                sizes = ends - starts
                at = np.concatenate([[0], np.cumsum(sizes)])
                where = np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])
                strings = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data[where].tobytes())])
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (m, sid.view(np.int64), doc)), strings], names=["m", "sid", "least", "string"])

    return docs.mapInArrow(run, "m INT, sid LONG, least LONG, string BINARY")


def _pairs(rows: DataFrame) -> DataFrame:
    """Add ``pair``, what ``_third_scan`` looks up, to ``sid, least``."""

    def run(batches):
        for batch in batches:
            sid, least = (batch.column(c).to_numpy().view(np.uint64) for c in ("sid", "least"))
            yield pa.RecordBatch.from_arrays([pa.array((sid ^ mix(least)).view(np.int64))], names=["pair"])

    return rows.select("sid", "least").mapInArrow(run, "pair LONG")


class Symbols:
    """Strings in a row, each read as a ring with an end mark (0; bytes are 1 to 256).

    ``code(k)`` ranks the ``k`` symbols from each position on; ``ends(k)`` says which hold an end.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) + 1 for s in strings])
        self.size = int(sizes.sum())
        self.owner = np.repeat(np.arange(len(strings)), sizes)
        self.first = np.cumsum(sizes) - sizes
        self.rings = np.repeat(sizes, sizes)
        self.offset = np.arange(self.size) - self.first[self.owner]
        self.symbols = np.zeros(self.size, np.uint64)
        self.symbols[self.offset < self.rings - 1] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)

    def shift(self, k: int) -> np.ndarray:
        """The position ``k`` further on (or back) around each position's ring."""
        return self.first[self.owner] + (self.offset + k) % self.rings

    def code(self, k: int) -> np.ndarray:
        packed = np.zeros(self.size, np.uint64)
        for i in range(k):
            packed = packed << np.uint64(9) | self.symbols[self.shift(i)]
        values, ranks = np.unique(packed, return_inverse=True)
        return ranks.astype(np.uint16 if len(values) <= 1 << 16 else np.int64)  # 16 bits sort by radix

    def ends(self, k: int) -> np.ndarray:
        return self.offset + k > self.rings - 1


def suffix_array(text: Symbols, code: np.ndarray, lo: int, hi: int, depth: int) -> np.ndarray:
    """Positions ``lo`` to ``hi`` in the order of their first ``depth`` symbols or more."""
    order = np.arange(lo, hi)
    for k in range((depth + GROUP - 1) // GROUP - 1, -1, -1):
        at = text.first[text.owner[order]] + (text.offset[order] + k * GROUP) % text.rings[order]
        order = order[np.argsort(code[at], kind="stable")]
    return order


def merge(text: Symbols, shards: list[np.ndarray], code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions in the order of their first ``depth`` symbols, and the block of each.

    The interleave starts as shard after shard. A position's transform symbol is the group
    of symbols before it, and it leads to the position where that group begins.
    """
    order, block = np.concatenate(shards), np.zeros(text.size, np.int64)
    rounds = [(GROUP, code)] * (depth // GROUP) + ([(depth % GROUP, text.code(depth % GROUP))] if depth % GROUP else [])
    for k, symbol in rounds:
        lead = text.shift(-k)
        before, ends = symbol[lead], text.ends(k)[lead]
        read = before[order]
        dealt = np.argsort(read, kind="stable")
        order, block, read = order[dealt], block[dealt], read[dealt]
        border = np.ones(len(read), bool)
        border[1:] = (read[1:] != read[:-1]) | (block[1:] != block[:-1])
        border |= ends[order]  # what holds an end is like nothing else
        order, block = lead[order], np.cumsum(border) - 1
    return order, block


def repeated(strings: list[bytes], least: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Per string the byte ranges whose windows also occur in a string with a smaller ``least``."""
    text = Symbols(strings)
    code = text.code(GROUP)
    cuts = [*text.first[::SHARD].tolist(), text.size]
    shards = [suffix_array(text, code, a, b, length) for a, b in zip(cuts, cuts[1:])]
    order, block = merge(text, shards, code, length)
    mine = least[text.owner[order]]
    lowest = np.full(int(block[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, block, mine)
    hit = np.zeros(text.size, bool)
    hit[order] = lowest[block] < mine
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    opens = hit.copy()
    opens[1:] &= ~hit[:-1]
    closes = hit.copy()
    closes[:-1] &= ~hit[1:]
    # windows that hold an end are never hit, so a run of hits lies in one string
    for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist()):
        s, at = int(text.owner[a]), int(text.first[text.owner[a]])
        ranges = out[s]
        if ranges and a - at <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], b - at + length)
        else:
            ranges.append((a - at, b - at + length))
    return out


_RANGES = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_FOUND = "m INT, sid LONG, ranges ARRAY<STRUCT<lo: LONG, hi: LONG>>"


def _windows(length: int):
    """Two 64-bit hashes of each window of each string, some strings at once."""
    names = ["m", "sid", "least", "at", "w1", "w2"]

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("string")):
                counts = np.maximum(np.diff(offsets) - length + 1, 0)
                of = np.repeat(np.arange(b - a), counts)
                at = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                starts = offsets[of] + at
                w1 = span_hashes(data, starts, starts + length)
                w2 = span_hashes(data ^ np.uint8(0xA5), starts, starts + length)
                part = [batch.column(c).slice(a, b - a).take(pa.array(of)) for c in names[:3]]
                yield pa.RecordBatch.from_arrays([*part, pa.array(at.astype(np.int32)), *(pa.array(w.view(np.int64)) for w in (w1, w2))], names=names)

    return run


def _runs(length: int):
    """The windows of each string as the byte ranges they cover, windows that follow each other in one."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("at")
            at = lists.flatten().to_numpy()
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.lexsort((at, of))
            at, of = at[order].astype(np.int64), of[order]
            opens = np.ones(len(at), bool)
            opens[1:] = (of[1:] != of[:-1]) | (at[1:] > at[:-1] + 1)
            starts = np.flatnonzero(opens)
            lo, hi = at[starts], at[np.append(starts[1:], len(at)) - 1] + length
            ranges = pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], fields=list(_RANGES.value_type))
            offsets = np.searchsorted(of[starts], np.arange(len(lists) + 1)).astype(np.int32)
            ranges = pa.ListArray.from_arrays(pa.array(offsets), ranges, type=_RANGES)
            yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("sid"), ranges, batch.column("least")], names=["m", "sid", "ranges", "least"])

    return run


def _crowd(total: int) -> int:
    """Strings of one minimizer that are merged in one bin, of ``total`` strings of all."""
    return max(HOT, min(total // SHARE, MOST))


def _inner(points: DataFrame, strings: DataFrame, length: int) -> DataFrame:
    """``m, sid, ranges`` of the strings that hold windows of a smaller document; ``strings``: ``m, sid, least``, saved."""
    counts = save(strings.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    held = fuse.screen(save(_pairs(strings.join(counts.select("m"), "m", "left_semi")).distinct(), "several"), "pair")
    total = counts.agg(F.sum("n")).first()[0] or 0
    crowded = save(counts.where(F.col("n") > _crowd(total)).select(F.col("m").cast("long")), "crowded")
    some_crowded = crowded.count() > 0
    hot = fuse.screen(crowded, "m") if some_crowded else None

    def scanned(want_hot: bool) -> DataFrame:
        """The third scan, with joins in place of the filters that are too long to broadcast."""
        out = _third_scan(points, length, held, hot, want_hot)
        if held is None:
            out = out.join(strings.select("m", "sid", "least"), ["m", "sid", "least"], "left_semi")
            out = out.join(counts.select("m"), "m", "left_semi")
        if some_crowded and hot is None:
            out = out.join(crowded.select(F.col("m").cast("int")), "m", "left_semi" if want_hot else "left_anti")
        return out

    def work(rows):
        # equal strings once, with the smallest document any row has
        least: dict[bytes, list[int]] = {}
        for m, sid, doc, s in zip(*(rows.column(c).to_pylist() for c in ("m", "sid", "least", "string"))):
            row = least.setdefault(s, [doc, m, sid])
            row[0] = min(row[0], doc)
        found = repeated(list(least), np.array([r[0] for r in least.values()], np.int64), length)
        out = [(m, sid, [{"lo": a, "hi": b} for a, b in ranges]) for (_, m, sid), ranges in zip(least.values(), found) if ranges]
        return pa.table([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.int64(), _RANGES))], names=["m", "sid", "ranges"])

    bins = max(1, -(-total // BIN))
    merged = scanned(False).withColumn("bin", F.expr(f"pmod(xxhash64(m), {bins})")).groupBy("bin").applyInArrow(work, _FOUND)
    if not some_crowded:
        return merged
    merged = save(merged, "merged")  # before the crowded ones are scanned: one scan of all text at a time

    single = save(scanned(True).mapInArrow(_windows(length), "m INT, sid LONG, least LONG, at INT, w1 LONG, w2 LONG"), "windows")
    met = single.groupBy("w1", "w2").agg(F.min("least").alias("lowest"), F.max("least").alias("highest"), F.count(F.lit(1)).alias("n"))
    met = save(met.where("lowest < highest"), "shared-windows")
    hits = heavy_join(single, met.select("w1", "w2", "lowest"), met.select("w1", "w2", "n"), ["w1", "w2"]).where("lowest < least")
    # one row per string before it is looked up: windows of strings in a crowd grow faster than the text
    found = hits.groupBy("m", "sid", "least").agg(F.collect_list("at").alias("at")).mapInArrow(_runs(length), f"{_FOUND}, least LONG")
    ranges = found.join(strings.select("m", "sid", "least"), ["m", "sid", "least"], "left_semi").drop("least")
    return merged.unionByName(ranges)


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, ranges in zip(batch.column("_text").to_pylist(), batch.column("ranges").to_pylist()):
                data, kept, at, spans, gone = (text or "").encode(), [], 0, 0, 0
                end = -1
                for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
                    if lo > end:  # a gap: a new removed run
                        kept.append(data[at:lo])
                        spans += 1
                        gone += hi - lo
                        at = end = hi
                    elif hi > end:
                        gone += hi - end
                        at = end = hi
                kept.append(data[at:])
                out.append((gone, spans, b"".join(kept)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("key"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.binary())], names=["doc", "key", "n_removed", "n_spans", "kept"])

    return run


def removed_ranges(points: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, key, ranges``: the byte ranges each document loses; ``points``: ``doc_id, text_key, _text``."""
    met = _first_scan(points.select("doc_id", "_text"), length).groupBy("m").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    shared = save(met.where("lo < hi").select("m"), "shared")
    held = fuse.screen(shared, "m")
    found = _second_scan(points, length, held)
    if held is None:
        found = found.join(shared, "m", "left_semi").withColumn("m", F.shiftright("m", 32).cast("int"))  # as _short
    occurrences = save(found, "occurrences")
    strings = save(occurrences.groupBy("m", "sid").agg(F.min("doc").alias("least")), "strings")
    inner = save(_inner(points, strings, length), "inner")
    known = occurrences.join(strings, ["m", "sid"]).join(inner, ["m", "sid"], "left")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("size").cast("long").alias("hi")))
    lost = known.withColumn("lost", F.when(F.col("doc") > F.col("least"), everything).otherwise(F.col("ranges")))
    lost = lost.select("doc", "key", "start", F.explode("lost").alias("r"))
    span = F.struct((F.col("start") + F.col("r.lo")).cast("int").alias("lo"), (F.col("start") + F.col("r.hi")).cast("int").alias("hi"))
    return lost.groupBy("doc", "key").agg(F.collect_list(span).alias("ranges"))


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document; with what is left as ``kept_text`` if asked."""
    number = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_text"))
    prints = save(fingerprints(docs, id, text, lower=False).drop("key").withColumn("doc", number), "prints")
    first = prints.groupBy("digest").agg(F.min("doc").alias("least"))
    prints = save(prints.join(first, "digest"), "digests")
    copies = prints.where("doc > least").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    ranges = save(removed_ranges(without(rows, save(copies.distinct(), "copies"), "doc_id", "_text"), length), "ranges")
    held = fuse.screen(ranges.select("doc").distinct(), "doc")

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.contains(fuse.ids(batch.column("doc"))))) if held else batch

    losing = rows.select(number.alias("doc"), F.col("text_key").alias("key"), "_text").mapInArrow(pick, "doc LONG, key LONG, _text STRING")
    cut = losing.join(ranges, ["doc", "key"]).mapInArrow(_cut(length), "doc LONG, key LONG, n_removed LONG, n_spans LONG, kept BINARY")
    cut = cut.select("doc", F.col("key").alias("text_key"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                     *([F.col("kept").cast("string").alias("kept_text")] if with_text else []))
    out = prints.join(save(cut.dropDuplicates(["doc", "text_key"]), "cut"), ["doc", "text_key"], "left")
    copy = (F.col("doc") > F.col("least")) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id", "text_key", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
