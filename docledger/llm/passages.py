"""Removal of repeated passages of words by FM-indexes of shards.

A word goes if a window of ``LENGTH`` words covers it whose words also start earlier, in a
document with a smaller id or earlier in the same one. Documents stream past indexes:

* Windows are dealt out by minimizer, the least hash of the short word grams in them, so equal
  windows meet wherever they occur. Runs of neighbouring windows with one minimizer are one
  string. Minimizers that occur at one position only are screened out: a first scan counts them, a second one
  gives the strings of the others, as hashes with their places. A minimizer met very often
  (a line that a great part of the documents hold, with something else around it) gives
  strings of one window each, dealt out by their own hash.
* Equal strings are combined map-side with the earliest place of any. A third scan gives
  each string's words once, from that place, to a shard.
* A shard sorts the suffixes of its strings into an FM-index (Burrows-Wheeler transform in a
  wavelet matrix) and streams the strings past it: backward search finds the matching
  statistics, how far the words from each position on also occur elsewhere and at which
  ranks. Positions that match ``LENGTH`` words are reported as intervals, with the earliest
  place among the ranks they match.
* Every place of a string takes that string's intervals and loses those with an earlier
  place. Strings with very many places are salted in this join.

Documents with the same words as an earlier one have the same statistics and the same
earliest places; they are found by SHA-256 of their words and are not dealt out again. Words
are told apart by 64-bit hashes, strings by 128 bits of a hash of those.

Defined results: null text has no words; documents of fewer than ``LENGTH`` words lose
nothing. A null id is smaller than every other. Rows repeated under one id are one document:
places in it are ordered by position, and rows with equal texts lose nothing to each other.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fuse
from .fm_index import Matcher
from .tables import BROADCAST_ROWS, save, small, text_key, without
from .words import BLANK, _powers, chunks, grams, mix, runs, words

LENGTH = 20
#: Words of a minimizer's gram: long enough that unrelated texts seldom share one.
GRAM = 8
#: Windows a string may have, so that texts of one repeated word give short strings too.
WINDOWS = 64
#: Places of one minimizer from which its windows are dealt out one by one.
CROWDED = 256
#: Strings of a shard.
SHARD = 2_000
#: Places of one string from which a join salts it, and the salts.
HEAVY = 1_000
SALTS = 64
_BASES = [np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]
_INVERSES = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two independent 64-bit hashes of each span of words."""
    out = []
    for k, (base, inverse) in enumerate(zip(_BASES, _INVERSES)):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(k)) * _powers(base, len(hashes)), out=sums[1:])
        back = _powers(inverse, len(hashes) + 1)[starts]
        out.append(mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64)))
    return out


def strings(hashes: np.ndarray, docs: np.ndarray, length: int, crowded=None) -> tuple[np.ndarray, ...]:
    """Minimizer, first and last word, whether it is a single window, and its minimizers, of each string of a chunk."""
    none = np.zeros(0, np.int64)
    nothing = none.astype(np.uint64), none, none, none.astype(bool), none
    n = len(hashes) - length + 1
    if n <= 0:
        return nothing
    every = least = grams(hashes, min(GRAM, length))
    width, have = length - min(GRAM, length) + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: have - width], least[width - have :])
    valid = docs[length - 1 :] == docs[:n]
    opens = valid.copy()
    opens[1:] &= (least[1:] != least[:-1]) | (docs[1:n] != docs[: n - 1]) | ~valid[:-1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return nothing
    run = np.maximum(np.cumsum(opens) - 1, 0)
    single = crowded.value.contains(least[starts]) if crowded else np.zeros(len(starts), bool)
    begins = valid & (single[run] | ((np.arange(n) - starts[run]) % WINDOWS == 0))
    closes = valid.copy()
    closes[:-1] &= begins[1:] | ~valid[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + length
    m, sizes = least[starts], ends - starts - length + width
    at = np.cumsum(sizes) - sizes
    inside = every[np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))]
    times = np.add.reduceat((inside == np.repeat(m, sizes)).astype(np.int64), at)
    return m, starts, ends, single[run[starts]], times


def _scan(docs: DataFrame, length: int, crowded, columns: str, give) -> DataFrame:
    """Rows of ``give(hashes, places)`` for the strings of each chunk of text."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            ids, keys = fuse.ids(batch.column("doc_id")).view(np.int64), batch.column("text_key").to_numpy()
            for a, b, data, offsets in chunks(batch.column("_text")):
                hashes, of, _ = words(data, offsets)
                m, starts, ends, single, times = strings(hashes, of, length, crowded)
                if not len(m):
                    continue
                doc = of[starts]
                first = np.searchsorted(of, doc)  # the document's first word in the chunk
                place = {"m": m, "single": single, "times": times, "from": starts, "to": ends, "doc": ids[a:b][doc], "key": keys[a:b][doc],
                         "start": (starts - first).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in give(hashes, place)], names=names)

    return docs.mapInArrow(run, columns)


def _pick(place: dict, some: np.ndarray) -> dict:
    return {k: v[some] for k, v in place.items()}


def _places(docs: DataFrame, length: int, held, crowded) -> DataFrame:
    """Every place of the strings whose minimizer ``held`` may hold; ``home`` is what a shard is chosen by."""

    def give(hashes, place):
        if held:
            place = _pick(place, held.value.contains(place["m"]))
        a, b = sequence_hashes(hashes, place["from"], place["to"])
        home = np.where(place["single"], a, place["m"]).view(np.int64)
        return [place["m"].view(np.int64), home, a.view(np.int64), b.view(np.int64), place["doc"], place["key"], place["start"]]

    return _scan(docs, length, crowded, "m LONG, home LONG, a LONG, b LONG, doc LONG, key LONG, start INT", give)


def _place_key(a: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(a ^ mix(doc.view(np.uint64))) + start.astype(np.uint64))


def _earliest(rows: DataFrame) -> DataFrame:
    """``place``, what ``_contents`` looks up, of ``a, doc, start``."""

    def run(batches):
        for batch in batches:
            a, doc, start = (batch.column(c).to_numpy() for c in ("a", "doc", "start"))
            yield pa.RecordBatch.from_arrays([pa.array(_place_key(a.view(np.uint64), doc, start).view(np.int64))], names=["place"])

    return rows.select("a", "doc", "start").mapInArrow(run, "place LONG")


def _contents(docs: DataFrame, length: int, held, crowded) -> DataFrame:
    """Words (as hashes) of the strings at the places that ``held`` may hold."""

    def give(hashes, place):
        a, b = sequence_hashes(hashes, place["from"], place["to"])
        if held:
            some = held.value.contains(_place_key(a, place["doc"], place["start"]))
            place, a, b = _pick(place, some), a[some], b[some]
        home = np.where(place["single"], a, place["m"]).view(np.int64)
        sizes = place["to"] - place["from"]
        at = np.concatenate([[0], np.cumsum(sizes)])
        where = np.repeat(place["from"] - at[:-1], sizes) + np.arange(at[-1])
        parts = [None, pa.py_buffer((at * 8).astype(np.int32).tobytes()), pa.py_buffer(hashes[where].tobytes())]
        content = pa.Array.from_buffers(pa.binary(), len(sizes), parts)
        return [home, a.view(np.int64), b.view(np.int64), place["doc"], place["start"], content]

    return _scan(docs, length, crowded, "home LONG, a LONG, b LONG, doc LONG, start INT, words BINARY", give)


def intervals(sequences: list[np.ndarray], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Of distinct sequences with places: number, first and last word, earliest document, and shift.

    Every window of the interval also starts at its own position plus the shift in that
    document, and at no place before it.
    """
    sizes = np.array([len(s) for s in sequences])
    values, codes = np.unique(np.concatenate(sequences), return_inverse=True)
    ring = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    first = np.cumsum(sizes + 1) - sizes  # of each sequence; a mark (0) is before it
    owner = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ring[first[owner] + offset] = codes + 1
    matcher = Matcher(ring, length)
    reach, lo, _ = matcher.statistics(np.split(codes + 1, np.cumsum(sizes)[:-1]))
    # the earliest place among all suffixes of a block; marks come last
    position = start[owner] + offset
    order = np.lexsort((position, doc[owner]))
    rank = np.full(len(ring), len(order))
    rank[first[owner[order]] + offset[order]] = np.arange(len(order))
    begins = np.flatnonzero(matcher.common[:-1] < length)
    earliest = np.minimum.reduceat(rank[matcher.index.suffixes], begins)
    hit = np.flatnonzero(reach == length)
    who = order[earliest[np.searchsorted(begins, lo[hit], "right") - 1]]
    where, shift, own = doc[owner[who]], position[who] - offset[hit], owner[hit]
    edge = np.ones(len(hit), bool)
    edge[1:] = (own[1:] != own[:-1]) | (where[1:] != where[:-1]) | (shift[1:] != shift[:-1]) | (hit[1:] != hit[:-1] + 1)
    a = np.flatnonzero(edge)
    b = np.append(a[1:], len(hit)) - 1
    return [own[a], offset[hit[a]], offset[hit[b]] + length, where[a], shift[a]] if len(hit) else [np.zeros(0, np.int64)] * 5


def _work(length: int):
    names, types = ["a", "b", "lo", "hi", "other", "shift"], [pa.int64()] * 6

    def run(rows):
        place: dict = {}  # a filter lets some strings through from more than one place
        for a, b, doc, start, content in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "doc", "start", "words"))):
            place[content] = min(place.get(content, (doc, start, a, b)), (doc, start, a, b))
        doc, start, a, b = (np.array(c, np.int64) for c in zip(*place.values()))
        own, lo, hi, other, shift = intervals([np.frombuffer(s, np.uint64) for s in place], doc, start, length)
        columns = [a[own], b[own], lo, hi, other, shift]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return run


def heavy_join(rows: DataFrame, few: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of many ``rows`` with ``few`` per key; keys with a high ``n`` in ``counts`` (saved) are salted.

    The bar rises with the rows, so the heavy keys always fit a broadcast.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = save(counts.where(F.col("n") > max(HEAVY, total // BROADCAST_ROWS)).select(*on, F.lit(SALTS).alias("_salts")), "heavy")
    if not heavy.head(1):
        return rows.join(few, on)
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(small(heavy), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts")
    right = few.join(small(heavy), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [*on, "_salt"]).drop("_salt")


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words at these places, joined by one space."""
    if not len(starts):
        return b""
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes
    where = np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))
    out = data[np.minimum(where, len(data) - 1)]
    out[at[1:] - 1] = 0x20
    return out[:-1].tobytes()


def counted(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_words, digest`` (SHA-256 of the words joined by one space) of each row."""

    def run(batches):
        for batch in batches:
            n, digests = [], []
            for _, _, data, offsets in chunks(batch.column("_text")):
                starts, ends = runs(~BLANK[data], offsets)
                cuts = np.searchsorted(starts, offsets)
                n += np.diff(cuts).tolist()
                digests += [hashlib.sha256(_joined(data, starts[a:b], ends[a:b])).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digests, pa.string())],
                                             names=["doc_id", "text_key", "n_words", "digest"])

    return docs.mapInArrow(run, "doc_id LONG, text_key LONG, n_words LONG, digest STRING")


def _cut(batches):
    """Take the words of ``ranges`` out of each text."""
    for batch in batches:
        out = []
        texts = batch.column("_text")
        for k, ranges in enumerate(batch.column("ranges")):
            data = np.frombuffer((texts[k].as_py() or "").encode(), np.uint8)
            starts, ends = runs(~BLANK[data], np.array([0, len(data)]))
            gone = np.zeros(len(starts) + 1, np.int64)
            parts = ranges.values
            np.add.at(gone, parts.field("lo").to_numpy(), 1)
            np.add.at(gone, parts.field("hi").to_numpy(), -1)
            kept = np.cumsum(gone)[:-1] == 0
            out.append((int((~kept).sum()), _joined(data, starts[kept], ends[kept])))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())],
                                         names=["doc", "text_key", "n_removed", "kept"])


def repeated_ranges(points: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, key, ranges``: the ranges of words each document loses. ``points``: ``doc_id, text_key, _text``."""
    met = _scan(points, length, None, "m LONG, times LONG", lambda hashes, place: [place["m"].view(np.int64), place["times"]])
    shared = save(met.groupBy("m").agg(F.sum("times").alias("n")).where("n > 1"), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    crowded = shared.where(F.col("n") > max(CROWDED, total // fuse.BROADCAST_KEYS)).select("m")
    crowded = fuse.screen(crowded, "m", fuse.BROADCAST_KEYS) if crowded.head(1) else None
    held = fuse.screen(shared, "m")
    places = _places(points, length, held, crowded)
    if held is None:
        places = places.join(shared.select("m"), "m", "left_semi")
    places = save(places.drop("m"), "places")
    least = F.min(F.struct("doc", "start")).alias("least")
    known = places.groupBy("a", "b").agg(least, F.first("home").alias("home"), F.count(F.lit(1)).alias("n"))
    known = save(known.select("a", "b", "home", "least.*", "n"), "strings")
    first = fuse.screen(save(_earliest(known).distinct(), "earliest"), "place")
    content = _contents(points, length, first, crowded)
    if first is None:
        content = content.join(known.select("a", "b", "doc", "start"), ["a", "b", "doc", "start"], "left_semi")
    shards = max(1, -(-known.count() // SHARD))
    dealt = content.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)))
    found = dealt.groupBy("shard").applyInArrow(_work(length), "a LONG, b LONG, lo LONG, hi LONG, other LONG, shift LONG")
    found = save(found, "intervals")
    met = heavy_join(places.drop("home"), found, known.select("a", "b", "n"), ["a", "b"])
    lost = met.where("other < doc OR other = doc AND shift < start")
    span = F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))
    return lost.groupBy("doc", "key").agg(F.collect_list(span).alias("ranges"))


def passage_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``doc_id, text_key, n_words, n_removed, kept_sha256`` per document; with what is left as ``kept_text`` if asked."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_text"))
    number = F.coalesce("doc_id", F.lit(-(1 << 63)))
    prints = save(counted(rows).withColumn("doc", number), "counted")
    groups = prints.where(F.col("n_words") >= length).groupBy("digest").agg(F.min("doc").alias("least"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n"))
    groups = save(groups.where("least < last"), "groups")
    copies = heavy_join(prints.select("digest", "doc", "doc_id", "text_key"), groups.select("digest", "least"), groups.select("digest", "n"), ["digest"])
    copies = save(copies.where("doc > least").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "copies")
    ranges = save(repeated_ranges(without(rows, copies, "doc_id", "_text"), length), "ranges")
    held = fuse.screen(ranges.select("doc").distinct(), "doc")

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.contains(fuse.ids(batch.column("doc"))))) if held else batch

    losing = rows.select(number.alias("doc"), F.col("text_key").alias("key"), "_text").mapInArrow(pick, "doc LONG, key LONG, _text STRING")
    cut = losing.join(ranges, ["doc", "key"]).mapInArrow(_cut, "doc LONG, text_key LONG, n_removed LONG, kept BINARY")
    cut = cut.select("doc", "text_key", "n_removed", F.sha2("kept", 256).alias("cut_sha256"), *([F.col("kept").cast("string").alias("kept_text")] if with_text else []))
    gone = copies.select(F.coalesce("_id", F.lit(-(1 << 63))).alias("doc"), F.col("_key").alias("text_key"), F.lit(True).alias("copy"))
    out = prints.join(save(cut.dropDuplicates(["doc", "text_key"]), "cut"), ["doc", "text_key"], "left").join(gone, ["doc", "text_key"], "left")
    copy = F.coalesce("copy", F.lit(False))
    if with_text:
        out = out.join(rows.select(number.alias("doc"), "text_key", F.col("_text").alias("whole")).dropDuplicates(["doc", "text_key"]), ["doc", "text_key"], "left")
        whole = F.trim(F.regexp_replace(F.coalesce("whole", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return out.select(
        "doc_id", "text_key", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("cut_sha256", "digest")).alias("kept_sha256"),
        *([F.when(copy, F.lit("")).otherwise(F.coalesce("kept_text", whole)).alias("kept_text")] if with_text else []),
    )
