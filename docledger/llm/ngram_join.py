"""Exact Jaccard join of word-shingle sets as a metric-space join.

1 - J is a metric. Pivots form regions, and a document is copied into every region where a
neighbour within 1 - threshold may be:

* Documents with equal sets are one point; only the one with the smallest id goes on.
* Sampled documents make no useful pivots: nearly every document is at distance 1 from
  nearly every other, so all would lie in all windows. Regions are therefore anchored at
  single shingles. A set of n shingles goes to the regions of its first
  n - ceil(threshold * n) + 1 shingles in one fixed order: two sets within the threshold
  share at least one of them, so every link lies inside some region. The order puts
  shingles seen to be frequent last, so a passage that many documents share makes regions
  only where it is most of a document. Any order is exact; this one keeps regions small.
* A region's pivot is the member with the fewest shingles of its own, as a hub of its near
  copies would have. Each document's distance to the pivot most like it is taken exactly,
  and those links give first components; distances to its other pivots are taken where
  they could join two components. A region in one component by then is done.
* The other regions are joined again, those with one pivot together: two members of
  different components are tested if the triangle inequality lets them, that is unless
  their distances to the pivot are known and differ by more than 1 - threshold. Large cells are cut into
  chunks, and pairs of chunks are joined in tasks of their own.

All links between different components are tested, so components are exact. The result is
components, not all links: pairs already in one component are not measured, so links
between different texts and the number of links of a document are not to be had. Regions
are not joined again with pivots of their own; chunks stand for that recursion. Before sets of
whole texts move, a pair must pass a bound on sketches of about a bit for each shingle: for
each bit in which two sketches differ there is a shingle that only one set holds.

Defined results: null, empty and blank texts have empty sets and are linked with nothing.
A null id takes no part and has a null component. Rows repeated under one id are one
document where that id stands for its set. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import fuse
from .components import components
from .tables import frugal, save, small, text_key, without
from .words import chunks, shingle_sets

PERCENT = 80
WORDS = 5
#: Members a cell may have to be joined by rows; one of n is joined in sqrt(n / CHUNK) chunks.
CELL = 48
CHUNK = 32
#: Pairs that share one copy of their pivot's set.
FAN = 64
#: Turns in which the first pairs are measured; each has its share of the sets on disk.
ROUNDS = 4
#: Pairs of five longs that may be broadcast to the sets: about 64 MB.
PAIRS = 1_000_000
#: Shingles that may be put at the end of the order at a time: 8 MB.
MOVED = 1_000_000
#: Pairs whose sketches are in Python's memory at once.
SLICE = 512
#: Bits of a sketch at least; longer sets have longer ones.
SKETCH_BITS = 2048
ONE_SET = "doc_id LONG, text_key LONG, n_shingles LONG, sig BINARY, sketch BINARY, s LONG, seen LONG"


def sketch(items: np.ndarray) -> bytes:
    """Parities of the shingles in as many cells, a power of two, as there are shingles."""
    cells = max(SKETCH_BITS, 1 << (max(len(items), 1) - 1).bit_length())
    counts = np.bincount((items % np.uint64(cells)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(bool)).tobytes()


def differing(left: list[bytes], right: list[bytes], block: int = 4096) -> np.ndarray:
    """Bits in which pairs of sketches differ; the longer of two is folded onto the shorter."""
    out = np.zeros(len(left), np.int64)
    alike: dict[tuple[int, int], list[int]] = {}
    for k, (p, q) in enumerate(zip(left, right)):
        alike.setdefault((len(p), len(q)), []).append(k)
    for every in alike.values():
        for at in range(0, len(every), block):
            some = every[at : at + block]
            p, q = (np.frombuffer(b"".join([side[k] for k in some]), np.uint64).reshape(len(some), -1) for side in (left, right))
            while p.shape[1] != q.shape[1]:
                p, q = (p, q) if p.shape[1] > q.shape[1] else (q, p)
                half = p.shape[1] // 2
                p = p[:, :half] ^ p[:, half:]
            out[some] = np.bitwise_count(p ^ q).sum(1, dtype=np.int64)
    return out


def set_sizes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Size and 128-bit hash of each document's set, and in rows without a hash the shingles
    that several sets of a batch hold, with their number."""
    names = [f.split()[0] for f in ONE_SET.split(", ")]

    def run(batches):
        for batch in batches:
            sizes, sigs, sketches, every = [], [], [], []
            for _, _, data, offsets in chunks(batch.column("_text")):
                for s in shingle_sets(data, offsets, words):
                    sizes.append(len(s))
                    sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    sketches.append(sketch(s))
                    every.append(s)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(sketches, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            every = np.sort(np.concatenate(every)) if every else np.zeros(0, np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, int)
            seen = np.diff(np.append(starts, len(every)))
            some = seen > 2
            m = int(some.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, pa.int64())] * 3 + [pa.nulls(m, pa.binary())] * 2 + [pa.array(every[starts[some]].view(np.int64)), pa.array(seen[some])],
                names=names)

    return docs.mapInArrow(frugal(run), ONE_SET)


def anchors(docs: DataFrame, moved, percent: int, words: int, held=None) -> DataFrame:
    """``s, x, n, own``: the regions of each document; only regions in ``held`` if given, and
    then ``own`` is the number of its other ones. ``moved``: shingles that come last."""

    def run(batches):
        last = moved.value
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in chunks(batch.column("_text")):
                parts, sizes = [], []
                for s in shingle_sets(data, offsets, words):
                    keep = len(s) + (percent * len(s)) // -100 + 1 if len(s) else 0
                    sizes.append(len(s))
                    if len(last) and keep:
                        late = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
                        if late[:keep].any():
                            s = np.concatenate([s[~late], s[late]])
                    parts.append(s[:keep])
                counts = np.fromiter(map(len, parts), np.int64, len(parts))
                s, which = np.concatenate(parts), np.repeat(np.arange(b - a), counts)
                own = np.zeros(b - a, np.int64)
                if held:
                    pick = held.value.contains(s)
                    own = counts - np.bincount(which[pick], minlength=b - a)
                    s, which = s[pick], which[pick]
                columns = [s.view(np.int64), ids[a:b][which], np.array(sizes, np.int64)[which], own[which]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["s", "x", "n", "own"])

    return docs.mapInArrow(frugal(run), "s LONG, x LONG, n LONG, own LONG")


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``x, items`` of the documents in ``wanted`` (a saved table of distinct ``x``)."""
    held = fuse.screen(wanted, "x")

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            if held:
                pick = held.value.contains(ids.view(np.uint64))
                ids, batch = ids[pick], batch.filter(pa.array(pick))
            for a, b, data, offsets in chunks(batch.column("_text")):
                items = [s.view(np.int64) for s in shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(items, pa.list_(pa.int64()))], names=["x", "items"])

    return docs.mapInArrow(frugal(run), "x LONG, items ARRAY<LONG>")


def _measured(pairs: DataFrame, docs: DataFrame, words: int, rounds: int = 1) -> DataFrame:
    """Add ``both``, the size of the intersection, to pairs ``a, b, na, nb`` (a saved table).

    The set of ``b`` moves once for each pair, that of ``a`` once for every ``FAN`` pairs, so
    a pivot of many documents is spread over many tasks. Pairs are dealt to ``rounds``, and
    the sets that a round has moved are dropped before the next one.
    """
    fans = save(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("long").alias("fans")), "fans")
    dealt = pairs.join(small(fans), "a").withColumn("fan", F.expr("pmod(xxhash64(b), fans)"))
    dealt = dealt.select("a", F.col("b").alias("x"), "na", "nb", "fan", F.expr(f"pmod(xxhash64(a, fan), {rounds})").alias("turn"))
    dealt = save(dealt, "dealt")
    out = None
    for turn in range(rounds):
        mine = dealt.where(F.col("turn") == turn).drop("turn")
        heads = save(mine.select(F.col("a").alias("x"), "fan").distinct(), "heads")
        right = whole_sets(docs, save(mine.select("x").distinct(), "ids"), words).withColumnRenamed("items", "right")
        left = whole_sets(docs, save(heads.select("x").distinct(), "ids"), words).join(small(heads), "x")
        left = save(left.select(F.col("x").alias("a"), "fan", F.col("items").alias("left")), "left")  # one scan of text at a time
        both = F.size(F.array_intersect("left", "right")).cast("long").alias("both")
        sized = right.join(small(mine, PAIRS), "x").join(left, ["a", "fan"]).select("a", F.col("x").alias("b"), "na", "nb", both)
        sized = save(sized, "sized")
        out = out.unionByName(sized) if out else sized
    return out


def _possible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b, na, nb`` whose sketches don't rule the threshold out, and the bits they differ in."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):  # sketches are as long as their sets
                batch = whole.slice(at, SLICE)
                apart = differing(batch.column("left").to_pylist(), batch.column("right").to_pylist())
                # at the threshold the sets differ in (1 - t) / (1 + t) of the sum of their sizes
                total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
                batch = batch.append_column("apart", pa.array(apart))
                yield batch.select(["a", "b", "na", "nb", "apart"]).filter(pa.array(apart * (100 + percent) <= (100 - percent) * total))

    left = sketches.select(F.col("x").alias("a"), F.col("sketch").alias("left"))
    right = sketches.select(F.col("x").alias("b"), F.col("sketch").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "left", "right").mapInArrow(frugal(run), "a LONG, b LONG, na LONG, nb LONG, apart LONG").distinct()


def _chunk_join(percent: int, tile: int = 256):
    """Pairs of different components in a pair of chunks that sizes, sketches and windows allow."""
    width = (100 - percent) / 100 + 1e-9

    def run(group, rows):
        lo, hi = group[1].as_py(), group[2].as_py()
        x, n, c, d, part = (rows.column(k).to_numpy(zero_copy_only=False) for k in ("x", "n", "c", "d", "part"))
        d = d.astype(float)
        sketches = rows.column("sketch").to_pylist()
        left = np.flatnonzero(part == lo)
        right = left if lo == hi else np.flatnonzero(part == hi)
        out = []
        for at in range(0, len(left), tile):
            p = left[at : at + tile]
            for to in range(0, len(right), tile):
                q = right[to : to + tile]
                total = n[p][:, None] + n[q][None]
                may = 100 * np.minimum(n[p][:, None], n[q][None]) >= percent * np.maximum(n[p][:, None], n[q][None])
                may &= (c[p][:, None] != c[q][None]) & ~(np.abs(d[p][:, None] - d[q][None]) > width)
                if lo == hi:
                    may &= p[:, None] < q[None]
                i, j = np.nonzero(may)
                apart = differing([sketches[k] for k in p[i]], [sketches[k] for k in q[j]])
                keep = apart * (100 + percent) <= (100 - percent) * total[i, j]
                out.append((p[i[keep]], q[j[keep]]))
        i, j = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        a, b = np.where(x[i] < x[j], i, j), np.where(x[i] < x[j], j, i)
        return pa.table([pa.array(v) for v in (x[a], x[b], n[a], n[b])], names=["a", "b", "na", "nb"])

    return run


def links(docs: DataFrame, frequent: np.ndarray, sketches: DataFrame, percent: int = PERCENT, words: int = WORDS, cell: int = CELL) -> DataFrame:
    """``a, b``: links that connect what the threshold connects. ``docs``: ``doc_id, _text``, one row per set."""
    size_fits = F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    moved = docs.sparkSession.sparkContext.broadcast(np.sort(frequent))
    counted = anchors(docs, moved, percent, words).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    shared = save(counted.where("n > 1").select("s"), "shared")
    held = fuse.screen(shared, "s")
    members = save(anchors(docs, moved, percent, words, held), "members")
    hub = F.min(F.struct("own", "x", "n")).alias("hub")
    regions = members.groupBy("s").agg(F.count(F.lit(1)).alias("size"), hub).where("size > 1")
    regions = save(regions.select("s", "size", F.col("hub.x").alias("pivot"), F.col("hub.n").alias("np")), "regions")
    members = save(members.join(regions, "s").where("x != pivot").drop("own"), "placed")
    # distances to pivots
    pairs = members.select(F.col("pivot").alias("a"), F.col("x").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb"))
    pairs = save(_possible(pairs.where(size_fits).distinct(), sketches, percent), "pairs")
    # each document's most similar pivot first, the others only across components
    least = F.min(F.struct("apart", "a", "na", "nb")).alias("p")
    first = save(pairs.groupBy("b").agg(least).select("p.a", "b", "p.na", "p.nb"), "first")
    checked = _measured(first, docs, words, ROUNDS)
    found = checked.where(_near(percent)).select("a", "b")
    comp = save(components(found), "components")
    rest = pairs.drop("apart").join(first.select("a", "b"), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        name = comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        rest = rest.join(name, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    rest = _measured(save(rest.where("ca != cb").drop("ca", "cb"), "rest"), docs, words)
    more = rest.where(_near(percent)).select("a", "b")
    comp = components(more.unionByName(comp.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    comp = save(comp, "components").select(F.col("node").alias("x"), F.col("component").alias("c"))
    checked, found = checked.unionByName(rest), found.unionByName(more)
    # regions that hold several components beside their pivot
    gap = checked.select(F.col("a").alias("pivot"), F.col("b").alias("x"), F.expr("1 - both / (na + nb - both)").alias("d"))
    named = members.where("size > 2").join(comp, "x", "left").withColumn("c", F.coalesce("c", "x")).select("s", "pivot", "x", "n", "c")
    mixed = named.groupBy("s").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least < most")
    left = named.join(save(mixed.select("s"), "mixed"), "s", "left_semi").select("pivot", "x", "n", "c").distinct()
    left = left.join(gap, ["pivot", "x"], "left")
    return found.unionByName(_cells(docs, left, checked, sketches, percent, words, cell, size_fits))


def _cells(docs, left, checked, sketches, percent, words, cell, size_fits) -> DataFrame:
    """Links among the members of each pivot that are not yet in one component."""
    left = save(left, "left")
    counts = left.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"))
    left = save(left.join(counts, "pivot"), "cells")
    few, many = left.where(F.col("size") <= cell), left.where(F.col("size") > cell)
    p = few.select("pivot", F.col("x").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("d").alias("da"))
    q = few.select("pivot", F.col("x").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("d").alias("db"))
    window = F.expr(f"da IS NULL OR db IS NULL OR abs(da - db) <= {(100 - percent) / 100 + 1e-9}")
    more = p.join(q, "pivot").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & size_fits & window)
    more = more.select("a", "b", "na", "nb").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = _possible(more, sketches, percent).drop("apart")
    chunks_of = F.ceil(F.sqrt(F.col("size") / CHUNK)).cast("long")  # grow as the chunks do
    many = many.withColumn("chunks", chunks_of).withColumn("part", F.expr("pmod(xxhash64(x), chunks)"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    many = many.join(sketches, "x").withColumn("other", other).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    tasks = many.select("pivot", "lo", "hi", "part", "x", "n", "c", "d", "sketch").groupBy("pivot", "lo", "hi")
    far = tasks.applyInArrow(_chunk_join(percent), "a LONG, b LONG, na LONG, nb LONG").distinct()
    far = far.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    more = save(more.unionByName(far).distinct(), "more")
    return _measured(more, docs, words).where(_near(percent)).select("a", "b")


def _near(percent: int):
    return F.expr(f"100 * both >= {percent} * (na + nb - both)")


def ngram_join(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, words: int = WORDS, **limits) -> DataFrame:
    """One row per document: ``doc_id, text_key, n_shingles, component_id``."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), text_key(text).alias("text_key"), F.col(text).alias("_text"))
    scanned = save(set_sizes(rows, words), "set_sizes")
    seen = scanned.where("sig IS NULL").groupBy("s").agg(F.sum("seen").alias("seen")).where(F.col("seen") > CELL)
    frequent = np.array([r["s"] for r in seen.orderBy(F.desc("seen"), "s").limit(MOVED).collect()], np.int64).view(np.uint64)
    base = scanned.where("sig IS NOT NULL").drop("s", "seen")
    classes = base.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("rep"))
    sketches = save(base.join(classes, "sig").where("doc_id = rep").select(F.col("rep").alias("x"), "sketch"), "sketches")
    base = base.drop("sketch")
    classed = save(base.join(classes, "sig", "left").drop("sig"), "classed")
    idle = classed.where("rep IS NULL OR rep != doc_id OR doc_id IS NULL").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    points = without(rows.select("doc_id", "_text"), save(idle.distinct(), "idle"), "doc_id", "_text")
    comp = save(components(links(points, frequent, sketches, percent, words, **limits)), "components")
    joined = classed.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return joined.select("doc_id", "text_key", "n_shingles", group.alias("component_id"))


def one_per_group(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with the smallest id of their group, with all their columns."""
    result = ngram_join(docs, id, text, **options)
    gone = result.where("component_id != doc_id").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    return without(docs, save(gone.distinct(), "gone"), id, text)
