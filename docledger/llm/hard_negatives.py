"""Hard negatives by segment summaries, exact.

A vector is cut into segments, and each segment keeps its mean and standard deviation. For
two segments of n components the inner product lies within
``n * (mean * mean +- deviation * deviation)``, so the sums over segments bound the score of
two vectors from a few numbers each. Summaries are made once and stored, for a coarse cut and
a finer one. A search reads bounds of the coarse cut for all rows, refines the rows that are
left with the finer one, and scores exactly what is left then. A row goes as soon as its
bounds miss the wanted range of scores, or as enough rows inside the range are surely better.

Two searches use this: the best rows of an anchor's own label, and, for each of those, the
best rows of other labels whose score lies in a range below it. Anchors are a stated set of
queries; they meet all rows in blocks of bounded size on both sides, dealt by row number, so
no label or id can gather in one task. A block pair yields a few rows per query, and the
query's best of all blocks are taken after a map-side cut.

Defined results: rows with a null label, a null or empty vector, or a null or not finite
component take no part, nor do rows with a scaled component beyond 2^24, whose scores would
not fit a long. Vectors of different lengths are not compared. Rows repeated under one id are
rows of their own; rows that tie in score and id are ordered by row number. A null id is no
anchor and comes after other ids. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .tables import save

#: Segments of the coarse and of the finer cut.
CUTS = (4, 16)
#: Rows and queries of a block.
ROWS = 8192
QUERIES = 4096
#: Queries bounded at once, and pairs scored one by one at once: some tens of MB each.
STRIPE = 64
PAIRS = 40_000
LARGEST = 1 << 24
#: Share of pairs up to which they are taken one by one, not as a product of matrices.
FEW = 0.02
_FIRST, _LAST = -(1 << 62), (1 << 63) - 1


def edges(size: int, cut: int) -> np.ndarray:
    """Where the segments of a cut begin."""
    return np.arange(min(cut, size)) * size // min(cut, size)


def summaries(x: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each segment of each row."""
    at = edges(x.shape[1], cut)
    n = np.diff(np.append(at, x.shape[1]))
    mean = np.add.reduceat(x, at, axis=1) / n
    apart = x - np.repeat(mean, n, axis=1)
    return mean, np.sqrt(np.add.reduceat(apart * apart, at, axis=1) / n)


def _weighted(stored: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stored summaries by cut, times the root of the segment's length: plain products then bound.

    One more deviation of 3e-5 of the vector's length makes up for rounding.
    """
    out, at = [], 0
    for cut in CUTS:
        begin = edges(size, cut)
        k, root = len(begin), np.sqrt(np.diff(np.append(begin, size)))
        mean, deviation = stored[:, at : at + k] * root, stored[:, at + k : at + 2 * k] * root
        long = np.sqrt((mean**2).sum(1) + (deviation**2).sum(1))
        out.append((mean, np.column_stack([deviation, 3e-5 * long + 1e-3])))
        at += 2 * k
    return out


def summarised(rows: DataFrame, id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``row, id, label, size, vector, summary`` of the rows that take part; vectors scaled and floored."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("_vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.cumsum(sizes) - sizes
            packed, stored, taken = [None] * len(sizes), [None] * len(sizes), np.zeros(len(sizes), bool)
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                x = np.floor(scale * flat[begin[own][:, None] + np.arange(size)])
                small = (np.abs(x) <= LARGEST).all(1)
                own, x = own[small], x[small]
                notes = np.concatenate([part for cut in CUTS for part in summaries(x, cut)], axis=1)
                for k, v, s in zip(own.tolist(), x.astype("<i4"), notes):
                    packed[k], stored[k], taken[k] = v.tobytes(), s.tobytes(), True
            columns = [*(batch.column(c) for c in ("row", "id", "label")), pa.array(sizes, pa.int32()),
                       pa.array(packed, pa.binary()), pa.array(stored, pa.binary())]
            whole = pa.RecordBatch.from_arrays(columns, names=["row", "id", "label", "size", "vector", "summary"])
            yield whole.filter(pa.array(taken))

    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    known = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    narrow = known.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"),
                          F.col(label).cast("string").alias("label"), values.alias("_vector"))
    return narrow.mapInArrow(run, "row LONG, id LONG, label STRING, size INT, vector BINARY, summary BINARY")


def best(query: dict, rows: dict, allowed, low: np.ndarray, high: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Query, range, row and score: per query and range the ``most`` best allowed rows inside.

    ``query`` and ``rows``: ``x`` (integers), ``cuts`` (of ``_weighted``); rows also ``id`` and
    ``row``, by which ties are ordered. ``allowed(a, b)`` tells for queries a to b which rows
    count; ``low`` and ``high`` have a row per query and a column per range.
    """
    out = []
    peak = [float(np.abs(side["x"]).max(initial=0)) for side in (query, rows)]
    exact = np.float64 if peak[0] * peak[1] * rows["x"].shape[1] < 1 << 53 else np.int64  # doubles are exact up to there
    x, y = query["x"].astype(exact), rows["x"].astype(exact)
    for a in range(0, len(low), STRIPE):
        b = min(a + STRIPE, len(low))
        left = allowed(a, b)
        for (mean, apart), (row_mean, row_apart) in zip(query["cuts"], rows["cuts"]):
            middle, width = _products(mean[a:b], row_mean, left), _products(apart[a:b], row_apart, left)
            left = np.any([_inside(left, middle - width, middle + width, lo, hi, most) for lo, hi in zip(low[a:b].T, high[a:b].T)], axis=0)
        score = _products(x[a:b], y, left)
        for k, (lo, hi) in enumerate(zip(low[a:b].T, high[a:b].T)):
            q, r = np.nonzero(_inside(left, score, score, lo, hi, most))
            value = score[q, r]
            order = np.lexsort((rows["row"][r], rows["id"][r], -value, q))
            q, r, value = q[order], r[order], value[order].astype(np.int64)
            first = np.arange(len(q)) - np.searchsorted(q, q) < most
            out.append((q[first] + a, np.full(int(first.sum()), k), r[first], value[first]))
    return tuple(np.concatenate(part) for part in zip(*out))


def _inside(left: np.ndarray, least: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Which rows may be among the ``most`` best from ``low`` to ``high``, by bounds of their scores."""
    low, high = low[:, None], high[:, None]
    may = left & (top >= low) & (least <= high)
    if may.shape[1] > most:
        sure = np.where(may & (least >= low) & (top <= high), least, _FIRST)
        may &= top >= np.partition(sure, -most, axis=1)[:, -most, None]
    return may


def _products(x: np.ndarray, y: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Inner products of the rows of both sides, only of the pairs that are ``left`` if these are few."""
    if left.mean() > FEW:
        return x @ y.T
    out = np.zeros(left.shape, x.dtype)
    q, r = np.nonzero(left)
    for k in range(0, len(q), PAIRS):
        i, j = q[k : k + PAIRS], r[k : k + PAIRS]
        out[i, j] = np.einsum("ij,ij->i", x[i], y[j])
    return out


def _side(table: pa.Table, size: int) -> dict:
    """The rows of one length as matrices."""
    table = table.filter(pc.equal(table.column("size"), size)).combine_chunks()
    raw = b"".join(table.column("vector").to_pylist())
    stored = np.frombuffer(b"".join(table.column("summary").to_pylist()), np.float64)
    return {
        "table": table, "x": np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, size),
        "cuts": _weighted(stored.reshape(table.num_rows, -1), size), "label": np.array(table.column("label").to_pylist(), object),
        "row": table.column("row").to_numpy(), "id": table.column("id").combine_chunks().fill_null(_LAST).to_numpy(),
    }


def _search(points: DataFrame, queries: DataFrame, same: bool, most: int) -> DataFrame:
    """``row, slot, other, id, score, rank``: per query and range the best rows of its own label or of others.

    ``queries``: the columns of ``points``, and the ranges ``low`` and ``high`` (arrays of one
    length). Both are saved tables. ``other`` and ``id`` are of the rows found.
    """
    row_blocks = max(1, -(-points.count() // ROWS))
    query_blocks = max(1, -(-queries.count() // QUERIES))

    names = ["row", "slot", "other", "id", "score"]

    def work(key, rows, wanted):
        found = []
        for size in set(wanted.column("size").to_pylist()) & set(rows.column("size").to_pylist()):
            q, r = _side(wanted, size), _side(rows, size)
            codes = {v: k for k, v in enumerate(set(r["label"]) | set(q["label"]))}
            ql, rl = (np.array([codes[v] for v in s["label"]]) for s in (q, r))

            def allowed(a, b):
                equal = ql[a:b, None] == rl
                return equal & (q["row"][a:b, None] != r["row"]) if same else ~equal

            low, high = (np.array(q["table"].column(c).to_pylist(), np.int64) for c in ("low", "high"))
            at, slot, hit, score = best(q, r, allowed, low, high, most)
            columns = [pa.array(q["row"][at]), pa.array(slot, pa.int32()), pa.array(r["row"][hit]), r["table"].column("id").take(pa.array(hit)), pa.array(score, pa.int64())]
            found.append(pa.table(columns, names=names))
        empty = pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), *[pa.int64()] * 3)], names=names)
        return pa.concat_tables([empty, *found])

    def dealt(df, key, own, blocks, other, others):
        return df.withColumns({own: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"), other: F.explode(F.sequence(F.lit(0), F.lit(others - 1)))})

    left = dealt(points, "row", "_r", row_blocks, "_q", query_blocks).groupBy("_r", "_q")
    right = dealt(queries, "row", "_q", query_blocks, "_r", row_blocks).groupBy("_r", "_q")
    some = left.cogroup(right).applyInArrow(work, "row LONG, slot INT, other LONG, id LONG, score LONG")
    first = Window.partitionBy("row", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "other")
    return some.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, anchors: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition on the column ``id`` of the result of ``summarised``. Scores are
    inner products of the components times ``scale``, floored. A negative's score lies between
    ``low`` and ``high`` hundredths of the positive's.
    """
    points = save(summarised(rows, id, vector, label, scale), "summaries")
    any_score = {"low": F.array(F.lit(_FIRST)), "high": F.array(F.lit(_LAST))}
    chosen = save(points.where(anchors).withColumns(any_score), "anchors")
    near = _search(points, chosen, True, positives)
    near = save(near.select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    edge = {"low": f"(-{low} * positive_score - pmod(-{low} * positive_score, 100)) div -100",
            "high": f"({high} * positive_score - pmod({high} * positive_score, 100)) div 100"}
    # one range per positive, at most ``positives``; missing ones hold nothing
    slots = [F.struct(*[F.coalesce(F.max(F.when(F.col("rank") == k + 1, F.expr(e))), F.lit(d)).alias(c) for (c, e), d in zip(edge.items(), (0, -1))]) for k in range(positives)]
    ranges = near.groupBy("row").agg(F.array(*slots).alias("ranges")).select("row", F.col("ranges.low").alias("low"), F.col("ranges.high").alias("high"))
    items = save(chosen.drop("low", "high").join(ranges, "row"), "queries")
    far = _search(points, items, False, negatives)
    far = far.select("row", (F.col("slot") + 1).alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.withColumnRenamed("rank", "of").join(chosen.select("row", F.col("id").alias("anchor_id")), "row")
    return far.join(named, ["row", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
