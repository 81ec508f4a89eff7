"""Embedding near-dedup by a subspace pigeonhole join, exact.

Unit vectors with cosine at least t have squared distance at most T = 2 - 2 t. They are
rotated at random, so their energy is spread evenly, and split into blocks of dimensions.
If the squared distances of all blocks add up to T or less, some block has no more than its
proportional share. So each block is range-joined under that budget: vectors go to strips of
the block's first coordinate as wide as twice the radius, and those near a border also to
the next strip. Inside a strip, candidates are pairs within the block's budget; a pair is
taken in the first block that yields it, and its cosine is then checked in double precision.

A strip with many vectors is cut into chunks, and each pair of chunks is a task of its own,
so no task holds a group whole. Tasks give numbers of links and enough links to connect what
they connect, never all pairs. Equal vectors are one vector with a multiplicity.

Defined results: vectors that are null, empty, zero, or hold a null or a value that is not
finite, and vectors without a label, link with nothing. Vectors of different lengths are not
compared. Rows repeated under one id are vectors of their own that share the id. A null id
takes part in no link and has no component. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import components
from .tables import save

COSINE = 0.93
BLOCK = 8  # dimensions
CHUNK = 2048
SEED = 3
SLACK = 1e-9
_ROTATIONS: dict[int, np.ndarray] = {}


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    if size not in _ROTATIONS:
        q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED + size)).normal(size=(size, size)))
        _ROTATIONS[size] = q * np.sign(np.diag(r))
    return _ROTATIONS[size]


def matrix(column, size: int) -> np.ndarray:
    """An Arrow column of vectors of one size as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)


def _blocks(size: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK, size)) for a in range(0, size, BLOCK)]


def _shares(size: int, budget: float) -> list[float]:
    """Squared-distance budget of each block, in proportion to its dimensions."""
    return [budget * (b - a) / size + SLACK for a, b in _blocks(size)]


def strips(points: DataFrame, cosine: float, vector: str) -> DataFrame:
    """``label, size, block, strip, rep, copies, vector`` for each strip a vector is in."""
    budget = 2 - 2 * cosine
    schema = "label STRING, size INT, block INT, strip INT, rep LONG, copies LONG, vector " + vector

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            take, block_of, strip_of = [], [], []
            for size in np.unique(sizes):
                here = np.flatnonzero(sizes == size)
                y = units(matrix(vectors.take(pa.array(here)), int(size))) @ rotation(int(size))
                for k, ((a, _), share) in enumerate(zip(_blocks(int(size)), _shares(int(size), budget))):
                    radius = np.sqrt(share)
                    at = y[:, a] / (2 * radius)
                    home = np.floor(at).astype(np.int64)
                    over = at + 0.5 >= home + 1  # a neighbour with a larger coordinate may be in the next strip
                    for which, strip in ((np.ones(len(here), bool), home), (over, home + 1)):
                        take.append(here[which])
                        block_of.append(np.full(int(which.sum()), k))
                        strip_of.append(strip[which])
            at = pa.array(np.concatenate(take))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(at), pa.array(sizes[np.concatenate(take)], pa.int32()), pa.array(np.concatenate(block_of), pa.int32()),
                 pa.array(np.concatenate(strip_of), pa.int32()), batch.column("rep").take(at), batch.column("copies").take(at), batch.column("vector").take(at)],
                names=["label", "size", "block", "strip", "rep", "copies", "vector"])

    return points.mapInArrow(run, schema)


def _join(cosine: float):
    budget = 2 - 2 * cosine

    def run(group, rows):
        _, size, block, strip, lo, hi = (g.as_py() for g in group)
        rep, copies = rows.column("rep").to_numpy(), rows.column("copies").to_numpy()
        u = units(matrix(rows.column("vector"), size))
        y = u @ rotation(size)
        blocks, shares = _blocks(size), _shares(size, budget)
        home = np.floor(y[:, blocks[block][0]] / (2 * np.sqrt(shares[block])))
        part = rows.column("part").to_numpy()
        left = np.flatnonzero(part == lo)
        right = left if lo == hi else np.flatnonzero(part == hi)

        def apart(k):
            a, b = blocks[k]
            p, q = y[left, a:b], y[right, a:b]
            return (p * p).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * p @ q.T

        near = apart(block) <= shares[block] + SLACK
        near &= (home[left] == strip)[:, None] | (home[right] == strip)[None]  # else the strip before has the pair
        i, j = np.nonzero(near)
        keep = left[i] < right[j] if lo == hi else np.ones(len(i), bool)
        i, j = left[i[keep]], right[j[keep]]
        for k, ((a, b), share) in enumerate(zip(blocks[:block], shares[:block])):
            d = y[i, a:b] - y[j, a:b]
            later = (d * d).sum(1) > share + SLACK  # not given by an earlier block
            i, j = i[later], j[later]
        cos = np.einsum("ij,ij->i", u[i], u[j])
        linked = cos >= cosine
        i, j = i[linked], j[linked]
        n = np.zeros(len(rep), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        root = np.arange(len(rep))
        while len(i):  # smallest row each row is connected to
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(n)
        return pa.table([pa.array(rep[some]), pa.array(n[some]), pa.array(rep[root[some]])], names=["rep", "n", "root"])

    return run


def embedding_join(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    kind = "array<float>" if dict(rows.dtypes)[vector] == "array<float>" else "array<double>"
    v = F.col("_vector")
    rows = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("_vector"), F.col(label).cast("string").alias("label"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    base = rows.select("vec_id", "label", F.when(F.coalesce(usable, F.lit(False)), v).alias("vector"))
    points = base.where("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    points = save(points.withColumn("rep", F.monotonically_increasing_id()), "points")
    placed = save(strips(points.select("label", "vector", "rep", "copies"), cosine, kind), "strips")
    cell = ["label", "size", "block", "strip"]
    counts = placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks"))
    tasks = placed.join(counts, cell).withColumn("part", F.expr("pmod(xxhash64(rep), chunks)"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tasks = tasks.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})
    found = tasks.groupBy(*cell, "lo", "hi").applyInArrow(_join(cosine), "rep LONG, n LONG, root LONG")
    found = save(found, "found")
    comp = save(components(found, "rep", "root"), "components")
    total = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = points.join(total, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = save(known.withColumn("component", F.coalesce("component", "rep")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    same = ["label", "vector"]
    out = base.where("vector IS NOT NULL").join(known, same).select("vec_id", "n_links", "component_id")
    lone = base.where("vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
