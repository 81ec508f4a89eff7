"""Joins that stay whole and balanced when one key holds much of the fact side."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
HOT_SHARE = 1 / 64
HOT_ROWS = 1_000_000
SALTS = 32
#: Parts that ``spread`` makes of each split of a large scan.
SPREAD = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan over all slots before costly per-row work.

    The number of splits says nothing about where the rows are: a Parquet row group lies in
    one split whole, and a file of few row groups has splits without rows. So rows always move,
    by the hash of ``keys`` (a round-robin repartition would first sort every partition); a
    large scan is dealt into ``SPREAD`` parts a split, so that no task is long.
    """
    if df.isStreaming:
        return df
    slots, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(slots if splits < slots else SPREAD * splits, *keys)


def fits_broadcast(
    df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure a side before broadcasting it; reads at most ``max_rows + 1`` rows."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, nbytes = df.limit(max_rows + 1).agg(F.count(F.lit(1)), size).first()
    return rows <= max_rows and (nbytes or 0) <= max_bytes


def hot_keys(fact: DataFrame, keys: list[str], share: float, min_rows: int) -> list:
    """Keys that hold at least ``share`` of the rows: never more than ``1/share`` of them.

    ``fact`` is read once: counts are combined map-side, their sum is observed on the way,
    and only the top few reach the driver.
    """
    seen = Observation()
    counts = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).observe(seen, F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n")).limit(math.ceil(1 / share)).collect()
    floor = max((seen.get["total"] or 0) * share, min_rows)
    return [r for r in top if r["n"] >= floor]


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    how: str = "left",
    measure_dim: bool = True,
    probe: bool = True,
    max_rows: int = MAX_BROADCAST_ROWS,
    share: float = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join a large side to one that is unique (or nearly so) per key.

    A small ``dim``, by measured size, is broadcast. Beyond that, fact rows of hot
    keys are spread over ``salts`` buckets, equal ones as one row with a count, and only
    the dim rows of those keys are repeated, so no task gets a hot key whole and the rest
    of ``dim`` moves once.

    Finding hot keys reads the key columns of ``fact`` once more. Pass ``probe=False``
    where they are costly (a hash of all text): the join then relies on adaptive
    execution, which splits an oversized partition of the fact side by measured bytes.
    """
    if how.replace("_", "") in ("right", "rightouter", "full", "outer", "fullouter"):
        raise ValueError(f"a {how} join keeps rows of the side that salting repeats")
    keys = [on] if isinstance(on, str) else list(on)
    if measure_dim and fits_broadcast(dim, max_rows):
        return fact.join(F.broadcast(dim), keys, how)
    hot = hot_keys(fact, keys, share, hot_rows) if probe else []
    if not hot:
        return fact.join(dim, keys, how)

    def is_hot() -> Column:
        return _any(
            [reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(r[k]) for k in keys]) for r in hot]
        )

    salty = F.coalesce(is_hot(), F.lit(False)) | _any([F.col(k).isNull() for k in keys])
    plain = [c for c, t in fact.dtypes if not t.startswith(("map", "variant"))]
    # A salt of columns only: a task that is run again deals alike. Equal rows would share it,
    # so they are counted first (map-side) and join once, where all columns can be compared.
    counted = len(plain) == len(fact.columns)
    some = fact.where(salty)
    if counted:
        some = some.groupBy(*fact.columns).agg(F.count(F.lit(1)).alias("_copies"))
    some = some.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("bigint"))
    repeated = dim.where(is_hot()).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    joined = some.join(repeated, [*keys, "_salt"], how).drop("_salt")
    if counted:
        joined = joined.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")
    return fact.where(~salty).join(dim, keys, how).unionByName(joined)
