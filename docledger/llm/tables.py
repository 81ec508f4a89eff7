"""Helpers on tables: scratch tables, checked broadcasts, global row numbers."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import scratch_folder

#: Rows of two longs that may be broadcast: about 64 MB. Beyond it, rows are shuffled.
BROADCAST_ROWS = 2_000_000


#: Spark's setting to drop a query's shuffle files as soon as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def give_back() -> None:
    """Return what this process has freed to the system: allocators keep their largest peak otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def frugal(run):
    """``run`` of a ``mapInArrow`` whose worker, which later stages use again, keeps no freed memory."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors.

    The shuffle files of the write are dropped when it ends; the table replaces them.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table of a few fixed-width columns for broadcast if it has few enough rows.

    ``df`` should be a saved table; the count then reads only file footers.
    """
    return F.broadcast(df) if df.count() <= rows else df


def numbered(
    df: DataFrame, order: list[str | Column], weight: str | None = None, name: str = "numbered"
) -> DataFrame:
    """Add ``pos`` (row number from 0 in ``order``) and ``before`` (sum of ``weight`` ahead).

    Rows are range-partitioned and sorted once. Each task numbers its own rows, and the
    totals of the tasks (one row per task, all that reaches the driver) shift them.
    Rows that tie in ``order`` are numbered in any order. Carry narrow columns only.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    fields = [*df.schema.fields, T.StructField("_task", T.IntegerType()),
              T.StructField("_pos", T.LongType()), T.StructField("_before", T.LongType())]

    def local(batches):
        task, pos, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            if weight is None:
                sizes = pa.array([0] * n, pa.int64())
                before = sizes
            else:
                import pyarrow.compute as pc

                sizes = batch.column(weight).cast(pa.int64())
                sums = pc.cumulative_sum(sizes)
                before = pc.add(pc.subtract(sums, sizes), total)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([task] * n, pa.int32()),
                 pa.array(range(pos, pos + n), pa.int64()), before],
                names=[*batch.schema.names, "_task", "_pos", "_before"],
            )
            pos += n
            if weight is not None and n:
                total += sums[-1].as_py()

    rows = save(ranged.mapInArrow(frugal(local), T.StructType(fields)), name)
    last = F.col(weight) if weight else F.lit(0)
    totals = rows.groupBy("_task").agg(F.count(F.lit(1)).alias("n"), F.sum(last).alias("w")).collect()
    shifts, pos, before = [], 0, 0
    for r in sorted(totals):
        shifts.append((r["_task"], pos, before))
        pos, before = pos + r["n"], before + (r["w"] or 0)
    shift = spark.createDataFrame(shifts, "_task INT, _shift_pos LONG, _shift LONG")
    out = rows.join(F.broadcast(shift), "_task")
    return out.select(
        *df.columns,
        (F.col("_pos") + F.col("_shift_pos")).alias("pos"),
        (F.col("_before") + F.col("_shift")).alias("before"),
    )


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id: str, text: str) -> DataFrame:
    """Drop the rows whose id and text are in ``gone`` (``_id, _key``, a saved table).

    Whole rows are shuffled only if ``gone`` is too long for a broadcast.
    """
    same = F.col(id).eqNullSafe(F.col("_id")) & (text_key(text) == F.col("_key"))
    return docs.join(small(gone), same, "left_anti")
