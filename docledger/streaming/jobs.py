"""Usage roll-up, first-seen fingerprints and file intake as streams.

Every job writes to a table folder and keeps its state in a checkpoint folder, both
shared by all executors, so a lost executor or a restarted driver resumes them.

Tables that batches add to are kept as ``batch=<id>`` folders and, now and then, a ``base=<id>``
folder that holds all up to that batch. A base counts once it is in the list of bases, which
is written last, so readers see whole bases only and a batch that is run again finds what it
found before. Readers take the latest base and the batches behind it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import money
from ..operators.intake import first_seen, uploads
from ..session import saved
from ..sources.tables import BINARY_FILE_SCHEMA


#: Batches after which a table gets a new base, and hexadecimal digits of its index's parts.
COMPACT = 8
DIGITS = 2


def _bases(spark: SparkSession, out: str) -> list[int]:
    """Ids of the finished bases; there is one in ``COMPACT`` batches."""
    try:
        return sorted(r.base for r in spark.read.schema("base BIGINT").json(f"{out}/bases").collect())
    except AnalysisException:  # no base yet
        return []


def stored(spark: SparkSession, out: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of all batches with a smaller id than ``before``: latest base and later batches.

    ``batch`` tells which batch a row is from. With ``before``, as batches read it, only the
    folders of that base and of the batches behind it are listed and read, so the files of a
    batch's read don't grow with the number of batches.
    """
    bases = [k for k in _bases(spark, out) if before is None or k < before]
    base = bases[-1] if bases else -1
    rows = spark.createDataFrame([], f"{schema}, batch BIGINT")
    if bases:
        rows = rows.unionByName(spark.read.schema(f"{schema}, batch BIGINT").parquet(f"{out}/base={base}"))
    behind = "*" if before is None else "{" + ",".join(map(str, range(base + 1, before))) + "}"
    if behind == "{}":
        return rows
    try:
        later = spark.read.option("basePath", out).schema(f"{schema}, batch BIGINT").parquet(f"{out}/batch={behind}")
    except AnalysisException:  # no batch yet
        return rows
    return rows.unionByName(later.where(F.col("batch") > base))


def compact(spark: SparkSession, out: str, rows: DataFrame, batch_id: int, parts: list[str]) -> None:
    """Write ``rows`` as the base up to a batch, then list it."""
    rows.write.mode("overwrite").partitionBy(*parts).parquet(f"{out}/base={batch_id}")
    spark.createDataFrame([(batch_id,)], "base BIGINT").coalesce(1).write.mode("append").json(f"{out}/bases")


def usage_rollup(usage: DataFrame, delay: str = "1 day", width: str = "1 day", unique: str | None = None) -> DataFrame:
    """Documents, tokens and cost per window and processor of a usage stream.

    Windows leave the state once the watermark has passed them, and later events for them are
    dropped. Events repeated under one ``unique`` id within the delay count once.
    """
    marked = usage.withWatermark("ts", delay)
    if unique:
        marked = marked.dropDuplicatesWithinWatermark([unique])
    return (
        marked.groupBy(F.window("ts", width).alias("w"), F.coalesce("processor", F.lit("?")).alias("processor"))
        .agg(
            F.count(F.lit(1)).alias("docs"),
            F.sum("total_tokens").alias("tokens"),
            money(F.sum("cost_inr")).alias("cost_inr"),
        )
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("date"), "processor", "docs", "tokens", "cost_inr")
    )


USAGE_WINDOWS = "date STRING, processor STRING, docs BIGINT, tokens BIGINT, cost_inr DECIMAL(18,4)"


def start_usage_rollup(
    usage: DataFrame, out: str, checkpoint: str, unique: str | None = None, every: int = COMPACT
) -> StreamingQuery:
    """Windows are rewritten as they grow: each batch's changes land in its own folder.

    After ``every`` batches the latest version of each window becomes the new base.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        if batch_id % every == every - 1:
            rows = current_usage(spark, out, batch_id + 1).withColumn("batch", F.lit(batch_id).cast("bigint"))
            compact(spark, out, rows, batch_id, [])

    # append mode after a deduplication would hold windows back; update mode shows them grow
    return (
        usage_rollup(usage, unique=unique)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def current_usage(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """Latest version of every window."""
    names = ["docs", "tokens", "cost_inr"]
    return (
        stored(spark, out, USAGE_WINDOWS, before)
        .groupBy("date", "processor")
        .agg(F.max_by(F.struct(*names), "batch").alias("s"))
        .select("date", "processor", "s.*")
    )


def start_first_seen(
    rows: DataFrame, out: str, checkpoint: str, order: list[str], keep: list[str], every: int = COMPACT, digits: int = DIGITS
) -> StreamingQuery:
    """First record per fingerprint over all history, first batch wins.

    The index is a table, not stream state, so it may grow without bound. It is partitioned
    by the first digits of the fingerprint, and a batch reads only the parts that it touches:
    their base and at most ``every`` later batches. A batch that is run again writes the same
    folder and looks only at earlier batches.
    """
    schema = index_schema(rows, keep)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = first_seen(batch, order, keep).withColumn("part", F.substring("sha1", 1, digits))
        new = saved(new, "first-seen")
        touched = [r.part for r in new.select("part").distinct().collect()]  # 16 ** digits at most
        earlier = stored(spark, out, schema, batch_id).where(F.col("part").isin(touched))
        fresh = new.join(earlier.select("sha1"), "sha1", "left_anti")
        fresh.write.mode("overwrite").partitionBy("part").parquet(f"{out}/batch={batch_id}")
        if batch_id % every == every - 1:
            whole = stored(spark, out, schema, batch_id + 1)
            compact(spark, out, whole.repartition("part", F.pmod(F.xxhash64("sha1"), F.lit(4))), batch_id, ["part"])

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def index_schema(rows: DataFrame, keep: list[str]) -> str:
    types = dict(rows.dtypes)
    return ", ".join(["sha1 STRING", *[f"`{c}` {types[c]}" for c in keep], "part STRING"])


def current_index(spark: SparkSession, out: str, schema: str) -> DataFrame:
    return stored(spark, out, schema).drop("batch", "part")


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they arrive; the source remembers the paths it has seen."""
    files = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", "true").load(folder)
    )
    named = files.select(F.substring_index("path", "/", -1).alias("filename"), "content")
    return uploads(named)


def start_intake(files: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        files.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .option("path", out).outputMode("append").trigger(availableNow=True).start()
    )
