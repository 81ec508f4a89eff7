"""Scans of the domain tables and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import base_name, output_name
from ..operators.register import nested_row, safe_text
from .specs import DocSpec

USAGE_SCHEMA = (
    "event_id BIGINT, timestamp STRING, date STRING, month STRING, processor STRING, "
    "department STRING, model STRING, model_role STRING, is_retry BOOLEAN, proc_ms BIGINT, "
    "input_tokens BIGINT, output_tokens BIGINT, total_tokens BIGINT, cost_inr DECIMAL(18,4)"
)
BATCH_SCHEMA = (
    "id STRING, timestamp STRING, mode STRING, department STRING, total BIGINT, "
    "success BIGINT, warnings BIGINT, errors BIGINT, by_type MAP<STRING,BIGINT>, "
    "files ARRAY<STRING>"
)
BINARY_FILE_SCHEMA = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files: ``(filename, content)``, one row per file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(base_name(F.col("path")).alias("filename"), "content")


def read_manifest_texts(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.text(pattern, wholetext=True).withColumnRenamed("value", "raw")


def parse_json_rows(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON lines; only the lines that do not parse are dropped."""
    row = F.from_json(column, schema)
    readable = F.try_parse_json(column).isNotNull()
    return lines.where(readable).select(row.alias("r")).select("r.*")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_rows(spark.read.text(path), USAGE_SCHEMA)


def read_batches(spark: SparkSession, pattern: str) -> DataFrame:
    """Batch history records, one JSON file each; unreadable ones are skipped."""
    texts = spark.read.text(pattern, wholetext=True)
    return latest_batches(parse_json_rows(texts, BATCH_SCHEMA))


def latest_batches(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.desc("id"))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def document_json(documents: DataFrame, columns: list[str]) -> DataFrame:
    """``(name, value)``: the JSON text of each document, nulls written out."""
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return documents.select("name", body.alias("value"))


def write_document_json(documents: DataFrame, path: str) -> None:
    """JSON lines of ``(type_key, value)``, one folder per document type."""
    documents.select("type_key", "value").write.mode("append").partitionBy("type_key").text(path)


def output_names(documents: DataFrame, suffix_column: str, extension: str) -> DataFrame:
    return documents.withColumn(
        "name", output_name(F.col("filename"), F.col(suffix_column), extension)
    )


def register_frame(spec: DocSpec, documents: DataFrame, cells: str = "cells") -> DataFrame:
    return documents.select("doc_id", *nested_row(spec, F.col(cells)))


def write_register(register: DataFrame, spec: DocSpec, path: str) -> str:
    """Register of one type as CSV with a header, under a folder named by its key."""
    safe = register.select(
        *[safe_text(F.col(f"`{c}`"), t).alias(c) for c, t in register.dtypes]
    )
    target = f"{path}/type={spec.key}"
    safe.write.mode("overwrite").option("header", True).csv(target)
    return target


def export_all(documents: DataFrame) -> DataFrame:
    """Both exports of every processed document as ``(name, kind, value)`` rows.

    ``documents`` has filename, json_suffix, data_json and summary_json.
    """
    def part(kind: str, column: str, extension: str) -> DataFrame:
        named = output_names(documents, "json_suffix", extension)
        return named.select("doc_id", "name", F.lit(kind).alias("kind"), F.col(column).alias("value"))

    return part("json", "data_json", ".json").unionByName(part("sheet", "summary_json", ".csv"))


