"""Documents to packed training sequences, in five stages.

Each stage reads what the one before kept, written as Parquet, and its decisions take
effect: junk goes, one of each set of equal texts and of each group of near copies stays,
secrets are taken out of the texts, and what is left is packed.

Null ids, null and empty texts, repeated rows and empty tables get the results that the
operators define; columns beside those of ``documents`` are carried to the last stage.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from docledger.llm import exact_dedup, ngram_join, packing, quality, secrets
from docledger.llm.queries import table, word_tokenizer
from docledger.llm.tables import save


#: Rows of a batch of texts in the tasks: every stage adds workers and buffers to an executor,
#: which keep the size of the largest batches they have seen.
BATCH_ROWS = 250


def small_batches(stage):
    """The stage with the session's batches of texts kept small."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


@small_batches
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_documents(docs)


@small_batches
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs)


@small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = secrets.scan(docs, secrets.train_on(docs), docs.columns)
    changed = F.size("llm_findings") > 0
    new = {"text": F.col("llm_redacted"), "n_chars": F.when(changed, F.length("llm_redacted")).otherwise(F.col("n_chars")).cast("long")}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: SQL has neither the classifier's hashes nor a forest nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, f"stage-{k + 1}")
    return docs
