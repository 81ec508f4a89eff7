"""Registered queries of this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import embedding_join, exact_dedup, hard_negatives, ngram_join, packing, passages, quality, secrets, sentencepiece_fst, sharding, spelling, suffix_dedup, warc

def piece_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    """No SQL: SQL has no such hashes."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query("op2_sharding")
def op2_sharding(spark, sf_dir):
    """No SQL: DuckDB has no CRC-32."""
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"))
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op3_ngram_join")
def op3_ngram_join(spark, sf_dir):
    """No SQL: its join of all shingles is too slow on whole tables."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents")).drop("text_key")


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    """No SQL: SQL has no tokenizer. Texts are encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    ids = sentencepiece_fst.encode(docs, piece_tokenizer()).drop("text")
    rows = sentencepiece_fst.decode(ids, piece_tokenizer())
    sha = F.sha2("decoded", 256)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"),
        F.octet_length("decoded").cast("long").alias("decoded_bytes"), sha.alias("decoded_sha256"),
        sha.eqNullSafe(F.col("text_sha256")).alias("same_text"),
    )


@query(
    "op5_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op5_exact_dedup(spark, sf_dir):
    rows = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op6_packing")
def op6_packing(spark, sf_dir):
    """No SQL: SQL has no tokenizer."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_tokenizer())


@query("op10_secret_scan")
def op10_secret_scan(spark, sf_dir):
    """No SQL: SQL has no forest."""
    docs = table(spark, sf_dir, "documents")
    rows = secrets.scan(docs, secrets.train_on(docs), ["doc_id"])
    return rows.select(
        "doc_id", F.col("llm_candidates").alias("n_candidates"), F.size("llm_findings").cast("long").alias("n_secrets"),
        F.col("llm_findings").alias("findings"), F.sha2("llm_redacted", 256).alias("redacted_sha256"),
    )


@query("op7_embedding_join")
def op7_embedding_join(spark, sf_dir):
    """No SQL: components need a search of any length."""
    return embedding_join.embedding_join(table(spark, sf_dir, "embeddings"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    """No SQL: all 50-byte strings of whole tables are too many for it."""
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("text_key")


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, n AS payload_bytes, h AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM f
    """,
)
def op9_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("request", "metadata")


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) FOR c IN embedding] AS x
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
          AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0
    ),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
               CAST(list_sum([a.x[k] * b.x[k] FOR k IN range(1, len(a.x) + 1)]) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
    ),
    p AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id,
           positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
    QUALIFY row_number() OVER w <= 5
    """,
)
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("id") % 100 == 0)


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    """No SQL: DuckDB has no CRC-32."""
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    h = F.crc32(F.concat_ws(":", "doc_id", "run"))
    at = F.pmod(h, F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return spelling.variants(spelling.vocabulary(runs, F.when(h % 199 == 0, less).otherwise(F.col("run"))))


@query("op11_passage_dedup")
def op11_passage_dedup(spark, sf_dir):
    """No SQL: all 20-word windows of whole tables are too many for it."""
    return passages.passage_dedup(table(spark, sf_dir, "documents")).drop("text_key")
