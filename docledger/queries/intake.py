"""Uploads, copies, the extraction cache and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..functions.costs import PREDICT_BASE_INPUT, PREDICT_INPUT_PER_PAGE, PREDICT_OUTPUT, cost
from ..operators import classify, intake, locate
from ..plans import bindings as b
from ..session import saved
from .registry import query
from .sqltext import FILES, STATUS, WS, band

_MIME = """CASE WHEN filename LIKE '%.pdf' THEN 'application/pdf' WHEN filename LIKE '%.png' THEN 'image/png'
    WHEN filename LIKE '%.TIF' THEN 'image/tiff' WHEN filename LIKE '%.jpeg' THEN 'image/jpeg' END"""


@query("src_uploads", f"""
WITH {FILES}
SELECT filename || ':' || substr(sha1, 1, 10) AS upload_id, doc_id, filename, sha1, {_MIME} AS mime_type
FROM files WHERE {_MIME} IS NOT NULL
""")
def src_uploads(spark, sf):
    return intake.uploads(b.files(spark, sf)).select(
        "upload_id", "doc_id", "filename", "sha1", "mime_type"
    )


@query("mime_filter", f"""
WITH {FILES}, m AS (SELECT lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) AS suffix, {_MIME} AS mime_type FROM files)
SELECT suffix, coalesce(mime_type, 'unsupported') AS mime_type, count(*) AS n FROM m GROUP BY ALL
""")
def mime_filter(spark, sf):
    f = F.col("filename")
    return (
        b.files(spark, sf)
        .select(text.suffix(f).alias("suffix"),
                F.coalesce(text.mime_type(f), F.lit("unsupported")).alias("mime_type"))
        .groupBy("suffix", "mime_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _hashed(spark, sf):
    """Every document by hash; the text is read once and goes no further."""
    return b.files(spark, sf).select(
        "doc_id", "filename", "lang", "source", F.sha1("content").alias("sha1")
    )


def _with_ids(rows):
    return rows.withColumn("upload_id", intake.upload_id(F.col("filename"), F.col("sha1")))


def _labelled(spark, sf):
    return b.table(spark, sf, "labels").select("doc_id", "quality", "toxic")


@query("dup_first_seen", f"""
WITH {FILES}, r AS (SELECT *, row_number() OVER (PARTITION BY sha1 ORDER BY doc_id) AS rn FROM files)
SELECT sha1, doc_id AS first_doc, filename AS first_file, source AS department, lang AS processor FROM r WHERE rn = 1
""")
def dup_first_seen(spark, sf):
    rows = _hashed(spark, sf).select(
        "sha1", F.col("doc_id").alias("first_doc"), F.col("filename").alias("first_file"),
        F.col("source").alias("department"), F.col("lang").alias("processor"),
    )
    return intake.first_seen(
        rows, ["first_doc"], ["first_doc", "first_file", "department", "processor"]
    )


def _index(spark, sf):
    known = _hashed(spark, sf).join(_labelled(spark, sf).select("doc_id"), "doc_id", "left_semi")
    rows = known.select(
        "sha1", F.col("doc_id").alias("first_doc"), F.col("filename").alias("first_file")
    )
    return intake.first_seen(rows, ["first_doc"], ["first_doc", "first_file"])


@query("dup_check", f"""
WITH {FILES}, i AS (SELECT sha1, min(doc_id) AS first_doc, arg_min(filename, doc_id) AS first_file
  FROM files WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY sha1)
SELECT f.doc_id, f.filename, i.first_doc, i.first_file FROM files f JOIN i ON f.sha1 = i.sha1
""")
def dup_check(spark, sf):
    found = intake.known_copies(_hashed(spark, sf), _index(spark, sf))
    return found.select("doc_id", "filename", "first_doc", "first_file")


@query("skip_loaded", f"""
WITH {FILES}, u AS (SELECT *, filename || ':' || substr(sha1, 1, 10) AS upload_id FROM files)
SELECT doc_id, upload_id FROM u WHERE upload_id NOT IN
  (SELECT upload_id FROM u WHERE doc_id IN (SELECT doc_id FROM labels))
""")
def skip_loaded(spark, sf):
    new = _with_ids(_hashed(spark, sf))
    loaded = new.join(_labelled(spark, sf).select("doc_id"), "doc_id", "left_semi")
    return intake.not_loaded(new, loaded).select("doc_id", "upload_id")


@query("collection_upsert", """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'done' ELSE 'error' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def collection_upsert(spark, sf):
    collection = b.table(spark, sf, "documents").select("doc_id", F.lit("pending").alias("status"))
    changes = _labelled(spark, sf).select(
        "doc_id", F.when(F.col("quality") == 1, "done").otherwise("error").alias("status")
    )
    return intake.upsert(collection, changes, "doc_id")


@query("cache_split", f"""
WITH {FILES}, k AS (SELECT doc_id, lang || '_v1_' || sha1 AS cache_key FROM files),
c AS (SELECT k.cache_key, arg_max(l.quality, l.doc_id) AS quality FROM labels l JOIN k ON l.doc_id = k.doc_id
  WHERE l.toxic = 0 GROUP BY k.cache_key)
SELECT k.doc_id, k.cache_key, c.cache_key IS NOT NULL AS hit, '{{"quality":' || c.quality || '}}' AS payload
FROM k LEFT JOIN c ON k.cache_key = c.cache_key
""")
def cache_split(spark, sf):
    key = intake.cache_key(F.col("lang"), F.lit("v1"), F.col("sha1"))
    docs = _hashed(spark, sf).select("doc_id", key.alias("cache_key"))
    payload = F.concat(
        F.lit('{"quality":'), F.col("quality").cast("string"),
        F.when(F.col("toxic") == 1, "").otherwise("}"),
    )
    cache = docs.join(_labelled(spark, sf), "doc_id").select(
        "cache_key", payload.alias("payload"), F.col("doc_id").alias("stored_at")
    )
    return intake.cache_split(docs, cache).select("doc_id", "cache_key", "hit", "payload")


@query("extract_plug", f"""
WITH {FILES}, k AS (SELECT doc_id, lang || '_v1_' || sha1 AS cache_key, length(text) AS n FROM files),
c AS (SELECT DISTINCT k.cache_key FROM labels l JOIN k ON l.doc_id = k.doc_id WHERE l.toxic = 0)
SELECT doc_id, '{{"chars": ' || n || '}}' AS raw_text, TRUE AS ok FROM k
WHERE cache_key NOT IN (SELECT cache_key FROM c)
""")
def extract_plug(spark, sf):
    """A user's extractor on the misses only; here it reports the length of the text.

    One document per content is extracted, its copies take the same answer.
    """
    docs, cache = _cached(spark, sf, lambda payload: F.lit("{}"), "toxic = 0")
    fresh = _extracted(spark, sf, docs, cache)
    out = intake.served(docs, cache, fresh).where("served <> 'cache'")
    return out.select("doc_id", F.col("payload").alias("raw_text"), F.lit(True).alias("ok"))


def _cached(spark, sf, payload, which):
    """Documents with their cache keys, and a cache that knows the labelled ones."""
    key = intake.cache_key(F.col("lang"), F.lit("v1"), F.col("sha1"))
    docs = saved(_hashed(spark, sf).select("doc_id", key.alias("cache_key")), "cache-keys")
    cache = docs.join(_labelled(spark, sf).where(which), "doc_id").select(
        "cache_key", payload(F.col("quality")).alias("payload"), F.col("doc_id").alias("stored_at")
    )
    return docs, cache


def _extracted(spark, sf, docs, cache):
    first = saved(intake.leaders(docs, cache), "leaders")
    texts = b.files(spark, sf).select("doc_id", F.col("content").alias("text"))

    def extractor(batches):
        for pdf in batches:
            chars = pdf["text"].str.len()
            yield pdf[["doc_id"]].assign(payload=['{"chars": %d}' % n for n in chars])

    told = intake.extract_misses(intake.pick(texts, first), extractor, "doc_id BIGINT, payload STRING")
    return told.join(first, "doc_id")


@query("cache_store", f"""
WITH {FILES}, k AS (SELECT doc_id, lang || '_v1_' || sha1 AS cache_key, length(text) AS n FROM files),
c AS (SELECT k.cache_key, arg_max(l.quality, l.doc_id) AS quality FROM labels l JOIN k ON l.doc_id = k.doc_id WHERE l.toxic = 0 GROUP BY k.cache_key),
f AS (SELECT cache_key, min(doc_id) AS leader FROM k WHERE cache_key NOT IN (SELECT cache_key FROM c) GROUP BY cache_key)
SELECT k.doc_id, CASE WHEN c.cache_key IS NOT NULL THEN 'cache' WHEN k.doc_id = leader THEN 'extracted' ELSE 'copied' END AS served,
  CASE WHEN c.cache_key IS NOT NULL THEN '{{"data":{{"quality":' || quality || '}},"ai_scores":{{}}}}' ELSE '{{"data":{{"chars": ' || n || '}},"ai_scores":{{"chars":99}}}}' END AS payload,
  TRUE AS hit_next_time
FROM k LEFT JOIN c ON k.cache_key = c.cache_key LEFT JOIN f ON k.cache_key = f.cache_key
""")
def cache_store(spark, sf):
    """Look up, extract one document per missing content, store, and look up again."""
    known = lambda q: intake.payload(F.concat(F.lit('{"quality":'), q.cast("string"), F.lit("}")), F.lit(None))
    docs, cache = _cached(spark, sf, known, "toxic = 0")
    told = _extracted(spark, sf, docs, cache)
    fresh = told.withColumns({
        "payload": intake.payload(F.col("payload"), F.lit('{"chars":99}')), "stored_at": F.lit(1 << 40),
    })
    first = intake.served(docs, cache, fresh)
    again = intake.cache_split(docs, intake.store(cache, fresh)).select("doc_id", F.col("hit").alias("hit_next_time"))
    return first.join(again, "doc_id").select("doc_id", "served", "payload", "hit_next_time")


@query("latest_success", """
WITH a AS (SELECT event_id // 2 AS doc_id, event_id % 2 AS attempt, event_type <> 'error' AS ok,
    'model-' || (user_id % 3) AS model, value AS score FROM events)
SELECT doc_id, count(*) AS attempts, max(attempt) FILTER (ok) AS attempt,
  arg_max(model, attempt) FILTER (ok) AS model, arg_max(score, attempt) FILTER (ok) AS score
FROM a GROUP BY doc_id
""")
def latest_success(spark, sf):
    e = F.col("event_id")
    attempts = b.table(spark, sf, "events").select(
        F.floor(e / 2).alias("doc_id"), (e % 2).alias("attempt"),
        (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.col("value").alias("score"),
    )
    return intake.latest_success(attempts, ["model", "score"])


@query("text_layer", f"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS page FROM documents)
SELECT doc_id, count(*) AS n_pages, CAST(sum(length(trim(page, {WS}))) AS BIGINT) AS chars,
  CASE WHEN sum(length(trim(page, {WS}))) >= 40 THEN 'digital' ELSE 'scanned' END AS layer
FROM p GROUP BY doc_id
""")
def text_layer(spark, sf):
    pages = b.pages_of(F.col("text"))
    return b.table(spark, sf, "documents").select(
        "doc_id", F.size(pages).cast("bigint").alias("n_pages"),
        locate.text_layer(pages).alias("t"),
    ).select("doc_id", "n_pages", F.col("t.chars").cast("bigint").alias("chars"), "t.layer")


@query("page_cap", """
WITH p AS (SELECT doc_id, string_split(text, chr(10))[1:15] AS pages FROM documents),
u AS (SELECT doc_id, unnest(pages) AS page, generate_subscripts(pages, 1) - 1 AS page_no FROM p)
SELECT doc_id, page_no, length(page) AS n_chars FROM u
""")
def page_cap(spark, sf):
    """Every document taken as scanned."""
    kept = locate.first_pages(b.pages_of(F.col("text")), F.lit(True))
    return b.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(kept).alias("page_no", "page")
    ).select("doc_id", "page_no", F.length("page").alias("n_chars"))


@query("model_pages", f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents),
l AS (SELECT doc_id, CASE WHEN list_sum(list_transform(pages, lambda x: length(trim(x, {WS})))) >= 40 THEN pages ELSE pages[1:15] END AS pages FROM p),
u AS (SELECT doc_id, unnest(pages) AS page, generate_subscripts(pages, 1) - 1 AS page_no FROM l)
SELECT doc_id, page_no, length(page) AS n_chars FROM u
""")
def model_pages(spark, sf):
    """Only documents without a text layer lose pages beyond the cap."""
    pages = b.pages_of(F.col("text"))
    kept = locate.first_pages(pages, locate.text_layer(pages)["layer"] == "scanned")
    return b.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(kept).alias("page_no", "page")
    ).select("doc_id", "page_no", F.length("page").alias("n_chars"))


@query("predict_cost", f"""
WITH {FILES}, p AS (SELECT CASE WHEN filename LIKE '%.pdf' THEN length(text) - length(replace(text, chr(10), '')) + 1
    ELSE 1 END AS pages FROM files WHERE filename NOT LIKE '%.txt'),
s AS (SELECT count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages FROM p),
t AS (SELECT *, 2000 + 1200 * greatest(pages, 1) AS i, 2000 * documents + 1200 * pages AS each FROM s)
SELECT documents, pages, i AS expected_input_tokens, 900 AS expected_output_tokens, i + 900 AS expected_tokens,
  CAST(printf('%.4f', i / 1000.0::DOUBLE * 0.03::DOUBLE + 900 / 1000.0::DOUBLE * 0.12::DOUBLE) AS DOUBLE) AS est_cost_inr,
  each + 900 * documents AS per_document_tokens
FROM t
""")
def predict_cost(spark, sf):
    """Batch prediction (base tokens once) and the sum of per-document predictions."""
    files = b.files(spark, sf)
    mime = text.mime_type(F.col("filename"))
    pages = F.when(mime == "application/pdf", F.size(b.pages_of(F.col("content")))).otherwise(1)
    per = files.where(mime.isNotNull()).select(F.greatest(pages, F.lit(1)).alias("pages"))
    each = F.lit(PREDICT_BASE_INPUT + PREDICT_OUTPUT) + F.col("pages") * PREDICT_INPUT_PER_PAGE
    t = per.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"),
        F.coalesce(F.sum(each), F.lit(0)).alias("per_document_tokens"),
    )
    inp = F.lit(PREDICT_BASE_INPUT) + F.greatest("pages", F.lit(1)) * PREDICT_INPUT_PER_PAGE
    return t.select(
        "documents", "pages", inp.alias("expected_input_tokens"),
        F.lit(PREDICT_OUTPUT).cast("bigint").alias("expected_output_tokens"),
        (inp + PREDICT_OUTPUT).alias("expected_tokens"),
        cost(inp, F.lit(PREDICT_OUTPUT)).cast("double").alias("est_cost_inr"),
        "per_document_tokens",
    )


def _hits(words) -> str:
    return " + ".join(f"contains(low, '{w}')::INT" for w in words)


_KEYWORD_CTE = "w AS (SELECT doc_id, lower(text) AS low FROM documents),\nh AS (SELECT doc_id, " + ", ".join(
    f"{_hits(s.keywords)} AS h{i}" for i, s in enumerate(b.CANDIDATES)
) + """ FROM w),
kw AS (SELECT doc_id, greatest(h0, h1, h2, h3) AS hits, CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN NULL
    WHEN h0 >= greatest(h1, h2, h3) THEN 'order_note' WHEN h1 >= greatest(h2, h3) THEN 'notice'
    WHEN h2 >= h3 THEN 'permit' ELSE 'receipt' END AS key FROM h),
kx AS (SELECT doc_id, key AS use_case_key, CASE key WHEN 'order_note' THEN 'Order Note' WHEN 'notice' THEN 'Notice'
    WHEN 'permit' THEN 'Permit' WHEN 'receipt' THEN 'Receipt' ELSE 'Unknown' END AS document_type,
  CASE WHEN key IS NULL THEN 0 ELSE least(90, 50 + 10 * hits) END AS confidence, 'keyword' AS method FROM kw)
"""


@query("classify_keywords", f"WITH {_KEYWORD_CTE} SELECT * FROM kx")
def classify_keywords(spark, sf):
    docs = b.table(spark, sf, "documents")
    return docs.select(
        "doc_id", classify.keyword_class(F.col("text"), b.CANDIDATES).alias("c")
    ).select("doc_id", "c.*")


@query("classify_ai_lookup", """
WITH a AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS use_case_key,
  CASE event_type WHEN 'view' THEN 'Viewed Page' WHEN 'click' THEN 'Clicked Page' WHEN 'purchase' THEN 'Purchase'
    WHEN 'signup' THEN 'Form' ELSE 'Unknown' END AS document_type,
  CASE event_type WHEN 'purchase' THEN 90 WHEN 'error' THEN 0 ELSE k END AS confidence,
  event_type IN ('view', 'click', 'purchase') AS matched FROM a
""")
def classify_ai_lookup(spark, sf):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    answer = (
        F.when(e == "error", '{"use_case_key": null, "confidence": 0}')
        .when(e == "purchase", '{"use_case_key": "purchase", "document_type": ""}')
        .when(e == "signup", F.format_string(
            '{"use_case_key": "signup", "document_type": "Form", "confidence": %s}', k))
        .otherwise(F.format_string('{"use_case_key": "%s", "confidence": %s.9}', e, k))
    )
    found = b.table(spark, sf, "events").select(
        "event_id", classify.answer_class(answer, b.EVENT_TYPES).alias("c")
    )
    return found.select(
        "event_id", "c.use_case_key", "c.document_type", "c.confidence", "c.matched"
    )


@query("classify_all", f"""
WITH {_KEYWORD_CTE}, a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'memo' WHEN quality = 1 THEN 'hit' END AS ans FROM labels)
SELECT kx.doc_id,
  CASE ans WHEN 'hit' THEN 'order_note' WHEN 'memo' THEN NULL ELSE use_case_key END AS use_case_key,
  CASE ans WHEN 'hit' THEN 'Order Note' WHEN 'memo' THEN 'Memo' ELSE document_type END AS document_type,
  CASE ans WHEN 'hit' THEN 88 WHEN 'memo' THEN 0 ELSE confidence END AS confidence,
  CASE WHEN ans IS NULL THEN 'keyword' ELSE 'ai' END AS method,
  CASE WHEN ans = 'hit' OR (ans IS NULL AND use_case_key IS NOT NULL) THEN 'pending' ELSE 'unsupported' END AS status,
  CASE WHEN ans = 'hit' OR (ans IS NULL AND use_case_key IS NOT NULL) THEN NULL ELSE 'Unsupported document type.' END AS error
FROM kx LEFT JOIN a ON kx.doc_id = a.doc_id
""")
def classify_all(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text")
    return classify.classify(docs, b.answers(spark, sf), b.CANDIDATES, F.col("text"))


@query("assign_manual", """
SELECT doc_id, 'order_note' AS use_case_key, 'Order Note' AS document_type, 100 AS confidence, 'manual' AS method
FROM documents
""")
def assign_manual(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id")
    return docs.select("doc_id", classify.manual_class(b.CANDIDATES[0]).alias("c")).select(
        "doc_id", "c.*"
    )


@query("processed_docs", """
SELECT d.doc_id, d.lang AS type_key FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality = 1 AND trim(d.lang) <> ''
""")
def processed_docs(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("type_key"))
    data = F.when(F.col("quality") == 1, F.lit("{}")).alias("data")
    joined = docs.join(_labelled(spark, sf), "doc_id", "left").select("doc_id", "type_key", data)
    return classify.processed(joined).select("doc_id", "type_key")


@query("doc_header", f"""
WITH {STATUS}
SELECT doc_id, key AS document_type, CASE status WHEN 'done' THEN 'AI' WHEN 'error' THEN 'Keywords' ELSE 'Manual' END AS routed,
  {band('coalesce(confidence, 0)')} AS band,
  CASE WHEN seconds < 60 THEN CAST(round_even(seconds, 0) AS BIGINT) || 's'
    ELSE (CAST(round_even(seconds, 0) AS BIGINT) // 60) || 'm ' || lpad((CAST(round_even(seconds, 0) AS BIGINT) % 60)::VARCHAR, 2, '0') || 's' END AS took
FROM docs
""")
def doc_header(spark, sf):
    method = F.when(F.col("status") == "done", "ai").when(F.col("status") == "error", "keyword").otherwise("manual")
    return b.doc_status(spark, sf).select(
        "doc_id", F.col("key").alias("document_type"),
        classify.method_label(method).alias("routed"),
        scores.band(F.coalesce("confidence", F.lit(0))).alias("band"),
        text.duration_text(F.col("seconds")).alias("took"),
    )
