"""WARC archives of page captures, and their assembly into one nested row per capture.

Each page becomes a response (or a revisit of an equal payload), a request and a metadata
record; the other two name the first as concurrent to them. Spark's text writer puts a
record per line with the record terminator as line separator, so its files are archives
(gzip-compressed).
Files are read whole (their size is bounded by ``FILE_BYTES`` or one record), parsed by
length, and the records are joined through their concurrent-to identifiers. Payloads are
hashed where they are read and shuffled only if asked for.

Defined results: a null payload is empty, a null URL leaves its header out. Pages without
an id are captures of their own; they may revisit a page with an id, and are responses where
no equal payload has one. Rows repeated in id, URL and payload are written once with their
number and give as many rows. A very long payload has a file of its own. An empty table
gives an archive without records and no rows. Other columns are not read. A record that
cannot be parsed gives a row of type ``broken`` and reading goes on at the next one.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import scratch_folder
from .tables import save, small

#: Payloads below this are never revisits.
REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
END = "\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"
RECORD = ("record_id STRING, type STRING, concurrent_to STRING, refers_to STRING, uri STRING, date STRING, "
          "digest STRING, payload_bytes LONG, payload_digest STRING, fields MAP<STRING, STRING>, payload BINARY")
_NEXT = re.compile(rb"\r\n\r\n(?=WARC/1\.)")


def _urn(archive: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(archive), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def _record(kind: Column | str, id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]  # null: left out
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write the records of all pages below ``path``; returns the saved plan of captures."""
    archive = path.rsplit("/", 1)[-1]
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("_payload"))
    rows = rows.withColumn("digest", F.sha2("_payload", 256))
    prints = save(rows.select("page_id", F.xxhash64("url").alias("where"), "digest", F.octet_length("_payload").alias("n")), "captures")
    counted = prints.groupBy("page_id", "where", "digest").agg(F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"))
    first = counted.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
    lead = F.min("where").over(Window.partitionBy("page_id", "digest"))
    counted = counted.withColumn("other", ~F.col("where").eqNullSafe(lead))  # one more URL of an id and payload
    plan = save(counted.join(first.where("pages > 1 AND first IS NOT NULL").drop("pages"), "digest", "left"), "plan")
    special = plan.where("copies > 1 OR other OR (first IS NOT NULL AND NOT first <=> page_id)").withColumnRenamed("digest", "_digest")
    special = save(special.select(F.col("page_id").alias("_id"), F.col("where").alias("_where"), "_digest", "first", "copies", "other"), "special")
    same = rows.page_id.eqNullSafe(F.col("_id")) & (F.xxhash64(rows.url) == F.col("_where")) & (rows.digest == F.col("_digest"))
    rows = rows.join(small(special, 500_000), same, "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    if special.where("copies > 1").count():
        once, more = rows.where("copies = 1"), rows.where("copies > 1")
        rows = once.unionByName(more.dropDuplicates(["page_id", "url", "digest"]))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    capture = _urn(archive, F.lit("capture"), F.col("page_id"), F.when(F.col("page_id").isNull() | F.col("other"), F.xxhash64("url")), F.col("digest"))
    uri = F.regexp_replace("url", r"[\r\n]", " ")
    length = F.octet_length("_payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit(END))
    head = _record(
        F.when(revisit, "revisit").otherwise("response"), F.col("capture"),
        [("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http; msgtype=response")),
         ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
         ("WARC-Refers-To", F.when(revisit, _urn(archive, F.lit("capture"), F.col("first"), F.lit(None), F.col("digest"))))],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_payload"))))
    request = _record(
        "request", _urn(archive, F.lit("request"), F.col("capture")),
        [("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)))
    fields = F.concat(F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.col("page_id").cast("string")), F.concat(F.lit("copies: "), F.col("copies").cast("string"))), F.lit("\r\n"))
    metadata = _record(
        "metadata", _urn(archive, F.lit("metadata"), F.col("capture")),
        [("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/warc-fields"))], fields)
    longest = prints.agg(F.max("n")).first()[0] or 0
    records = rows.withColumn("capture", capture).select(F.explode(F.array(head, request, metadata)).alias("value"))
    per_file = max(3, min(30_000, FILE_BYTES // (longest + 2048)))
    records.write.option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)
    return plan


def parse(content: bytes, with_payload: bool = False):
    """Records of one archive file, as dicts; gzip members are unpacked."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at, size = 0, len(content)
    while at < size:
        while content[at : at + 2] == b"\r\n":
            at += 2
        if at >= size:
            break
        end = content.find(b"\r\n\r\n", at)
        lines = content[at : end if end >= 0 else size].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (ln.partition(":") for ln in lines[1:])}
        length = headers.get("content-length", "")
        if not lines[0].startswith("WARC/") or end < 0 or not length.isdigit() or end + 4 + int(length) > size:
            yield {"type": "broken"}
            found = _NEXT.search(content, at)
            at = found.end() if found else size
            continue
        block = memoryview(content)[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)
        kind, out = headers.get("warc-type"), {}
        if kind == "response":
            cut = content.find(b"\r\n\r\n", end + 4, at)
            payload = content[cut + 4 : at] if cut >= 0 else bytes(block)
            out = {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
            if with_payload:
                out["payload"] = payload
        elif kind == "metadata":
            pairs = (ln.partition(":") for ln in bytes(block).decode("utf-8", "replace").split("\r\n") if ":" in ln)
            out = {"fields": {k.strip(): v.strip() for k, _, v in pairs}}
        yield out | {
            "record_id": headers.get("warc-record-id"), "type": kind, "concurrent_to": headers.get("warc-concurrent-to"),
            "refers_to": headers.get("warc-refers-to"), "uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "digest": (headers.get("warc-payload-digest") or "").removeprefix("sha256:") or None,
        }


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``."""
    names = [f.split()[0] for f in RECORD.replace("MAP<STRING, STRING>", "MAP").split(", ")]
    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse(content.as_py(), with_payload))
                cells = [[list(v.items()) if isinstance(v := r.get(n), dict) else v for r in rows] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture, response, request, metadata, revisits``.

    ``records`` should be a saved table. ``revisits`` is the response that a revisit refers to.
    """
    parts = ["record_id", "uri", "date", "digest", "payload_bytes", "payload_digest", "payload", "type", "refers_to"]
    heads = records.where("type IN ('response', 'revisit')").select(F.col("record_id").alias("capture"), F.struct(*parts).alias("response"))
    request = records.where("type = 'request' AND concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("capture")).agg(
        F.first(F.struct("record_id", "uri", "date")).alias("request"))
    metadata = records.where("type = 'metadata' AND concurrent_to IS NOT NULL").groupBy(F.col("concurrent_to").alias("capture")).agg(
        F.collect_list(F.struct("record_id", "fields")).alias("metadata"))
    rows = heads.join(request, "capture", "left").join(metadata, "capture", "left")
    kept = records.where("type = 'response'").select(
        F.col("record_id").alias("_to"), F.struct("record_id", "uri", "payload_bytes", "payload_digest").alias("revisits"))
    page = records.where("type = 'metadata'").select(F.col("concurrent_to").alias("_to"), F.col("fields")["page-id"].cast("long").alias("page_id"))
    seen = records.where("type = 'revisit'").select(F.col("refers_to").alias("_to")).distinct()
    kept = kept.join(seen, "_to", "left_semi").join(page, "_to", "left").select("_to", F.col("revisits").withField("page_id", F.col("page_id")).alias("revisits"))
    return rows.join(kept, F.col("response.refers_to") == F.col("_to"), "left").drop("_to")


def round_trip(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives of the pages to the scratch folder, read them back and assemble them."""
    spark = pages.sparkSession
    path = scratch_folder(spark, "warc")
    write_archives(pages, path, id, url, payload)
    captures = assemble(save(read_records(spark, path), "records"))
    copies = F.coalesce(F.col("metadata")[0]["fields"]["copies"].cast("int"), F.lit(1))
    rows = captures.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    return rows.select(
        F.col("metadata")[0]["fields"]["page-id"].cast("long").alias("page_id"),
        F.coalesce("response.payload_bytes", "revisits.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "revisits.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("revisits.page_id").alias("refers_to"), "request", "metadata",
    )
