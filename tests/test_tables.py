"""Joins, intake, sources, sinks, roll-ups and streams."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docledger.operators import classify, intake, joins, locate, manifests, register, rollups
from docledger.plans.bindings import CANDIDATES
from docledger.session import scratch_folder
from docledger.sources import tables
from docledger.sources.specs import DocSpec, specs_from_json
from docledger.streaming import jobs


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_lookup_join_of_hot_and_null_keys(spark, how):
    fact = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k")
    )
    dim = spark.range(30).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("x"))
    fact = fact.withColumn("k", F.col("k").cast("int"))
    want = fact.join(dim, "k", how)
    assert [r.k for r in joins.hot_keys(fact, ["k"], 1 / 8, 10)] == [7]
    got = joins.lookup_join(fact, dim, "k", how, measure_dim=False, share=1 / 8, hot_rows=10, salts=4)
    assert sorted(got.collect(), key=str) == sorted(want.select(got.columns).collect(), key=str)
    small = joins.lookup_join(fact, dim, "k", how)
    assert small.count() == want.count()
    assert not joins.fits_broadcast(dim, max_rows=10) and joins.fits_broadcast(dim)
    assert not joins.fits_broadcast(dim, max_bytes=10)


def test_file_intake(spark, tmp_path):
    for name, body in {"a.pdf": b"one", "b.TIF": b"two", "c.txt": b"no", "d.png": b"one"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.filename: r for r in intake.uploads(tables.read_files(spark, str(tmp_path))).collect()}
    assert sorted(got) == ["a.pdf", "b.TIF", "d.png"]
    digest = hashlib.sha1(b"one").hexdigest()
    assert got["a.pdf"].upload_id == f"a.pdf:{digest[:10]}" and got["d.png"].sha1 == digest


def test_first_seen_and_index(spark):
    rows = spark.createDataFrame([("h1", 3, "c"), ("h1", 1, "a"), ("h2", 2, "b")], "sha1 STRING, n INT, f STRING")
    index = intake.first_seen(rows, ["n"], ["n", "f"])
    assert sorted(map(tuple, index.collect())) == [("h1", 1, "a"), ("h2", 2, "b")]
    more = spark.createDataFrame([("h1", 0, "z"), ("h3", 9, "q"), ("h3", 8, "p")], "sha1 STRING, n INT, f STRING")
    assert list(map(tuple, intake.extend_index(index, more, ["n"], ["n", "f"]).collect())) == [("h3", 8, "p")]


def test_latest_success_keeps_one_retry(spark):
    rows = [("a", 0, True, "r0"), ("a", 1, False, None), ("b", 0, False, None), ("b", 1, True, "r1"),
            ("c", 0, True, "x"), ("c", 1, True, "y"), ("c", 2, True, "never"), ("d", 0, False, None)]
    df = spark.createDataFrame(rows, "doc_id STRING, attempt INT, ok BOOLEAN, data STRING")
    got = {r.doc_id: (r.attempts, r.data) for r in intake.latest_success(df, ["data"]).collect()}
    assert got == {"a": (2, "r0"), "b": (2, "r1"), "c": (2, "y"), "d": (1, None)}


def test_keyword_classes(values):
    texts = ["the ING wh and", "eau", "xyz", None, "sch que"]
    got = values(lambda c: classify.keyword_class(c, CANDIDATES), texts)
    assert [(r.use_case_key, r.confidence) for r in got] == [
        ("order_note", 90), ("notice", 60), (None, 0), (None, 0), ("notice", 60),
    ]
    many = DocSpec("m", "Many", keywords=tuple("abcdefgh"))
    assert values(lambda c: classify.keyword_class(c, [many]), ["abcdefgh", "z"])[0].confidence == 90
    assert values(lambda c: classify.keyword_class(c, [many]), ["zzz"])[0].confidence == 60
    assert values(lambda c: classify.keyword_class(c, []), ["a"])[0].document_type == "Unknown"


def test_candidates(spark):
    df = spark.createDataFrame(
        [("a", "x", "production"), ("b", "x", "draft"), ("c", "y", "production"), ("d", "z", "draft")],
        "key STRING, department STRING, status STRING",
    )
    pick = lambda d: sorted(r.key for r in classify.candidates_for(df, d).collect())
    assert pick("x") == ["a"] and pick("z") == ["a", "c"] and pick("none") == ["a", "c"]


def test_candidates_of_every_department(spark):
    rows = [("a", "x", "production"), ("b", "x", "draft"), ("c", "y", "production"), ("d", "z", "draft"), ("e", None, "production")]
    df = spark.createDataFrame(rows, "key STRING, department STRING, status STRING")
    got = sorted(map(str, map(tuple, classify.candidates_by_department(df).collect())))
    want = [(d, k) for d, ks in (("x", "a"), ("y", "c"), ("z", "ace"), (None, "ace")) for k in ks]
    assert got == sorted(map(str, want))


def test_usage_log_skips_only_bad_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    good = {"processor": "p", "total_tokens": 7, "cost_inr": 0.1234, "is_retry": True}
    (path / "u.jsonl").write_text("\n".join([json.dumps(good), '{"processor": "cut', json.dumps(good), ""]))
    usage = tables.read_usage(spark, str(path))
    total = rollups.usage_totals(usage).first()
    assert (total.docs, total.tokens, float(total.cost_inr), total.retry_count) == (2, 14, 0.2468, 2)
    empty = rollups.usage_totals(usage.limit(0)).first()
    assert (empty.docs, empty.tokens, empty.avg_tokens) == (0, 0, 0)


def test_batches_and_rates(spark, tmp_path):
    for i, text in enumerate(['{"id": "2", "total": 3, "success": 1}', '{"id": "1", "total": 1, "success": 1}', "{"]):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "record.json").write_text(text)
    batches = tables.read_batches(spark, f"{tmp_path}/*/record.json")
    assert [r.id for r in batches.collect()] == ["2", "1"]
    assert rollups.success_rate(batches).first().success_rate == 50
    assert rollups.success_rate(batches.limit(0)).first().success_rate == 100
    docs = spark.createDataFrame(
        [("b", "x", "done", 0), ("b", "y", "error", 2), ("b", "x", "done", 1)],
        "batch_id STRING, label STRING, status STRING, n_issues INT",
    )
    record = rollups.batch_records(docs).first()
    assert (record.total, record.success, record.warnings, record.errors) == (3, 2, 2, 1)
    assert record.by_type == {"x": 2}  # only processed documents count


def test_sinks(spark, tmp_path):
    spec = DocSpec("memo", "Memo")
    df = spark.createDataFrame([(1, "é")], "doc_id INT, `Head er` STRING")
    target = tables.write_register(df, spec, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(target).first()["Head er"] == "é"
    docs = spark.createDataFrame([("memo", "{}"), ("bill", "[]")], "type_key STRING, value STRING")
    tables.write_document_json(docs, str(tmp_path / "json"))
    back = spark.read.text(str(tmp_path / "json"))
    assert sorted(map(tuple, back.collect())) == [("[]", "bill"), ("{}", "memo")]
    tables.append_json(df, str(tmp_path / "log"))
    tables.append_json(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_sums_keep_small_addends(spark):
    cases = {"a": [0.0000004] * 3, "b": [1e12, 0.25, 0.0000004], "c": [1e300, -1e300, 0.1, 0.2], "d": [1e-20, 2e-20], "e": [None]}
    rows = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k STRING, v DOUBLE")
    got = {r.k: r.s for r in rows.groupBy("k").agg(register.exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {"a": 0.0000012, "b": 1e12 + 0.25 + 0.0000004, "c": pytest.approx(0.3), "d": pytest.approx(3e-20), "e": 0.0}


def test_page_cap_is_for_scanned_files(spark):
    rows = [("digital", [f"page {k} has text" for k in range(20)]), ("scanned", [""] * 20)]
    df = spark.createDataFrame(rows, "layer STRING, pages ARRAY<STRING>")
    scanned = locate.text_layer(F.col("pages"))["layer"] == "scanned"
    kept = df.select("layer", F.size(locate.first_pages(F.col("pages"), scanned)).alias("n"))
    assert {r.layer: r.n for r in kept.collect()} == {"digital": 20, "scanned": 15}


def test_line_aggregates_of_a_hot_document(spark):
    lines = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("doc"), F.col("id").alias("n"),
        F.concat(F.lit("v"), (F.col("id") % 5).cast("string")).alias("v"), F.lit("0.1").alias("q"),
    )
    columns = [("first", "v", "first"), ("sum", "q", "sum"), ("join", "v", "join")]
    got = register.line_aggregates(lines, "doc", F.col("n"), columns).where("doc = 1").first()
    # Every third line is of document 1, and so is the line with that very number.
    assert got["first"] == "v0" and got["join"] == "v0, v1, v3, v4, v2"
    assert got["sum"] == pytest.approx(66.8, abs=1e-9)


def test_manifest_files(spark, tmp_path):
    texts = {
        "ok": {"key": "vendor_invoice", "keywords": ["GST"], "status": "odd"}, "nokey": {"document_type": "x"},
        "kind": {"key": "k", "sections": [{"fields": [{"path": "a", "kind": "odd"}]}]},
    }
    for name, body in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "manifest.json").write_text(json.dumps(body))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "manifest.json").write_text("{")
    raw = tables.read_manifest_texts(spark, f"{tmp_path}/*/manifest.json")
    rows = manifests.parse_manifests(raw).collect()
    assert [(r.key, r.document_type, r.status, r.keywords) for r in rows] == [
        ("vendor_invoice", "Vendor Invoice", "production", ["gst"])
    ]
    assert [s.key for s in specs_from_json([r.raw for r in raw.collect()])] == ["vendor_invoice"]


def test_first_seen_stream_over_batches(spark, tmp_path):
    """First batch wins over bases and batches; a batch reads the parts that it touches only."""
    source, folder = tmp_path / "in", scratch_folder(spark, "test")
    schema = "sha1 STRING, n INT"
    index = "sha1 STRING, n INT, part STRING"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        jobs.start_first_seen(stream, f"{folder}/out", f"{folder}/cp", ["n"], ["n"], every=2).awaitTermination()
        return sorted(map(tuple, jobs.current_index(spark, f"{folder}/out", index).collect()))

    assert step([("aa", 2), ("aa", 1), ("bb", 5)]) == [("aa", 1), ("bb", 5)]
    assert step([("aa", 0), ("cc", 7)]) == [("aa", 1), ("bb", 5), ("cc", 7)]
    assert jobs._bases(spark, f"{folder}/out") == [1]
    assert step([("bb", 0), ("dd", 3), ("aa1", 4)]) == [("aa", 1), ("aa1", 4), ("bb", 5), ("cc", 7), ("dd", 3)]
    for k in range(5):
        want = step([(f"e{k}", k), ("cc", 0)])
    assert len(want) == 10 and jobs._bases(spark, f"{folder}/out") == [1, 3, 5, 7]
    read = jobs.stored(spark, f"{folder}/out", index)
    assert {r.batch for r in read.select("batch").collect()} == set(range(8))  # rows keep their batch
    for batch_id in (3, 7):  # one base and at most one batch behind it, however many there are
        folders = {f.split("/out/")[1].split("/")[0] for f in jobs.stored(spark, f"{folder}/out", index, batch_id).inputFiles()}
        assert folders <= {f"base={batch_id - 2}", f"batch={batch_id - 1}"}
    plan = jobs.stored(spark, f"{folder}/out", index, 7).where(F.col("part").isin(["cc"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 1 and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert jobs.stored(spark, f"{folder}/out", index, 2).count() == 3  # a batch that is run again sees earlier ones only


def test_file_stream(spark, tmp_path):
    inbox, folder = tmp_path / "inbox", scratch_folder(spark, "files")
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"one")
    (inbox / "b.txt").write_bytes(b"two")
    jobs.start_intake(
        jobs.file_stream(spark, str(inbox)), f"{folder}/out", f"{folder}/cp"
    ).awaitTermination()
    assert [r.filename for r in spark.read.parquet(f"{folder}/out").collect()] == ["a.pdf"]
