"""Scalar functions against hand-computed rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docledger.functions import costs, dates, errors, jsondoc, numbers, scores, text
from docledger.operators import locate, repair


def test_dates(values):
    cases = {
        "2026-06-27": "2026-06-27", "2026-6-7": "2026-06-07", "27/06/2026": "2026-06-27",
        "27-06-2026": "2026-06-27", "27.06.2026": "2026-06-27", "7/6/26": "2026-06-07",
        "7/6/75": "1975-06-07", "1-1-69": "1969-01-01", "1-1-68": "2068-01-01",
        "27-JUN-2026": "2026-06-27", "27-Jun-26": "2026-06-27", "27 June 2026": "2026-06-27",
        "27  Jun 2026": "2026-06-27", " 27 may 2026\t": "2026-05-27", "2026/06/27": "2026-06-27",
        "2026-06- 7": "2026-06-07", "31/02/2026": None, "06/27/2026": None, "": None, "  ": None,
        "27.06.26": None, "27-June-2026": None, "27 Jun 26": None, "26-6-7-1": None,
        "20260627": None, "27/06-2026": None, "0/06/2026": None, "29-02-2024": "2024-02-29",
        "29-02-2023": None, "12026-06-27": None,
    }
    assert values(dates.iso_date, list(cases)) == list(cases.values())
    assert values(dates.iso_date, [None]) == [None]


def test_numbers(values):
    cases = {
        "₹1,234.50": 1234.5, "-5": -5.0, "1-2": None, "1.2.3": None, "1e5": 15.0, ".5": 0.5,
        "-": None, ".": None, "-.": None, "": None, "  ": None, "Rs 7": 7.0, "Rs. 7": 0.7, "5.": 5.0,
    }
    assert values(numbers.coerce_number, list(cases)) == list(cases.values())
    typed = [("true", "bool"), ("5", "number"), ("₹5", "string")]
    assert values(numbers.coerce_number, typed, "v STRING, t STRING") == [None, 5.0, 5.0]
    lenient = {"1,200": 1200.0, "5 %": 5.0, "₹5": None, "1d": None, "NaN": None, "1e3": 1000.0, " ": None}
    assert values(numbers.lenient_number, list(lenient)) == list(lenient.values())
    assert values(numbers.optional_int, ["2.5", "3.5", "", "x", None]) == [2, 4, None, None, None]


def test_rounding_matches_python(values):
    xs = [2.675, 0.125, 1.005, 2.5, 1234567.125, 0.00015, 99.995, -2.675]
    got = values(lambda c: numbers.round_places(c, 2), xs, "v DOUBLE")
    assert got == [round(x, 2) for x in xs]


def test_general_format(values):
    xs = [1234.5, 0.1, 100000.0, 1234567.0, 0.00001234, 77941.25, 123456.5, 1e21, -2.5, 0.0]
    assert values(numbers.general_format, xs, "v DOUBLE") == [f"{x:g}" for x in xs]


def test_trim_and_slugs(values):
    assert values(text.strip, [" x y ", "\t\n a \x1f", "　", None]) == ["x y", "a", "", None]
    names = {
        "a/b/My File (1).v2.pdf": "My_File_1_v2", "??.pdf": "purchase_order", ".hidden": "hidden",
        "naïve-é_1.png": "naïve-é_1", "plain": "plain",
    }
    assert values(text.file_slug, list(names)) == list(names.values())
    assert values(text.label_slug, ["Vendor v1.2 list"]) == ["Vendor_v1_2_list"]
    assert values(text.key_slug, [" My Type #2 ", None]) == ["my_type_2", ""]
    assert values(text.header_key, ["Inv. No.", None]) == ["invno", ""]
    kinds = values(text.mime_type, ["a.PDF", "b.tif", "c.TIFF", "d.txt", "e", "f.jpeg"])
    assert kinds == ["application/pdf", "image/tiff", "image/tiff", None, None, "image/jpeg"]


def test_display(values):
    pairs = [("1234.5", "INR"), ("x", "INR"), (None, ""), ("2.675", "")]
    assert values(numbers.format_currency, pairs, "v STRING, c STRING") == [
        "INR 1,234.50", "—", "—", "2.67",
    ]
    secs = [0.4, 12.5, 59.7, 60.0, 65.0, 3599.6, -3.0]
    assert values(text.duration_text, secs, "s DOUBLE") == [
        "0s", "12s", "60s", "1m 00s", "1m 05s", "60m 00s", "0s",
    ]


def test_heuristic_scores(values):
    cases = [
        (None, "null", 0), ("", "string", 0), ("  ", "string", 0), ("0", "number", 80),
        ("0.0", "number", 80), ("1234", "number", 97), ("1234", "string", 98), ("true", "bool", 99),
        ("27AAAAA1234A1Z5", "string", 99), ("27aaaaa1234a1z5", "string", 99), ("ABCDE1234F", "string", 99),
        ("2026-06-27", "string", 96), ("27/06/26", "string", 96), ("ab", "string", 78),
        ("some longer text", "string", 92), ("123456789", "string", 92),
    ]
    got = values(scores.heuristic_score, [c[:2] for c in cases], "v STRING, t STRING")
    assert got == [c[2] for c in cases]


def test_reported_scores_and_bands(values):
    got = values(scores.reported_score, ["-5", "94.5", "95.5", "120", "x", "inf", "nan", None])
    assert got == [0, 94, 96, 100, None, None, None, None]
    assert values(scores.band, [74, 75, 94, 95], "s INT") == ["verify", "review", "review", "high"]


def test_costs_and_usage(values):
    got = values(lambda i, o: costs.cost(i, o).cast("double"), [(1000, 1000), (5, 0), (123, 457)], "a BIGINT, b BIGINT")
    assert got == [round(i / 1000 * 0.03 + o / 1000 * 0.12, 4) for i, o in [(1000, 1000), (5, 0), (123, 457)]]
    bodies = [
        '{"usage": {"prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 0}}',
        '{"usage_metadata": {"prompt_token_count": 3, "candidates_token_count": 4, "total_token_count": 9}}',
        "{}",
    ]
    assert [tuple(r) for r in values(costs.response_usage, bodies)] == [(10, 5, 15), (3, 4, 9), (0, 0, 0)]
    assert costs.resolve_rate({"A": "x", "B": "0.5"}, ("A", "B"), 0.1) == 0.5
    assert costs.resolve_rate({}, ("A",), 0.1) == 0.1


def test_error_verdicts(values):
    cases = [
        (401, "try again", "fatal"), (503, "prompt blocked", "retryable"), (None, "Invalid API key", "fatal"),
        (None, "quota: model NOT FOUND", "fatal"), (None, "odd", "retryable"), (418, None, "retryable"),
    ]
    got = values(errors.error_verdict, [c[:2] for c in cases], "c INT, m STRING")
    assert got == [c[2] for c in cases]


def test_search_terms(values):
    cases = [
        ("12.0", "number", ["12"]), ("7", "number", []), ("1234567.0", "number", ["1234567", "1.23457e+06"]),
        ("1E20", "number", ["100000000000000000000", "1e+20"]),
        ("3.25", "number", ["3.25"]), (" a\nb ", "string", ["a\nb"]), ("first line\nsecond", "string", ["first line\nsecond", "first line"]),
        ("true", "bool", []), (None, "null", []), ("x", "string", []),
    ]
    got = values(locate.search_terms, [c[:2] for c in cases], "v STRING, t STRING")
    assert got == [c[2] for c in cases]


def test_responses(values):
    raws = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Sure: {"a": 3} done', '{"a": ', "", None, "[1]", "no } json {"]
    got = values(
        lambda c: F.struct(
            F.try_variant_get(jsondoc.parse_response(c).data, "$.a", "int").alias("a"),
            jsondoc.parse_response(c).error.alias("e"),
        ),
        raws,
    )
    assert [r.a for r in got[:3]] == [1, 2, 3] and [r.e for r in got[:3]] == [None] * 3
    assert [r.e for r in got[3:]] == [
        "no JSON object found", "empty output", "empty output", "not a JSON object", "no JSON object found",
    ]


def test_flatten_and_depth(values):
    doc = '{"a": {"b": [1, {"c": "x"}], "e": {}, "_confidence": {"q": 1}}, "n": null, "t": "{\\"["}'
    flat = values(lambda c: jsondoc.flatten(F.try_parse_json(c)), [doc])[0]
    assert {(r.path, r.v, r.t) for r in flat} == {
        ("a.b[0]", "1", "number"), ("a.b[1].c", "x", "string"), ("n", None, "null"), ("t", '{"[', "string"),
    }
    kept = values(lambda c: jsondoc.flatten(F.try_parse_json(c), c, keep_confidence=True), [doc])[0]
    assert "a._confidence.q" in {r.path for r in kept}
    escapes = json.dumps({"t": '\n"\\{' * 20_000})
    assert values(jsondoc.json_depth, [doc, "{}", '{"a":[[1]]}', escapes]) == [4, 1, 3, 1]


def flattened(data, prefix=""):
    """The same by recursion over Python values, which keep the order of names."""
    if isinstance(data, dict):
        parts = [flattened(v, f"{prefix}.{k}" if prefix else k) for k, v in data.items() if k != "_confidence"]
    elif isinstance(data, list):
        parts = [flattened(v, f"{prefix}[{i}]") for i, v in enumerate(data)]
    else:
        return {prefix: data}
    return {k: v for part in parts for k, v in part.items()}


def nest(depth, leaf="1"):
    return '{"a":' * depth + leaf + "}" * depth


def test_flatten_any_depth_and_names_with_dots(values):
    docs = [
        nest(3), nest(70), "[" * 40 + "7" + "]" * 40, "5", "{}", "[]", '{"": {"x": 1}, "x": 2}',
        '{"a.b": 1, "a": {"b": 2}}', '{"a": {"b": 2}, "a.b": 1}', '{"p": {"z.q": 1, "z": {"q": 2}}, "b": 0, "a": 1}',
        '{"a[0]": "x", "a": ["y"]}', '{"a": ["y"], "a[0]": "x"}', '{"it\'s.a": 1, "it\'s": {"a": 2}}',
        '{"k": 1, "k": 2}', '{"x": {"y.z": 1}, "x.y": {"z": 2}, "x.y.z": 3, "q": [[], {}, null]}',
    ]
    got = values(lambda c: jsondoc.flatten(F.try_parse_json(c), c), docs)
    for doc, flat in zip(docs, got):
        assert len({r.path for r in flat}) == len(flat)
        as_text = {k: None if v is None else str(v) for k, v in flattened(json.loads(doc)).items()}
        assert {r.path: r.v for r in flat} == as_text, doc
    assert values(lambda c: jsondoc.flatten(F.try_parse_json(c), c), [None, "{", nest(5000)]) == [None] * 3


def test_drawback_rate(values):
    rows = [
        (None, "200", "1,000", "0", "2"), ("1.5", "200", "1000", "0", None), (None, "0", "1000", "0", None),
        (None, "20", "0", "1000", None), (None, "2000", "1000", "0", None), (None, "20", None, None, None),
    ]

    def rate(r, a, f, s, x):
        return repair.derived_drawback_rate(r, a, repair.local_fob(f, s, x))

    got = values(rate, rows, "r STRING, a STRING, f STRING, s STRING, x STRING")
    assert got == [10.0, None, None, 2.0, None, None]
