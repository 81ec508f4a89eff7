"""Scans and crowded minimizers of the byte-string removal: less work, the same strings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import suffix_dedup
from docledger.llm.tables import text_key
from docledger.llm.words import span_hashes


def by_definition(data: np.ndarray, offsets: np.ndarray, length: int):
    """The strings of every document, window by window."""
    out = []
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        last, first = None, None
        for at in range(a, b - length + 1):
            grams = np.arange(at, at + length - suffix_dedup.GRAM + 1)
            least = int(span_hashes(data, grams, grams + suffix_dedup.GRAM).min())
            if least != last or at - first == suffix_dedup.WINDOWS:
                out.append([least, d, at, 0])
                last, first = least, at
            out[-1][3] = at + length
    return out


@pytest.mark.parametrize("letters", [1, 2, 20])
def test_strings_of_a_chunk(letters):
    sizes = [0, 700, 49, 50, 0, 1, 120, 51, 900, 30]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.random.default_rng(letters).integers(97, 97 + letters, offsets[-1]).astype(np.uint8)
    got = list(zip(*(x.tolist() for x in suffix_dedup.minimizers(data, offsets, 50))))
    assert got == [tuple(x) for x in by_definition(data, offsets, 50)]


def test_a_crowded_string_gives_runs_instead_of_windows(spark, monkeypatch):
    """A run of a string is one range, so the rows that are joined and gathered grow with strings."""
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    line = "x".join(str(k * k) for k in range(60))
    rows = [(k, f"{k * 7919 % 1000:04d}" + line + f"{k * 104729 % 9973:05d}" * 3) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id LONG, _text STRING").withColumn("text_key", text_key("_text"))
    found = suffix_dedup.removed_ranges(docs.select("doc_id", "text_key", "_text"), 50)
    ranges = {r["doc"]: sorted((x["lo"], x["hi"]) for x in r["ranges"]) for r in found.collect()}
    assert set(ranges) == set(range(1, 30))
    for k, spans in ranges.items():
        text = np.frombuffer(rows[k][1].encode(), np.uint8)
        assert len(spans) <= len(suffix_dedup.minimizers(text, np.array([0, len(text)]), 50)[0])
        covered = set().union(*(range(a, b) for a, b in spans))
        assert covered >= set(range(4, 4 + len(line)))


def test_crowds_are_a_share_of_all_strings(monkeypatch):
    assert [suffix_dedup._crowd(n) for n in (0, 500_000, 2_500_000, 10**9)] == [256, 256, 1250, 4096]
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert suffix_dedup._crowd(30) == 1
