"""Removal of repeated passages, and matching statistics, against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from docledger.llm import fuse, passages
from docledger.llm.fm_index import Matcher

SCHEMA = "doc_id LONG, text STRING, a LONG, b LONG, m LONG, home LONG, doc LONG, key STRING, _id LONG, _key LONG, _text STRING, n LONG"


def documents(seed: int, n: int = 60) -> list[tuple]:
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(30)] + ["é", "中文", "😀"]
    line = " ".join(f"common{k}" for k in range(22))
    passages_ = [" ".join(rng.choice(vocabulary, k)) for k in (20, 25, 60, 100)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40))), *rng.choice([*passages_, line, line, ""], rng.integers(0, 4)), " ".join(rng.choice(vocabulary, 5))]
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(parts)))
    near = rows[5][1].split()
    rows += [(200 + i, " ".join([*near[:i], "changed", *near[i + 1 :]])) for i in range(12)]  # near copies
    rows += [(300, rows[4][1]), (301, rows[4][1].replace(" ", "\n")), (302, rows[4][1]), (6, rows[2][1]), (6, rows[2][1]), (6, line)]
    rows += [(410 + k, f"own{k} " * k) for k in (20, 21, 25, 33)] + [(500 + k, " ".join(f"{k}p{j % k}" for j in range(30))) for k in (2, 3, 9, 11)]
    rows += [(400, "same " * 300), (401, "same " * 19), (402, "x y " * 50), (403, None), (404, ""), (405, " \n\t"), (406, "z" * 90_000)]
    return [*rows, (None, line + " tail"), (None, None)]


def brute(rows, length=20):
    first: dict = {}
    number = lambda i: -(1 << 63) if i is None else i
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - length + 1):
            window, place = tuple(w[k : k + length]), (number(i), k)
            first[window] = min(first.get(window, place), place)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < (number(i), k):
                gone[k : k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((number(i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def test_matching_statistics():
    rng = np.random.default_rng(3)
    ring = rng.integers(0, 4, 400)
    ring[0] = 0
    streams = [rng.integers(1, 5, k) for k in (0, 1, 30, 200, 7)] + [ring[50:90][ring[50:90] > 0]]
    streams = [np.where(s == 4, -1, s) for s in streams]
    depth = 6
    matcher = Matcher(ring, depth)
    length, lo, size = matcher.statistics(streams)
    text = ring.tolist() * 2
    windows = {k: [tuple(text[a : a + k]) for a in range(len(ring))] for k in range(depth + 1)}
    at = 0
    for s in streams:
        for k in range(len(s)):
            want = max(n for n in range(depth + 1) if n <= len(s) - k and tuple(s[k : k + n].tolist()) in windows[n])
            assert length[at + k] == want
            pattern = tuple(s[k : k + want].tolist())
            ranks = matcher.index.suffixes[lo[at + k] : lo[at + k] + size[at + k]]
            assert size[at + k] == sum(w == pattern for w in windows[want])
            assert all(tuple(text[p : p + want]) == pattern for p in ranks.tolist())
        at += len(s)


@pytest.mark.parametrize("crowded, heavy, limit, shard", [(256, 1000, 50_000_000, 2000), (3, 2, 50_000_000, 5), (256, 1000, 0, 2000)])
def test_passages(spark, monkeypatch, crowded, heavy, limit, shard):
    """As they are, with every rare way taken, and without any filter that is broadcast."""
    monkeypatch.setattr(passages, "CROWDED", crowded)
    monkeypatch.setattr(passages, "HEAVY", heavy)
    monkeypatch.setattr(passages, "SHARD", shard)
    monkeypatch.setattr(fuse.screen, "__defaults__", (limit,))
    rows = documents(1)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "k", 6, 7, "t", 8) for r in rows], SCHEMA).repartition(3)
    got = passages.passage_dedup(df, with_text=True).collect()
    want = brute(rows)
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == want
    assert sum(w[2] for w in want) > 1000
    assert passages.passage_dedup(df.where("doc_id < -1")).count() == 0


def test_windows_of_other_lengths(spark):
    rows = documents(2, 20)
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    for length in (1, 5, 33):
        got = passages.passage_dedup(df, length=length).collect()
        assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == [w[:4] for w in brute(rows, length)]
