"""Spelling variants against brute force."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docledger.llm import queries as q, spelling

LETTERS = "abdeéÿ"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts: dict) -> dict:
    form, near = {}, {}
    for w in counts:
        near[w] = [x for x in counts if one_edit(w, x)]
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def words_like(rng, n: int) -> list[str]:
    """Words of few letters, many of them one edit apart, and some that repeat one letter."""
    out = {"a" * k for k in range(6, 12)} | {"ab" * k for k in range(3, 7)} | {"b" * 300, "b" * 299, "b" * 150 + "a" + "b" * 149}
    while len(out) < n:
        out.add("".join(rng.choice(list(LETTERS), rng.integers(6, 10))))
        for w in rng.choice(sorted(out), 3):
            k = int(rng.integers(0, len(w)))
            changed = [w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "d" + w[k + 1 :]][rng.integers(0, 3)]
            out |= {changed} if len(changed) >= 6 else set()
    return sorted(out)


def as_rows(df) -> dict:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("part, entries", [(spelling.PART, spelling.ENTRIES), (3, 40)])
def test_variants(spark, monkeypatch, part, entries):
    monkeypatch.setattr(spelling, "PART", part)
    monkeypatch.setattr(spelling, "ENTRIES", entries)
    rng = np.random.default_rng(8)
    counts = {w: int(5 ** rng.integers(1, 6)) for w in words_like(rng, 300)}
    df = spark.createDataFrame(list(counts.items()), "word STRING, n LONG").repartition(3)
    assert as_rows(spelling.variants(df)) == brute(counts)
    assert spelling.variants(df.where("n < 0")).count() == 0


def test_index_counts_every_pattern():
    rng = np.random.default_rng(2)
    words = words_like(rng, 60)
    held = spelling.Dictionary(words)
    ring = "#" + "#".join(words)
    for pattern in {ring[a : a + k] for a, k in zip(rng.integers(0, len(ring), 80).tolist(), rng.integers(1, 9, 80).tolist())}:
        code = [0 if c == "#" else int(np.searchsorted(held.letters, ord(c))) + 1 for c in pattern]
        wrapped = ring + ring[: len(pattern) - 1]
        want = sum(wrapped.startswith(pattern, k) for k in range(len(ring)))
        state = spelling._every(len(ring), 1)
        for c in reversed(code[: len(code) // 2 + 1]):  # the front half backwards, then the rest forwards
            state = spelling._grow(held.forward, state, np.array([c]))
        state = (state[0], state[2], state[1], state[3])
        for c in code[len(code) // 2 + 1 :]:
            state = spelling._grow(held.reverse, state, np.array([c]))
        assert state[3].tolist() == [want]
        first = held.forward.suffixes[state[2][0]]
        assert (ring + ring)[first : first + len(pattern)] == pattern


def test_query(spark, tmp_path):
    rng = np.random.default_rng(5)
    pool = words_like(rng, 120)
    rows = [(i, " ".join(w.upper() if rng.integers(0, 2) and w.isascii() else w for w in rng.choice(pool, 150))) for i in range(40)]
    rows += [(7, rows[7][1]), (None, rows[3][1]), (50, None), (51, ""), (52, "x" * 70_000 + " 12 " + "x" * 70_000), (53, "ÀÉabcd×÷ef " * 6)]
    schema = "doc_id LONG, text STRING, run STRING, word STRING, n LONG, part STRING"
    spark.createDataFrame([(*r, "r", "w", 1, "p") for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    counts: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert len(kept) > 100 and as_rows(q.QUERIES["op12_spelling_variants"](spark, str(tmp_path))) == brute(kept)
