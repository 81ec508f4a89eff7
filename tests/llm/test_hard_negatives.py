"""Hard negatives against brute force, and the bounds of segment summaries."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docledger.llm import hard_negatives as hn


def rows_of_case(seed: int):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 10))
    rows = [(i, [float(x) for x in np.float32(centres[i % 4] + rng.normal(size=10) * 0.3)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(20, [0.5] * 10, 1), (300, [0.5] * 10, 1), (301, [0.5] * 10, 2), (302, [0.5] * 10, 2), (301, [0.5] * 10, 2)]  # ties, a repeated row
    rows += [(400, None, 1), (401, [float("nan")] * 10, 1), (402, [1.0, None], 1), (403, [], 1), (404, [0.5] * 10, None),
             (405, [1e30] * 10, 1), (406, [float("inf")] * 10, 2), (None, [0.5] * 10, 2), (460, [1.0, 2.0], 1), (461, [1.0, 1.0], 1), (462, [0.9, 1.9], 0)]
    return rows


def brute(rows, step=20):
    known = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or not v or any(x is None or not math.isfinite(x) or abs(256 * x) > hn.LARGEST for x in v):
            continue
        known.append((n, i, [math.floor(256 * x) for x in v], label))
    out = []
    last = lambda i: math.inf if i is None else i
    for n, i, v, label in known:
        if i is None or i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), last(j), m, other) for m, j, w, other in known if m != n and len(w) == len(v)]
        for p, pid, _, _ in sorted(s for s in scored if s[3] == label)[:5]:
            fits = sorted(s for s in scored if s[3] != label and -80 * p <= -100 * s[0] <= -100 * p)[:5]
            out += [(i, pid, k + 1, j, -p, -s) for k, (s, j, _, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(hn.ROWS, hn.QUERIES), (40, 3)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "ROWS", blocks[0])
    monkeypatch.setattr(hn, "QUERIES", blocks[1])
    monkeypatch.setattr(hn, "STRIPE", 2)
    rows = rows_of_case(1)
    clashing = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, row STRING, query STRING, summary STRING, _vector STRING"
    df = spark.createDataFrame([(*r, "r", "q", "s", "v") for r in rows], clashing).repartition(3)
    got = hn.hard_negatives(df, F.col("id") % 20 == 0).collect()
    assert sorted((r[0], math.inf if r[1] is None else r[1], r[2], math.inf if r[3] is None else r[3], r[4], r[5]) for r in got) == brute(rows)
    assert hn.hard_negatives(df.where("vec_id < 0"), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("size", [1, 3, 4, 17, 64])
def test_summaries_bound_the_scores(size):
    rng = np.random.default_rng(size)
    x = np.floor(rng.normal(size=(200, size)) * rng.choice([1, 300, 1e6], size=(200, 1)))
    stored = np.concatenate([part for cut in hn.CUTS for part in hn.summaries(x, cut)], axis=1)
    score = x @ x.T
    widths = []
    for mean, apart in hn._weighted(stored, size):
        middle, width = mean @ mean.T, apart @ apart.T
        assert (np.abs(score - middle) <= width).all()
        widths.append(width)
    assert (widths[1] <= widths[0] * (1 + 1e-6) + 1e-6 * np.abs(score).max()).all()  # a finer cut is tighter
