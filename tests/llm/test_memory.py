"""Workers are used again by later stages, so they must not keep what they have freed."""

from __future__ import annotations

import pytest

pytest.importorskip("numpy")
from docledger.llm import tables  # noqa: E402


def test_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(tables, "give_back", lambda: given.append(1))
    run = tables.frugal(lambda batches: (b + 1 for b in batches))
    assert list(run([1, 2])) == [2, 3] and given == [1]

    def fails(batches):
        yield from batches
        raise ValueError

    with pytest.raises(ValueError):
        list(tables.frugal(fails)([1]))
    assert given == [1, 1]


def test_give_back_runs():
    tables.give_back()
