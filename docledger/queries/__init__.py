"""Registered queries, each beside the DuckDB SQL that checks it."""

from . import batches, catalog, documents, intake, lines, locations, rollups, scalars, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
