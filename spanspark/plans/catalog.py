"""All registered queries and their DuckDB equivalents."""

from __future__ import annotations

from spanspark.plans import detection, files, relations, sequences, texts
from spanspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "detection", "files", "relations", "sequences", "texts"]
