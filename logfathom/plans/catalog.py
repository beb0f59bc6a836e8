"""All registered queries."""

from __future__ import annotations

from logfathom.plans import analytics, documents, extensions, lines, outputs, stores, streams, tails  # noqa: F401
from logfathom.plans.facts import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
