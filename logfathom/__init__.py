"""Security-log analytics as Spark jobs: normalise, enrich, store, query, export."""

from logfathom.session import builder, prepare

__all__ = ["builder", "prepare"]
