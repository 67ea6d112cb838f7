"""Named queries over the shared tables, each with the SQL that must give the same rows."""

from tidepoint.catalog import bookkeeping, ingest, packages, reads, results, streams  # noqa: F401
from tidepoint.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
