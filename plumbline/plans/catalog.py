"""Registry of the audit, search and retrieval queries with their SQL equivalents."""

from __future__ import annotations

from . import pages, planted, replays, retrieval, search, stores

_PARTS = (pages, planted, search, retrieval, stores, replays)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
FLAGSHIP = "audit_ranked_findings"
