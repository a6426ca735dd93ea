"""Named queries over a folder of tables, and the SQL that each is held against."""

from __future__ import annotations

from . import changelog, connectors, metrics, permissions, reports, retrieval

_MODULES = [retrieval, changelog, permissions, reports, connectors, metrics]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
