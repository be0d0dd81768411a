"""Every query of the engine by its id, and the SQL that checks it."""

from __future__ import annotations

from tessera.plans import aggregates, graph, joins, leads, sources, streams, text, views, writes
from tessera.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "aggregates", "graph", "joins", "leads", "sources", "streams", "text", "views", "writes"]
