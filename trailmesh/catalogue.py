"""Every query of the engine with its SQL equivalent, where there is one."""

from __future__ import annotations

from .plans import q_chunks, q_etl, q_exports, q_graph, q_outlines, q_places, q_store, q_trace
from .plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "q_chunks", "q_etl", "q_exports", "q_graph", "q_outlines", "q_places", "q_store", "q_trace"]
