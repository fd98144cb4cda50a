"""The named queries of the core and the SQL that yields the same rows."""

from __future__ import annotations

from . import graph_queries, read_queries  # noqa: F401
from .registry import REGISTRY

QUERIES = REGISTRY.queries
ORACLES = REGISTRY.oracles
