"""All queries of the engine and their oracles."""

from . import queries_core, queries_extra, queries_policy, queries_store
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "queries_core", "queries_extra", "queries_policy", "queries_store"]
