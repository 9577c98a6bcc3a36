"""Registered queries with their oracle SQL."""

from inkstrata.plans import catalogs, derived, details, ingest, overlay, records, residual, search, segment, state, streams, universe
from inkstrata.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogs", "derived", "details", "ingest", "overlay", "records", "residual", "search", "segment", "state", "streams", "universe"]
