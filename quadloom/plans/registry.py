"""All registered queries of the tile engine and their oracles."""

from __future__ import annotations

from . import encoding_queries, oracles, queries

QUERIES = {**queries.QUERIES, **encoding_queries.QUERIES}
ORACLES = {**oracles.ORACLES, **encoding_queries.ORACLES}
