"""All registered queries of the catalogue engine and their SQL oracles."""

from __future__ import annotations

from .operators import awards, derived, endpoints, funnel, ingest, media, names, preferences, retrieval, scoring, semantic, similar, spaces, studios, traits, twostage, vector
from .plans import flows, requests, search, similar_items
from .streaming import refresh, trending

MODULES = (retrieval, scoring, vector, flows, trending, preferences, endpoints, traits, similar, semantic, funnel, derived, ingest, search, requests, names, awards, studios, similar_items, twostage, refresh, spaces, media)


def queries() -> dict:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
