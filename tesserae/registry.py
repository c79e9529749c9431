"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

from tesserae.plans import curated, curation, derivation, lookups, primitives, searching, upkeep

QUERIES: dict = {}
SQL: dict[str, str] = {}

for _module in (derivation, searching, curation, curated, upkeep, lookups, primitives):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
