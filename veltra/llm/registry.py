"""The queries of this subpackage and the SQL that checks them, gathered from the operator modules."""

from __future__ import annotations

from . import (
    centroid_clusters,
    decontaminate,
    exact_dedup,
    html_extract,
    langid,
    line_dedup,
    nearest_neighbours,
    packing,
    ranked_search,
    simhash_dedup,
    token_counts,
    token_store,
    toxicity,
)

_MODULES = (
    line_dedup,
    html_extract,
    simhash_dedup,
    packing,
    decontaminate,
    token_store,
    langid,
    toxicity,
    token_counts,
    exact_dedup,
    ranked_search,
    centroid_clusters,
    nearest_neighbours,
)

QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
