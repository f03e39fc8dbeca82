"""All registered queries and their comparison SQL, collected from the query modules."""

from __future__ import annotations

from voxgrain.plans import (
    cleaning_queries,
    collection_queries,
    label_queries,
    model_queries,
    privacy_queries,
    profiling_queries,
    report_queries,
    source_queries,
)

MODULES = (
    cleaning_queries,
    collection_queries,
    label_queries,
    model_queries,
    privacy_queries,
    profiling_queries,
    report_queries,
    source_queries,
)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        clash = found.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        found.update(module.QUERIES)
    return found


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
