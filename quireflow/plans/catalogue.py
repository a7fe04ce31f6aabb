"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from quireflow.plans import document_queries, grid_queries, layout_queries, model_queries, rule_queries, text_queries

_MODULES = (layout_queries, text_queries, document_queries, model_queries, rule_queries, grid_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
