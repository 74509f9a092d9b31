"""All query modules outside the llm subpackage."""

from __future__ import annotations

from ledgerloom.plans import data_queries, evaluation_queries, graph_queries, holder_queries, ledger_queries, model_queries, record_queries, series_queries, stream_queries

MODULES = [data_queries, evaluation_queries, graph_queries, holder_queries, ledger_queries, model_queries, record_queries, series_queries, stream_queries]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
