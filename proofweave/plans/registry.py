"""All queries of the core library, by name."""

from __future__ import annotations

from types import SimpleNamespace

from proofweave.plans import core_oracle, core_queries, references_queries

_MODULES = (SimpleNamespace(QUERIES=core_queries.QUERIES, ORACLE=core_oracle.ORACLE), references_queries)


def queries() -> dict:
    out: dict = {}
    for module in _MODULES:
        out.update(module.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out.update(module.ORACLE)
    return out
