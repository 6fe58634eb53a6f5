"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from ferrule.llm import queries_copies, queries_corpus, queries_sources

MODULES = [queries_corpus, queries_copies, queries_sources]


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
