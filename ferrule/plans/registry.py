"""All queries of the core package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from ferrule.plans import answers, lexical, logs, relations, trailing

MODULES = [trailing, lexical, relations, answers, logs]


def queries() -> dict[str, Callable]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
