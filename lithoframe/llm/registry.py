"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import bytebpe, chat, langid, neardup, packing, quality, secrets, substrings, topk, urlfilter

MODULES = (langid, chat, topk, packing, neardup, quality, secrets, urlfilter, substrings, bytebpe)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
