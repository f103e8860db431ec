"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import core, extractors, maintenance  # noqa: F401  registers its queries on import


def queries() -> dict:
    return dict(core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(core.SQL)
