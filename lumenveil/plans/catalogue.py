"""All registered queries over the fixture views."""

from __future__ import annotations

from lumenveil.plans import details, display, operations, queries as _queries, registry, vision  # noqa: F401  they fill the register


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
