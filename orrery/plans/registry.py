"""Names of all queries over the reference operators, with their SQL."""

from __future__ import annotations

from orrery.plans import asked, base, cameras, placing, relational, scores, spatial  # noqa: F401  they register their queries


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
