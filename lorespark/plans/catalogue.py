"""All queries of the library and their SQL."""

from __future__ import annotations

from lorespark.plans import corpus, events, graphs, retrieval, upkeep  # noqa: F401  they register their queries
from lorespark.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
