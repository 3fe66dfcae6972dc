"""Names of the subpackage's queries, with their SQL oracles."""

from __future__ import annotations

from folioscale.llm.oracle import oracle
from folioscale.llm.queries import QUERIES, Query

__all__ = ["oracle", "queries"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)
