"""All registered queries."""

from __future__ import annotations

from evigrid.plans import (  # noqa: F401 - importing registers the queries
    audits,
    documents,
    evidence,
    ledgers,
    replicates,
    scores,
    statistics,
    tracks,
)
from evigrid.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
