"""All registered queries of the engine's own operators."""

from __future__ import annotations

from . import aggregates, coordination, events, extraction, filters, flows, integrity, ledger, ranking, scalars, scans, scheduling, sources, verdicts  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
