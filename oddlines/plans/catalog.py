"""All registered queries."""

from __future__ import annotations

from oddlines.plans import (  # noqa: F401  (importing registers the queries)
    check_queries,
    decision_queries,
    event_queries,
    line_queries,
    restart_queries,
    stream_queries,
    text_queries,
)
from oddlines.plans.registry import CHECKS, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def checks() -> dict[str, str]:
    return dict(CHECKS)
