"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from . import audits, contexts, extractions, graphs, memories, queues, relational, searches, streams, texts  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
