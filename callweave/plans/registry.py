"""Queries of the conversation operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from . import calls, ordered, runs, scoring, texts  # noqa: F401  they register their queries
from .base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
