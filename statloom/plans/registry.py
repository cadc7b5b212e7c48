"""All registered queries of the library, and their DuckDB counterparts."""

from __future__ import annotations

from . import analytics, surface
from .tables import sql


def _surface(text: str):
    return lambda spark, sf_dir: sql(spark, sf_dir, text)


def queries() -> dict:
    return {k: _surface(text) for k, (text, _) in surface.QUERIES.items()} | {k: f for k, (f, _) in analytics.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: other or text for k, (text, other) in surface.QUERIES.items()} | {k: o for k, (_, o) in analytics.QUERIES.items() if o}
