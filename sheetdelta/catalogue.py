"""All queries of the library by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import learned as _learned  # noqa: F401  (adds its queries and their SQL)
from .plans.oracles import ORACLES
from .plans.queries import QUERIES

FLAGSHIP = "change_report_counts"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
