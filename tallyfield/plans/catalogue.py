"""All named queries over the test tables, each with the SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfield.plans import fit_queries, flow_queries, market_queries, numeric_queries, scale_queries, source_queries, stream_queries  # noqa: F401  they register their queries
from tallyfield.plans.registry import QUERIES, SQL

FLAGSHIP = "purchases_by_user"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
