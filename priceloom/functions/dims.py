"""Small tables that are sent to every task, behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension that is sent to every task.
DIMENSION_ROWS = 50_000


def dimension(table: DataFrame, limit: int = DIMENSION_ROWS) -> DataFrame:
    """The table, sent to every task while it has at most that many rows; Spark chooses the join beyond."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table
