"""Broadcast only behind a size check; otherwise let the planner shuffle.

Two kinds of checks are used:

* driver-side inputs (literal dimensions, file lists, pattern lists) carry
  their length, so the check is a comparison against ``MAX_BROADCAST_ROWS``;
* derived DataFrames use the optimizer's size estimate when it is exact
  (local relations) and otherwise leave the choice to AQE, which converts a
  sort-merge join into a broadcast join only after measuring the shuffle
  output against ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, known_rows: int | None) -> DataFrame:
    """Hint a broadcast when the row count is known and below the bound."""
    if known_rows is not None and known_rows <= MAX_BROADCAST_ROWS:
        return F.broadcast(df)
    return df
