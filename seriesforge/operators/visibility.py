"""Hide series whose lower-cased name contains a hidden pattern.

A list of patterns that the caller writes out becomes one boolean expression
that stays inside whole-stage codegen - no join at all. A table of patterns is
joined on n-grams (see ``search.substring_semi_join``), whatever its size:
nothing is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hidden_expr(name: Column, patterns: Sequence[str]) -> Column:
    low = F.lower(name)
    cond = F.lit(False)
    for p in patterns:
        cond = cond | low.contains(F.lit(p.lower()))
    return cond


def with_hidden(df: DataFrame, patterns: Sequence[str] | DataFrame | None, name_col: str, out: str = "_hidden") -> DataFrame:
    """Add a boolean column: whether the row's name is hidden (a null name isn't)."""
    if isinstance(patterns, DataFrame):
        from seriesforge.operators.search import substring_semi_join
        lowered = patterns.select(F.lower(F.col(patterns.columns[0])).alias("pattern"))
        hits = substring_semi_join(df.select(name_col).distinct(), name_col, lowered, "pattern").withColumn(out, F.lit(True))
        return df.join(hits, name_col, "left").withColumn(out, F.coalesce(out, F.lit(False))).select(*df.columns, out)
    return df.withColumn(out, F.coalesce(hidden_expr(F.col(name_col), patterns or []), F.lit(False)))


def hide_series(df: DataFrame, patterns: Sequence[str] | DataFrame | None, name_col: str = "name",
                admin: Column | None = None) -> DataFrame:
    """Drop rows whose name is hidden; rows where ``admin`` is true are kept."""
    keep = ~F.col("_hidden") if admin is None else (admin | ~F.col("_hidden"))
    return with_hidden(df, patterns, name_col).where(keep).drop("_hidden")


def guard_visible(requests: DataFrame, patterns: Sequence[str] | DataFrame | None, name_col: str = "name",
                  role_col: str = "role") -> DataFrame:
    """non-admin requests for a hidden name get status ``not_found``."""
    status = F.when((F.col(role_col) != "admin") & F.col("_hidden"), F.lit("not_found")).otherwise(F.lit("ok"))
    return with_hidden(requests, patterns, name_col).withColumn("status", status).drop("_hidden")
