"""Date rules: nanosecond panel dates (S-1) and text range bounds (S-4)."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS_PER_DAY = 86_400_000_000_000


def day_from_nanos(col: Column) -> Column:
    """bigint ns since epoch -> DATE, flooring (correct before 1970)."""
    days = (col - F.pmod(col, F.lit(NANOS_PER_DAY))) / F.lit(NANOS_PER_DAY)
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def iso_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def in_text_range(date_col: Column, start: Column, end: Column) -> Column:
    """Inclusive bounds compared as ISO text, empty/null bound = open.

    This is exactly the comparison of stored ``YYYY-MM-DD`` text with the raw
    bound text, so '2020' as start keeps 2020-01-01 and as end drops it.
    """
    txt = iso_text(date_col)
    lo = F.when(F.coalesce(start, F.lit("")) == "", F.lit(True)).otherwise(txt >= start)
    hi = F.when(F.coalesce(end, F.lit("")) == "", F.lit(True)).otherwise(txt <= end)
    return lo & hi


def with_bounds(requests):
    """Add ``_lo`` and ``_hi`` (first day in, first day out) for bounds that are a day, a month or a year: the date
    comparison equals that of ISO text then, and is done once a request instead of once a row. Other texts give null."""
    def day(c: str, after: int) -> Column:
        col = F.col(c)
        whole = F.date_add(F.expr(f"try_cast({c} AS date)"), after)
        return (F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}$"), whole)
                .when(col.rlike(r"^\d{4}-\d{2}$"), F.expr(f"try_cast(concat({c}, '-01') AS date)"))
                .when(col.rlike(r"^\d{4}$"), F.expr(f"try_cast(concat({c}, '-01-01') AS date)")))
    return requests.withColumn("_lo", day("start_date", 0)).withColumn("_hi", day("end_date", 1))


def in_bounds(date_col: Column) -> Column:
    """The rule of ``in_text_range`` on the columns of ``with_bounds``."""
    start, end = F.col("start_date"), F.col("end_date")
    lo = F.when(F.coalesce(start, F.lit("")) == "", F.lit(True)).when(F.col("_lo").isNotNull(), date_col >= F.col("_lo")).otherwise(iso_text(date_col) >= start)
    hi = F.when(F.coalesce(end, F.lit("")) == "", F.lit(True)).when(F.col("_hi").isNotNull(), date_col < F.col("_hi")).otherwise(iso_text(date_col) <= end)
    return lo & hi


_DAY = re.compile(r"^\d{4}(-\d{2}(-\d{2})?)?$")


def _first_day(text: str) -> date | None:
    """First day of a bound that is a day, a month or a year; None for other texts and days that don't exist."""
    if not _DAY.match(text):
        return None
    try:
        return date.fromisoformat((text + "-01-01")[:10])
    except ValueError:
        return None


def literal_range(date_col: Column, start: str | None, end: str | None) -> Column:
    """Same rule for driver-side scalar bounds, as date literals so the
    predicate reaches the parquet scan (PushedFilters / row-group skipping)."""
    cond = F.lit(True)
    if start:
        day = _first_day(start)
        cond = cond & (iso_text(date_col) >= F.lit(start) if day is None else date_col >= F.lit(day))
    if end:
        day = _first_day(end)
        if day is None:
            cond = cond & (iso_text(date_col) <= F.lit(end))
        else:
            cond = cond & (date_col <= F.lit(day) if len(end) == 10 else date_col < F.lit(day))
    return cond
