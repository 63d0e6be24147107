"""Long <-> wide and the documented output shapes.

Wide output is one row per date and one column per requested series; the
request list is a short driver-side argument, so pivot values are given
explicitly (no extra distinct job) and the plan is a single hash aggregate
on ``date``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.operators import series as SR
from seriesforge.plans.broadcast import broadcast_if_small


class EmptyResultError(ValueError):
    pass


class RepeatedDateError(ValueError):
    pass


def wide_slice(spark, cat: DataFrame, obs: DataFrame, names: Sequence[str], freq: str | None = "m",
               start: str | None = None, end: str | None = None) -> DataFrame:
    """Long slice (name, date, value) of the requested series (F1 + F2)."""
    req = spark.createDataFrame([(i, n, freq, start, end) for i, n in enumerate(names)],
                                "request_id int, name string, freq string, start_date string, end_date string")
    resolved = SR.resolve_series(broadcast_if_small(req, len(names)), cat)
    return SR.series_slice(resolved, obs).select("name", "date", "value")


def repeated_dates(long: DataFrame) -> DataFrame:
    """S-9: (name, date) pairs that occur more than once."""
    return long.groupBy("name", "date").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pivot_wide(long: DataFrame, names: Sequence[str], check_repeats: bool = True) -> DataFrame:
    """One row per date (outer union of all dates), one column per
    requested name that has data, in request order; sorted by Date. One pass
    over the input (checkpointed) decides which names have data and whether a
    date repeats."""
    from seriesforge.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(long.sparkSession)
    long = long.where(F.col("name").isin(list(names))).checkpoint(eager=True)
    per_name = (long.groupBy("name", "date").agg(F.count(F.lit(1)).alias("n"))
                .groupBy("name").agg(F.max("n").alias("n")).collect())  # a row for each requested name
    if check_repeats and any(r["n"] > 1 for r in per_name):
        raise RepeatedDateError("a series repeats a date; the wide frame would be ambiguous")
    present = {r["name"] for r in per_name}
    cols = [n for n in dict.fromkeys(names) if n in present]
    if not cols:
        return long.sparkSession.createDataFrame([], "Date date")
    wide = long.groupBy(F.col("date").alias("Date")).pivot("name", cols).agg(F.first("value"))
    return wide.select("Date", *[F.col(f"`{c.replace('`', '``')}`") for c in cols]).orderBy("Date")


def require_data(wide: DataFrame) -> DataFrame:
    """The wide frame with Date as a column; an empty one is an error."""
    if wide.isEmpty():
        raise EmptyResultError("no data found for the requested columns")
    return wide


def to_records(wide: DataFrame) -> DataFrame:
    """One JSON object per date: {"Date": …, "<name>": value, …}."""
    return wide.select("Date", F.to_json(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in wide.columns]))
                       .alias("record"))


def to_columns(long: DataFrame, keys: Sequence[str] = ("name", "frequency")) -> DataFrame:
    """Per series (``keys``: request, name, frequency as the caller has
    them) two parallel arrays (dates, values) in date order. One row per
    series: use for bounded series, as the API answer does."""
    s = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("_p"))
    return s.select(*[F.col(k).alias("series_name" if k == "name" else k) for k in keys],
                    F.transform("_p", lambda p: p["date"]).alias("dates"),
                    F.transform("_p", lambda p: p["value"]).alias("values"))


def write_csv(wide: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, Date first; names with commas are quoted."""
    wide.write.mode(mode).option("header", True).csv(path)
