"""Clean long observations and summarise them per file and series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_missing(long: DataFrame) -> DataFrame:
    """Null and NaN observations are not stored."""
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def reject_bad_files(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A kept observation with a null date fails its whole file.

    Returns (good observations, rejected files). The per-file flag is a
    partial+final aggregate (one row per file), so the rejected list is tiny
    and the anti join against it is a broadcast hash join chosen by AQE.
    """
    kept = drop_missing(long)
    rejects = (kept.groupBy("source_file")
               .agg(F.bool_or(F.col("date").isNull()).alias("bad"))
               .where("bad").select("source_file"))
    good = kept.join(rejects, "source_file", "left_anti")
    return good, rejects


def series_metadata(obs: DataFrame) -> DataFrame:
    """Per file and series: first/last date and number of observations
    (repeated dates are counted)."""
    return (obs.groupBy("source_file", "country", "frequency", "name")
            .agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"),
                 F.count(F.lit(1)).alias("count")))


def file_series_count(meta: DataFrame) -> DataFrame:
    """Number of series a file contributed (kept in the manifest)."""
    return meta.groupBy("source_file").agg(F.count_distinct("name").alias("series_count"))
