"""A1–A3: list parquet panels under country roots, classify, restrict.

Listing is a Spark ``binaryFile`` scan with the ``content`` column pruned, so
only paths and modification times are read; the roots table is tiny.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.dims import COUNTRIES, EXCLUDED_PATTERNS

VALID_SUFFIX_REGEX = r"_([mqa])\.parquet$"


def discover_files(spark: SparkSession, roots: Sequence[tuple[str, str]]) -> DataFrame:
    """(path, file_name, country, mtime) for ``*.parquet`` directly under each root.

    ``roots`` is ``[(country, root_dir), …]``; a root that does not exist is
    skipped. Sub-directories are not searched.
    """
    frames = []
    for country, root in roots:
        try:
            df = (spark.read.format("binaryFile")
                  .option("pathGlobFilter", "*.parquet")
                  .option("recursiveFileLookup", "false")
                  .load(root))
        except Exception as exc:  # missing root -> skipped
            if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
                continue
            raise
        frames.append(df.select(
            F.col("path"),
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            F.lit(country).alias("country"),
            F.col("modificationTime").alias("mtime")))
    if not frames:
        return spark.createDataFrame([], "path string, file_name string, country string, mtime timestamp")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def is_excluded(file_name: Column) -> Column:
    low = F.lower(file_name)
    cond = F.lit(False)
    for p in EXCLUDED_PATTERNS:
        cond = cond | low.contains(p)
    return cond


def suffix_frequency(file_name: Column, any_case: bool = False) -> Column:
    """Frequency letter from ``_m/_q/_a.parquet`` (case-sensitive in batch)."""
    src = F.lower(file_name) if any_case else file_name
    letter = F.regexp_extract(src, VALID_SUFFIX_REGEX, 1)
    return F.when(letter != "", letter)


def classify_files(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Keep valid, non-excluded panel files and add their ``frequency``."""
    return (files.withColumn("frequency", suffix_frequency(F.col(name_col)))
            .where(F.col("frequency").isNotNull() & ~is_excluded(F.col(name_col))))


def restrict_countries(files: DataFrame, codes: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """Files of the chosen countries (default all) and the unknown codes.

    ``codes`` is a short driver-side argument list, so the unknown-code check is
    plain Python; the file filter is an ``isin`` pushed into the plan.
    """
    known = [c for c, _ in COUNTRIES]
    if not codes:
        return files, []
    unknown = [c for c in codes if c not in known]
    chosen = [c for c in codes if c in known]
    return files.where(F.col("country").isin(chosen)), unknown

