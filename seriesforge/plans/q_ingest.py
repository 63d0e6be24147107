"""Registered queries for B1–B7 (panel reshaping and cleaning)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import ingest as I
from seriesforge.plans import fixtures as FX
from seriesforge.plans import state as S
from seriesforge.plans.registry import BASE, OBS1, OBS1_RAW, META, query, with_ctes
from seriesforge.sources import panels as P

OBS_COLS = ["name", "frequency", "country", "source_file", "date", "value"]


@query("panel_roundtrip", with_ctes("SELECT name, frequency, country, source_file, date, value FROM obs1", obs1=OBS1))
def panel_roundtrip(spark, d):
    """FX1 -> one wide panel per file (FX2) -> unpivot (B2) -> drop missing."""
    raw = FX.obs_raw(spark, d)
    names = sorted(r["name"] for r in raw.select("name").distinct().collect())  # the panel's columns: given, they may be any number
    wide = raw.groupBy("source_file", "country", "frequency", "date").pivot("name", names).agg(F.first("value"))
    long = P.unpivot_panel(wide, ["source_file", "country", "frequency", "date"], names)
    return I.drop_missing(long).select(*OBS_COLS)


@query("normalize_date", with_ctes(
    "SELECT name, frequency, source_file, CAST(date - INTERVAL 30 YEAR AS DATE) AS date FROM obs",
    obs=OBS1_RAW))
def normalize_date(spark, d):
    """B1 on nanosecond timestamps 30 years earlier (before 1970: floor division)."""
    raw = FX.obs_raw(spark, d)
    ns = ((F.unix_date(F.add_months("date", -360)).cast("long") * 86400 + 46800) * 1_000_000_000)
    src = raw.select("name", "frequency", "source_file", ns.alias("date_ns"))
    return src.select("name", "frequency", "source_file",
                      P.normalize_date(F.col("date_ns"), src.schema["date_ns"].dataType).alias("date"))


@query("coerce_value", with_ctes("SELECT name, frequency, source_file, date, value FROM obs", obs=OBS1_RAW))
def coerce_value(spark, d):
    """Values arriving as text (missing ones as 'n/a') become doubles."""
    raw = FX.obs_raw(spark, d)
    txt = F.when(F.col("value").isNull(), F.lit("n/a")).otherwise(F.col("value").cast("string"))
    src = raw.select("name", "frequency", "source_file", "date", txt.alias("value_text"))
    return src.select("name", "frequency", "source_file", "date",
                      P.coerce_value(F.col("value_text"), src.schema["value_text"].dataType).alias("value"))


@query("drop_missing", with_ctes("SELECT name, frequency, country, source_file, date, value FROM obs1", obs1=OBS1))
def drop_missing(spark, d):
    return I.drop_missing(FX.obs_raw(spark, d)).select(*OBS_COLS)


@query("reject_bad_files", with_ctes(
    "SELECT DISTINCT source_file FROM obs1 WHERE frequency = 'q' AND country = 'kr' AND month(date) = 4",
    obs1=OBS1))
def reject_bad_files(spark, d):
    """Korean quarterly files get a null date in April rows -> whole file rejected."""
    raw = FX.obs_raw(spark, d)
    bad = (F.col("frequency") == "q") & (F.col("country") == "kr") & (F.month("date") == 4)
    damaged = raw.withColumn("date", F.when(bad, F.lit(None).cast("date")).otherwise(F.col("date")))
    _, rejects = I.reject_bad_files(damaged)
    return rejects


@query("reject_bad_files_good", with_ctes(
    "SELECT name, frequency, country, source_file, date, value FROM obs1 WHERE source_file NOT IN "
    "(SELECT source_file FROM obs1 WHERE frequency = 'q' AND country = 'kr' AND month(date) = 4)",
    obs1=OBS1))
def reject_bad_files_good(spark, d):
    """B5, kept side: observations of the files that load."""
    raw = FX.obs_raw(spark, d)
    bad = (F.col("frequency") == "q") & (F.col("country") == "kr") & (F.month("date") == 4)
    damaged = raw.withColumn("date", F.when(bad, F.lit(None).cast("date")).otherwise(F.col("date")))
    good, _ = I.reject_bad_files(damaged)
    return good.select(*OBS_COLS)


@query("series_metadata", with_ctes("SELECT * FROM meta1", **{k: BASE[k] for k in ("obs1", "meta1")}))
def series_metadata(spark, d):
    return I.series_metadata(S.obs1(spark, d))


@query("file_series_count", with_ctes(
    "SELECT source_file, count(DISTINCT name) AS series_count FROM meta1 GROUP BY source_file",
    **{k: BASE[k] for k in ("obs1", "meta1")}))
def file_series_count(spark, d):
    return I.file_series_count(I.series_metadata(S.obs1(spark, d)))
