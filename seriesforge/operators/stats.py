"""D-1…D-8: catalog statistics, country list, dimension decoding.

All are aggregates over the catalog (one row per series key) with partial
aggregation; the breakdowns are JSON text ``{"code":n,…}`` with sorted keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.dims import country_dim, frequency_dim

STAT_KEYS = ["total_series", "total_series_freq", "total_data_points", "by_country", "by_frequency"]


def stats_totals(cat: DataFrame) -> DataFrame:
    """D-1: distinct names, series keys, sum of counts (0 when empty)."""
    return cat.agg(F.count_distinct("name").alias("total_series"),
                   F.count(F.lit(1)).alias("total_series_freq"),
                   F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_data_points"))


def stats_by_country(cat: DataFrame) -> DataFrame:
    """D-2: distinct names per country."""
    return cat.groupBy("country").agg(F.count_distinct("name").alias("count"))


def stats_by_frequency(cat: DataFrame) -> DataFrame:
    """D-3: series keys per frequency."""
    return cat.groupBy("frequency").agg(F.count(F.lit(1)).alias("count"))


def stats_table(cat: DataFrame) -> DataFrame:
    """D-4: five (key, value) rows; numbers as text, breakdowns as JSON text.
    One pass over the catalog: name, country and frequency counts are the
    grouping sets of one aggregate, of which a few rows are folded."""
    per = cat.groupingSets([["name"], ["country", "name"], ["frequency"]], "name", "country", "frequency").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.sum("count").alias("points"))
    # _g bits: name, country, frequency (1 = folded away)
    names, places, freqs = F.col("_g") == 3, F.col("_g") == 1, F.col("_g") == 6
    few = per.groupBy("_g", "country", "frequency").agg(F.count(F.lit(1)).alias("names"), F.sum("n").alias("n"), F.sum("points").alias("points"))

    def breakdown(which, code: str, number: str):
        entries = F.array_sort(F.collect_list(F.when(which, F.struct(F.col(code).alias("k"), F.col(number).alias("v")))))
        return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))

    def total(which, number: str):
        return F.coalesce(F.sum(F.when(which, F.col(number))), F.lit(0)).cast("string")
    one = few.agg(total(names, "names").alias("total_series"), total(names, "n").alias("total_series_freq"), total(names, "points").alias("total_data_points"),
                  breakdown(places, "country", "names").alias("by_country"), breakdown(freqs, "frequency", "n").alias("by_frequency"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in STAT_KEYS])))


def read_stats(stats: DataFrame | None, cat: DataFrame) -> DataFrame:
    """D-5: one typed row from the stored table; computed live when the
    table is absent or empty (a one-row probe decides)."""
    if stats is None or not stats.take(1):
        stats = stats_table(cat)
    kv = stats.agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in STAT_KEYS])
    mt = "map<string,bigint>"
    return kv.select(*[F.col(k).cast("long").alias(k) for k in STAT_KEYS[:3]],
                     F.from_json("by_country", mt).alias("by_country"),
                     F.from_json("by_frequency", mt).alias("by_frequency"))


def build_summary(manifest: DataFrame, cat: DataFrame) -> DataFrame:
    """D-6: files processed, series keys and observations after a rebuild."""
    files = manifest.agg(F.count(F.lit(1)).alias("files_processed"))
    series = cat.agg(F.count(F.lit(1)).alias("series"),
                     F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("data_points"))
    # two one-row aggregates side by side: a one-row-per-side keyed join
    return files.withColumn("_k", F.lit(1)).join(series.withColumn("_k", F.lit(1)), "_k").drop("_k")


def list_countries(cat: DataFrame) -> DataFrame:
    """D-7: distinct countries in order."""
    return cat.select("country").distinct().orderBy("country")


def decode_dimensions(df: DataFrame) -> DataFrame:
    """D-8: add country_name / frequency_name from the fixed dimensions
    (5 rows each, broadcast by construction)."""
    spark = df.sparkSession
    out = df
    if "country" in df.columns:
        out = out.join(F.broadcast(country_dim(spark)), "country", "left")
    if "frequency" in df.columns:
        out = out.join(F.broadcast(frequency_dim(spark)), "frequency", "left")
    return out
