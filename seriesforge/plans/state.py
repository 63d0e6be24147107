"""Catalog state built from the fixtures (the inputs of the registered queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.dims import country_rank
from seriesforge.operators import catalog as C
from seriesforge.operators import ingest as I
from seriesforge.plans import fixtures as FX


def with_load_seq(df: DataFrame, run: int) -> DataFrame:
    return df.withColumn("load_seq", F.struct(F.lit(run).cast("long").alias("run"),
                                              country_rank(F.col("country")).cast("int").alias("country_rank"),
                                              F.col("source_file").alias("file")))


def obs1(spark: SparkSession, d: str) -> DataFrame:
    """FX1 observations as stored (null values dropped)."""
    return I.drop_missing(FX.obs_raw(spark, d))


def obs3(spark: SparkSession, d: str) -> DataFrame:
    return I.drop_missing(FX.obs_raw(spark, d, overlap=True))


def meta(obs: DataFrame, run: int) -> DataFrame:
    return with_load_seq(I.series_metadata(obs), run)


def catalog1(spark: SparkSession, d: str) -> DataFrame:
    """Catalog after a full load of FX1."""
    return C.catalog_from_meta(meta(obs1(spark, d), 1))


def catalog13(spark: SparkSession, d: str) -> DataFrame:
    """Catalog after loading FX1 (run 1) and then FX3 (run 2)."""
    return C.upsert_catalog(catalog1(spark, d), meta(obs3(spark, d), 2))


def all_obs(spark: SparkSession, d: str) -> DataFrame:
    """Every stored observation of both loads (owners decided by the catalog)."""
    return obs1(spark, d).unionByName(obs3(spark, d))


def manifest1(spark: SparkSession, d: str) -> DataFrame:
    """Manifest after the FX1 load: files with >= 1 series, fixed mtime per file."""
    counts = I.file_series_count(I.series_metadata(obs1(spark, d)))
    files = obs1(spark, d).select("source_file", "country", "frequency").distinct()
    return (files.join(counts, "source_file")
            .select(F.col("source_file").alias("filepath"), "country", "frequency",
                    F.timestamp_seconds(F.lit(1704067200)).alias("mtime"), "series_count",
                    F.timestamp_seconds(F.lit(1704153600)).alias("last_processed")))
