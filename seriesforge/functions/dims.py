"""Small fixed dimensions: countries, frequencies, tiers (broadcast-safe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values (must equal the service's published lists).
COUNTRIES = [("cn", "China"), ("jp", "Japan"), ("kr", "Korea"), ("tw", "Taiwan"),
             ("region", "Regional/Cross-country")]
FREQUENCIES = [("d", "Daily"), ("w", "Weekly"), ("m", "Monthly"), ("q", "Quarterly"),
               ("a", "Annual")]
# Frequencies that ingest accepts (file suffix letter).
INGEST_FREQUENCIES = ["m", "q", "a"]
# Source-file exclusion substrings (any case, anywhere in the file name).
EXCLUDED_PATTERNS = ["latest", "recent", "hist", "history"]
# Monthly quota per tier for per-user keys; None = unlimited.
MONTHLY_LIMITS = {"free": 10, "daily": 30, "premium": None}
# Limit for the rolling one-day window; tiers outside the table use free's.
DAILY_WINDOW_LIMITS = {"free": 10, "daily": 30, "premium": None}
DEFAULT_SEARCH_LIMIT = 50
MAX_SEARCH_LIMIT = 200
ANONYMOUS_SEARCH_LIMIT = 20
KEY_PREFIX = "eae_"


def country_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "country string, country_name string")


def frequency_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FREQUENCIES, "frequency string, frequency_name string")


def country_rank(col):
    """Load order of country roots (cn, jp, kr, tw, region); unknown last."""
    expr = F.when(F.lit(False), F.lit(0))
    for i, (code, _) in enumerate(COUNTRIES):
        expr = expr.when(col == code, F.lit(i))
    return expr.otherwise(F.lit(len(COUNTRIES)))
