"""Stored table schemas (natural keys instead of surrogate ids)."""

from pyspark.sql import types as T

# One row per observation; (name, frequency) is the series key. Not unique on
# date: a panel may repeat a date and both rows are kept.
OBSERVATIONS = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("frequency", T.StringType(), False),
    T.StructField("country", T.StringType(), False),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("date", T.DateType(), False),
    T.StructField("value", T.DoubleType(), True),
])

# Ordering key of loads: later loads own a series key. (run, country rank, file).
LOAD_SEQ = T.StructType([
    T.StructField("run", T.LongType(), False),
    T.StructField("country_rank", T.IntegerType(), False),
    T.StructField("file", T.StringType(), False),
])

CATALOG = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("frequency", T.StringType(), False),
    T.StructField("country", T.StringType(), False),
    T.StructField("source_file", T.StringType(), True),
    T.StructField("min_date", T.DateType(), True),
    T.StructField("max_date", T.DateType(), True),
    T.StructField("count", T.LongType(), True),
    T.StructField("load_seq", LOAD_SEQ, True),
])

MANIFEST = T.StructType([
    T.StructField("filepath", T.StringType(), False),
    T.StructField("country", T.StringType(), False),
    T.StructField("frequency", T.StringType(), False),
    T.StructField("mtime", T.TimestampType(), False),
    T.StructField("series_count", T.LongType(), True),
    T.StructField("last_processed", T.TimestampType(), True),
])

STATS = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])

FILE_EVENTS = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("path", T.StringType(), True),
    T.StructField("kind", T.StringType(), True),
])
