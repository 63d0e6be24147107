"""Registered queries for B8–B11."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seriesforge.operators import reshape as RS
from seriesforge.plans import state as S
from seriesforge.plans.registry import BASE, query, with_ctes

WIDE_NAMES = ["NATION_3, Orders (s.a.), AUTOMOBILE", "NATION_4, Orders (s.a.), MACHINERY", "missing"]


def _pivot_sql(freq: str, start: str, end: str) -> str:
    cols = ",\n".join(f"max(CASE WHEN name = '{n}' THEN value END) AS \"{n}\"" for n in WIDE_NAMES[:2])
    return with_ctes(f"""SELECT date AS "Date", {cols} FROM obs1
      WHERE name IN ('{WIDE_NAMES[0]}', '{WIDE_NAMES[1]}') AND frequency = '{freq}'
        AND strftime(date, '%Y-%m-%d') >= '{start}' AND strftime(date, '%Y-%m-%d') <= '{end}'
      GROUP BY date""", obs1=BASE["obs1"])


@query("pivot_wide", _pivot_sql("q", "1997", "1999"))
def pivot_wide(spark, d):
    long = RS.wide_slice(spark, S.catalog1(spark, d), S.obs1(spark, d), WIDE_NAMES, "q", "1997", "1999")
    return RS.require_data(RS.pivot_wide(long, WIDE_NAMES))


@query("records_json", with_ctes(f"""SELECT date, name, value FROM obs1
      WHERE name IN ('{WIDE_NAMES[0]}', '{WIDE_NAMES[1]}') AND frequency = 'q'
        AND strftime(date, '%Y-%m-%d') >= '1997' AND strftime(date, '%Y-%m-%d') <= '1999'""", obs1=BASE["obs1"]))
def records_json(spark, d):
    """B10, each JSON object parsed back to (date, name, value): number text differs between engines, values don't."""
    long = RS.wide_slice(spark, S.catalog1(spark, d), S.obs1(spark, d), WIDE_NAMES, "q", "1997", "1999")
    records = RS.to_records(RS.pivot_wide(long, WIDE_NAMES))
    cells = records.select("Date", F.explode(F.from_json("record", "map<string,string>")).alias("name", "value"))
    return cells.where("name <> 'Date'").select(F.col("Date").alias("date"), "name", F.col("value").cast("double").alias("value"))


@query("columns_arrays", with_ctes(
    """SELECT name AS series_name, frequency, CAST(row_number() OVER (PARTITION BY name, frequency ORDER BY date, value) - 1
       AS BIGINT) AS idx, date, value FROM obs1""", obs1=BASE["obs1"]))
def columns_arrays(spark, d):
    """B11 for every series, flattened back to (series, frequency, idx, date, value)."""
    cols = RS.to_columns(S.obs1(spark, d))
    z = cols.select("series_name", "frequency", F.posexplode(F.arrays_zip("dates", "values")).alias("idx", "p"))
    return z.select("series_name", "frequency", F.col("idx").cast("long").alias("idx"), F.col("p.dates").alias("date"),
                    F.col("p.values").alias("value"))


@query("csv_roundtrip", _pivot_sql("q", "1996", "1999"))
def csv_roundtrip(spark, d):
    """The wide frame written as CSV below the shared folder and read back."""
    from seriesforge.session import ensure_checkpoint_dir
    long = RS.wide_slice(spark, S.catalog1(spark, d), S.obs1(spark, d), WIDE_NAMES, "q", "1996", "1999")
    wide = RS.pivot_wide(long, WIDE_NAMES)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    RS.write_csv(wide, path)
    return spark.read.option("header", True).schema(wide.schema).csv(path)
