"""Registered queries: Spark callables (spark, sf_dir) -> DataFrame and their
DuckDB twins over the same driver tables.

The DuckDB text re-derives every result independently (windows where Spark
uses ``max_by``, plain SQL where Spark uses operators), over fixtures given by
the same portable SQL templates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.plans import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def with_ctes(body: str, _recursive: bool = False, **ctes: str) -> str:
    return ("WITH RECURSIVE " if _recursive else "WITH ") + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


# ---- shared DuckDB fixture CTEs --------------------------------------------------

OBS1_RAW = FX.fx_sql(FX.obs_raw_sql())
OBS3_RAW = FX.fx_sql(FX.obs_raw_sql(overlap=True))
OBS1 = f"SELECT * FROM ({OBS1_RAW}) WHERE value IS NOT NULL AND NOT isnan(value)"
OBS3 = f"SELECT * FROM ({OBS3_RAW}) WHERE value IS NOT NULL AND NOT isnan(value)"
META = ("SELECT source_file, country, frequency, name, min(date) AS min_date, max(date) AS max_date, "
        "count(*) AS count FROM {src} GROUP BY source_file, country, frequency, name")
CAT1 = "SELECT name, frequency, country, source_file, min_date, max_date, count FROM meta1"
CRANK = "CASE country WHEN 'cn' THEN 0 WHEN 'jp' THEN 1 WHEN 'kr' THEN 2 WHEN 'tw' THEN 3 WHEN 'region' THEN 4 ELSE 5 END"
CAT13 = f"""SELECT name, frequency, country, source_file, min_date, max_date, count FROM (
  SELECT *, row_number() OVER (PARTITION BY name, frequency ORDER BY run DESC, {CRANK} DESC, source_file DESC) AS rn
  FROM (SELECT *, 1 AS run FROM meta1 UNION ALL SELECT *, 2 AS run FROM meta3) u) x WHERE rn = 1"""
BASE = dict(obs1=OBS1, meta1=META.format(src="obs1"), cat1=CAT1)
BASE13 = dict(obs1=OBS1, obs3=OBS3, meta1=META.format(src="obs1"), meta3=META.format(src="obs3"), cat13=CAT13)
REQ = FX.fx_sql(FX.SERIES_REQUESTS_SQL)
PARSED = ("SELECT request_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, trim(unnest(parts)) AS name, "
          "freq, start_date, end_date, role FROM (SELECT *, string_split(columns, ';') AS parts FROM req) p")
RESOLVED = """SELECT request_id, name, freq, start_date, end_date, country, frequency, source_file, min_date, max_date, count
FROM (SELECT p.request_id, p.name, p.freq, p.start_date, p.end_date, c.country, c.frequency, c.source_file,
             c.min_date, c.max_date, c.count,
             row_number() OVER (PARTITION BY p.request_id, p.name ORDER BY CASE WHEN c.frequency = 'm' THEN 0 ELSE 1 END,
                                c.frequency) AS rn
      FROM (SELECT DISTINCT request_id, name, freq, start_date, end_date FROM {parsed}) p
      JOIN cat1 c ON c.name = p.name
      WHERE coalesce(p.freq, '') = '' OR c.frequency = p.freq) x WHERE rn = 1"""
IN_RANGE = ("(coalesce(r.start_date, '') = '' OR strftime(o.date, '%Y-%m-%d') >= r.start_date) AND "
            "(coalesce(r.end_date, '') = '' OR strftime(o.date, '%Y-%m-%d') <= r.end_date)")
GET_SERIES = f"""SELECT r.request_id, r.name AS series_name, r.country, r.frequency,
       CAST(count(o.date) AS BIGINT) AS count,
       CASE WHEN count(o.date) > 0 THEN min(o.date) ELSE r.min_date END AS min_date,
       CASE WHEN count(o.date) > 0 THEN max(o.date) ELSE r.max_date END AS max_date
FROM resolved r LEFT JOIN obs1 o ON o.name = r.name AND o.frequency = r.frequency AND o.source_file = r.source_file
     AND {IN_RANGE}
GROUP BY r.request_id, r.name, r.country, r.frequency, r.min_date, r.max_date"""
HIDDEN_SQL = " OR ".join(f"strpos(lower({{col}}), '{p}') > 0" for p in FX.HIDDEN_PATTERNS)


def hidden_sql(col: str) -> str:
    return "(" + HIDDEN_SQL.format(col=col) + ")"


# The query modules register themselves on import.
from seriesforge.plans import q_ingest, q_catalog, q_series, q_search, q_metering, q_reshape, q_streaming, q_store  # noqa: E402,F401
