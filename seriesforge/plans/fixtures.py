"""Derived test inputs (FIXTURES.md) as portable SQL templates.

Each template names the driver tables as ``{orders}``, ``{customer}`` …; the
Spark side fills them with ``parquet.`<dir>/<table>.parquet``` so the scan is
planned by Catalyst with pushdown, the DuckDB twin fills them with the view
names.  The same text feeds ``queries()`` inputs and ``oracle_sql()`` CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]

_COUNTRY_CASE = ("CASE n_regionkey WHEN 0 THEN 'cn' WHEN 1 THEN 'jp' WHEN 2 THEN 'kr' "
                 "WHEN 3 THEN 'tw' ELSE 'region' END")


def obs_raw_sql(overlap: bool = False) -> str:
    """FX1 (or FX3 with ``overlap``): long observations with some null values."""
    sep = "/z_" if overlap else "/"
    extra = " AND o_orderstatus = 'F' AND n_nationkey % 3 = 0" if overlap else ""
    return f"""
SELECT name, frequency, country, concat(country, '{sep}', lower(n_name), '_', frequency, '.parquet') AS source_file,
       date, CASE WHEN (n_nationkey + month(date)) % 11 = 0 THEN NULL ELSE CAST(amount AS DOUBLE) END AS value
FROM (
  SELECT n_name, n_nationkey, country, name, frequency, date, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS amount
  FROM (
    SELECT n_name, n_nationkey, o_totalprice, frequency,
           {_COUNTRY_CASE} AS country,
           concat(n_name, CASE n_nationkey % 7 WHEN 0 THEN ', S&P PMI, ' WHEN 1 THEN ', Café Orders, '
                  ELSE ', Orders (s.a.), ' END, c_mktsegment) AS name,
           CAST(CASE frequency WHEN 'm' THEN date_trunc('month', o_orderdate)
                WHEN 'q' THEN date_trunc('quarter', o_orderdate) ELSE date_trunc('year', o_orderdate) END AS DATE) AS date
    FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
    CROSS JOIN (VALUES ('m'), ('q'), ('a')) AS f(frequency)
    WHERE NOT (frequency = 'm' AND n_nationkey % 6 = 5){extra}
  ) x GROUP BY n_name, n_nationkey, country, name, frequency, date
) y"""


FILE_LISTING_SQL = f"""
SELECT concat(country, '/', file_name) AS path, file_name, country, mtime_s FROM (
  SELECT {_COUNTRY_CASE} AS country,
         concat(lower(n_name), suffix) AS file_name, 1704067200 + 3600 * n_nationkey AS mtime_s
  FROM {{nation}} CROSS JOIN (VALUES ('_m.parquet'), ('_q.parquet'), ('_a.parquet'), ('_d.parquet'), ('_M.parquet'),
       ('_latest_m.parquet'), ('_HIST_q.parquet'), ('_m.parquet.tmp')) AS s(suffix)) x"""

MANIFEST_SQL = f"""
SELECT path, country, mtime_s FROM (
  SELECT concat(country, '/', lower(n_name), suffix) AS path, country,
         1704067200 + 3600 * n_nationkey - CASE n_nationkey % 4 WHEN 2 THEN 60 ELSE 0 END AS mtime_s
  FROM (SELECT n_name, n_nationkey, {_COUNTRY_CASE} AS country FROM {{nation}} WHERE n_nationkey % 4 <> 1) n
  CROSS JOIN (VALUES ('_m.parquet'), ('_q.parquet'), ('_a.parquet')) AS s(suffix)
  UNION ALL SELECT 'cn/gone_m.parquet', 'cn', 1704067200) x"""

SEARCH_QUERIES_SQL = """
SELECT * FROM (VALUES
  (1, 'orders', NULL, NULL, 50, 'admin'), (2, 'ORDERS s.a.', 'm', NULL, 50, 'user'), (3, 's p pmi', NULL, NULL, 50, 'admin'),
  (4, 'S&P PMI', NULL, NULL, 50, 'user'), (5, 'cafe', NULL, 'jp', 50, 'user'), (6, 'rder', NULL, NULL, 30, 'anonymous'),
  (7, 'NATION_1%MACH', NULL, NULL, 50, 'user'), (8, ',', NULL, NULL, 5, 'user'), (9, 'orders furniture', 'q', NULL, 50, 'user'),
  (10, 'no such thing', NULL, NULL, 50, 'user'), (11, '"pmi, building"', NULL, NULL, 50, 'admin'),
  (12, 'pmi', NULL, 'zz', 50, 'admin'), (13, 'machinery', '', '', 200, 'user'), (14, 'machinery', NULL, NULL, 500, 'user'),
  (15, '%', 'a', 'cn', 7, 'user'), (16, '_', 'q', NULL, 9, 'admin'), (17, '', 'm', 'jp', 4, 'anonymous'), (18, 'y', 'a', 'jp', 50, 'user'),
  (19, '&P', NULL, 'cn', 50, 'user'), (20, '%_%_%', 'a', 'tw', 3, 'user'), (21, 'a.)', 'q', 'kr', 50, 'user'), (22, NULL, NULL, NULL, 50, 'user')
) AS t(query_id, q, freq, country, lim, role)
UNION ALL
SELECT 100 + n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN concat(n_name, ' orders') WHEN 1 THEN substring(n_name, 3, 6)
       WHEN 2 THEN concat('%', substring(n_name, length(n_name), 1), ', _') ELSE lower(n_name) END,
       CASE n_nationkey % 3 WHEN 0 THEN 'q' WHEN 1 THEN '' ELSE NULL END, NULL, 20 * (n_nationkey % 13),
       CASE n_nationkey % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'anonymous' ELSE 'user' END
FROM {nation}"""

SERIES_REQUESTS_SQL = """
SELECT * FROM (VALUES
  (1, 'NATION_3, Orders (s.a.), AUTOMOBILE', NULL, '1996-01-01', '1998-12-31', 'user'),
  (2, 'NATION_5, Orders (s.a.), BUILDING', NULL, NULL, NULL, 'user'),
  (3, 'NATION_3, Orders (s.a.), AUTOMOBILE; NATION_4, Orders (s.a.), MACHINERY ;missing;', 'q', '1997', '1999', 'user'),
  (4, 'NATION_0, S&P PMI, BUILDING;NATION_2, Orders (s.a.), BUILDING', 'a', NULL, '', 'user'),
  (5, 'NATION_0, S&P PMI, BUILDING', 'a', NULL, NULL, 'admin'),
  (6, 'NATION_2, Orders (s.a.), BUILDING;NATION_2, Orders (s.a.), BUILDING;missing;missing', 'm', '2030-01-01', NULL, 'user')
) AS t(request_id, columns, freq, start_date, end_date, role)
UNION ALL
SELECT 100 + n_nationkey, concat(n_name, ', Orders (s.a.), BUILDING ; ', n_name, ', S&P PMI, MACHINERY;', lower(n_name)),
       CASE n_nationkey % 3 WHEN 0 THEN 'q' WHEN 1 THEN NULL ELSE 'a' END,
       CASE n_nationkey % 4 WHEN 0 THEN '1995-07' WHEN 1 THEN '1996-02-15' WHEN 2 THEN '1994' ELSE NULL END,
       CASE n_nationkey % 5 WHEN 0 THEN '1997-03' WHEN 1 THEN '1998' WHEN 2 THEN '1997-xx' ELSE '' END,
       CASE n_nationkey % 2 WHEN 0 THEN 'admin' ELSE 'user' END
FROM {nation}"""

REQUEST_LOG_SQL = """
SELECT event_id, ts, user_id,
       CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'multi_series' ELSE 'series' END AS kind,
       CASE WHEN event_type NOT IN ('view', 'click') THEN concat('NATION_', CAST(user_id % 25 AS VARCHAR(10)),
            CASE WHEN event_id % 7 = 0 THEN ', S&P PMI, BUILDING' ELSE ', Orders (s.a.), BUILDING' END) END AS series,
       CASE WHEN user_id % 10 = 9 THEN NULL WHEN user_id % 10 = 8 THEN 'admin-key' WHEN user_id % 10 = 7 THEN 'eae_unknown'
            WHEN user_id % 10 = 6 THEN 'other' ELSE concat('eae_', CAST(user_id AS VARCHAR(10))) END AS api_key,
       CASE WHEN user_id % 10 IN (6, 7, 9) AND user_id % 20 < 10 THEN concat('u', CAST(user_id AS VARCHAR(10)), '@x.org') END AS bearer_email
FROM {events}"""

KEYS_SQL = """
SELECT DISTINCT concat('eae_', CAST(user_id AS VARCHAR(10))) AS api_key, concat('u', CAST(user_id AS VARCHAR(10)), '@x.org') AS email,
       '' AS name, CASE user_id % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'daily' WHEN 2 THEN 'premium' ELSE 'trial' END AS tier,
       user_id % 25 <> 0 AS is_active
FROM {events}"""

MEMBERS_SQL = """
SELECT DISTINCT concat('u', CAST(user_id AS VARCHAR(10)), '@x.org') AS email, concat('User ', CAST(user_id AS VARCHAR(10))) AS name,
       CASE WHEN user_id % 13 = 0 THEN 'comped' ELSE 'paid' END AS status,
       CASE user_id % 5 WHEN 0 THEN 'Daily' WHEN 1 THEN 'Daily + Data' WHEN 2 THEN 'East Asia|Daily' WHEN 3 THEN 'Free' ELSE '' END AS tier_names
FROM {events}"""

FILE_EVENTS_SQL = """
SELECT ts, concat(CASE user_id % 6 WHEN 0 THEN 'cn' WHEN 1 THEN 'jp' WHEN 2 THEN 'kr' WHEN 3 THEN 'tw' WHEN 4 THEN 'region'
       ELSE 'elsewhere' END, '/f', CAST(user_id AS VARCHAR(10)),
       CASE event_type WHEN 'view' THEN '_M.parquet' WHEN 'error' THEN '_latest_m.parquet' WHEN 'click' THEN '_q.parquet'
       WHEN 'signup' THEN '_a.parquet' ELSE '.csv' END) AS path,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'created' WHEN 1 THEN 'modified' ELSE 'deleted' END AS kind
FROM {events}"""

# Fixed test values: hidden pattern list (FX9), admin keys, roots of the file events.
HIDDEN_PATTERNS = ["s&p pmi"]
ADMIN_KEYS = ["admin-key"]
EVENT_ROOTS = [("cn", "cn/"), ("jp", "jp/"), ("kr", "kr/"), ("tw", "tw/"), ("region", "region/")]
# M2 key-issue log (email, api_key, created_at): three issues for one email, one for another.
KEY_ISSUES = [("a@x.org", "eae_a1", "2024-01-01 00:00:00"), ("a@x.org", "eae_a2", "2024-01-05 00:00:00"),
              ("a@x.org", "eae_a3", "2024-01-09 12:00:00"), ("b@x.org", "eae_b1", "2024-01-02 00:00:00")]


def table_refs(sf_dir: str) -> dict[str, str]:
    return {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in DRIVER_TABLES}


def duck_refs() -> dict[str, str]:
    return {t: t for t in DRIVER_TABLES}


def fx_sql(template: str, duck: bool = True, sf_dir: str | None = None) -> str:
    return template.format(**(duck_refs() if duck else table_refs(sf_dir)))


def fx(spark: SparkSession, template: str, sf_dir: str) -> DataFrame:
    return spark.sql(fx_sql(template, duck=False, sf_dir=sf_dir))


# ---- Spark-side fixtures ------------------------------------------------------

def obs_raw(spark, sf_dir, overlap=False):
    return fx(spark, obs_raw_sql(overlap), sf_dir)


def file_listing(spark, sf_dir):
    return fx(spark, FILE_LISTING_SQL, sf_dir)


def manifest(spark, sf_dir):
    return fx(spark, MANIFEST_SQL, sf_dir)


def search_queries(spark, sf_dir):
    return fx(spark, SEARCH_QUERIES_SQL, sf_dir)


def series_requests(spark, sf_dir):
    return fx(spark, SERIES_REQUESTS_SQL, sf_dir)


def request_log(spark, sf_dir):
    return fx(spark, REQUEST_LOG_SQL, sf_dir)


def keys(spark, sf_dir):
    return fx(spark, KEYS_SQL, sf_dir)


def members(spark, sf_dir):
    """Member records with nested ``tiers array<struct<name>>``."""
    m = fx(spark, MEMBERS_SQL, sf_dir)
    tiers = F.transform(F.filter(F.split("tier_names", r"\|"), lambda t: t != ""),
                        lambda t: F.struct(t.alias("name")))
    return m.select("email", "name", "status", tiers.alias("tiers"))


def file_events(spark, sf_dir):
    return fx(spark, FILE_EVENTS_SQL, sf_dir)


def hidden_patterns(spark):
    return spark.createDataFrame([(p,) for p in HIDDEN_PATTERNS], "pattern string")
