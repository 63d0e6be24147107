"""Registered queries for D-1…D-8, E7 and F1–F9."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import series as SR
from seriesforge.operators import stats as ST
from seriesforge.operators import visibility as V
from seriesforge.plans import fixtures as FX
from seriesforge.plans import state as S
from seriesforge.plans.registry import (BASE, GET_SERIES, IN_RANGE, PARSED, REQ, RESOLVED, hidden_sql, query,
                                        with_ctes)


def _parsed(spark, d):
    return SR.parse_names(FX.series_requests(spark, d)).withColumn("pos", F.col("pos").cast("long"))


def _visible_requests(spark, d):
    """F6 input: parsed names, hidden ones removed for non-admin callers."""
    return V.hide_series(_parsed(spark, d), FX.HIDDEN_PATTERNS, admin=F.col("role") == "admin")


RQ = dict(BASE, req=REQ, parsed=PARSED)
VISIBLE = f"SELECT * FROM parsed WHERE role = 'admin' OR NOT {hidden_sql('name')}"


@query("parse_names", with_ctes("SELECT request_id, pos, name FROM parsed", req=REQ, parsed=PARSED))
def parse_names(spark, d):
    return _parsed(spark, d).select("request_id", "pos", "name")


@query("resolve_series", with_ctes(
    "SELECT request_id, name, frequency, country, source_file, min_date, max_date, count FROM resolved",
    **RQ, resolved=RESOLVED.format(parsed="parsed")))
def resolve_series(spark, d):
    r = SR.resolve_series(_parsed(spark, d), S.catalog1(spark, d))
    return r.select("request_id", "name", "frequency", "country", "source_file", "min_date", "max_date", "count")


@query("slice_range", with_ctes(
    "SELECT o.name, o.frequency, o.date, o.value FROM obs1 o WHERE strftime(o.date, '%Y-%m-%d') >= '1997' "
    "AND strftime(o.date, '%Y-%m-%d') <= '1999-06'", obs1=BASE["obs1"]))
def slice_range(spark, d):
    """F2 with driver-side bounds: '1997' keeps 1997-01-01, '1999-06' drops 1999-06-01."""
    return SR.slice_range(S.obs1(spark, d), "1997", "1999-06").select("name", "frequency", "date", "value")


@query("get_series", with_ctes(GET_SERIES, **RQ, resolved=RESOLVED.format(parsed="parsed")))
def get_series(spark, d):
    r = SR.resolve_series(_parsed(spark, d), S.catalog1(spark, d))
    return SR.get_series(r, S.obs1(spark, d))


@query("get_series_long", with_ctes(
    f"""SELECT r.request_id, r.name AS series_name, r.frequency, o.date, o.value
        FROM resolved r JOIN obs1 o ON o.name = r.name AND o.frequency = r.frequency
        AND o.source_file = r.source_file AND {IN_RANGE}""", **RQ, resolved=RESOLVED.format(parsed="parsed")))
def get_series_long(spark, d):
    r = SR.resolve_series(_parsed(spark, d), S.catalog1(spark, d))
    return SR.get_series_long(r, S.obs1(spark, d))


@query("multi_series", with_ctes(GET_SERIES, **RQ, visible=VISIBLE, resolved=RESOLVED.format(parsed="visible")))
def multi_series(spark, d):
    """names split, hidden removed for non-admin, repeats collapsed, F4 each."""
    r = SR.resolve_series(_visible_requests(spark, d), S.catalog1(spark, d))
    return SR.get_series(r, S.obs1(spark, d))


@query("not_found", with_ctes(
    "SELECT v.request_id, v.pos, v.name FROM visible v WHERE NOT EXISTS "
    "(SELECT 1 FROM resolved r WHERE r.request_id = v.request_id AND r.name = v.name)",
    **RQ, visible=VISIBLE, resolved=RESOLVED.format(parsed="visible")))
def not_found(spark, d):
    vis = _visible_requests(spark, d)
    r = SR.resolve_series(vis, S.catalog1(spark, d))
    return SR.not_found(vis, r).select("request_id", "pos", "name")


@query("series_info", with_ctes(
    """SELECT c.name, x.country, c.frequency, c.count, c.min_date, c.max_date FROM cat1 c
       JOIN (SELECT name, arg_max(country, frequency) AS country FROM cat1 GROUP BY name) x ON x.name = c.name
       WHERE c.name IN (SELECT name FROM parsed) OR c.name LIKE 'NATION_1%'""", **RQ))
def series_info(spark, d):
    cat = S.catalog1(spark, d)
    names = _parsed(spark, d).select("name").unionByName(
        cat.where(F.col("name").like("NATION_1%")).select("name"))
    return SR.series_info(names, cat)


@query("guard_visible", with_ctes(
    f"SELECT request_id, pos, name, CASE WHEN role <> 'admin' AND {hidden_sql('name')} THEN 'not_found' "
    "ELSE 'ok' END AS status FROM parsed", req=REQ, parsed=PARSED))
def guard_visible(spark, d):
    return V.guard_visible(_parsed(spark, d), FX.HIDDEN_PATTERNS).select("request_id", "pos", "name", "status")


@query("hide_series", with_ctes(f"SELECT name, frequency, country FROM cat1 WHERE NOT {hidden_sql('name')}", **BASE))
def hide_series(spark, d):
    """E7 on the whole catalog with the pattern table (FX9)."""
    return V.hide_series(S.catalog1(spark, d), FX.hidden_patterns(spark)).select("name", "frequency", "country")


# ---- stats -------------------------------------------------------------------------

@query("stats_totals", with_ctes(
    "SELECT count(DISTINCT name) AS total_series, count(*) AS total_series_freq, "
    "CAST(coalesce(sum(count), 0) AS BIGINT) AS total_data_points FROM cat1", **BASE))
def stats_totals(spark, d):
    return ST.stats_totals(S.catalog1(spark, d))


@query("stats_by_country", with_ctes(
    "SELECT country, count(DISTINCT name) AS count FROM cat1 GROUP BY country", **BASE))
def stats_by_country(spark, d):
    return ST.stats_by_country(S.catalog1(spark, d))


@query("stats_by_frequency", with_ctes("SELECT frequency, count(*) AS count FROM cat1 GROUP BY frequency", **BASE))
def stats_by_frequency(spark, d):
    return ST.stats_by_frequency(S.catalog1(spark, d))


STATS_SQL = """
SELECT 'total_series' AS key, CAST(count(DISTINCT name) AS VARCHAR) AS value FROM cat1
UNION ALL SELECT 'total_series_freq', CAST(count(*) AS VARCHAR) FROM cat1
UNION ALL SELECT 'total_data_points', CAST(coalesce(sum(count), 0) AS VARCHAR) FROM cat1
UNION ALL SELECT 'by_country', '{' || string_agg('"' || country || '":' || n, ',' ORDER BY country) || '}'
          FROM (SELECT country, count(DISTINCT name) AS n FROM cat1 GROUP BY country)
UNION ALL SELECT 'by_frequency', '{' || string_agg('"' || frequency || '":' || n, ',' ORDER BY frequency) || '}'
          FROM (SELECT frequency, count(*) AS n FROM cat1 GROUP BY frequency)"""


@query("stats_table", with_ctes(STATS_SQL, **BASE))
def stats_table(spark, d):
    return ST.stats_table(S.catalog1(spark, d))


@query("read_stats", with_ctes(
    """SELECT max(CASE WHEN key = 'total_series' THEN CAST(value AS BIGINT) END) AS total_series,
              max(CASE WHEN key = 'total_series_freq' THEN CAST(value AS BIGINT) END) AS total_series_freq,
              max(CASE WHEN key = 'total_data_points' THEN CAST(value AS BIGINT) END) AS total_data_points,
              max(CASE WHEN key = 'by_country' THEN value END) AS by_country,
              max(CASE WHEN key = 'by_frequency' THEN value END) AS by_frequency FROM stats""",
    **BASE, stats=STATS_SQL))
def read_stats(spark, d):
    """D-5 from an empty stored table -> computed live; maps shown as JSON text."""
    empty = spark.createDataFrame([], "key string, value string")
    r = ST.read_stats(empty, S.catalog1(spark, d))
    return r.select("total_series", "total_series_freq", "total_data_points",
                    F.to_json("by_country").alias("by_country"), F.to_json("by_frequency").alias("by_frequency"))


@query("read_stats_stored", with_ctes(
    """SELECT count(DISTINCT name) AS total_series, count(*) AS total_series_freq,
              CAST(sum(count) AS BIGINT) AS total_data_points FROM cat1""", **BASE))
def read_stats_stored(spark, d):
    """D-5 from a stored table (as publishing writes it), with another catalog beside it: the table wins."""
    stored = ST.stats_table(S.catalog1(spark, d)).checkpoint()
    r = ST.read_stats(stored, S.catalog1(spark, d).limit(0))
    return r.select("total_series", "total_series_freq", "total_data_points")


@query("get_series_data", with_ctes(
    f"""SELECT r.request_id, r.name AS series_name, r.frequency,
               CAST(row_number() OVER (PARTITION BY r.request_id, r.name ORDER BY o.date, o.value) - 1 AS BIGINT) AS idx, o.date, o.value
        FROM resolved r JOIN obs1 o ON o.name = r.name AND o.frequency = r.frequency
        AND o.source_file = r.source_file AND {IN_RANGE}""", **RQ, resolved=RESOLVED.format(parsed="parsed")))
def get_series_data(spark, d):
    """F3 + F4: the nested answer's data, in its order."""
    r = SR.resolve_series(_parsed(spark, d), S.catalog1(spark, d))
    nested = SR.get_series(r, S.obs1(spark, d), nested=True)
    each = nested.select("request_id", "series_name", "frequency", F.posexplode("data").alias("idx", "p"))
    return each.select("request_id", "series_name", "frequency", F.col("idx").cast("long").alias("idx"), "p.date", "p.value")


@query("series_info_map", with_ctes(
    """SELECT c.name, x.country, c.frequency, c.count, c.min_date, c.max_date FROM cat1 c
       JOIN (SELECT name, arg_max(country, frequency) AS country FROM cat1 GROUP BY name) x ON x.name = c.name
       WHERE c.name IN (SELECT name FROM parsed)""", **RQ))
def series_info_map(spark, d):
    """F8: the nested answer's map of frequencies, flattened back."""
    info = SR.series_info_nested(_parsed(spark, d).select("name"), S.catalog1(spark, d))
    return info.select("name", "country", F.explode("frequencies").alias("frequency", "f")).select(
        "name", "country", "frequency", "f.count", "f.min_date", "f.max_date")


@query("build_summary", with_ctes(
    "SELECT (SELECT count(DISTINCT source_file) FROM meta1) AS files_processed, count(*) AS series, "
    "CAST(coalesce(sum(count), 0) AS BIGINT) AS data_points FROM cat1", **BASE))
def build_summary(spark, d):
    return ST.build_summary(S.manifest1(spark, d), S.catalog1(spark, d))


@query("list_countries", with_ctes("SELECT DISTINCT country FROM cat1", **BASE))
def list_countries(spark, d):
    return ST.list_countries(S.catalog1(spark, d))


@query("decode_dimensions", with_ctes(
    """SELECT name, frequency, country, CASE country WHEN 'cn' THEN 'China' WHEN 'jp' THEN 'Japan'
       WHEN 'kr' THEN 'Korea' WHEN 'tw' THEN 'Taiwan' WHEN 'region' THEN 'Regional/Cross-country' END AS country_name,
       CASE frequency WHEN 'd' THEN 'Daily' WHEN 'w' THEN 'Weekly' WHEN 'm' THEN 'Monthly' WHEN 'q' THEN 'Quarterly'
       WHEN 'a' THEN 'Annual' END AS frequency_name FROM cat1""", **BASE))
def decode_dimensions(spark, d):
    return ST.decode_dimensions(S.catalog1(spark, d).select("name", "frequency", "country"))
