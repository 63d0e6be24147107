"""Registered batch forms of H1–H3 over the FX8 file events."""

from __future__ import annotations

from seriesforge.plans import fixtures as FX
from seriesforge.plans.registry import query, with_ctes
from seriesforge.streaming import file_events as H

EV = FX.fx_sql(FX.FILE_EVENTS_SQL)
REL = """SELECT * FROM ev WHERE kind IN ('created', 'modified', 'deleted')
  AND regexp_matches(lower(regexp_extract(path, '[^/]*$')), '_[mqa]\\.parquet$')
  AND NOT regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'latest|recent|hist')"""
ROUTE = "SELECT ts, path, kind, CASE " + " ".join(
    f"WHEN starts_with(path, '{r}') THEN '{c}'" for c, r in FX.EVENT_ROOTS) + " END AS country FROM rel"


@query("relevant_changes", with_ctes("SELECT * FROM rel", ev=EV, rel=REL))
def relevant_changes(spark, d):
    return H.relevant_changes(FX.file_events(spark, d))


@query("route_country", with_ctes("SELECT * FROM routed WHERE country IS NOT NULL", ev=EV, rel=REL, routed=ROUTE))
def route_country(spark, d):
    return H.route_country(H.relevant_changes(FX.file_events(spark, d)), FX.EVENT_ROOTS)


@query("debounced_batches", with_ctes(
    """SELECT min(ts) AS start, max(ts) + INTERVAL 30 SECOND AS "end",
         array_to_string(list_sort(list_distinct(list(country))), ',') AS countries
       FROM (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 SECOND THEN 1 ELSE 0 END)
                        OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
             FROM (SELECT ts, country, lag(ts) OVER (ORDER BY ts) AS prev FROM routed WHERE country IS NOT NULL) a) b
       GROUP BY sid""", ev=EV, rel=REL, routed=ROUTE))
def debounced_batches(spark, d):
    from pyspark.sql import functions as F
    ev = H.route_country(H.relevant_changes(FX.file_events(spark, d)), FX.EVENT_ROOTS)
    return H.debounced_batches(ev).withColumn("countries", F.array_join("countries", ","))
