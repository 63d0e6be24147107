"""Registered queries for E1–E9 (search) over the FX1 catalog and FX5 queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.functions.text import TOKEN_SPLIT_REGEX, sql_accent_literals
from seriesforge.operators import search as E
from seriesforge.plans import fixtures as FX
from seriesforge.plans import state as S
from seriesforge.plans.registry import BASE, hidden_sql, query, with_ctes

_SRC, _DST = sql_accent_literals()


def _tok(x: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate(lower({x}), {_SRC}, {_DST}), "
            f"'{TOKEN_SPLIT_REGEX}'), lambda t: t <> '')")


def _fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


FACETS = ("(coalesce(q.freq, '') = '' OR c.frequency = q.freq) AND "
          "(coalesce(q.country, '') = '' OR c.country = q.country)")
CATT = f"SELECT name, frequency, country, ' ' || array_to_string({_tok('name')}, ' ') || ' ' AS ntext FROM cat1"
_QCLEAN = "replace(replace(q, '\"', ''), '''', '')"
QT = f"SELECT *, {_tok(_QCLEAN)} AS qt FROM queries"
PHRASE = f"""SELECT q.query_id, c.name, c.frequency, c.country FROM qt q JOIN catt c
  ON len(q.qt) > 0 AND strpos(c.ntext, ' ' || array_to_string(q.qt, ' ') || ' ') > 0 WHERE {FACETS}"""
LIKE_ALL = f"""SELECT q.query_id, c.name, c.frequency, c.country FROM queries q JOIN cat1 c
  ON like_escape({_fold('c.name')}, '%' || {_fold('q.q')} || '%', chr(1)) WHERE {FACETS}"""
HITS = f"""SELECT * FROM phrase UNION ALL SELECT * FROM ({LIKE_ALL}) l
  WHERE l.query_id NOT IN (SELECT query_id FROM phrase)"""
GROUPED = """SELECT query_id, name, array_to_string(list_sort(list_distinct(list(frequency))), ',') AS frequencies,
  arg_min(country, frequency) AS country FROM hits GROUP BY query_id, name"""
TOPK = """SELECT g.query_id, g.name, g.country, g.frequencies FROM (
  SELECT g.*, row_number() OVER (PARTITION BY g.query_id ORDER BY g.name) AS rn FROM grouped g) g
  JOIN queries q ON q.query_id = g.query_id WHERE g.rn <= coalesce(q.lim, 50)"""
SQ = dict(BASE, queries=FX.fx_sql(FX.SEARCH_QUERIES_SQL))
SEARCH = dict(SQ, catt=CATT, qt=QT, phrase=PHRASE, hits=HITS, grouped=GROUPED)


def _flat(df):
    return df.withColumn("frequencies", F.array_join("frequencies", ","))


@query("token_index", with_ctes(
    f"SELECT name, frequency, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS token "
    f"FROM (SELECT name, frequency, {_tok('name')} AS t FROM cat1) x", **BASE))
def token_index(spark, d):
    ix = E.build_token_index(S.catalog1(spark, d))
    return ix.select("name", "frequency", F.col("pos").cast("long").alias("pos"), "token")


@query("match_phrase", with_ctes("SELECT * FROM phrase", **SQ, catt=CATT, qt=QT, phrase=PHRASE))
def match_phrase(spark, d):
    return E.match_phrase(S.catalog1(spark, d), FX.search_queries(spark, d))


@query("match_like", with_ctes(LIKE_ALL, **SQ))
def match_like(spark, d):
    return E.match_like(S.catalog1(spark, d), FX.search_queries(spark, d))


@query("search_fallback", with_ctes("SELECT * FROM hits", **SQ, catt=CATT, qt=QT, phrase=PHRASE, hits=HITS))
def search_fallback(spark, d):
    return E.search_fallback(S.catalog1(spark, d), FX.search_queries(spark, d))


@query("search_series", with_ctes(TOPK, **SEARCH))
def search_series(spark, d):
    return _flat(E.search_series(S.catalog1(spark, d), FX.search_queries(spark, d)))


VIS_Q = """SELECT query_id, q, freq, country,
  CASE WHEN role = 'anonymous' THEN least(coalesce(lim, 50), 20) ELSE coalesce(lim, 50) END AS lim, role
  FROM raw_queries WHERE coalesce(lim, 50) <= 200"""
VIS_HITS = f"""SELECT h.* FROM hits0 h JOIN queries q ON q.query_id = h.query_id
  WHERE q.role = 'admin' OR NOT {hidden_sql('h.name')}"""
VIS = dict(BASE, raw_queries=FX.fx_sql(FX.SEARCH_QUERIES_SQL), queries=VIS_Q, catt=CATT, qt=QT, phrase=PHRASE,
           hits0=HITS, hits=VIS_HITS, grouped=GROUPED)


@query("search_visible", with_ctes(TOPK, **VIS))
def search_visible(spark, d):
    rows, _, _ = E.search_visible(S.catalog1(spark, d), FX.search_queries(spark, d), FX.HIDDEN_PATTERNS)
    return _flat(rows)


@query("search_visible_summary", with_ctes(
    f"""SELECT q.query_id, q.q, CAST(coalesce(n.count, 0) AS BIGINT) AS count, q.role <> 'anonymous' AS authenticated
        FROM queries q LEFT JOIN (SELECT query_id, count(*) AS count FROM ({TOPK}) t GROUP BY query_id) n
        ON n.query_id = q.query_id""", **VIS))
def search_visible_summary(spark, d):
    _, summary, _ = E.search_visible(S.catalog1(spark, d), FX.search_queries(spark, d), FX.HIDDEN_PATTERNS)
    return summary


@query("search_rejected", with_ctes(
    "SELECT query_id, 'limit above 200' AS error FROM queries WHERE coalesce(lim, 50) > 200",
    queries=FX.fx_sql(FX.SEARCH_QUERIES_SQL)))
def search_rejected(spark, d):
    _, _, rejected = E.search_visible(S.catalog1(spark, d), FX.search_queries(spark, d), FX.HIDDEN_PATTERNS)
    return rejected


@query("search_names", with_ctes(
    "SELECT query_id, name FROM (" + TOPK + ") t",
    **dict(BASE, raw_queries=FX.fx_sql(FX.SEARCH_QUERIES_SQL),
           queries="SELECT query_id, q, coalesce(freq, 'm') AS freq, country, lim, role FROM raw_queries",
           catt=CATT, qt=QT, phrase=PHRASE, hits=HITS, grouped=GROUPED)))
def search_names(spark, d):
    return E.search_names(S.catalog1(spark, d), FX.search_queries(spark, d))
