"""Full-text phrase search with a substring fallback, over a
DataFrame of queries (one job for a whole batch of searches).

Plan shape
* phrase (E2): every query is joined to the token index on its *rarest*
  token (document frequency from the index), then verified with a substring
  test on the space-joined token text - exact, and a hot token such as a
  country name never fans a query out to a third of the catalog;
* substring (E3): the index holds the 1-, 2- and 3-character grams of each
  name, and the empty gram; a query joins it on the rarest 3-gram of its
  longest literal run, on that run itself if it is shorter, and on the empty
  gram if it has no literal at all (such a pattern matches by length alone),
  and is verified with LIKE - an equi-join for every pattern;
* fallback (E5): the substring path runs only for queries with no phrase hit
  after facets (``left_anti`` on query_id);
* grouping + top-k (E6): hash aggregate per (query, name), then
  ``row_number() <= limit`` per query, which Catalyst plans as a
  WindowGroupLimit (partial top-k before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.functions import text as TX
from seriesforge.functions.dims import ANONYMOUS_SEARCH_LIMIT, DEFAULT_SEARCH_LIMIT, MAX_SEARCH_LIMIT
from seriesforge.operators import visibility as V

NGRAM = 3


def build_token_index(cat: DataFrame) -> DataFrame:
    """(token, pos, name, frequency, country, ntext) per catalog row."""
    tok = TX.tokens(F.col("name"))
    base = cat.select("name", "frequency", "country", tok.alias("_tok"))
    return base.select(F.posexplode("_tok").alias("pos", "token"), "name", "frequency", "country",
                       TX.token_text(F.col("_tok")).alias("ntext"))


def build_gram_index(cat: DataFrame, n: int = NGRAM) -> DataFrame:
    """Character grams of up to ``n`` characters of the ASCII-folded name: (gram, name, frequency, country)."""
    return cat.select("name", "frequency", "country", F.explode(TX.grams_up_to(TX.ascii_fold(F.col("name")), n)).alias("gram"))


def _facets(freq: Column, country: Column) -> Column:
    f_ok = (F.coalesce(freq, F.lit("")) == "") | (F.col("frequency") == freq)
    c_ok = (F.coalesce(country, F.lit("")) == "") | (F.col("country") == country)
    return f_ok & c_ok


def _rarest(keys: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Per query the key with the lowest document frequency in ``index``."""
    df = index.groupBy(key).agg(F.count(F.lit(1)).alias("_df"))
    j = keys.join(df, key)
    return j.groupBy("query_id").agg(F.min_by(F.col(key), F.struct("_df", key)).alias(key))


def match_phrase(cat: DataFrame, queries: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """E2 (+E4): (query_id, name, frequency, country) for phrase hits."""
    index = index if index is not None else build_token_index(cat)
    q = queries.select("query_id", "freq", "country",
                       TX.tokens(F.translate(F.col("q"), "\"'", "")).alias("_qt"))
    q = q.where(F.size("_qt") > 0).select("query_id", F.col("freq").alias("_freq"),
                                          F.col("country").alias("_country"), "_qt",
                                          TX.token_text(F.col("_qt")).alias("_phrase"))
    keys = q.select("query_id", F.explode("_qt").alias("token"))
    pick = _rarest(keys, index, "token")
    cand = pick.join(index, "token").join(q, "query_id")
    hits = cand.where(F.col("ntext").contains(F.col("_phrase")) & _facets(F.col("_freq"), F.col("_country")))
    return hits.select("query_id", "name", "frequency", "country").distinct()


def match_like(cat: DataFrame, queries: DataFrame, gram_index: DataFrame | None = None) -> DataFrame:
    """E3 (+E4): ``name LIKE '%q%'`` with SQLite semantics (raw q). A null q matches nothing."""
    gram_index = gram_index if gram_index is not None else build_gram_index(cat.select("name", "frequency", "country"))
    run = F.coalesce(F.try_element_at(TX.like_literal_runs(F.col("q")), F.lit(1)), F.lit(""))
    q = queries.where(F.col("q").isNotNull()).select(
        "query_id", F.col("q").alias("_q"), F.col("freq").alias("_freq"), F.col("country").alias("_country"), run.alias("_run"))
    pick = _rarest(q.select("query_id", F.explode(TX.widest_grams(F.col("_run"), NGRAM)).alias("gram")), gram_index, "gram")
    hits = pick.join(gram_index, "gram").join(q, "query_id")
    return (hits.where(TX.like_contains(F.col("name"), F.col("_q")) & _facets(F.col("_freq"), F.col("_country")))
            .select("query_id", "name", "frequency", "country"))


def search_fallback(cat: DataFrame, queries: DataFrame, index: DataFrame | None = None,
                    gram_index: DataFrame | None = None) -> DataFrame:
    """E5: phrase hits; substring hits only for queries with no phrase hit."""
    phrase = match_phrase(cat, queries, index)
    rest = queries.join(phrase.select("query_id").distinct(), "query_id", "left_anti")
    return phrase.unionByName(match_like(cat, rest, gram_index))


def group_hits(hits: DataFrame) -> DataFrame:
    """E6 grouping: per (query, name) sorted distinct frequencies, country at
    the lowest frequency code."""
    return hits.groupBy("query_id", "name").agg(
        F.array_sort(F.collect_set("frequency")).alias("frequencies"),
        F.min_by("country", "frequency").alias("country"))


def top_k(grouped: DataFrame, limit: Column) -> DataFrame:
    """First ``limit`` names per query in name order (WindowGroupLimit)."""
    w = Window.partitionBy("query_id").orderBy("name")
    return grouped.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def _signatures(queries: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Identical requests are searched once: (query_id -> sig) and distinct sigs
    as a query table whose ``query_id`` is the signature text."""
    sig = F.to_json(F.struct(*[F.col(c) for c in cols]))
    keyed = queries.withColumn("_sig", sig)
    distinct = keyed.select(F.col("_sig").alias("query_id"), *cols).dropDuplicates(["query_id"])
    return keyed.select("query_id", "_sig"), distinct


def _expand(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(rows.withColumnRenamed("query_id", "_sig"), "_sig").drop("_sig")


def search_series(cat: DataFrame, queries: DataFrame, index: DataFrame | None = None,
                  gram_index: DataFrame | None = None) -> DataFrame:
    """(query_id, name, country, frequencies) - ``lim`` column or 50.
    Repeated (q, freq, country, lim) requests are answered once."""
    ids, sigs = _signatures(queries, ["q", "freq", "country", "lim"])
    hits = search_fallback(cat, sigs, index, gram_index)
    grouped = group_hits(hits).join(sigs.select("query_id", "lim"), "query_id")
    lim = F.coalesce(F.col("lim"), F.lit(DEFAULT_SEARCH_LIMIT))
    rows = top_k(grouped, lim).select("query_id", "name", "country", "frequencies")
    return _expand(rows, ids)


def search_visible(cat: DataFrame, queries: DataFrame, patterns, index: DataFrame | None = None,
                   gram_index: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Limit rules, hidden series removed for non-admin before the top-k.

    ``queries`` has (query_id, q, freq, country, lim, role) with role in
    anonymous/user/admin. Returns (rows, per-query summary, rejected queries).
    """
    lim = F.coalesce(F.col("lim"), F.lit(DEFAULT_SEARCH_LIMIT))
    rejected = queries.where(lim > MAX_SEARCH_LIMIT).select("query_id", F.lit("limit above 200").alias("error"))
    ok = queries.where(lim <= MAX_SEARCH_LIMIT).withColumn(
        "lim", F.when(F.col("role") == "anonymous", F.least(lim, F.lit(ANONYMOUS_SEARCH_LIMIT))).otherwise(lim))
    ok = ok.withColumn("_admin", F.col("role") == "admin")
    ids, sigs = _signatures(ok, ["q", "freq", "country", "lim", "_admin"])
    hits = search_fallback(cat, sigs, index, gram_index)
    hits = hits.join(sigs.select("query_id", "_admin"), "query_id")
    hits = V.hide_series(hits, patterns, admin=F.col("_admin"))
    grouped = group_hits(hits).join(sigs.select("query_id", "lim"), "query_id")
    rows = _expand(top_k(grouped, F.col("lim")).select("query_id", "name", "country", "frequencies"), ids)
    summary = (ok.select("query_id", "q", "role")
               .join(rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("count")), "query_id", "left")
               .select("query_id", "q", F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                       (F.col("role") != "anonymous").alias("authenticated")))
    return rows, summary, rejected


def search_names(cat: DataFrame, queries: DataFrame, **kw) -> DataFrame:
    """Names only, frequency defaulting to 'm', no visibility filter."""
    q = queries.withColumn("freq", F.when(F.col("freq").isNull(), F.lit("m")).otherwise(F.col("freq")))
    return search_series(cat, q, **kw).select("query_id", "name")


def substring_semi_join(left: DataFrame, left_col: str, patterns: DataFrame, pat_col: str,
                        lower: bool = True) -> DataFrame:
    """Distinct ``left_col`` values containing any pattern (exact): an equi-join
    on a pattern's first 3-gram, or on the whole pattern if it is shorter."""
    txt = F.lower(F.col(left_col)) if lower else F.col(left_col)
    values = left.select(F.col(left_col).alias("_v"), txt.alias("_t")).distinct()
    wanted = patterns.select(F.col(pat_col).alias("_p")).where("_p IS NOT NULL").distinct().withColumn("gram", F.substring("_p", 1, NGRAM))
    grams = values.select("_v", "_t", F.explode(TX.grams_up_to(F.col("_t"), NGRAM)).alias("gram"))
    hits = grams.join(wanted, "gram").where(F.col("_t").contains(F.col("_p")))
    return hits.select(F.col("_v").alias(left_col)).distinct()
