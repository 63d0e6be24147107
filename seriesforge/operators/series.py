"""F1–F8: resolve requested series, slice by date, shape the answer.

Requests are DataFrames, so a batch of lookups is one job: the requests join
the catalog on ``name`` (requests are the small, broadcastable side), the
resolved keys join the observations on (name, frequency, source_file) - the
source file makes the join return only the owner's rows - and the per-row
text range predicate filters the slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.dates import in_bounds, literal_range, with_bounds

_CAT = ["country", "frequency", "source_file", "min_date", "max_date", "count"]


def _blank(c):
    return F.coalesce(F.col(c), F.lit("")) == ""


def resolve_series(requests: DataFrame, cat: DataFrame, req_keys=("request_id",),
                   carry=("start_date", "end_date")) -> DataFrame:
    """given freq -> exact key; no freq -> 'm', else the lowest code.

    ``requests`` has ``req_keys``, ``name``, ``freq``. One row per
    (request, name) that resolves.
    """
    keys = list(req_keys)
    carry = [c for c in carry if c in requests.columns]
    r = requests.select(*keys, "name", "freq", *carry).distinct()
    cols = [*_CAT, F.col("load_seq.run").alias("load_run")] if "load_seq" in cat.columns else _CAT
    names = [*_CAT, "load_run"] if "load_seq" in cat.columns else _CAT
    c = cat.select("name", *cols)
    j = r.join(c, "name").where(_blank("freq") | (F.col("frequency") == F.col("freq")))
    pref = F.struct((F.col("frequency") != "m").alias("not_m"), F.col("frequency"))
    picked = j.groupBy(*keys, "name", "freq", *carry).agg(F.min_by(F.struct(*names), pref).alias("_s"))
    return picked.select(*keys, "name", "freq", *carry, *[F.col(f"_s.{x}").alias(x) for x in names])


def slice_range(obs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """inclusive bounds from driver-side text, as date literals (pushed down)."""
    return obs.where(literal_range(F.col("date"), start, end))


def series_slice(resolved: DataFrame, obs: DataFrame, req_keys=("request_id",)) -> DataFrame:
    """Owned observations of each resolved request inside its own range (the
    rule of visibility of C3: the owner's file and, where known, its run)."""
    keys = list(req_keys)
    owner = ["name", "frequency", "source_file"]
    if "load_run" in obs.columns and "load_run" in resolved.columns:
        owner.append("load_run")
    r = with_bounds(resolved.select(*keys, *owner, "start_date", "end_date"))
    o = obs.select(*owner, "date", "value")
    return r.join(o, owner).where(in_bounds(F.col("date")))


def get_series(resolved: DataFrame, obs: DataFrame, req_keys=("request_id",), nested: bool = False) -> DataFrame:
    """per resolved request: count, first and last date of the slice
    (catalog dates when the slice is empty); ``nested`` adds ``data`` =
    array<struct<date,value>> in date order (use for bounded slices)."""
    keys = list(req_keys)
    sl = series_slice(resolved, obs, keys)
    aggs = [F.count("date").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")]
    if nested:
        aggs.append(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("data"))
    per = sl.groupBy(*keys, "name").agg(*aggs)
    out = resolved.join(per, [*keys, "name"], "left")
    cols = [*keys, F.col("name").alias("series_name"), "country", "frequency",
            F.coalesce("n", F.lit(0)).cast("long").alias("count"),
            F.when(F.coalesce("n", F.lit(0)) > 0, F.col("lo")).otherwise(F.col("min_date")).alias("min_date"),
            F.when(F.coalesce("n", F.lit(0)) > 0, F.col("hi")).otherwise(F.col("max_date")).alias("max_date")]
    if nested:
        cols.append(F.coalesce("data", F.array().cast("array<struct<date:date,value:double>>")).alias("data"))
    return out.select(*cols)


def get_series_long(resolved: DataFrame, obs: DataFrame, req_keys=("request_id",)) -> DataFrame:
    """F4 flat form: one row per returned observation (distributed, unbounded-safe)."""
    keys = list(req_keys)
    sl = series_slice(resolved, obs, keys)
    return sl.select(*keys, F.col("name").alias("series_name"), "frequency", "date", "value")


def parse_names(requests: DataFrame, col: str = "columns", req_keys=("request_id",)) -> DataFrame:
    """split on ';' and trim (names contain commas). Keeps position."""
    keys = list(req_keys)
    parts = F.posexplode(F.transform(F.split(F.col(col), ";"), lambda s: F.trim(s)))
    others = [c for c in requests.columns if c not in keys and c != col]
    return requests.select(*keys, *others, parts.alias("pos", "name"))


def not_found(requested: DataFrame, resolved: DataFrame, req_keys=("request_id",)) -> DataFrame:
    """requested names without a match (repeats kept, blanks included)."""
    keys = list(req_keys)
    return requested.join(resolved.select(*keys, "name").distinct(), [*keys, "name"], "left_anti")


def series_info(names: DataFrame, cat: DataFrame) -> DataFrame:
    """F8 (flat): per requested name and frequency: count, min, max, plus the
    name's country as reported (the country at the highest frequency code)."""
    n = names.select("name").distinct()
    c = cat.select("name", "frequency", "country", "count", "min_date", "max_date")
    j = c.join(n, "name", "left_semi")
    ctry = j.groupBy("name").agg(F.max_by("country", "frequency").alias("info_country"))
    return j.join(ctry, "name").select("name", F.col("info_country").alias("country"), "frequency",
                                       "count", "min_date", "max_date")


def series_info_nested(names: DataFrame, cat: DataFrame) -> DataFrame:
    """F8: name, country, map frequency -> struct(count, min_date, max_date)."""
    flat = series_info(names, cat)
    entry = F.struct("frequency", F.struct("count", "min_date", "max_date"))
    return flat.groupBy("name", "country").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("frequencies"))
