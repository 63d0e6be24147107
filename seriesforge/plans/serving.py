"""Requests answered from a stored snapshot: search on its indexes, lookups on
its partitions.

A lookup first resolves its requests against the catalog (a batch of requests
is small beside the rows they ask for). The runs, frequencies and days that the
resolved requests need then become literals, so the scan of the observations
reads their partitions and row groups only; names go through the bloom filter
of the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.dates import with_bounds
from seriesforge.operators import search as E
from seriesforge.operators import series as SR
from seriesforge.operators import visibility as V
from seriesforge.session import ensure_checkpoint_dir
from seriesforge.sources.snapshot import Snapshot

#: Names that a lookup writes into the scan; more are joined only.
MAX_LITERAL_NAMES = 200


def _needed(resolved: DataFrame, obs: DataFrame) -> DataFrame:
    """The observations that ``resolved`` can need, by literals that reach the scan."""
    b = with_bounds(resolved)
    open_lo, open_hi = F.col("_lo").isNull(), F.col("_hi").isNull()
    keys = resolved.select("frequency", "load_run").distinct().collect()  # as many as runs were not compacted since
    span = b.agg(F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), F.max(open_lo).alias("any_start"), F.max(open_hi).alias("any_end")).first()
    if not keys:
        return obs.limit(0)
    obs = obs.where(F.col("frequency").isin(sorted({k["frequency"] for k in keys})) & F.col("load_run").isin(sorted({k["load_run"] for k in keys})))
    if not span["any_start"]:
        obs = obs.where(F.col("date") >= F.lit(span["lo"]))
    if not span["any_end"]:
        obs = obs.where(F.col("date") < F.lit(span["hi"]))
    few = [r["name"] for r in resolved.select("name").distinct().limit(MAX_LITERAL_NAMES + 1).collect()]
    return obs.where(F.col("name").isin(few)) if len(few) <= MAX_LITERAL_NAMES else obs  # a filter, not another result


def get_series(snap: Snapshot, requests: DataFrame, hidden=None, nested: bool = False, long: bool = False) -> DataFrame:
    """F1 + F4 (and F6, F9 with ``hidden`` patterns and a ``role`` column) on a stored snapshot."""
    ensure_checkpoint_dir(requests.sparkSession)
    if hidden is not None:
        requests = V.hide_series(requests, hidden, admin=F.col("role") == "admin")
    resolved = SR.resolve_series(requests, snap.catalog).checkpoint(eager=True)
    obs = _needed(resolved, snap.observations)
    return SR.get_series_long(resolved, obs) if long else SR.get_series(resolved, obs, nested=nested)


def search(snap: Snapshot, queries: DataFrame) -> DataFrame:
    """E6 on the stored token and gram indexes."""
    return E.search_series(snap.catalog, queries, snap.token_index, snap.gram_index)


def search_visible(snap: Snapshot, queries: DataFrame, hidden) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E8 on the stored indexes."""
    return E.search_visible(snap.catalog, queries, hidden, snap.token_index, snap.gram_index)
