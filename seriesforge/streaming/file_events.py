"""H1–H4: file-change events -> debounced incremental updates.

H1/H2 are row-local expressions (no join: the roots are a short ordered
list, so "first root that is a prefix" is an ordered CASE). H3 in batch form
sessionises with a 30 s gap using hour buckets (no single-task global
window over events). The stream form keeps one timer for all countries, in
processing time: each event restarts it, and after 30 s of silence the
countries seen are one update. Countries and timer are state, at most one row
a root, so a restart goes on where it was; there is no watermark, so late
events count like others. H4 runs the updates and feeds failed ones back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from seriesforge.sources.files import is_excluded, suffix_frequency

KINDS = ["created", "modified", "deleted"]
DEBOUNCE = "30 seconds"
DEBOUNCE_SECONDS = 30


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relevant_changes(events: DataFrame) -> DataFrame:
    """H1: created/modified/deleted events on valid panel names (suffix test
    in any case here), not excluded."""
    name = file_name(F.col("path"))
    return events.where(F.col("kind").isin(KINDS) & suffix_frequency(name, any_case=True).isNotNull()
                        & ~is_excluded(name))


def route_country(events: DataFrame, roots: Sequence[tuple[str, str]]) -> DataFrame:
    """H2: country of the first root that prefixes the path; others dropped."""
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for country, root in roots:
        expr = expr.when(F.col("path").startswith(root), F.lit(country))
    return events.withColumn("country", expr).where(F.col("country").isNotNull())


def debounced_batches(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """H3 (batch): sessions of events separated by gaps <= 30 s; one row per
    session (start, end = last event + 30 s, sorted countries).

    Previous-event lookup and session ids are computed inside time buckets;
    the carry between buckets uses bucket-level rows only.
    """
    e = events.select("ts", "country", F.date_trunc(bucket, "ts").alias("_b"))
    wb = Window.partitionBy("_b").orderBy("ts")
    e = e.withColumn("_prev", F.lag("ts").over(wb))
    per_b = e.groupBy("_b").agg(F.max("ts").alias("_last"))
    wl = Window.orderBy("_b")  # bucket-level rows only (one per non-empty bucket)
    per_b = per_b.withColumn("_carry_prev", F.lag("_last").over(wl))
    e = e.join(per_b.select("_b", "_carry_prev"), "_b")
    prev = F.coalesce(F.col("_prev"), F.col("_carry_prev"))
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    e = e.withColumn("_start", F.when(prev.isNull() | (gap > DEBOUNCE_SECONDS * 1_000_000), F.col("ts")))
    wrun = wb.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("_sid_local", F.max("_start").over(wrun))
    starts = e.groupBy("_b").agg(F.max("_start").alias("_bstart"))
    starts = starts.withColumn("_carry", F.last("_bstart", ignorenulls=True).over(
        wl.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.join(starts.select("_b", "_carry"), "_b").withColumn("sid", F.coalesce("_sid_local", "_carry"))
    return e.groupBy("sid").agg(
        F.min("ts").alias("start"),
        (F.max("ts") + F.expr(f"INTERVAL {DEBOUNCE}")).alias("end"),
        F.array_sort(F.collect_set("country")).alias("countries")).drop("sid")


# times are microseconds inside: the same in tasks of any time zone
SEEN = "country string, first long, last long, events long"
_FIRED = "burst long, country string, first long, last long, events long"
BURSTS = "burst timestamp, country string, first timestamp, last timestamp, events long"


def _seen() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Events of a chunk as a row a country: what is shuffled doesn't grow with a burst's events."""
    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            if len(chunk):
                chunk["ts"] = chunk["ts"].astype("Int64")  # nulls stay nulls
                yield chunk.groupby("country", as_index=False).agg(first=("ts", "min"), last=("ts", "max"), events=("ts", "size"))
    return run


def _debouncer(silence_ms: int) -> StatefulProcessor:
    """One timer for all countries. Made here, so that it travels to the executors by value."""
    from pyspark.sql import Row
    from pyspark.sql import types as T
    from pyspark.sql.streaming import StatefulProcessor

    country = T.StructType([T.StructField("country", T.StringType())])
    seen = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("events", T.LongType())])
    timer = T.StructType([T.StructField("at", T.LongType())])

    class Debouncer(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.countries = handle.getMapState("countries", country, seen)
            self.timer = handle.getValueState("timer", timer)

        def handleInputRows(self, key, rows, timerValues):
            merged = {name[0]: tuple(old) for name, old in self.countries.iterator()}  # a row a root at most
            for r in rows:
                first, last, events = merged.get(r.country, (None, None, 0))
                merged[r.country] = (min((t for t in (first, r.first) if t is not None), default=None),
                                     max((t for t in (last, r.last) if t is not None), default=None), events + r.events)
            for name, now in merged.items():
                self.countries.updateValue((name,), now)
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + silence_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            burst = expiredTimerInfo.getExpiryTimeInMs() * 1000
            rows = [Row(burst=burst, country=name[0], first=first, last=last, events=events) for name, (first, last, events) in self.countries.iterator()]
            self.countries.clear()
            self.timer.clear()
            return iter(rows)

        def close(self):
            pass

    return Debouncer()


def debounced_stream(events: DataFrame, silence: float = DEBOUNCE_SECONDS) -> DataFrame:
    """H3 (streaming) over routed events (ts, country): once ``silence`` seconds have gone by without an event, a row for
    each country seen since the last time: when the silence was full, the country, its first and last event's time and the
    number of its events. Late events count like others; a null ``ts`` is an event without a time. Append mode; start the
    query inside ``timers``."""
    seen = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "country").mapInPandas(_seen(), SEEN)
    fired = seen.withColumn("all", F.lit("all")).groupBy("all").transformWithState(
        statefulProcessor=_debouncer(int(silence * 1000)), outputStructType=_FIRED, outputMode="append", timeMode="ProcessingTime")
    return fired.select(*(F.timestamp_micros(c).alias(c) if c in ("burst", "first", "last") else F.col(c) for c in fired.columns))


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """The session's settings are ``conf`` inside, what they were after it."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def timers(spark: SparkSession):
    """Settings that a query with timers keeps from its start: state in RocksDB, in one partition as there is one key."""
    return settings(spark, {**ROCKSDB, "spark.sql.shuffle.partitions": "1"})


def continuous_refresh(spark, events_dir: str, schema, roots: Sequence[tuple[str, str]], on_batch: Callable[[list[str]], object],
                       checkpoint: str, once: bool = False, silence: float = DEBOUNCE_SECONDS, every: str = "1 second") -> StreamingQuery | None:
    """H4: read change events as a stream and call ``on_batch(countries)`` (normally ``maintenance.build_store``) after each
    ``silence`` seconds without an event, for the countries seen since the last call. Events that come during an update wait
    for the next one. A failed update is printed and its countries become events themselves, in a folder beside the
    checkpoint that the stream reads too: they are tried again after the next silence, without a new event and after a
    restart. A batch that is run again repeats its update, which compares files by time and does no harm. ``every`` is how
    often timers are looked at. ``once`` updates all countries, whatever came, and returns None; an update that fails raises."""
    if once:
        on_batch([c for c, _ in roots])
        return None
    again, again_schema = f"{checkpoint.rstrip('/')}-again", "ts timestamp, country string"
    spark.createDataFrame([], again_schema).write.mode("append").parquet(again)  # the folder is there
    changes = route_country(relevant_changes(spark.readStream.schema(schema).parquet(events_dir)), roots)
    events = changes.select(F.col("ts").cast("timestamp").alias("ts"), "country").unionByName(spark.readStream.schema(again_schema).parquet(again))

    def run(batch: DataFrame, epoch_id: int) -> None:
        countries = sorted({r["country"] for r in batch.select("country").collect()})  # one row a root at most
        if not countries:
            return
        try:
            on_batch(countries)
        except Exception as exc:  # a failed update is reported, the stream continues
            print(f"update failed for {countries}: {exc}")
            failed = spark.createDataFrame([(c,) for c in countries], "country string").select(F.current_timestamp().alias("ts"), "country")
            failed.coalesce(1).write.mode("append").parquet(again)

    with timers(spark):
        return (debounced_stream(events, silence).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                .foreachBatch(run).trigger(processingTime=every).start())
