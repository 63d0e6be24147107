"""Registered queries that go through files: A1, A4, A5/A6 with C7/C8, and H4 to H6. Panels, stores and stream sinks lie below
the session's checkpoint folder, which all machines share."""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.dims import COUNTRIES
from seriesforge.operators import ingest as I
from seriesforge.operators import metering as MT
from seriesforge.plans import fixtures as FX
from seriesforge.plans import state as S
from seriesforge.plans.maintenance import build_store
from seriesforge.plans.q_metering import ANCH, ANCHORED, BASE_M, MONTHLY, WALK
from seriesforge.plans.q_streaming import EV, REL, ROUTE
from seriesforge.plans.registry import BASE, BASE13, OBS1, query, with_ctes
from seriesforge.session import ensure_checkpoint_dir
from seriesforge.sources import files as FL
from seriesforge.sources import panels as P
from seriesforge.sources import snapshot as SN
from seriesforge.streaming import file_events as H
from seriesforge.streaming import usage as U


def scratch(spark: SparkSession, what: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def write_panels(spark: SparkSession, obs: DataFrame, root: str, prefix: str = "") -> list[tuple[str, str]]:
    """One wide panel file for each country and frequency of ``obs`` (FX2), at ``root/<country>/``; returns the roots. One
    job writes them all, so each has the columns of all; cells that a panel hasn't are null and are no observations (B3).
    The names are few by construction: nations x segments."""
    names = sorted(r["name"] for r in obs.select("name").distinct().collect())
    wide = obs.groupBy("country", "frequency", F.col("date").alias("Date")).pivot("name", names).agg(F.first("value"))
    writing = f"{root}/_writing/{prefix or 'all'}"
    wide.repartition("country", "frequency").write.partitionBy("country", "frequency").parquet(writing)
    fs, _ = SN._fs(spark, root)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for of_country in (n for n in SN._children(spark, writing) if n.startswith("country=")):
        country = of_country.removeprefix("country=")
        fs.mkdirs(path_of(f"{root}/{country}"))
        for of_freq in SN._children(spark, f"{writing}/{of_country}"):
            folder = f"{writing}/{of_country}/{of_freq}"
            file = next(n for n in SN._children(spark, folder) if n.endswith(".parquet"))
            fs.rename(path_of(f"{folder}/{file}"), path_of(f"{root}/{country}/{prefix}{country}_{of_freq.removeprefix('frequency=')}.parquet"))
    return [(c, f"{root}/{c}") for c, _ in COUNTRIES]


def base_name(path: str):
    return F.element_at(F.split(path, "/"), -1)


FILES1 = "SELECT DISTINCT country, concat(country, '_', frequency, '.parquet') AS file_name, frequency FROM obs1"


@query("discover_files", with_ctes(f"SELECT country, file_name, frequency FROM ({FILES1}) f", obs1=OBS1))
def discover_files(spark, d):
    """A1 + A2 on the panel files of FX1, a missing root among them."""
    roots = write_panels(spark, S.obs1(spark, d), scratch(spark, "panels"))
    return FL.classify_files(FL.discover_files(spark, [*roots, ("xx", scratch(spark, "none"))])).select("country", "file_name", "frequency")


@query("read_panels", with_ctes("SELECT name, frequency, country, concat(country, '_', frequency, '.parquet') AS file_name, date, value FROM obs1", obs1=OBS1))
def read_panels(spark, d):
    """A4 + B1 to B4 on the panel files of FX1."""
    listing = FL.classify_files(FL.discover_files(spark, write_panels(spark, S.obs1(spark, d), scratch(spark, "panels")))).checkpoint()
    with P.case_sensitive(spark):
        rows = I.drop_missing(P.read_panels(spark, listing)).checkpoint()
    return rows.select("name", "frequency", "country", base_name("source_file").alias("file_name"), "date", "value")


@query("snapshot_roundtrip", with_ctes(
    """SELECT name, frequency, country, file_name, min(date) AS min_date, max(date) AS max_date, count(*) AS count, round(sum(value), 2) AS total
       FROM (SELECT name, frequency, country, concat('z_', country, '_', frequency, '.parquet') AS file_name, date, value FROM obs3
             UNION ALL
             SELECT name, frequency, country, concat(country, '_', frequency, '.parquet'), date, value FROM obs1 o
             WHERE NOT EXISTS (SELECT 1 FROM obs3 n WHERE n.name = o.name AND n.frequency = o.frequency)) x
       GROUP BY name, frequency, country, file_name""", **{k: BASE13[k] for k in ("obs1", "obs3")}))
def snapshot_roundtrip(spark, d):
    """A5 + A6 with C7 and C8 on files: FX1 panels are built, FX3 panels come and are added, and the catalog of the
    reopened store stands beside the rows it makes visible."""
    where, root = scratch(spark, "panels"), scratch(spark, "store")
    roots = write_panels(spark, S.obs1(spark, d), where)
    build_store(spark, root, roots)
    write_panels(spark, S.obs3(spark, d), where, "z_")
    build_store(spark, root, roots)
    snap = SN.open_snapshot(spark, root)
    sums = snap.visible_observations().groupBy("name", "frequency", "source_file").agg(F.count("*").alias("rows"), F.round(F.sum("value"), 2).alias("total"))
    return (snap.catalog.join(sums, ["name", "frequency", "source_file"], "left").where("rows = count")
            .select("name", "frequency", "country", base_name("source_file").alias("file_name"), "min_date", "max_date", "count", "total"))


@query("concurrent_updates", with_ctes(
    "SELECT name, frequency, country, concat(country, '_', frequency, '.parquet') AS file_name, min_date, max_date, count FROM cat1", **BASE))
def concurrent_updates(spark, d):
    """A5 + A6 with C7: four builds of one store run side by side, each for a part of the countries of FX1; the last version
    has what all of them loaded."""
    roots = write_panels(spark, S.obs1(spark, d), scratch(spark, "panels"))
    store, codes = scratch(spark, "store"), [c for c, _ in roots]

    def build(part: list[str]) -> None:
        session = spark.newSession()
        session.conf.set("spark.sql.session.timeZone", "UTC")
        build_store(session, store, roots, countries=part)
    with ThreadPoolExecutor(4) as pool:
        for done in [pool.submit(build, codes[i::4]) for i in range(4)]:
            done.result()
    return SN.open_snapshot(spark, store).catalog.select("name", "frequency", "country", base_name("source_file").alias("file_name"), "min_date", "max_date", "count")


# ---- streams over the events table ------------------------------------------------------

@query("continuous_refresh", with_ctes(
    """SELECT name, frequency, country, concat(country, '_', frequency, '.parquet') AS file_name, min_date, max_date, count FROM cat1
       WHERE country IN (SELECT country FROM routed WHERE country IS NOT NULL)""", **BASE, ev=EV, rel=REL, routed=ROUTE))
def continuous_refresh(spark, d):
    """H4 joined to C7 and C8: the file events (FX8) come as a stream, and the store holds the panels of the countries
    that they touch."""
    roots = write_panels(spark, S.obs1(spark, d), scratch(spark, "panels"))
    waiting, store = scratch(spark, "events"), scratch(spark, "store")
    FX.file_events(spark, d).write.parquet(waiting)
    routed = H.route_country(H.relevant_changes(spark.read.parquet(waiting)), FX.EVENT_ROOTS).select("country").distinct()
    left, updated = {r["country"] for r in routed.collect()}, threading.Event()  # one row a root at most

    def update(countries: list[str]) -> None:
        build_store(spark, store, roots, countries=countries)
        left.difference_update(countries)
        if not left:
            updated.set()
    if not left:  # nothing happened: the store of no country
        build_store(spark, store, [])
        updated.set()
    q = H.continuous_refresh(spark, waiting, spark.read.parquet(waiting).schema, FX.EVENT_ROOTS, update, scratch(spark, "offsets"), silence=2)
    try:
        while q.isActive and not updated.wait(0.2):
            pass
    finally:
        q.stop()
    if q.exception():
        raise q.exception()
    return SN.open_snapshot(spark, store).catalog.select("name", "frequency", "country", base_name("source_file").alias("file_name"), "min_date", "max_date", "count")


@query("debounced_stream", with_ctes(
    """SELECT country, min(ts) AS first, max(ts) AS last, count(*) AS events FROM routed WHERE country IS NOT NULL GROUP BY country""",
    ev=EV, rel=REL, routed=ROUTE))
def debounced_stream(spark, d):
    """H3 as a stream over the file events (FX8), taken in several batches: what its bursts have of each country, the last
    one included."""
    waiting, out, offsets = scratch(spark, "events"), scratch(spark, "bursts"), scratch(spark, "offsets")
    FX.file_events(spark, d).repartition(4).write.parquet(waiting)
    log = spark.readStream.schema(spark.read.parquet(waiting).schema).option("maxFilesPerTrigger", 1).parquet(waiting)
    bursts = H.debounced_stream(H.route_country(H.relevant_changes(log), FX.EVENT_ROOTS), silence=2)
    fired, batch_rows = threading.Event(), {"seen": 0}
    total = H.route_country(H.relevant_changes(FX.file_events(spark, d)), FX.EVENT_ROOTS).count()

    spark.createDataFrame([], H.BURSTS).write.parquet(f"{out}/epoch=0000")  # there may be no events
    if not total:
        fired.set()

    def keep(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")  # again after a failure: the same rows
        batch_rows["seen"] += spark.read.schema(batch.schema).parquet(f"{out}/epoch={epoch_id}").agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
        if batch_rows["seen"] >= total:
            fired.set()
    with H.timers(spark):
        q = bursts.writeStream.outputMode("append").option("checkpointLocation", offsets).foreachBatch(keep).trigger(processingTime="500 milliseconds").start()
    try:
        while q.isActive and not fired.wait(0.2):
            pass
    finally:
        q.stop()
    if q.exception():
        raise q.exception()
    return (spark.read.schema(H.BURSTS).parquet(f"{out}/epoch=*").groupBy("country")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")))


def _arriving(spark: SparkSession, d: str, start, parts: int = 3) -> None:
    """The request log (FX7) comes in parts, in the order of time; ``start`` (attributed stream -> query) takes each and is
    started anew for the next. Keys and members are as they stand."""
    waiting, log = scratch(spark, "log"), FX.request_log(spark, d)
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).cast("double")
    cuts = log.select(at.alias("at")).approxQuantile("at", [i / parts for i in range(1, parts)], 0.01)
    cuts = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(cuts, cuts[1:]):
        log.where((at > low) & (at <= high)).write.mode("append").parquet(waiting)
        stream = spark.readStream.schema(log.schema).parquet(waiting)
        start(MT.attribute_requests(stream, FX.keys(spark, d), FX.members(spark, d), FX.ADMIN_KEYS)).awaitTermination()


@query("monthly_usage_stream", with_ctes(
    "SELECT api_key, strftime(ts, '%Y-%m') AS month, count(*) AS count FROM charged "
    "WHERE auth_type = 'user_api_key' GROUP BY api_key, strftime(ts, '%Y-%m')", **BASE_M))
def monthly_usage_stream(spark, d):
    """H5: the log in parts, each of which writes the counts it touched; the table after the last."""
    out, offsets = scratch(spark, "usage"), scratch(spark, "offsets")
    _arriving(spark, d, lambda stream: (
        U.monthly_usage_stream(stream, FX.HIDDEN_PATTERNS).writeStream.outputMode("update").option("checkpointLocation", offsets)
        .trigger(availableNow=True).foreachBatch(U.usage_sink(out)).start()))
    return U.usage_table(spark, out)


def _admission(spark: SparkSession, d: str, rule: str) -> DataFrame:
    out, offsets = scratch(spark, "admission"), scratch(spark, "offsets")
    with U.keyed_state(spark):
        _arriving(spark, d, lambda stream: (
            U.admission_stream(stream, rule, FX.HIDDEN_PATTERNS).writeStream.outputMode("append").format("parquet")
            .option("checkpointLocation", offsets).option("path", out).trigger(availableNow=True).start()))
    return spark.read.parquet(out).select("event_id", "ts", "identity", "used", "admitted")


@query("admission_stream", with_ctes(f"SELECT event_id, ts, api_key AS identity, used, admitted FROM ({MONTHLY}) m", **BASE_M))
def admission_stream(spark, d):
    """H6 (monthly rule) with the log in parts."""
    return _admission(spark, d, "monthly")


@query("admission_stream_anchored", with_ctes(
    f"SELECT event_id, ts, identity, used, admitted FROM ({ANCHORED}) m", _recursive=True, **BASE_M, anch=ANCH, walk=WALK))
def admission_stream_anchored(spark, d):
    """H6 (rolling windows) with the log in parts."""
    return _admission(spark, d, "anchored")
