"""Catalog ownership, observation replacement, change detection.

The catalog is persisted ownership state: one row per series key
(name, frequency) naming the file (and load) whose observations are visible.
Merging is "last load wins" by ``load_seq`` = (run, country rank, path) and is
computed with ``max_by`` in a hash aggregate (partial aggregation before the
shuffle), never by re-reading every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge import schemas

KEY = ["name", "frequency"]
_CAT_COLS = ["country", "source_file", "min_date", "max_date", "count", "load_seq"]


def _latest(df: DataFrame, keys: list[str], cols: list[str], order_col: str) -> DataFrame:
    """One row per key: the row with the greatest ``order_col``."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("_w"))
    return picked.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in cols])


def upsert_catalog(cat: DataFrame, new_meta: DataFrame) -> DataFrame:
    """Insert or replace on (name, frequency); the later load replaces
    country, source file, dates and count. ``new_meta`` carries ``load_seq``."""
    incoming = new_meta.select(*KEY, *_CAT_COLS)
    return _latest(cat.select(*KEY, *_CAT_COLS).unionByName(incoming), KEY, _CAT_COLS, "load_seq")


def catalog_from_meta(meta: DataFrame) -> DataFrame:
    """C1 from an empty catalog (full rebuild): the last loader of each key."""
    return _latest(meta.select(*KEY, *_CAT_COLS), KEY, _CAT_COLS, "load_seq")


def owned_observations(obs: DataFrame, cat: DataFrame) -> DataFrame:
    """Observations visible through their owner (net effect of C1+C2).

    The one rule of visibility: name, frequency and file are the owner's and,
    where rows know the run that wrote them, so is the run. A left-semi join;
    AQE turns it into a broadcast join when the measured catalog is small and
    splits skewed keys otherwise.
    """
    keys = [*KEY, "source_file"]
    if "load_run" in obs.columns and "load_seq" in cat.columns:
        cat = cat.withColumn("load_run", F.col("load_seq.run"))
        keys.append("load_run")
    return obs.join(cat.select(*keys), keys, "left_semi")


def replace_observations(obs: DataFrame, new_obs: DataFrame, owned_keys: DataFrame) -> DataFrame:
    """Drop every old row of the series keys a load now owns, add the new rows."""
    keep = obs.join(owned_keys.select(*KEY).distinct(), KEY, "left_anti")
    return keep.unionByName(new_obs.select(*obs.columns))


def detect_changes(files: DataFrame, manifest: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """C4: (path, country, frequency, status) with status changed/unchanged/removed.

    ``files`` = classified listing (path, country, frequency, mtime);
    ``manifest`` = (filepath, country, mtime). A file is changed when unknown
    or when its mtime differs; a manifest row of the same countries that is
    no longer listed is removed. One full outer join on the path.
    """
    m = manifest
    if countries:
        m = m.where(F.col("country").isin(list(countries)))
        files = files.where(F.col("country").isin(list(countries)))
    f = files.select(F.col("path"), F.col("country").alias("f_country"),
                     F.col("frequency"), F.col("mtime").alias("f_mtime"))
    m = m.select(F.col("filepath").alias("path"), F.col("country").alias("m_country"),
                 F.col("mtime").alias("m_mtime"))
    j = f.join(m, "path", "full_outer")
    status = (F.when(F.col("f_country").isNull(), F.lit("removed"))
              .when(F.col("m_country").isNull() | ~F.col("f_mtime").eqNullSafe(F.col("m_mtime")),
                    F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    return j.select("path", F.coalesce("f_country", "m_country").alias("country"), "frequency",
                    status.alias("status"))


def change_report(changes: DataFrame) -> DataFrame:
    """C11: counts scanned / changed / unchanged / removed (one row)."""
    st = F.col("status")
    return changes.agg(
        F.count_if(st != "removed").alias("scanned"),
        F.count_if(st == "changed").alias("changed"),
        F.count_if(st == "unchanged").alias("unchanged"),
        F.count_if(st == "removed").alias("removed"))


def remove_source(cat: DataFrame, obs: DataFrame, manifest: DataFrame, paths: DataFrame):
    """Drop the series a file owns, their observations and its manifest row.

    ``paths`` is a one-column DataFrame (``path``). Returns
    (catalog', observations', manifest', removed series per path).
    """
    p = paths.select(F.col("path").alias("source_file")).distinct()
    gone = cat.join(p, "source_file", "left_semi").select(*KEY, "source_file")
    cat2 = cat.join(p, "source_file", "left_anti")
    obs2 = obs.join(gone.select(*KEY), KEY, "left_anti")
    man2 = manifest.join(p.withColumnRenamed("source_file", "filepath"), "filepath", "left_anti")
    counts = gone.groupBy(F.col("source_file").alias("path")).agg(F.count(F.lit(1)).alias("series_removed"))
    counts = p.select(F.col("source_file").alias("path")).join(counts, "path", "left").fillna(0, ["series_removed"])
    return cat2, obs2, man2, counts


def upsert_manifest(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Record loads that gave >= 1 series; an existing row keeps its
    country/frequency and takes the new mtime, count and time."""
    new = loaded.where(F.col("series_count") > 0)
    cols = ["filepath", "country", "frequency", "mtime", "series_count", "last_processed"]
    old = manifest.select(*cols)
    j = old.join(new.select(*cols).alias("n"), "filepath", "full_outer")
    pick = lambda c, keep_old: (F.coalesce(old[c], F.col(f"n.{c}")) if keep_old
                                else F.when(F.col("n.filepath").isNotNull(), F.col(f"n.{c}")).otherwise(old[c]))
    return j.select("filepath", pick("country", True).alias("country"), pick("frequency", True).alias("frequency"),
                    pick("mtime", False).alias("mtime"), pick("series_count", False).alias("series_count"),
                    pick("last_processed", False).alias("last_processed"))


def evolve_catalog(cat: DataFrame) -> DataFrame:
    """Add a missing ``source_file`` (and any other catalog column) as null."""
    spark = cat.sparkSession
    empty = spark.createDataFrame([], schemas.CATALOG)
    return empty.unionByName(cat, allowMissingColumns=True)


def needs_rebuild(spark: SparkSession, cat: DataFrame | None, manifest: DataFrame | None) -> bool:
    """Rebuild when there is no store, no manifest, no ``source_file``
    column, or an empty manifest next to a non-empty catalog.

    Two one-row ``limit(1)`` probes; nothing else is read.
    """
    if cat is None or manifest is None:
        return True
    if "source_file" not in cat.columns:
        return True
    tracked = len(manifest.limit(1).take(1)) > 0
    has_series = len(cat.limit(1).take(1)) > 0
    return (not tracked) and has_series


def needs_rebuild_df(cat: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """C9 as a one-row plan (the schema part is decided while planning)."""
    spark = cat.sparkSession
    if manifest is None or "source_file" not in cat.columns:
        return spark.range(1).select(F.lit(True).alias("needs_rebuild"))
    tracked = manifest.agg(F.count(F.lit(1)).alias("tracked")).withColumn("_k", F.lit(1))
    series = cat.agg(F.count(F.lit(1)).alias("series")).withColumn("_k", F.lit(1))
    return tracked.join(series, "_k").select(((F.col("tracked") == 0) & (F.col("series") > 0)).alias("needs_rebuild"))
