"""Registered queries for A2/A3 and C1–C11 (catalog maintenance)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesforge.operators import catalog as C
from seriesforge.operators import ingest as I
from seriesforge.plans import fixtures as FX
from seriesforge.plans import maintenance as M
from seriesforge.plans import state as S
from seriesforge.plans.registry import BASE, BASE13, CRANK, META, OBS1, OBS3, query, with_ctes
from seriesforge.sources import files as FL

CAT_COLS = ["name", "frequency", "country", "source_file", "min_date", "max_date", "count"]
LISTING = FX.fx_sql(FX.FILE_LISTING_SQL)
MANIFEST = FX.fx_sql(FX.MANIFEST_SQL)
CLASSIFIED = ("SELECT *, regexp_extract(file_name, '_([mqa])\\.parquet$', 1) AS frequency FROM listing "
              "WHERE regexp_matches(file_name, '_([mqa])\\.parquet$') AND NOT regexp_matches(lower(file_name), "
              "'latest|recent|hist')")
CHANGES = """SELECT coalesce(f.path, m.path) AS path, coalesce(f.country, m.country) AS country, f.frequency,
  CASE WHEN f.path IS NULL THEN 'removed' WHEN m.path IS NULL OR f.mtime_s <> m.mtime_s THEN 'changed'
       ELSE 'unchanged' END AS status
FROM classified f FULL OUTER JOIN manifest m ON f.path = m.path"""


def _listing(spark, d):
    return FX.file_listing(spark, d).withColumn("mtime", F.timestamp_seconds("mtime_s"))


def _manifest(spark, d):
    return (FX.manifest(spark, d).withColumnRenamed("path", "filepath")
            .withColumn("mtime", F.timestamp_seconds("mtime_s")))


@query("classify_files", with_ctes("SELECT path, file_name, country, mtime_s, frequency FROM classified",
                                   listing=LISTING, classified=CLASSIFIED))
def classify_files(spark, d):
    return FL.classify_files(FX.file_listing(spark, d))


@query("restrict_countries", with_ctes(
    "SELECT path, file_name, country, mtime_s, frequency FROM classified WHERE country IN ('jp', 'tw')",
    listing=LISTING, classified=CLASSIFIED))
def restrict_countries(spark, d):
    files, unknown = FL.restrict_countries(FL.classify_files(FX.file_listing(spark, d)), ["jp", "tw", "xx"])
    assert unknown == ["xx"]
    return files


@query("detect_changes", with_ctes(CHANGES, listing=LISTING, classified=CLASSIFIED, manifest=MANIFEST))
def detect_changes(spark, d):
    return C.detect_changes(FL.classify_files(_listing(spark, d)), _manifest(spark, d))


@query("change_report", with_ctes(
    "SELECT CAST(count(*) FILTER (WHERE status <> 'removed') AS BIGINT) AS scanned, "
    "CAST(count(*) FILTER (WHERE status = 'changed') AS BIGINT) AS changed, "
    "CAST(count(*) FILTER (WHERE status = 'unchanged') AS BIGINT) AS unchanged, "
    "CAST(count(*) FILTER (WHERE status = 'removed') AS BIGINT) AS removed FROM changes",
    listing=LISTING, classified=CLASSIFIED, manifest=MANIFEST, changes=CHANGES))
def change_report(spark, d):
    return C.change_report(C.detect_changes(FL.classify_files(_listing(spark, d)), _manifest(spark, d)))


@query("upsert_catalog", with_ctes("SELECT * FROM cat13", **BASE13))
def upsert_catalog(spark, d):
    return S.catalog13(spark, d).select(*CAT_COLS)


@query("owned_observations", with_ctes(
    "SELECT o.* FROM (SELECT * FROM obs1 UNION ALL SELECT * FROM obs3) o "
    "WHERE EXISTS (SELECT 1 FROM cat13 c WHERE c.name = o.name AND c.frequency = o.frequency "
    "AND c.source_file = o.source_file)", **BASE13))
def owned_observations(spark, d):
    return C.owned_observations(S.all_obs(spark, d), S.catalog13(spark, d))


@query("replace_observations", with_ctes(
    "SELECT o.* FROM obs1 o WHERE NOT EXISTS (SELECT 1 FROM obs3 n WHERE n.name = o.name AND n.frequency = o.frequency) "
    "UNION ALL SELECT * FROM obs3", obs1=OBS1, obs3=OBS3))
def replace_observations(spark, d):
    """FX1 store, then FX3 loads: its keys' old rows go, its rows come in."""
    new = S.obs3(spark, d)
    return C.replace_observations(S.obs1(spark, d), new, new.select("name", "frequency"))


@query("full_rebuild", with_ctes(
    f"""SELECT name, frequency, country, source_file, min_date, max_date, count FROM (
      SELECT *, row_number() OVER (PARTITION BY name, frequency ORDER BY {CRANK} DESC, source_file DESC) AS rn
      FROM (SELECT * FROM meta1 UNION ALL SELECT * FROM meta3) u) x WHERE rn = 1""",
    **{k: BASE13[k] for k in ("obs1", "obs3", "meta1", "meta3")}))
def full_rebuild(spark, d):
    """C8 (state only): every FX1 and FX3 file loaded in one run, in load order."""
    obs = S.all_obs(spark, d)
    state = M.rebuild_state(obs, run=1)
    return state.catalog.select(*CAT_COLS)


@query("full_rebuild_observations", with_ctes(
    f"""SELECT o.* FROM (SELECT * FROM obs1 UNION ALL SELECT * FROM obs3) o JOIN (
      SELECT name, frequency, source_file FROM (
      SELECT *, row_number() OVER (PARTITION BY name, frequency ORDER BY {CRANK} DESC, source_file DESC) AS rn
      FROM (SELECT * FROM meta1 UNION ALL SELECT * FROM meta3) u) x WHERE rn = 1) c
      USING (name, frequency, source_file)""",
    **{k: BASE13[k] for k in ("obs1", "obs3", "meta1", "meta3")}))
def full_rebuild_observations(spark, d):
    state = M.rebuild_state(S.all_obs(spark, d), run=1)
    return state.visible_observations().drop("load_run")


INCR_META = """SELECT * FROM meta1 WHERE country <> 'kr' UNION ALL SELECT * FROM meta3"""


@query("incremental_update", with_ctes(
    f"""SELECT name, frequency, country, source_file, min_date, max_date, count FROM (
      SELECT *, row_number() OVER (PARTITION BY name, frequency ORDER BY run DESC, {CRANK} DESC, source_file DESC) rn
      FROM (SELECT *, 1 AS run FROM meta1 WHERE country <> 'kr' UNION ALL SELECT *, 2 AS run FROM meta3) u) x
      WHERE rn = 1""", **{k: BASE13[k] for k in ("obs1", "obs3", "meta1", "meta3")}))
def incremental_update(spark, d):
    """C7 (state only): FX1 loaded; then Korean FX1 files vanish and FX3 files appear."""
    return _incremental(spark, d).catalog.select(*CAT_COLS)


def _incremental(spark, d):
    o1, o3 = S.obs1(spark, d), S.obs3(spark, d)
    st = M.rebuild_state(o1, run=1, mtime=F.timestamp_seconds(F.lit(1704067200)))
    files1 = o1.select(F.col("source_file").alias("path"), "country", "frequency").distinct()
    files3 = o3.select(F.col("source_file").alias("path"), "country", "frequency").distinct()
    listing = (files1.where(F.col("country") != "kr").unionByName(files3)
               .withColumn("mtime", F.timestamp_seconds(F.lit(1704067200))))
    loader = lambda changed: o3.join(changed.select(F.col("path").alias("source_file")), "source_file", "left_semi")
    new_state, _ = M.incremental_state(st, listing, loader, run=2)
    return new_state


@query("incremental_report", with_ctes(
    """SELECT CAST((SELECT count(DISTINCT source_file) FROM obs1 WHERE country <> 'kr')
              + (SELECT count(DISTINCT source_file) FROM obs3) AS BIGINT) AS scanned,
              CAST((SELECT count(DISTINCT source_file) FROM obs3) AS BIGINT) AS changed,
              CAST((SELECT count(DISTINCT source_file) FROM obs1 WHERE country <> 'kr') AS BIGINT) AS unchanged,
              CAST((SELECT count(DISTINCT source_file) FROM obs1 WHERE country = 'kr') AS BIGINT) AS removed""",
    obs1=OBS1, obs3=OBS3))
def incremental_report(spark, d):
    """C7 + C11: change counts of the same incremental run."""
    o1, o3 = S.obs1(spark, d), S.obs3(spark, d)
    st = M.rebuild_state(o1, run=1, mtime=F.timestamp_seconds(F.lit(1704067200)))
    files1 = o1.select(F.col("source_file").alias("path"), "country", "frequency").distinct()
    files3 = o3.select(F.col("source_file").alias("path"), "country", "frequency").distinct()
    listing = (files1.where(F.col("country") != "kr").unionByName(files3)
               .withColumn("mtime", F.timestamp_seconds(F.lit(1704067200))))
    return C.change_report(C.detect_changes(listing, st.manifest))


@query("remove_source", with_ctes(
    """SELECT 'catalog' AS part, name, frequency, source_file, CAST(count AS BIGINT) AS n FROM cat1 WHERE source_file NOT IN
         (SELECT path FROM gone)
       UNION ALL SELECT 'observations', o.name, o.frequency, o.source_file, count(*) FROM obs1 o WHERE NOT EXISTS
         (SELECT 1 FROM cat1 c JOIN gone g ON g.path = c.source_file WHERE c.name = o.name AND c.frequency = o.frequency)
         GROUP BY o.name, o.frequency, o.source_file
       UNION ALL SELECT 'manifest', NULL, NULL, source_file, count(DISTINCT name) FROM meta1 WHERE source_file NOT IN
         (SELECT path FROM gone) GROUP BY source_file
       UNION ALL SELECT 'removed', NULL, NULL, g.path, count(c.name) FROM gone g LEFT JOIN cat1 c ON c.source_file = g.path
         GROUP BY g.path""",
    **BASE, listing=LISTING, classified=CLASSIFIED, manifest=MANIFEST, changes=CHANGES,
    gone="SELECT DISTINCT path FROM changes WHERE status <> 'unchanged'"))
def remove_source(spark, d):
    """Drop what changed or vanished files own (paths from C4 on FX4): catalog, observations, manifest, counts."""
    changes = C.detect_changes(FL.classify_files(_listing(spark, d)), _manifest(spark, d))
    paths = changes.where(F.col("status") != "unchanged").select("path")
    cat, obs, man, gone = C.remove_source(S.catalog1(spark, d), S.obs1(spark, d), S.manifest1(spark, d), paths)
    none = F.lit(None).cast("string")
    rows = [cat.select(F.lit("catalog").alias("part"), "name", "frequency", "source_file", F.col("count").cast("long").alias("n")),
            obs.groupBy("name", "frequency", "source_file").agg(F.count("*").alias("n")).select(F.lit("observations").alias("part"), "name", "frequency", "source_file", "n"),
            man.select(F.lit("manifest").alias("part"), none.alias("name"), none.alias("frequency"), F.col("filepath").alias("source_file"), F.col("series_count").alias("n")),
            gone.select(F.lit("removed").alias("part"), none.alias("name"), none.alias("frequency"), F.col("path").alias("source_file"), F.col("series_removed").alias("n"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("upsert_manifest", with_ctes(
    """SELECT coalesce(m.filepath, n.filepath) AS filepath, coalesce(m.country, n.country) AS country,
              coalesce(m.frequency, n.frequency) AS frequency,
              CASE WHEN n.filepath IS NOT NULL THEN n.mtime_s ELSE m.mtime_s END AS mtime_s,
              CASE WHEN n.filepath IS NOT NULL THEN n.series_count ELSE m.series_count END AS series_count
       FROM (SELECT path AS filepath, country, regexp_extract(path, '_([mqa])\\.parquet$', 1) AS frequency, mtime_s,
                    CAST(NULL AS BIGINT) AS series_count FROM manifest) m
       FULL OUTER JOIN (SELECT source_file AS filepath, any_value(country) AS country, any_value(frequency) AS frequency,
                               1800000000 AS mtime_s, count(DISTINCT name) AS series_count
                        FROM meta1 GROUP BY source_file) n ON m.filepath = n.filepath""",
    **{k: BASE[k] for k in ("obs1", "meta1")}, manifest=MANIFEST))
def upsert_manifest(spark, d):
    """FX4 manifest, then every FX1 file is (re)loaded."""
    man = (FX.manifest(spark, d).select(F.col("path").alias("filepath"), "country",
                                       F.regexp_extract("path", r"_([mqa])\.parquet$", 1).alias("frequency"),
                                       F.timestamp_seconds("mtime_s").alias("mtime"),
                                       F.lit(None).cast("long").alias("series_count"),
                                       F.lit(None).cast("timestamp").alias("last_processed")))
    meta = I.series_metadata(S.obs1(spark, d))
    loaded = (meta.groupBy("source_file").agg(F.any_value("country").alias("country"),
                                              F.any_value("frequency").alias("frequency"),
                                              F.count_distinct("name").alias("series_count"))
              .select(F.col("source_file").alias("filepath"), "country", "frequency",
                      F.timestamp_seconds(F.lit(1800000000)).alias("mtime"), "series_count",
                      F.current_timestamp().alias("last_processed")))
    out = C.upsert_manifest(man, loaded)
    return out.select("filepath", "country", "frequency", F.unix_seconds("mtime").alias("mtime_s"), "series_count")


@query("evolve_catalog", with_ctes(
    "SELECT name, frequency, country, CAST(NULL AS VARCHAR) AS source_file, min_date, max_date, count FROM cat1",
    **BASE))
def evolve_catalog(spark, d):
    old = S.catalog1(spark, d).drop("source_file", "load_seq")
    return C.evolve_catalog(old).select(*CAT_COLS)


@query("needs_rebuild", with_ctes(
    """SELECT 'current' AS state, false AS needs_rebuild
       UNION ALL SELECT 'empty_manifest', (SELECT count(*) FROM cat1) > 0
       UNION ALL SELECT 'no_source_column', true""", **BASE))
def needs_rebuild(spark, d):
    """C9 as a plan: (state, needs_rebuild) for three stores built from FX1."""
    cat, man = S.catalog1(spark, d), S.manifest1(spark, d)
    return (C.needs_rebuild_df(cat, man).select(F.lit("current").alias("state"), "needs_rebuild")
            .unionByName(C.needs_rebuild_df(cat, man.limit(0)).select(F.lit("empty_manifest").alias("state"),
                                                                      "needs_rebuild"))
            .unionByName(C.needs_rebuild_df(cat.drop("source_file"), man)
                         .select(F.lit("no_source_column").alias("state"), "needs_rebuild")))
