"""Full rebuild and incremental update as state transitions.

``State`` holds the stored observations (every loaded row, superseded rows
included), the catalog (ownership) and the manifest. Visibility is always
"observation joins its owner", so an update never rewrites unchanged data:
on disk (``sources.snapshot``) observations are append-only partitions and a
run only writes the files it loaded plus the small tables.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.functions.dims import country_rank
from seriesforge.operators import catalog as C
from seriesforge.operators import ingest as I


@dataclass
class State:
    catalog: DataFrame
    observations: DataFrame
    manifest: DataFrame

    def visible_observations(self) -> DataFrame:
        return C.owned_observations(self.observations, self.catalog)


def _load_seq(df: DataFrame, run: int, order: Sequence[str] | None) -> DataFrame:
    if order:
        rank = F.when(F.lit(False), F.lit(0))
        for i, c in enumerate(order):
            rank = rank.when(F.col("country") == c, F.lit(i))
        rank = rank.otherwise(F.lit(len(order)))
    else:
        rank = country_rank(F.col("country"))
    return df.withColumn("load_seq", F.struct(F.lit(run).cast("long").alias("run"), rank.cast("int").alias("country_rank"),
                                              F.col("source_file").alias("file")))


def _manifest_rows(meta: DataFrame, mtimes: DataFrame | None, mtime: Column | None) -> DataFrame:
    counts = (meta.groupBy("source_file").agg(F.any_value("country").alias("country"),
                                              F.any_value("frequency").alias("frequency"),
                                              F.count_distinct("name").alias("series_count")))
    rows = counts.select(F.col("source_file").alias("filepath"), "country", "frequency", "series_count")
    if mtimes is not None:
        rows = rows.join(mtimes.select(F.col("path").alias("filepath"), "mtime"), "filepath", "left")
    else:
        rows = rows.withColumn("mtime", mtime if mtime is not None else F.current_timestamp())
    return rows.select("filepath", "country", "frequency", "mtime", "series_count",
                       F.current_timestamp().alias("last_processed"))


def rebuild_state(obs: DataFrame, run: int = 1, mtime: Column | None = None, mtimes: DataFrame | None = None,
                  country_order: Sequence[str] | None = None) -> State:
    """Empty state, every file loaded in load order (cleaned long rows in)."""
    good, _ = I.reject_bad_files(obs)
    meta = _load_seq(I.series_metadata(good), run, country_order)
    cat = C.catalog_from_meta(meta)
    man = _manifest_rows(meta, mtimes, mtime)
    return State(cat, good.withColumn("load_run", F.lit(run).cast("long")), man)


def incremental_state(state: State, listing: DataFrame, loader: Callable[[DataFrame], DataFrame], run: int,
                      countries: Sequence[str] | None = None, country_order: Sequence[str] | None = None):
    """One incremental run. ``listing`` = classified files (path, country,
    frequency, mtime) of the chosen countries; ``loader`` maps the changed
    files to their raw long rows. Returns (state', change report row)."""
    # reliable checkpoint: one consistent view of the listing for this run
    from seriesforge.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(listing.sparkSession)
    changes = C.detect_changes(listing, state.manifest, countries).checkpoint(eager=True)
    report = C.change_report(changes)
    # driver decisions on the (file-level, small) change table
    counts = report.first()
    if counts["scanned"] == 0 or (counts["changed"] == 0 and counts["removed"] == 0):
        return state, report  # S-21 / nothing to do: same state
    touched = changes.where(F.col("status") != "unchanged").select("path")
    cat, obs, man, _ = C.remove_source(state.catalog, state.observations, state.manifest, touched)
    # stale rows of touched files are never visible again
    obs = obs.join(touched.withColumnRenamed("path", "source_file"), "source_file", "left_anti")
    changed = changes.where(F.col("status") == "changed").select("path", "country", "frequency")
    good, _ = I.reject_bad_files(loader(changed))
    meta = _load_seq(I.series_metadata(good), run, country_order)
    cat = C.upsert_catalog(cat, meta)
    obs = obs.unionByName(good.withColumn("load_run", F.lit(run).cast("long")).select(*obs.columns))
    man = C.upsert_manifest(man, _manifest_rows(meta, listing, None))
    return State(cat, obs, man), report


# ---- on-disk runs ---------------------------------------------------------------------

#: How often a build starts anew from a version that another one has published meanwhile.
ATTEMPTS = 20


class _Loads:
    """What one build reads from panels: each file once, however often the build starts anew."""

    def __init__(self, spark, root: str):
        self.spark, self.root, self.run, self.files = spark, root, None, None

    def begin(self, base: str | None) -> tuple[int, int]:
        """Version and run of an attempt from ``base``; rows that are there already become the new run's."""
        from seriesforge.sources import snapshot as SN
        version, run = SN.next_run(base)
        if self.run is not None:
            SN.move_run(self.spark, self.root, self.run, run)
        self.run = run
        return version, run

    def __call__(self, files: DataFrame) -> DataFrame:
        """The rows of ``files`` (path, country, frequency), as the run has them."""
        from seriesforge.sources import panels as P
        from seriesforge.sources import snapshot as SN
        columns = ["path", "country", "frequency"]
        files = files.select(*columns)
        fresh = files if self.files is None else files.join(self.files.select("path"), "path", "left_anti").checkpoint(eager=True)
        if self.files is None or not fresh.isEmpty():
            rows = SN.write_run(self.spark, self.root, I.drop_missing(P.read_panels(self.spark, fresh)), self.run)
        else:
            rows = SN.stored_observations(self.spark, self.root, [self.run])
        if self.files is not None:  # rows of files that need no loading any more stay out of sight
            rows = rows.join(files.select(F.col("path").alias("source_file")), "source_file", "left_semi")
        self.files = fresh if self.files is None else self.files.select(*columns).union(fresh.select(*columns))
        return rows.drop("load_run")


def build_store(spark, root: str, roots, countries: Sequence[str] | None = None, rebuild: bool = False) -> DataFrame:
    """C7/C8 on files: list the country roots, then rebuild or update the
    store under ``root`` and publish a new snapshot. Returns the change report,
    or the build summary after a rebuild. Each panel is read once: the run's
    observations are written first, and catalog and manifest follow from the
    written rows. Ingest runs case-sensitive (series names may differ only by
    case). Unknown country codes are named in a warning and left out.

    Builds may run side by side: one that finds another's version in the place
    of its own starts anew from that version. Files that the other has loaded
    in the same state are unchanged then; the rest is added to what it made,
    from rows that are read from the panels once."""
    from seriesforge.session import ensure_checkpoint_dir
    from seriesforge.sources import files as FL
    from seriesforge.sources import panels as P
    from seriesforge.sources import snapshot as SN

    order = [c for c, _ in roots]
    unknown = [c for c in countries or [] if c not in order]
    if unknown:
        warnings.warn(f"unknown countries: {', '.join(unknown)}", stacklevel=2)
    chosen = [c for c in (countries or order) if c in order]
    ensure_checkpoint_dir(spark)
    # one view of the listing: what is loaded and what the manifest says of it belong together
    listing = FL.classify_files(FL.discover_files(spark, [(c, r) for c, r in roots if c in chosen])).checkpoint(eager=True)
    with P.case_sensitive(spark):
        load = _Loads(spark, root)
        for _ in range(ATTEMPTS):
            try:
                return _build(spark, root, listing, load, chosen, rebuild)
            except SN.Conflict:
                continue
    raise SN.Conflict(f"{root} was published by others {ATTEMPTS} times meanwhile")


def _build(spark, root: str, listing: DataFrame, load: _Loads, chosen: list[str], rebuild: bool) -> DataFrame:
    """One attempt, from the version that is current as it begins."""
    from seriesforge.operators import stats as ST
    from seriesforge.sources import snapshot as SN
    base = SN.current_tag(spark, root)
    version, run = load.begin(base)
    snap = SN.open_snapshot(spark, root, base)
    if rebuild or snap is None or C.needs_rebuild(spark, snap.catalog, snap.manifest):
        st = rebuild_state(load(listing), run=run, mtimes=listing, country_order=chosen)
        SN.publish_snapshot(spark, root, st.catalog, st.manifest, version, run)
        done = SN.open_snapshot(spark, root, f"v{version}_{run}")
        return ST.build_summary(done.manifest, done.catalog)
    state = snap.state()
    new_state, report = incremental_state(state, listing, load, run=run, countries=chosen, country_order=chosen)
    if new_state is not state:
        SN.publish_snapshot(spark, root, new_state.catalog, new_state.manifest, version, run)
    return report
