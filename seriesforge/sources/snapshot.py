"""Publish and open versioned snapshots of the store on any Hadoop
path (local, HDFS, object stores).

Layout under ``root``::

    observations/frequency=<f>/load_run=<run>/part-*.parquet       append-only
    versions/v<n>_<run>/{catalog,manifest,stats,token_index,gram_index}/, RUNS, _COMPLETE
    commits/<n>                                                     "v<n>_<run>"
    CURRENT                                                         "v<n>_<run>", for people and older readers

Every attempt of a run has a run id and a version directory of its own, so a
run that died and is repeated never adds to what the dead one left. Rows are
visible only through the catalog of the current version, which names file and
run. Version n is whatever file ``commits/<n>`` names: that file is made whole
in one step that fails if it is there, so of several runs that start from one
version a single one publishes the next; the others get a ``Conflict`` and are
worked out anew from the version that won (``build_store`` does so, without
reading its panels again). Readers take the last commit, whatever ``CURRENT``
says; stores from before there were commits go by ``CURRENT``, or by the newest
complete version if it is missing. What no kept version names is deleted by
``vacuum``, but for the commits, whose numbers must not be given twice;
``compact`` rewrites the visible rows as one run.
"""

from __future__ import annotations

import re
import secrets
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import catalog as C
from seriesforge.operators import search as E
from seriesforge.operators import stats as ST
from seriesforge.plans.maintenance import State

OBS_SCHEMA = ("name string, frequency string, country string, source_file string, date date, "
              "value double, load_run bigint")
_TAG = re.compile(r"^v(\d+)_(\d+)$")
_COMMIT = re.compile(r"^\d{20}$")


class Conflict(RuntimeError):
    """Another run has published the version that this one was to be."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine()
    finally:
        stream.close()


def write_text_atomic(spark: SparkSession, path: str, text: str) -> None:
    """Write a file of its own, then rename it over ``path``: readers see the old text or the new."""
    sc = spark.sparkContext
    fs, p = _fs(spark, path)
    tmp = sc._jvm.org.apache.hadoop.fs.Path(f"{path}.{secrets.token_hex(8)}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = sc._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    tmp, p = fs.makeQualified(tmp), fs.makeQualified(p)
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration()).rename(tmp, p, options)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with ``text`` in it in one step; False if there is one already. Local files are linked, elsewhere the
    file system's rename that doesn't overwrite is asked for (atomic on HDFS)."""
    sc = spark.sparkContext
    fs, p = _fs(spark, path)
    tmp = sc._jvm.org.apache.hadoop.fs.Path(f"{path}.{secrets.token_hex(8)}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    tmp, p = fs.makeQualified(tmp), fs.makeQualified(p)
    try:
        if p.toUri().getScheme() == "file":
            local = sc._jvm.java.nio.file.Paths
            sc._jvm.java.nio.file.Files.createLink(local.get(p.toUri()), local.get(tmp.toUri()))
        else:
            rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
            options = sc._gateway.new_array(rename, 1)
            options[0] = rename.NONE
            sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), sc._jsc.hadoopConfiguration()).rename(tmp, p, options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(tmp, False)
    return True


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _numbers(tag: str) -> tuple[int, int]:
    m = _TAG.match(tag.strip())
    return (int(m[1]), int(m[2])) if m else (0, 0)


def complete_versions(spark: SparkSession, root: str) -> list[str]:
    """Tags of the complete versions, oldest first."""
    tags = [t for t in _children(spark, f"{root}/versions") if _TAG.match(t)]
    done = [t for t in tags if read_text(spark, f"{root}/versions/{t}/_COMPLETE") is not None]
    return sorted(done, key=_numbers)


def commits(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions, oldest first."""
    return sorted(int(n) for n in _children(spark, f"{root}/commits") if _COMMIT.match(n))


def _commit(root: str, version: int) -> str:
    return f"{root}/commits/{version:020d}"


def current_tag(spark: SparkSession, root: str) -> str | None:
    """What the last commit names; in a store without commits what ``CURRENT`` names, or the newest complete version."""
    made = commits(spark, root)
    if made:
        return read_text(spark, _commit(root, made[-1])).strip()
    tag = (read_text(spark, f"{root}/CURRENT") or "").strip()
    if _TAG.match(tag):
        return tag
    done = complete_versions(spark, root)
    return done[-1] if done else None


def current_version(spark: SparkSession, root: str) -> int:
    tag = current_tag(spark, root)
    return _numbers(tag)[0] if tag else 0


def next_run(base: str | None) -> tuple[int, int]:
    """(version, run id) of an attempt that starts from the version ``base``: the run is nobody else's and later than all
    runs of ``base``, so that what it loads is owned by it."""
    version = (_numbers(base)[0] if base else 0) + 1
    return version, version << 32 | secrets.randbits(32)


def stored_observations(spark: SparkSession, root: str, runs: list[int] | None = None) -> DataFrame:
    """All stored rows, or those of ``runs``: other folders, which builds under way may rename, aren't read then."""
    fs, p = _fs(spark, f"{root}/observations")
    if not fs.exists(p):
        return spark.createDataFrame([], OBS_SCHEMA)
    rows = spark.read.schema(OBS_SCHEMA).parquet(f"{root}/observations")
    return rows if runs is None else rows.where(F.col("load_run").isin(runs))


@dataclass
class Snapshot:
    root: str
    version: int
    catalog: DataFrame
    manifest: DataFrame | None  # None: a store from before there were manifests
    stats: DataFrame
    token_index: DataFrame
    gram_index: DataFrame
    observations: DataFrame  # every row of its runs; use ``visible_observations``

    def visible_observations(self) -> DataFrame:
        return C.owned_observations(self.observations, self.catalog)

    def state(self) -> State:
        return State(self.catalog, self.observations, self.manifest)


def write_run(spark: SparkSession, root: str, rows: DataFrame, run: int, compression: str = "gzip") -> DataFrame:
    """Write a run's observations and return them as they were written, so that all that follows from them is derived
    from the same rows and the input is read once. Names get a bloom filter."""
    columns = ["name", "frequency", "country", "source_file", "date", "value"]
    # a folder of its own: two jobs that write below one folder delete each other's unfinished files
    writing = f"{root}/writing/{run}_{secrets.token_hex(4)}"
    (rows.select(*columns)
     .hint("rebalance", "frequency", "source_file")  # a huge file is split, small ones share a task
     .sortWithinPartitions("frequency", "source_file", "name", "date")
     .write.option("compression", compression)
     .option("parquet.bloom.filter.enabled#name", "true")
     .partitionBy("frequency").parquet(writing))
    for f in _children(spark, writing):
        if f.startswith("frequency="):
            _move(spark, f"{writing}/{f}", f"{root}/observations/{f}/load_run={run}")
    _delete(spark, writing)
    return stored_observations(spark, root, [run])


def _move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a folder; its files, if there is such a folder already."""
    fs, p = _fs(spark, new)
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if fs.exists(p):
        pairs = [(f"{old}/{f}", f"{new}/{f}") for f in _children(spark, old)]
    else:
        fs.mkdirs(p.getParent())
        pairs = [(old, new)]
    for x, y in pairs:
        if not fs.rename(path_of(x), path_of(y)):
            raise OSError(f"{x} couldn't be renamed to {y}")


def move_run(spark: SparkSession, root: str, old: int, new: int) -> None:
    """Give the rows of a run that isn't published a new run id, by renaming their folders (one a frequency)."""
    for f in _children(spark, f"{root}/observations"):
        if f.startswith("frequency=") and f"load_run={old}" in _children(spark, f"{root}/observations/{f}"):
            _move(spark, f"{root}/observations/{f}/load_run={old}", f"{root}/observations/{f}/load_run={new}")


def publish_snapshot(spark: SparkSession, root: str, catalog: DataFrame, manifest: DataFrame, version: int, run: int,
                     compression: str = "gzip") -> None:
    """A5: write the version's small tables, mark it complete, then commit it as version ``version``. ``Conflict`` if there
    is such a version already: what was written goes, and the caller starts from that version."""
    if version in commits(spark, root):  # known before the tables are written
        raise Conflict(f"version {version} of {root} is there already")
    tag = f"v{version}_{run}"
    vdir = f"{root}/versions/{tag}"
    catalog.write.mode("overwrite").option("compression", compression).parquet(f"{vdir}/catalog")
    cat = spark.read.parquet(f"{vdir}/catalog")
    manifest.write.mode("overwrite").option("compression", compression).parquet(f"{vdir}/manifest")
    runs = sorted(r["run"] for r in cat.select(F.col("load_seq.run").alias("run")).distinct().collect())  # as many as weren't compacted since
    write_text_atomic(spark, f"{vdir}/RUNS", ",".join(map(str, runs)))
    ST.stats_table(cat).write.mode("overwrite").parquet(f"{vdir}/stats")
    E.build_token_index(cat).write.mode("overwrite").option("compression", compression).parquet(f"{vdir}/token_index")
    E.build_gram_index(cat).write.mode("overwrite").option("compression", compression).parquet(f"{vdir}/gram_index")
    write_text_atomic(spark, f"{vdir}/_COMPLETE", tag)
    if not create_new(spark, _commit(root, version), tag):
        _delete(spark, vdir)
        raise Conflict(f"version {version} of {root} is there already")
    write_text_atomic(spark, f"{root}/CURRENT", tag)


def open_snapshot(spark: SparkSession, root: str, tag: str | None = None) -> Snapshot | None:
    """Open the current version, or the one named (None when there is no store yet). Tables an older store lacks
    are derived from its catalog; a missing manifest is None, which calls for a rebuild."""
    tag = tag or current_tag(spark, root)
    if tag is None:
        return None
    vdir = f"{root}/versions/{tag}"
    there = set(_children(spark, vdir))

    def table(name: str) -> DataFrame | None:
        return spark.read.parquet(f"{vdir}/{name}") if name in there else None
    raw = table("catalog")
    if raw is None:
        return None
    cat = C.evolve_catalog(raw)
    manifest = table("manifest") if "source_file" in raw.columns else None
    derived = {n: table(n) for n in ("stats", "token_index", "gram_index")}
    make = {"stats": ST.stats_table, "token_index": E.build_token_index, "gram_index": E.build_gram_index}
    derived = {n: make[n](cat) if t is None else t for n, t in derived.items()}
    named = read_text(spark, f"{vdir}/RUNS") if "RUNS" in there else None
    runs = [int(r) for r in named.split(",")] if named else None if "RUNS" not in there else []
    return Snapshot(root, _numbers(tag)[0], cat, manifest, observations=stored_observations(spark, root, runs), **derived)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> tuple[int, int]:
    """Delete versions older than the last ``keep`` ones, and runs that no kept version names (also what dead
    attempts left). Not to be run while a build is under way. Returns (versions, run partitions) deleted."""
    done = [read_text(spark, _commit(root, n)).strip() for n in commits(spark, root)[-max(1, keep):]] or complete_versions(spark, root)
    kept = set(done[-max(1, keep):]) | {current_tag(spark, root)}
    live: set[int] = set()
    for tag in kept - {None}:  # a handful of versions; a version names as many runs as were not compacted since
        snap = open_snapshot(spark, root, tag)
        live |= {r["run"] for r in snap.catalog.select(F.col("load_seq.run").alias("run")).distinct().collect()}
    gone_versions = [t for t in _children(spark, f"{root}/versions") if t not in kept]
    for t in gone_versions:
        _delete(spark, f"{root}/versions/{t}")
    _delete(spark, f"{root}/writing")  # what builds that died were writing
    gone = 0
    for f in _children(spark, f"{root}/observations"):
        for r in _children(spark, f"{root}/observations/{f}") if f.startswith("frequency=") else []:
            if r.startswith("load_run=") and int(r.removeprefix("load_run=")) not in live:
                _delete(spark, f"{root}/observations/{f}/{r}")
                gone += 1
    return len(gone_versions), gone


def compact(spark: SparkSession, root: str, attempts: int = 20) -> None:
    """Rewrite the visible rows as one run and publish it: superseded rows are then in no run that is named. If another
    run publishes meanwhile, its version is compacted instead."""
    for _ in range(attempts):
        tag = current_tag(spark, root)
        snap = open_snapshot(spark, root, tag)
        if snap is None or snap.manifest is None:
            return
        version, run = next_run(tag)
        write_run(spark, root, snap.visible_observations(), run)
        cat = snap.catalog.withColumn("load_seq", F.struct(F.lit(run).cast("long").alias("run"), F.col("load_seq.country_rank"), F.col("load_seq.file")))
        try:
            return publish_snapshot(spark, root, cat, snap.manifest, version, run)
        except Conflict:
            continue
    raise Conflict(f"{root} is published too often to be compacted")
