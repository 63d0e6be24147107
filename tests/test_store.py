"""C5–C9 on files: full rebuild, incremental runs, snapshots (A5/A6), CSV."""

import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesforge.operators import reshape as RS
from seriesforge.operators import series as SR
from seriesforge.plans.maintenance import build_store
from seriesforge.sources import snapshot as SN


def _panel(path, dates, cols, mtime):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    df = pd.DataFrame({"Date": pd.to_datetime(dates), **cols})
    df.to_parquet(path, index=False)
    os.utime(path, (mtime, mtime))


def _catalog(spark, root):
    snap = SN.open_snapshot(spark, root)
    rows = snap.catalog.select("name", "source_file", "count").collect()
    return {r["name"]: (os.path.basename(r["source_file"]), r["count"]) for r in rows}, snap


def test_rebuild_then_incremental(spark, scratch):
    data, root = os.path.join(scratch, "data"), os.path.join(scratch, "store")
    roots = [("cn", os.path.join(data, "cn")), ("jp", os.path.join(data, "jp"))]
    t0 = time.time() - 1000
    _panel(f"{data}/cn/a_m.parquet", ["2020-01-01", "2020-02-01", "2020-03-01"],
           {"S1": [1.0, 2.0, 3.0], "S2": [10.0, None, 30.0]}, t0)
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01", "2020-02-01"], {"S1": [100.0, 200.0], "S3": [5.0, None]}, t0)
    summary = build_store(spark, root, roots).first()  # no store yet -> rebuild
    assert (summary["files_processed"], summary["series"], summary["data_points"]) == (2, 3, 5)
    cat, snap = _catalog(spark, root)
    assert cat == {"S1": ("b_m.parquet", 2), "S2": ("a_m.parquet", 2), "S3": ("b_m.parquet", 1)}
    vis = snap.visible_observations()
    assert vis.count() == sum(c for _, c in cat.values()) == 5
    assert {r["value"] for r in vis.where("name = 'S1'").collect()} == {100.0, 200.0}
    stats = {r["key"]: r["value"] for r in snap.stats.collect()}
    assert stats["total_series"] == "3" and stats["by_country"] == '{"cn":1,"jp":2}'

    # nothing changed -> same version
    report = build_store(spark, root, roots).first()
    assert (report["changed"], report["removed"], report["unchanged"]) == (0, 0, 2)
    assert SN.current_version(spark, root) == 1

    # jp/b drops S1 and changes S3; cn/c appears
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01", "2020-02-01"], {"S3": [7.0, 8.0]}, t0 + 10)
    _panel(f"{data}/cn/c_m.parquet", ["2020-01-01"], {"S4": [1.0]}, t0 + 10)
    report = build_store(spark, root, roots).first()
    assert (report["scanned"], report["changed"], report["unchanged"], report["removed"]) == (3, 2, 1, 0)
    cat, snap = _catalog(spark, root)
    assert cat == {"S2": ("a_m.parquet", 2), "S3": ("b_m.parquet", 2), "S4": ("c_m.parquet", 1)}  # S1 stays gone
    assert snap.visible_observations().count() == 5
    assert {r["value"] for r in snap.visible_observations().where("name = 'S3'").collect()} == {7.0, 8.0}

    # cn/a deleted -> its series go; an update restricted to jp leaves cn alone
    os.remove(f"{data}/cn/a_m.parquet")
    report = build_store(spark, root, roots, countries=["jp"]).first()
    assert report["changed"] == 0 and report["removed"] == 0
    report = build_store(spark, root, roots).first()
    assert report["removed"] == 1
    cat, snap = _catalog(spark, root)
    assert set(cat) == {"S3", "S4"}
    man = {os.path.basename(r["filepath"]) for r in snap.manifest.collect()}
    assert man == {"b_m.parquet", "c_m.parquet"}


def _two_panels(scratch):
    data = os.path.join(scratch, "data")
    t0 = time.time() - 1000
    _panel(f"{data}/cn/a_m.parquet", ["2020-01-01", "2020-02-01"], {"S1": [1.0, 2.0]}, t0)
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01", "2020-02-01"], {"S2": [5.0, 6.0]}, t0)
    return data, [("cn", f"{data}/cn"), ("jp", f"{data}/jp")], t0


def _served(spark, root):
    """What lookups on the stored tables answer: name -> (count, values)."""
    snap = SN.open_snapshot(spark, root)
    names = spark.createDataFrame([(n,) for n in ("S1", "S2", "S3")], "name string")
    req = names.select(F.lit(1).alias("request_id"), "name", F.lit("m").alias("freq"), F.lit(None).cast("string").alias("start_date"), F.lit(None).cast("string").alias("end_date"))
    got = SR.get_series(SR.resolve_series(req, snap.catalog), snap.observations, nested=True).collect()
    return {r["series_name"]: (r["count"], sorted(x["value"] for x in r["data"])) for r in got}


def test_run_that_died_before_the_pointer_moved(spark, scratch, monkeypatch):
    """Rows were written, then the run died; the next one must not see them twice."""
    data, roots, t0 = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    publish = SN.publish_snapshot

    def dies(*args, **kw):
        raise RuntimeError("lost")
    monkeypatch.setattr(SN, "publish_snapshot", dies)
    with pytest.raises(RuntimeError):
        build_store(spark, root, roots)
    assert SN.open_snapshot(spark, root) is None
    monkeypatch.setattr(SN, "publish_snapshot", publish)
    build_store(spark, root, roots)
    assert _served(spark, root) == {"S1": (2, [1.0, 2.0]), "S2": (2, [5.0, 6.0])}
    # an update that dies after its tables, before the pointer
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01", "2020-02-01"], {"S2": [7.0, 8.0]}, t0 + 10)
    write = SN.write_text_atomic
    monkeypatch.setattr(SN, "write_text_atomic", lambda sp, path, text: dies() if path.endswith("_COMPLETE") else write(sp, path, text))
    with pytest.raises(RuntimeError):
        build_store(spark, root, roots)
    assert _served(spark, root)["S2"] == (2, [5.0, 6.0])
    monkeypatch.setattr(SN, "write_text_atomic", write)
    build_store(spark, root, roots)
    assert _served(spark, root) == {"S1": (2, [1.0, 2.0]), "S2": (2, [7.0, 8.0])}
    assert SN.open_snapshot(spark, root).visible_observations().count() == 4
    # what the dead runs left goes, what is visible stays
    versions, runs = SN.vacuum(spark, root, keep=1)
    assert versions >= 2 and runs >= 2
    assert _served(spark, root) == {"S1": (2, [1.0, 2.0]), "S2": (2, [7.0, 8.0])}


def test_lost_pointer(spark, scratch):
    _, roots, _ = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    os.remove(f"{root}/CURRENT")
    assert SN.current_version(spark, root) == 1 and _served(spark, root)["S1"] == (2, [1.0, 2.0])
    report = build_store(spark, root, roots).first()  # found again, nothing to do: no second copy
    assert report["changed"] == 0 and SN.open_snapshot(spark, root).visible_observations().count() == 4


def _before_publishing(monkeypatch, act):
    """``act`` once, at the moment that a build is about to publish."""
    publish, waiting = SN.publish_snapshot, [act]

    def publishes(*args, **kw):
        if waiting:
            waiting.pop()()
        return publish(*args, **kw)
    monkeypatch.setattr(SN, "publish_snapshot", publishes)


def test_builds_of_two_countries_side_by_side(spark, scratch, monkeypatch):
    """cn publishes while jp is under way: both are in the store, each panel is read once, versions have numbers of their own."""
    data, roots, t0 = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    _panel(f"{data}/cn/c_m.parquet", ["2020-01-01"], {"S3": [1.0]}, t0 + 10)
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01", "2020-02-01"], {"S2": [7.0, 8.0]}, t0 + 10)
    _before_publishing(monkeypatch, lambda: build_store(spark, root, roots, countries=["cn"]))
    write, written = SN.write_run, []
    monkeypatch.setattr(SN, "write_run", lambda *a, **k: written.append(a[3]) or write(*a, **k))
    report = build_store(spark, root, roots, countries=["jp"]).first()
    assert (report["changed"], report["removed"]) == (1, 0)
    assert _served(spark, root) == {"S1": (2, [1.0, 2.0]), "S2": (2, [7.0, 8.0]), "S3": (1, [1.0])}
    assert SN.commits(spark, root) == [1, 2, 3] and len(written) == 2
    snap = SN.open_snapshot(spark, root)
    assert snap.manifest.count() == 3 and snap.visible_observations().count() == 5
    assert snap.stats.where("key = 'total_series'").first()["value"] == "3"


def test_builds_of_one_country_side_by_side(spark, scratch, monkeypatch):
    """The second finds its files loaded: one version, nothing twice. If a file has changed since, the later listing counts."""
    data, roots, t0 = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01", "2020-02-01"], {"S2": [7.0, 8.0]}, t0 + 10)
    _before_publishing(monkeypatch, lambda: build_store(spark, root, roots))
    report = build_store(spark, root, roots).first()
    assert (report["changed"], report["unchanged"]) == (0, 2)
    assert SN.commits(spark, root) == [1, 2] and _served(spark, root)["S2"] == (2, [7.0, 8.0])
    assert SN.open_snapshot(spark, root).visible_observations().count() == 4
    assert SN.stored_observations(spark, root).count() == 8  # the second's rows are there, in nobody's sight
    SN.vacuum(spark, root, keep=1)
    assert SN.stored_observations(spark, root).count() == 6  # they are gone; run 1 has what the update replaced


def test_first_builds_side_by_side(spark, scratch, monkeypatch):
    """Both start without a store: the second adds to the first's."""
    _, roots, _ = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    _before_publishing(monkeypatch, lambda: build_store(spark, root, roots, countries=["cn"]))
    build_store(spark, root, roots, countries=["jp"])
    assert _served(spark, root) == {"S1": (2, [1.0, 2.0]), "S2": (2, [5.0, 6.0])}
    assert SN.commits(spark, root) == [1, 2]


def test_compaction_beside_a_build(spark, scratch, monkeypatch):
    data, roots, t0 = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01"], {"S3": [9.0]}, t0 + 10)
    _before_publishing(monkeypatch, lambda: build_store(spark, root, roots))
    SN.compact(spark, root)
    assert _served(spark, root) == {"S1": (2, [1.0, 2.0]), "S3": (1, [9.0])}
    runs = {r["run"] for r in SN.open_snapshot(spark, root).catalog.select("load_seq.run").collect()}
    assert SN.commits(spark, root) == [1, 2, 3] and len(runs) == 1


def test_a_commit_is_made_once(spark, scratch):
    from concurrent.futures import ThreadPoolExecutor
    path = os.path.join(scratch, "commits", "00000000000000000001")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda i: SN.create_new(spark, path, f"v1_{i}"), range(24)))
    assert sum(made) == 1 and SN.read_text(spark, path) == f"v1_{made.index(True)}"
    assert [f for f in os.listdir(os.path.dirname(path)) if not f.startswith(".")] == ["00000000000000000001"]


def test_store_without_commits(spark, scratch):
    """A store from before there were commits: its pointer counts until the next run commits."""
    data, roots, t0 = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    SN._delete(spark, f"{root}/commits")
    assert SN.current_version(spark, root) == 1
    os.remove(f"{root}/CURRENT")
    assert SN.current_version(spark, root) == 1
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01"], {"S2": [7.0]}, t0 + 10)
    build_store(spark, root, roots)
    assert SN.commits(spark, root) == [2] and _served(spark, root)["S2"] == (1, [7.0])


def test_pointer_is_replaced_in_one_step(spark, scratch):
    path = os.path.join(scratch, "pointer")
    for text in ("one", "two"):
        SN.write_text_atomic(spark, path, text)
        assert SN.read_text(spark, path) == text
    assert [f for f in os.listdir(scratch) if f.endswith(".tmp")] == []


def test_compact(spark, scratch):
    data, roots, t0 = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01"], {"S3": [9.0]}, t0 + 10)
    build_store(spark, root, roots)
    assert SN.open_snapshot(spark, root).observations.count() == 5
    SN.compact(spark, root)
    SN.vacuum(spark, root, keep=1)
    snap = SN.open_snapshot(spark, root)
    assert snap.observations.count() == snap.visible_observations().count() == 3
    assert _served(spark, root) == {"S1": (2, [1.0, 2.0]), "S3": (1, [9.0])}
    _panel(f"{data}/jp/b_m.parquet", ["2020-01-01"], {"S3": [10.0]}, t0 + 20)
    build_store(spark, root, roots)  # updates go on after it
    assert _served(spark, root)["S3"] == (1, [10.0])


def test_old_stores_are_rebuilt(spark, scratch):
    """No manifest, or a catalog without files: the next run loads everything again."""
    _, roots, _ = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    tag = SN.current_tag(spark, root)
    SN._delete(spark, f"{root}/versions/{tag}/manifest")
    SN._delete(spark, f"{root}/versions/{tag}/gram_index")
    snap = SN.open_snapshot(spark, root)
    assert snap.manifest is None and snap.gram_index.count() > 0
    assert build_store(spark, root, roots).columns == ["files_processed", "series", "data_points"]
    assert SN.current_version(spark, root) == 2 and _served(spark, root)["S2"] == (2, [5.0, 6.0])


def test_unknown_countries_are_told(spark, scratch):
    _, roots, _ = _two_panels(scratch)
    with pytest.warns(UserWarning, match="zz"):
        build_store(spark, os.path.join(scratch, "store"), roots, countries=["cn", "zz"])


def test_stored_lookup_prunes(spark, scratch):
    """Lookups on the stored rows name the run and the frequency (partitions) and the first day (row groups)."""
    from seriesforge.plans import serving as SV
    _, roots, _ = _two_panels(scratch)
    root = os.path.join(scratch, "store")
    build_store(spark, root, roots)
    snap = SN.open_snapshot(spark, root)
    req = spark.createDataFrame([(1, "S1", "m", "2020-02", None)], "request_id int, name string, freq string, start_date string, end_date string")
    out = SV.get_series(snap, req)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.split("FileScan") if "load_run" in x and "PartitionFilters" in x)
    partition = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "load_run" in partition and "frequency" in partition
    assert "date" in scan.split("PushedFilters: [")[1].split("]")[0]
    assert [(r["count"], str(r["min_date"])) for r in out.collect()] == [(1, "2020-02-01")]
    q = spark.createDataFrame([(1, "s", None, None, 50), (2, "%", None, "jp", 50)], "query_id int, q string, freq string, country string, lim int")
    assert sorted((r["query_id"], r["name"]) for r in SV.search(snap, q).collect()) == [(1, "S1"), (1, "S2"), (2, "S2")]


def test_csv_roundtrip(spark, scratch):
    wide = spark.createDataFrame([("2020-01-01", 1.5, 2.0)], "Date string, `Japan, CPI` double, `Japan, PPI` double")
    wide = wide.withColumn("Date", F.to_date("Date"))
    out = os.path.join(scratch, "csv")
    RS.write_csv(wide, out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["Date", "Japan, CPI", "Japan, PPI"]
    assert back.first()["Japan, CPI"] == "1.5"
