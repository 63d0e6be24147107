"""Plan checks: pushdown, top-k, no full scans for pruned projections."""

import os

from pyspark.sql import functions as F

from seriesforge.operators import series as SR


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_slice_range_pushes_date_filter(spark, scratch):
    path = os.path.join(scratch, "obs")
    spark.createDataFrame([("a", "m", "2020-01-01", 1.0)], "name string, frequency string, d string, value double") \
        .select("name", "frequency", F.to_date("d").alias("date"), "value").write.partitionBy("frequency").parquet(path)
    obs = spark.read.parquet(path).where(F.col("frequency") == "m")
    plan = _plan(SR.slice_range(obs, "1997", "1999-06").select("name", "value"))
    assert "PushedFilters" in plan and "date" in plan.split("PushedFilters")[1][:200]
    assert "PartitionFilters" in plan


def test_top_k_uses_window_group_limit(spark):
    from seriesforge.operators import search as E
    df = spark.range(1000).select((F.col("id") % 7).alias("query_id"), F.col("id").cast("string").alias("name"))
    out = E.top_k(df, F.lit(5))
    out.collect()
    assert "WindowGroupLimit" in _plan(out)


def test_search_builds_lazily(spark):
    """Planning a search, or hiding by a table of patterns, runs no job; and no join is a nested loop."""
    from seriesforge.operators import search as E
    from seriesforge.operators import visibility as V
    cat = spark.createDataFrame([("S&P PMI", "m", "cn"), ("y", "q", "jp")], "name string, frequency string, country string")
    q = spark.createDataFrame([(1, "%", None, None, 50), (2, "", None, None, 1), (3, "_", None, None, 50), (4, "&p", None, None, 50), (5, "y", "q", "jp", 50), (6, None, None, None, 5)],
                              "query_id int, q string, freq string, country string, lim int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "lazy")
    out = E.search_series(cat, q)
    hidden = V.hide_series(cat, spark.createDataFrame([("pmi",), ("X",)], "pattern string"))
    assert tracker.getJobIdsForGroup("lazy") == []
    assert "NestedLoop" not in _plan(out) and "Cartesian" not in _plan(out) and "NestedLoop" not in _plan(hidden)
    assert sorted((r["query_id"], r["name"]) for r in out.collect()) == [(1, "S&P PMI"), (1, "y"), (2, "S&P PMI"), (3, "S&P PMI"), (3, "y"), (4, "S&P PMI"), (5, "y")]
    assert [r["name"] for r in hidden.collect()] == ["y"]


def test_hidden_by_list_and_by_table(spark):
    from seriesforge.operators import visibility as V
    names = ["S&P PMI", "ab", "Zürich x", "", None, "ABC"]
    df = spark.createDataFrame([(n, r) for n in names for r in ("admin", "user")], "name string, role string")
    for patterns in (["pmi"], ["b"], ["BC", "ü"], [""], ["q"], []):
        table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
        a, b = (sorted(map(str, V.guard_visible(df, p).collect())) for p in (patterns, table))
        assert a == b
        a, b = (sorted(map(str, V.hide_series(df, p, admin=F.col("role") == "admin").collect())) for p in (patterns, table))
        assert a == b


def test_invariants_on_fixtures(spark):
    """sum of catalog counts = owned observations; incremental with nothing
    changed keeps the catalog."""
    from pyspark.sql import functions as F

    from seriesforge.operators import catalog as C
    from seriesforge.plans import maintenance as M
    from seriesforge.plans import state as S
    d = "/root/testdata/sf0.001"
    st = M.rebuild_state(S.all_obs(spark, d), run=1, mtime=F.timestamp_seconds(F.lit(1704067200)))
    total = st.catalog.agg(F.sum("count")).first()[0]
    assert total == st.visible_observations().count()
    listing = (S.all_obs(spark, d).select(F.col("source_file").alias("path"), "country", "frequency").distinct()
               .withColumn("mtime", F.timestamp_seconds(F.lit(1704067200))))
    same, report = M.incremental_state(st, listing, lambda ch: S.all_obs(spark, d).limit(0), run=2)
    r = report.first()
    assert same is st and r["changed"] == 0 and r["removed"] == 0
    assert C.change_report(C.detect_changes(listing, st.manifest)).first()["unchanged"] == r["scanned"]
