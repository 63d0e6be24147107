"""A1–A4, B1–B5 on real parquet panels written with pandas/pyarrow."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesforge.operators import ingest as I
from seriesforge.sources import files as FL
from seriesforge.sources import panels as P


def _write(folder, name, df, index=False):
    os.makedirs(folder, exist_ok=True)
    df.to_parquet(os.path.join(folder, name), index=index)


def test_panel_variants(spark, scratch):
    jp = os.path.join(scratch, "jp")
    _write(jp, "a_m.parquet", pd.DataFrame({
        "Date": pd.to_datetime(["1969-12-31", "2020-01-01", "2020-02-01"]),
        "Japan, JGB. 10Y": [1.0, np.nan, 3.0], "x": [1, 2, 3], "X": ["1.5", "n/a", None]}))
    _write(jp, "b_q.parquet", pd.DataFrame({"v`q": [5.0, 6.0]},
                                           index=pd.Index(pd.to_datetime(["2021-01-01", "2021-04-01"]), name="Date")),
           index=True)
    _write(jp, "c_a.parquet", pd.DataFrame({"Date": ["2020-01-01", "2021-01-01"], "t": [1.0, 2.0]}))
    _write(jp, "d_m.parquet", pd.DataFrame({"when": ["2020-01-01"], "t": [1.0]}))       # no Date
    _write(jp, "e_m.parquet", pd.DataFrame({"Date": pd.to_datetime(["2020-01-01"])}))  # no values
    _write(jp, "f_m.parquet", pd.DataFrame({"Date": pd.to_datetime(["2020-01-01", None]), "t": [1.0, 2.0]}))
    _write(jp, "g_latest_m.parquet", pd.DataFrame({"Date": pd.to_datetime(["2020-01-01"]), "t": [1.0]}))
    listing = FL.discover_files(spark, [("jp", jp), ("cn", os.path.join(scratch, "missing"))])
    files = FL.classify_files(listing)
    assert sorted(r["file_name"] for r in files.collect()) == ["a_m.parquet", "b_q.parquet", "c_a.parquet",
                                                                  "d_m.parquet", "e_m.parquet", "f_m.parquet"]
    with P.case_sensitive(spark):
        raw = P.read_panels(spark, files)
        good, rejects = I.reject_bad_files(raw)
        rows = {(os.path.basename(r["source_file"]), r["name"], str(r["date"]), r["value"]) for r in good.collect()}
        rej = [os.path.basename(r["source_file"]) for r in rejects.collect()]
    assert rej == ["f_m.parquet"]
    assert ("a_m.parquet", "Japan, JGB. 10Y", "1969-12-31", 1.0) in rows
    assert ("a_m.parquet", "Japan, JGB. 10Y", "2020-01-01", None) not in rows
    assert ("a_m.parquet", "x", "2020-02-01", 3.0) in rows and ("a_m.parquet", "X", "1969-12-31", 1.5) in rows
    assert not any(r[1] == "X" and r[2] == "2020-01-01" for r in rows)  # 'n/a' -> dropped
    assert ("b_q.parquet", "v`q", "2021-04-01", 6.0) in rows
    assert ("c_a.parquet", "t", "2021-01-01", 2.0) in rows
    assert not any(r[0] in ("d_m.parquet", "e_m.parquet") for r in rows)


def test_restrict_countries_reports_unknown(spark):
    df = spark.createDataFrame([("p1", "jp"), ("p2", "cn")], "path string, country string")
    kept, unknown = FL.restrict_countries(df, ["jp", "zz"])
    assert unknown == ["zz"] and [r["path"] for r in kept.collect()] == ["p1"]


def test_unpivot_keeps_odd_names(spark):
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "d int, `a.b, c` double, `A.B, C` double")
    with P.case_sensitive(spark):
        long = P.unpivot_panel(wide, ["d"], ["a.b, c", "A.B, C"]).collect()
    assert {r["name"] for r in long} == {"a.b, c", "A.B, C"}


def _both_ways(spark, files):
    """The rows of panels decoded in tasks, and of the same panels scanned by schema."""
    with P.case_sensitive(spark):
        return [sorted((os.path.basename(r["source_file"]), r["country"], r["frequency"], str(r["date"]), r["name"], repr(r["value"]))
                       for r in P.read_panels(spark, files, bound).collect()) for bound in (P.PANEL_BYTES, 0)]


def test_panels_are_the_same_decoded_or_scanned(spark, scratch):
    import datetime
    import decimal

    import pyarrow as pa
    import pyarrow.parquet as pq
    cn = os.path.join(scratch, "cn")
    at = pd.to_datetime(["1969-12-31 23:00", "2020-02-29 12:30", None])
    _write(cn, "types_m.parquet", pd.DataFrame({
        "Date": at, "int": pd.array([1, None, -3], "Int64"), "small": np.array([1, 2, 3], "int8"), "flag": [True, False, None],
        "text": [" 1.5", "n/a", None], "float": np.array([0.1, np.nan, np.inf], "float32"), "kind": pd.Categorical(["1", "x", None]),
        "dec": [decimal.Decimal("1.25"), None, decimal.Decimal("-7.00")], "when": [datetime.date(2020, 1, 1)] * 3, "list": [[1.0], None, []],
        "v`q, a.b": [1.0, 2.0, 3.0], "INT": [9, 8, 7], "__index_level_0__": [0, 1, 2]}))
    for unit in ("s", "ms", "us", "ns"):
        pq.write_table(pa.table({"Date": pa.array([-1, 0, 1_600_000_000], pa.int64()).cast(pa.timestamp(unit)) if unit == "s"
                                 else pa.array(at.as_unit(unit).asi8[:2], pa.int64()).cast(pa.timestamp(unit)), "x": [1.0, 2.0, 3.0][:3 if unit == "s" else 2]}),
                       os.path.join(cn, f"{unit}_q.parquet"))
    _write(cn, "nanos_a.parquet", pd.DataFrame({"Date": [-1, 0, 86_400_000_000_000], "x": [1, 2, 3]}))
    _write(cn, "dates_a.parquet", pd.DataFrame({"Date": [datetime.date(1960, 1, 1), None], "x": [1, 2]}))
    _write(cn, "texts_a.parquet", pd.DataFrame({"Date": ["2020-01-05", "3/4/2021", "20220102", "Jan 2023", "none"], "x": ["1", "2e3", "", "NaN", "5"]}))
    _write(cn, "numbers_a.parquet", pd.DataFrame({"Date": [1.0, 2.0], "x": [1, 2]}))
    _write(cn, "empty_m.parquet", pd.DataFrame({"Date": pd.to_datetime([]), "x": np.array([], float)}))
    decoded, scanned = _both_ways(spark, FL.classify_files(FL.discover_files(spark, [("cn", cn)])))
    assert decoded == scanned and len(decoded) > 50
    assert ("types_m.parquet", "cn", "m", "1969-12-31", "v`q, a.b", "1.0") in decoded
    assert ("nanos_a.parquet", "cn", "a", "1969-12-31", "x", "1.0") in decoded


def test_wide_and_long_panels_come_in_bounded_batches(spark, scratch):
    jp = os.path.join(scratch, "jp")
    _write(jp, "wide_m.parquet", pd.DataFrame({"Date": pd.date_range("1990-01-01", periods=40), **{f"s {i}": np.arange(40.0) + i for i in range(3000)}}))
    _write(jp, "long_q.parquet", pd.DataFrame({"Date": pd.date_range("1800-01-01", periods=70_000), "x": np.arange(70_000.0), "y": 1}))
    with P.case_sensitive(spark):
        rows = P.read_panels(spark, FL.classify_files(FL.discover_files(spark, [("jp", jp)])))
        got = {r["frequency"]: (r["n"], r["names"], r["total"]) for r in rows.groupBy("frequency").agg(
            F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.sum("value").alias("total")).collect()}
    assert got["m"] == (120_000, 3000, 3000 * 780.0 + 40 * 2999 * 1500.0)
    assert got["q"] == (140_000, 2, 69_999 * 35_000.0 + 70_000)


def test_many_schemas_are_one_plan(spark, scratch):
    """300 panels of 300 schemas: neither the plan nor the number of jobs grows with them."""
    kr, jobs, plans = os.path.join(scratch, "kr"), [], []
    tracker = spark.sparkContext.statusTracker()
    for n in (40, 300):
        for i in range(n):
            _write(f"{kr}{n}", f"p{i}_m.parquet", pd.DataFrame({"Date": pd.to_datetime(["2020-01-01"]), f"s {i}": [float(i)], f"t {i % 7}": [1.0]}))
        files = FL.classify_files(FL.discover_files(spark, [("kr", f"{kr}{n}")])).checkpoint()
        spark.sparkContext.setJobGroup(f"panels {n}", "panels")
        with P.case_sensitive(spark):
            rows = P.read_panels(spark, files)
            assert rows.count() == 2 * n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs.append(len(tracker.getJobIdsForGroup(f"panels {n}")))
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString().count("\n"))
    assert jobs[0] == jobs[1] and plans[0] == plans[1]


def test_a_file_that_is_no_panel_is_named(spark, scratch):
    import pytest
    os.makedirs(f"{scratch}/us")
    with open(f"{scratch}/us/broken_m.parquet", "wb") as f:
        f.write(b"no parquet")
    with P.case_sensitive(spark), pytest.raises(Exception, match="broken_m.parquet"):
        P.read_panels(spark, FL.classify_files(FL.discover_files(spark, [("us", f"{scratch}/us")]))).count()
