"""H4–H6: streaming results equal the batch operators."""

import os
import random
import time

from pyspark.sql import functions as F

from seriesforge.operators import metering as MT
from seriesforge.plans import fixtures as FX
from seriesforge.streaming import file_events as H
from seriesforge.streaming import usage as U

SF = "/root/testdata/sf0.001"


def _log_dir(spark, scratch):
    out = os.path.join(scratch, "log")
    FX.request_log(spark, SF).repartition(4).write.parquet(out)
    return out


def _attributed_stream(spark, log_dir):
    log = spark.readStream.schema(spark.read.parquet(log_dir).schema).option("maxFilesPerTrigger", 1).parquet(log_dir)
    return MT.attribute_requests(log, FX.keys(spark, SF), FX.members(spark, SF), FX.ADMIN_KEYS)


def _run(df, name, mode, scratch):
    with U.keyed_state(df.sparkSession):
        q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", os.path.join(scratch, f"ck_{name}")).start())
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_monthly_usage_stream_equals_batch(spark, scratch):
    log_dir = _log_dir(spark, scratch)
    got = _run(U.monthly_usage_stream(_attributed_stream(spark, log_dir)), "h5", "complete", scratch)
    batch = MT.monthly_usage(MT.attribute_requests(FX.request_log(spark, SF), FX.keys(spark, SF),
                                                   FX.members(spark, SF), FX.ADMIN_KEYS))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_admission_stream_equals_batch(spark, scratch):
    log_dir = _log_dir(spark, scratch)
    attr_b = MT.attribute_requests(FX.request_log(spark, SF), FX.keys(spark, SF), FX.members(spark, SF),
                                   FX.ADMIN_KEYS)
    # one micro-batch with the whole log: order inside the call decides
    log = spark.readStream.schema(spark.read.parquet(log_dir).schema).parquet(log_dir)
    attr_s = MT.attribute_requests(log, FX.keys(spark, SF), FX.members(spark, SF), FX.ADMIN_KEYS)
    m = _run(U.admission_stream(attr_s, "monthly"), "h6m", "append", scratch)
    want_m = {r["event_id"]: (r["used"], r["admitted"]) for r in MT.monthly_admission(attr_b).collect()}
    got_m = {r["event_id"]: (r["used"], r["admitted"]) for r in m.collect()}
    assert got_m == want_m
    a = _run(U.admission_stream(attr_s, "anchored"), "h6a", "append", scratch)
    want_a = {r["event_id"]: (r["used"], r["admitted"]) for r in MT.anchored_admission(attr_b).collect()}
    got_a = {r["event_id"]: (r["used"], r["admitted"]) for r in a.collect()}
    assert got_a == want_a


def test_late_requests_give_no_quota_back(spark, scratch):
    """Out of order over several micro-batches: January counts in January, February goes on where it was."""
    log_dir = os.path.join(scratch, "log")
    rows = [(i, f"2024-02-01 00:00:{i:02d}") for i in range(10)] + [(10, "2024-01-31 23:00:00")] + [(11, "2024-02-02 00:00:00"), (12, "2024-01-31 23:30:00")]
    for part in (rows[:10], rows[10:11], rows[11:]):
        df = spark.createDataFrame([(i, t, "eae_1", "series", 200, "user_api_key", "free", "a@x.org") for i, t in part],
                                   "event_id long, ts string, api_key string, kind string, status int, auth_type string, tier string, email string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(log_dir)
    stream = spark.readStream.schema(spark.read.parquet(log_dir).schema).option("maxFilesPerTrigger", 1).parquet(log_dir)
    got = {r["event_id"]: (r["used"], r["admitted"]) for r in _run(U.admission_stream(stream, "monthly"), "h6late", "append", scratch).collect()}
    assert got[10] == (1, True) and got[11] == (11, False) and got[12] == (2, True)


def _requests(spark, rows, path):
    """(event_id, seconds after 2024-01-30, identity, tier) as attributed requests of a key and of a member."""
    df = spark.createDataFrame(rows, "event_id long, s long, who string, tier string")
    ts = F.to_timestamp(F.lit("2024-01-30")) + F.make_interval(secs=F.col("s"))
    both = [df.select("event_id", ts.alias("ts"), F.col("who").alias("api_key"), F.lit("series").alias("kind"), F.lit(200).alias("status"),
                      F.lit(auth).alias("auth_type"), "tier", F.col("who").alias("email")) for auth in ("user_api_key", "member")]
    both[0].unionByName(both[1]).coalesce(1).write.mode("append").parquet(path)


def test_a_hot_identity_is_sorted_in_bounded_runs(spark, scratch):
    """One identity sends most of each micro-batch, in no order, with ties: runs of 100 rows in blocks of 16 give what the
    batch rules give; state and runs carry over three batches."""
    rng, log_dir = random.Random(3), os.path.join(scratch, "log")
    rows = [(i, i // 3 * 997, "hot" if rng.random() < 0.7 else f"u{i % 7}", "daily") for i in range(1500)]
    rows += [(2000 + i, i * 9000, "free", "free") for i in range(60)] + [(3000 + i, i * 5000, "all", "premium") for i in range(100)]
    rows.sort(key=lambda r: (r[1], r[0]))
    for a in range(0, len(rows), 700):
        part = rows[a:a + 700]
        rng.shuffle(part)
        _requests(spark, part, log_dir)
    whole = spark.read.parquet(log_dir)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(log_dir)
    for rule, batch in (("monthly", MT.monthly_admission), ("anchored", MT.anchored_admission)):
        got = {r["event_id"]: (r["used"], r["admitted"]) for r in _run(U.admission_stream(stream, rule, run=100, block=16), f"hot_{rule}", "append", scratch).collect()}
        want = {r["event_id"]: (r["used"], r["admitted"]) for r in batch(whole).collect()}
        assert got == want and len(got) == len(rows)


def test_requests_without_a_time_are_left_out(spark, scratch):
    log_dir = os.path.join(scratch, "log")
    _requests(spark, [(1, None, "a", "free"), (2, 5, "a", None), (3, 6, None, "free")], log_dir)
    stream = spark.readStream.schema(spark.read.parquet(log_dir).schema).parquet(log_dir)
    for rule in ("monthly", "anchored"):
        assert {r["event_id"]: r["used"] for r in _run(U.admission_stream(stream, rule), f"null_{rule}", "append", scratch).collect()} == {2: 1, 3: 1}


def test_state_is_forgotten_after_days_without_a_request(spark, scratch):
    log_dir = os.path.join(scratch, "log")
    _requests(spark, [(i, i, "a", "free") for i in range(5)], log_dir)
    stream = spark.readStream.schema(spark.read.parquet(log_dir).schema).parquet(log_dir)
    with U.keyed_state(spark):
        q = (U.admission_stream(stream, keep_days=2 / 86_400).writeStream.format("memory").queryName("forgets").outputMode("append")
             .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(processingTime="200 milliseconds").start())
    try:
        _wait(lambda: spark.table("forgets").count() == 5)
        time.sleep(3)
        _requests(spark, [(10, 10, "a", "free")], log_dir)
        _wait(lambda: spark.table("forgets").count() == 6)
        assert spark.table("forgets").where("event_id = 10").first()["used"] == 1
    finally:
        q.stop()


def test_usage_table_takes_epochs_again_and_folds(spark, scratch):
    """A batch writes the keys it touched; one that comes again changes nothing; folds keep the counts."""
    table = os.path.join(scratch, "usage")
    assert U.usage_table(spark, table).count() == 0
    sink, want = U.usage_sink(table, fold_every=3), {}
    for epoch in range(11):
        touched = {(f"k{epoch % 4}", "2024-01"): epoch + 1, ("all", f"2024-{1 + epoch // 6:02d}"): epoch + 1}
        want |= touched
        batch = spark.createDataFrame([(k, m, n) for (k, m), n in touched.items()], "api_key string, month string, count long")
        for _ in range(2 if epoch in (0, 4, 9) else 1):
            sink(batch, epoch)
        assert spark.read.parquet(f"{table}/epochs/epoch={epoch}").count() == len(touched)
        assert {(r["api_key"], r["month"]): r["count"] for r in U.usage_table(spark, table).collect()} == want
    assert sorted(os.listdir(f"{table}/folds")) == ["fold=6", "fold=9"] and len([n for n in os.listdir(f"{table}/epochs") if n.startswith("epoch=")]) == 4


def _events(spark, scratch, rows, name="events"):
    path = os.path.join(scratch, name)
    spark.createDataFrame(rows, "ts string, path string, kind string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)
    return path


def _wait(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.1)
    assert condition()


def test_a_burst_is_one_update_after_silence(spark, scratch):
    """Each event restarts the one timer; late events and the last burst are updated too."""
    path = _events(spark, scratch, [("2024-01-01 00:00:00", "cn/a_m.parquet", "modified"), ("2024-01-01 00:10:01", "jp/c.csv", "created")])
    calls, last = [], []
    q = H.continuous_refresh(spark, path, spark.read.parquet(path).schema, FX.EVENT_ROOTS, lambda c: calls.append((time.time(), c)),
                             os.path.join(scratch, "ck"), silence=5, every="200 milliseconds")
    try:
        for i in range(4):  # over more than the silence, never silent for so long
            time.sleep(2)
            _events(spark, scratch, [(f"20{20 + i}-01-01 00:00:00", f"{'jp' if i % 2 else 'kr'}/b_q.parquet", "created")])
            last.append(time.time())
        _wait(lambda: calls)
        assert [c for _, c in calls] == [["cn", "jp", "kr"]] and calls[0][0] - last[-1] >= 4
        _events(spark, scratch, [("1999-06-01 00:00:00", "tw/late_a.parquet", "deleted")])
        _wait(lambda: len(calls) == 2)
        assert calls[1][1] == ["tw"]
    finally:
        q.stop()


def test_bursts_count_events_without_a_time(spark, scratch):
    path = _events(spark, scratch, [(None, "cn/a_m.parquet", "modified"), ("2024-01-01 00:00:00", "cn/a_m.parquet", "modified"), (None, "jp/a_m.parquet", "created")])
    stream = H.route_country(H.relevant_changes(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)), FX.EVENT_ROOTS)
    with H.timers(spark):
        q = (H.debounced_stream(stream, 1).writeStream.format("memory").queryName("bursts").outputMode("append")
             .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(processingTime="200 milliseconds").start())
    try:
        _wait(lambda: spark.table("bursts").count() == 2)
    finally:
        q.stop()
    got = {r["country"]: (str(r["first"]), str(r["last"]), r["events"]) for r in spark.table("bursts").collect()}
    assert got == {"cn": ("2024-01-01 00:00:00", "2024-01-01 00:00:00", 2), "jp": ("None", "None", 1)}


def test_failed_updates_are_tried_again_without_an_event_and_after_a_restart(spark, scratch):
    path = _events(spark, scratch, [("2024-01-01 00:00:00", "cn/a_m.parquet", "modified"), ("2024-01-01 00:10:00", "jp/b_q.parquet", "created")])
    calls, ok = [], []

    def update(countries):
        calls.append(countries)
        if not ok:
            raise RuntimeError("no luck")

    def start():
        return H.continuous_refresh(spark, path, spark.read.parquet(path).schema, FX.EVENT_ROOTS, update, os.path.join(scratch, "ck"), silence=1, every="200 milliseconds")
    q = start()
    try:
        _wait(lambda: len(calls) >= 2)  # again, without a new event
    finally:
        q.stop()
    assert all(c == ["cn", "jp"] for c in calls)
    ok.append(True)
    n = len(calls)
    q = start()
    try:
        _wait(lambda: len(calls) > n)
        assert calls[n] == ["cn", "jp"]
        time.sleep(4)
        assert len(calls) == n + 1  # done: not tried again
    finally:
        q.stop()


def test_refresh_once_builds_the_store(spark, scratch):
    """One shot: what is there is taken as read, and all countries are updated in one run."""
    import pandas as pd

    from seriesforge.plans.maintenance import build_store
    from seriesforge.sources import snapshot as SN
    roots = [(c, os.path.join(scratch, c) + "/") for c in ("cn", "jp")]
    for c, folder in roots:
        os.makedirs(folder)
        pd.DataFrame({"Date": pd.to_datetime(["2020-01-01"]), f"{c} x": [1.0]}).to_parquet(f"{folder}a_m.parquet", index=False)
    path = _events(spark, scratch, [("2024-01-01 00:00:00", f"{roots[0][1]}a_m.parquet", "created")])
    calls, store = [], os.path.join(scratch, "store")

    def update(countries):
        calls.append(countries)
        build_store(spark, store, [(c, r.rstrip("/")) for c, r in roots], countries=countries)
    H.continuous_refresh(spark, path, spark.read.parquet(path).schema, roots, update, os.path.join(scratch, "ck"), once=True)
    assert calls == [["cn", "jp"]]
    assert SN.open_snapshot(spark, store).catalog.count() == 2
