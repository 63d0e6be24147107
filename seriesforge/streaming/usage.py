"""H5/H6: request logs as streams.

H5 counts M5 in update mode (state = one count per key and month) into a table
that takes the rows a micro-batch touched, tagged with its epoch.
H6 applies M6 / M7 per identity with keyed state on RocksDB: a count for each
month, or the open window's start and admitted count; it grows with identities
and months, not with requests, and leaves after days without a request if the
caller says so. A late request counts in its own month, and never gives a newer month its quota back.
Requests of one micro-batch are taken in time order: an identity's are sorted
in runs that wait in its state and are merged block by block, so that one that
sends most of a batch takes no more memory than others.
"""

from __future__ import annotations

import uuid
from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from seriesforge.operators import metering as MT
from seriesforge.sources import snapshot as SN
from seriesforge.streaming.file_events import ROCKSDB, settings

# ---- H5 -------------------------------------------------------------------------------

USAGE = "api_key string, count long, month string"
#: Epochs after which the usage table is folded.
FOLD_EVERY = 50


def monthly_usage_stream(attributed: DataFrame, hidden=None) -> DataFrame:
    """H5: streaming M5 (use output mode ``update`` or ``complete``). ``hidden``: a list of patterns."""
    return MT.monthly_usage(attributed, hidden)


def usage_sink(table: str, fold_every: int = FOLD_EVERY):
    """``foreachBatch`` function for H5 in update mode: the (key, month) counts that a micro-batch touched are written below
    ``table`` as its epoch, by month. An epoch that comes again after a failure replaces itself."""
    def keep(batch: DataFrame, epoch: int) -> None:
        batch.select("api_key", "count", "month").write.mode("overwrite").partitionBy("month").parquet(f"{table}/epochs/epoch={epoch}")
        if epoch and epoch % fold_every == 0:
            fold_usage(batch.sparkSession, table, epoch)
    return keep


def _numbered(spark: SparkSession, folder: str, tag: str) -> list[int]:
    return sorted(int(n.removeprefix(tag)) for n in SN._children(spark, folder) if n.startswith(tag))


def usage_table(spark: SparkSession, table: str) -> DataFrame:
    """api_key, month, count as of the last epoch: the last fold and the epochs after it. An empty table gives no rows."""
    folds, epochs = _numbered(spark, f"{table}/folds", "fold="), _numbered(spark, f"{table}/epochs", "epoch=")
    fold = folds[-1] if folds else -1

    def part(path: str, epoch: int) -> DataFrame:
        return spark.read.schema(USAGE).parquet(path).withColumn("epoch", F.lit(epoch).cast("long"))
    rows = spark.createDataFrame([], f"{USAGE}, epoch long")
    if folds:
        rows = rows.unionByName(part(f"{table}/folds/fold={fold}", fold))
    later = [f"{table}/epochs/epoch={e}" for e in epochs if e > fold]  # at most about twice FOLD_EVERY
    if later:
        rows = rows.unionByName(spark.read.schema(f"{USAGE}, epoch long").option("basePath", f"{table}/epochs").parquet(*later))
    return rows.groupBy("api_key", "month").agg(F.max_by("count", "epoch").alias("count"))


def fold_usage(spark: SparkSession, table: str, epoch: int) -> None:
    """The counts as of ``epoch`` (the last one) become one table, by a rename; what the fold before it covered is deleted,
    what it needs stays for those who read it now."""
    folds = _numbered(spark, f"{table}/folds", "fold=")
    if epoch in folds:  # a batch that came again
        return
    making = f"{table}/folding-{uuid.uuid4().hex}"
    usage_table(spark, table).select("api_key", "count", "month").write.partitionBy("month").parquet(making)
    fs, source = SN._fs(spark, making)
    _, target = SN._fs(spark, f"{table}/folds/fold={epoch}")
    fs.mkdirs(target.getParent())
    fs.rename(source, target)
    if folds:
        for e in _numbered(spark, f"{table}/epochs", "epoch="):
            if e <= folds[-1]:
                SN._delete(spark, f"{table}/epochs/epoch={e}")
        for f in folds[:-1]:
            SN._delete(spark, f"{table}/folds/fold={f}")


# ---- H6 -------------------------------------------------------------------------------

_OUT = "identity string, event_id long, ts long, used long, admitted boolean"  # times are microseconds inside
#: Requests of an identity that are sorted together, and that a block of such a run holds.
RUN, BLOCK = 1 << 20, 1 << 14


def keyed_state(spark: SparkSession) -> AbstractContextManager:
    """Settings that an admission stream keeps from its start: its state is in RocksDB."""
    return settings(spark, ROCKSDB)


def _admitter(rule: str, keep_ms: int | None, run_rows: int, block_rows: int) -> StatefulProcessor:
    """M6 or M7 for one identity. Made here, so that it travels to the executors by value."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T
    from pyspark.sql.streaming import StatefulProcessor

    def struct(**fields):
        return T.StructType([T.StructField(n, t) for n, t in fields.items()])
    place, packed = struct(run=T.IntegerType(), block=T.IntegerType()), struct(rows=T.BinaryType())
    month, counted = struct(month=T.IntegerType()), struct(count=T.LongType())
    opened = struct(anchor=T.LongType(), count=T.LongType())
    request, day = [("ts", "<i8"), ("event_id", "<i8"), ("quota", "<i4")], 86_400_000_000

    class Admitter(StatefulProcessor):
        def init(self, handle):
            self.waiting = handle.getMapState("waiting", place, packed)  # empty when a batch ends
            if rule == "monthly":
                self.months = handle.getMapState("months", month, counted, keep_ms)
            else:
                self.window = handle.getValueState("window", opened, keep_ms)

        def handleInputRows(self, key, rows, timerValues):
            for part in self.in_order(rows):
                used, ok = self.monthly(part) if rule == "monthly" else self.anchored(part)
                yield pd.DataFrame({"identity": pd.Series([key[0]] * len(part), dtype=object), "event_id": part["event_id"], "ts": part["ts"],
                                    "used": used, "admitted": ok})

        def in_order(self, chunks):
            """The identity's requests of this batch by time, then event_id, a part at a time."""
            def by_time(held):
                rows = np.concatenate(held) if held else np.empty(0, request)
                return rows[np.lexsort((rows["event_id"], rows["ts"]))]
            held, size, runs = [], 0, []  # runs: the blocks of each

            def put():
                rows = by_time(held)
                blocks = range(0, len(rows), block_rows)
                for b, at in enumerate(blocks):
                    self.waiting.updateValue((len(runs), b), (rows[at:at + block_rows].tobytes(),))
                runs.append(len(blocks))
            for chunk in chunks:
                rows = np.empty(len(chunk), request)
                for name, _ in request:
                    rows[name] = chunk[name].to_numpy()
                held.append(rows)
                size += len(rows)
                if size >= run_rows:
                    put()
                    held, size = [], 0
            if not runs:
                rows = by_time(held)
                yield from (rows[at:at + block_rows] for at in range(0, len(rows), block_rows))
                return
            if held:
                put()
            heads, taken = {}, dict.fromkeys(range(len(runs)), 0)
            while True:
                for r, blocks in enumerate(runs):
                    if not len(heads.get(r, ())) and taken[r] < blocks:
                        at = (r, taken[r])
                        heads[r] = np.frombuffer(self.waiting.getValue(at)[0], request)
                        self.waiting.removeKey(at)
                        taken[r] += 1
                heads = {r: rows for r, rows in heads.items() if len(rows)}
                if not heads:
                    return
                # nothing that is still waiting comes before the least of the blocks' last requests
                ts, event = min((int(rows["ts"][-1]), int(rows["event_id"][-1])) for rows in heads.values())
                now = []
                for r, rows in heads.items():
                    n = int(np.count_nonzero((rows["ts"] < ts) | ((rows["ts"] == ts) & (rows["event_id"] <= event))))
                    now.append(rows[:n])
                    heads[r] = rows[n:]
                yield by_time(now)

        def monthly(self, rows):
            of = rows["ts"].astype("M8[us]").astype("M8[M]").astype(np.int64)
            used = np.empty(len(rows), np.int64)
            for m in np.unique(of).tolist():
                at = np.flatnonzero(of == m)
                before = self.months.getValue((m,))[0] if self.months.containsKey((m,)) else 0
                used[at] = before + np.arange(1, len(at) + 1)  # refused requests are counted too
                self.months.updateValue((m,), (before + len(at),))
            return used, (rows["quota"] < 0) | (used <= rows["quota"])

        def anchored(self, rows):
            anchor, count = self.window.get() if self.window.exists() else (None, 0)
            ts, quota = rows["ts"], rows["quota"].astype(np.int64)
            used, ok, i = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), 0
            while i < len(rows):
                if anchor is None or ts[i] - anchor > day:
                    anchor, count = int(ts[i]), 0
                end = int(np.searchsorted(ts, anchor + day, side="right"))  # a late request counts in the open window
                while i < end:  # a stretch of one quota
                    other = np.flatnonzero(quota[i:end] != quota[i])
                    stop = i + int(other[0]) if len(other) else end
                    n = stop - i if quota[i] < 0 else max(0, min(stop - i, int(quota[i]) - count))
                    ok[i:i + n], used[i:i + n] = True, count + np.arange(1, n + 1)
                    count, i = count + n, stop  # refused requests are not counted
            self.window.update((anchor, count))
            return pd.arrays.IntegerArray(used, ~ok), ok

        def close(self):
            pass

    return Admitter()


def admission_stream(attributed: DataFrame, rule: str = "monthly", hidden=None, keep_days: float | None = None,
                     run: int = RUN, block: int = BLOCK) -> DataFrame:
    """H6: per-identity admission with state; ``rule`` is monthly (M6) or anchored (M7). Requests without a time are left
    out; event ids are not null. Output mode ``append``; start the query inside ``keyed_state``. With ``keep_days`` an
    identity's month or window is forgotten so many days after its last request was handled (more than a month, and than the
    stream may be behind); such a query looks at the clock, so it needs a processing-time trigger and never ends by itself."""
    c = MT.charged(attributed, hidden)
    if rule == "monthly":
        c = c.where(F.col("auth_type") == "user_api_key").withColumn("identity", F.col("api_key"))
        quota = MT.monthly_limit(F.col("tier"))
    else:
        c = c.where(F.col("auth_type").isin("member", "api_key")).withColumn("identity", F.col("email"))
        quota = MT.window_limit(F.col("tier"))
    c = c.where(F.col("ts").isNotNull()).select("identity", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
                                                F.coalesce(quota, F.lit(-1)).alias("quota"))
    out = c.groupBy("identity").transformWithStateInPandas(
        statefulProcessor=_admitter(rule, None if keep_days is None else int(keep_days * 86_400_000), run, block), outputStructType=_OUT,
        outputMode="append", timeMode="None" if keep_days is None else "ProcessingTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))
