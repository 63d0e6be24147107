"""Exact substring dedup over words by De Bruijn compaction.

Edges are the windows of ``k`` words, nodes the sequences of k-1 words between them. Edges that occur once are left out
before they become rows (see _anchors). What stays are paths of edges: a run that has copies as a whole, counted by a
digest of its words read at its source coordinates; and, where runs with one anchor differ, the single edges that they
share, found by hash within the anchor's group and verified by their words. (An anchor with too many words of classes doesn't
make one group: its edges are counted by digest in partial aggregates, and found again by a join.) Repeated paths then
compact: where exactly one path ends in a node and exactly one begins there, both are one longer path. Most such joints
lie side by side in the text that a path was first seen in, and one window over each text's own paths closes them;
joints across texts are closed by connected components. The spans of a text are the unions of its occurrences of
compacted paths.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.llm import _anchors as A
from seriesforge.llm import _text as T
from seriesforge.llm._frames import arrow_map, ddl, staged
from seriesforge.llm._graph import connected_components

WINDOW = 35
#: Words of the grams that anchor windows.
GRAM = 12
#: Words of an anchor's runs that are compared together; an anchor with more is counted by digests.
TOGETHER = 1 << 19
#: Bytes of runs compared at once in a task.
CHUNK = 1 << 20
PATH = ["d1", "d2"]
PLACED = "d1 long, d2 long, head long, tail long, doc_id long, th long, start int, n int"


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _runs_read(k: int):
    """Texts with their runs -> each run's digest, first and last node, source coordinates, and its words if its edges
    are to be compared."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = T.texts_of(b.column("text"))
        units, first = A.units_of(raw, offsets, True)
        sums = T.Sums(units, T.ROOTS[0])
        row = A.owners(b, "start")
        start, n, ah, expand, lone, crowded = (A.flat(b, c) for c in ("start", "n", "ah", "expand", "lone", "crowded"))
        at = start.astype(np.int64) + first[row]
        end = at + n + k - 1
        data = raw.tobytes()
        digests, kept, have, words = [], [], -1, []
        for t, x, length, wide in zip(row.tolist(), start.tolist(), n.tolist(), expand.tolist()):  # rows come text by text
            if t != have:
                words, have = data[offsets[t]:offsets[t + 1]].split(), t
            line = b" ".join(words[x:x + length + k - 1])
            digests.append(_digest(line))
            kept.append(line if wide else None)
        d, r = _halves(digests), pa.array(row)
        return pa.record_batch([
            pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sums.spans(at, at + k - 1).view(np.int64)), pa.array(sums.spans(end - k + 1, end).view(np.int64)),
            b.column("doc_id").take(r), b.column("th").take(r), pa.array(start), pa.array(n), pa.array(ah), pa.array(lone), pa.array(crowded), pa.array(kept, pa.binary())],
            names=[*PATH, "head", "tail", "doc_id", "th", "start", "n", "ah", "lone", "crowded", "bytes"])
    return batch


def _edges(k: int, t: pa.RecordBatch, wanted) -> pa.RecordBatch | None:
    """Edges of the runs of a batch as paths of one edge. ``wanted`` (windows' hash, run) -> which windows to read."""
    raw, offsets = T.texts_of(t.column("bytes"))
    units, first = A.units_of(raw, offsets, True)
    begin, end, _ = T.words_of(raw, offsets)
    n = len(units) - k + 1
    run = np.repeat(np.arange(t.num_rows), np.diff(first))
    at = np.flatnonzero(run[:n] == run[k - 1:])
    at = at[wanted(T.Sums(units, T.ROOTS[1]).windows(k)[at], run[at])]
    if not len(at):
        return None
    data, sums = raw.tobytes(), T.Sums(units, T.ROOTS[0])
    d = _halves([_digest(data[x:y]) for x, y in zip(begin[at].tolist(), end[at + k - 1].tolist())])
    r = run[at]
    take = pa.array(r)
    return pa.record_batch([
        pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sums.spans(at, at + k - 1).view(np.int64)), pa.array(sums.spans(at + 1, at + k).view(np.int64)),
        t.column("doc_id").take(take), t.column("th").take(take), pa.array((t.column("start").to_numpy()[r] + at - first[r]).astype(np.int32)), pa.array(np.ones(len(at), np.int32)),
        t.column("ah").take(take), t.column("lone").take(take)], names=[*PATH, "head", "tail", "doc_id", "th", "start", "n", "ah", "lone"])


def _twice(*keys: np.ndarray) -> np.ndarray:
    """Which rows share all keys with another row."""
    order = np.lexsort(keys)
    same = np.ones(max(0, len(order) - 1), bool)
    for key in keys:
        same &= key[order[1:]] == key[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _shared_edges(k: int, chunk: int):
    """Runs sorted by anchor -> the edges of lone runs that another edge of the same anchor equals, word for word."""
    def work(t: pa.RecordBatch) -> pa.RecordBatch | None:
        ah = t.column("ah").to_numpy()
        group = np.cumsum(np.append(0, ah[1:] != ah[:-1]))
        found = _edges(k, t, lambda h, run: _twice(h, group[run]))
        if found is None:
            return None
        equal = _twice(*(found.column(c).to_numpy() for c in ("d1", "d2", "ah")))
        return found.filter(pa.array(equal & found.column("lone").to_numpy(zero_copy_only=False))).drop_columns(["ah", "lone"])
    return A.by_anchor(work, lambda b: np.diff(T.texts_of(b.column("bytes"))[1]), chunk)


def _compacted(paths: DataFrame) -> DataFrame:
    """Repeated paths (PATH, head, tail, and where first seen) -> PATH and the id of the compacted path of each."""
    ids = staged(paths.withColumn("id", F.xxhash64(*PATH)))
    ends = staged(ids.groupBy("tail").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n = 1").select(F.col("tail").alias("node"), "a"))
    begins = staged(ids.groupBy("head").agg(F.count("*").alias("n"), F.min("id").alias("b")).where("n = 1").select(F.col("head").alias("node"), "b"))
    joints = staged(ends.join(begins, "node").select("a", "b"))
    here = Window.partitionBy("doc_id", "th").orderBy("start", "n", "id")
    linked = ids.join(joints.withColumnRenamed("b", "id"), "id", "left")  # a: the path that must stand before
    placed = linked.withColumn("new", (~F.coalesce(F.col("a") == F.lag("id").over(here), F.lit(False))).cast("int"))
    islands = staged(placed.withColumn("island", F.sum("new").over(here)).withColumn(
        "island", F.min("id").over(Window.partitionBy("doc_id", "th", "island"))).select("id", "island", "a", *PATH))
    across = islands.where("a IS NOT NULL").select("a", F.col("island").alias("y")).join(
        islands.select(F.col("id").alias("a"), F.col("island").alias("x")), "a").where("x <> y").select("x", "y")
    roots = connected_components(across)
    return islands.join(roots.select(F.col("node").alias("island"), "root"), "island", "left").select(
        *PATH, F.coalesce("root", "island").alias("path"))


def repeated_spans(docs: DataFrame, k: int = WINDOW, m: int = GRAM, together: int = TOGETHER, chunk: int = CHUNK) -> DataFrame:
    """keyed documents -> (doc_id, th, path, start, n): every occurrence, in words, of a repeated path of n windows."""
    hits, classes = A.repeated_runs(docs, True, k, m)
    known = classes.select("ah", "rh", "one", "mixed", (F.col("copies") == 1).alias("lone"), (F.col("together") > together).alias("crowded"))
    first = F.struct("doc_id", "th", "start", "n") == F.col("one")
    marked = hits.join(known, ["ah", "rh"]).withColumn("expand", F.col("mixed") & F.coalesce(first, F.lit(False)))
    fields = ["start", "n", "ah", "expand", "lone", "crowded"]
    rows = A.by_text(marked.where("expand OR NOT lone").select("doc_id", "th", *fields).distinct(), *fields)
    read = staged(arrow_map(A.with_texts(docs, rows).select("doc_id", "th", "text", *fields), _runs_read(k), PLACED + ", ah long, lone boolean, crowded boolean, bytes binary"))

    whole = read.where("NOT lone").select(*PATH, "head", "tail", "doc_id", "th", "start", "n")
    copied = staged(whole.groupBy(*PATH).count().where("count > 1").select(*PATH))
    expand = read.where("bytes IS NOT NULL").select("ah", "doc_id", "th", "start", "lone", "crowded", "bytes")
    few = expand.where("NOT crowded").repartition("ah").sortWithinPartitions("ah").mapInArrow(_shared_edges(k, chunk), PLACED)
    each = staged(arrow_map(expand.where("crowded"), lambda b: _edges(k, b, lambda h, run: np.ones(len(h), bool)), PLACED + ", ah long, lone boolean"))
    dense = staged(each.groupBy(*PATH).count().where("count > 1").select(*PATH))
    many = each.where("lone").join(dense, PATH).select(*few.columns)
    paths = staged(whole.join(copied, PATH).union(few).union(many))

    distinct = staged(paths.groupBy(*PATH).agg(F.min("head").alias("head"), F.min("tail").alias("tail"), F.min(F.struct("doc_id", "th", "start", "n")).alias("one")).select(*PATH, "head", "tail", "one.*"))
    return paths.drop("head", "tail").join(staged(_compacted(distinct)), PATH).select("doc_id", "th", "path", "start", "n")


def substring_dedup(docs: DataFrame, k: int = WINDOW, m: int = GRAM, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept, n_words, n_removed and the columns of ``keep`` for every row of ``docs``: ``kept`` is the text without
    the words that a repeated window of ``k`` words covers, joined by single spaces.

    Null text: no words, kept is empty. Texts of fewer than ``k`` words lose nothing. Repeated rows are copies of each
    other and lose all their windows; a window may also repeat inside one text, overlaps included. Null doc_ids stay.
    An empty table gives no rows.
    """
    if not 1 <= m <= k or k < 2:
        raise ValueError("1 <= m <= k and k >= 2 are needed")
    spans = A.by_text(repeated_spans(A.keyed(docs), k, m).select("doc_id", "th", "start", "n").distinct(), "start", "n")
    none = F.array().cast("array<int>")
    joined = A.with_texts(A.keyed(docs, keep), spans, "left").select("doc_id", "text", F.coalesce("start", none).alias("start"), F.coalesce("n", none).alias("n"), *(f"_keep{i}" for i in range(len(keep))))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        at, start, length = b.column(2).offsets.to_numpy(), b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64)
        kept, total, gone = [], [], []
        for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            s, e = A.merged(start[at[i]:at[i + 1]], start[at[i]:at[i + 1]] + length[at[i]:at[i + 1]] + k - 1)
            left, last = [], 0
            for x, y in zip(s.tolist(), e.tolist()):
                left += words[last:x]
                last = y
            left += words[last:]
            kept.append(b" ".join(left))
            total.append(len(words))
            gone.append(len(words) - len(left))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), *b.columns[4:]], names=["doc_id", "kept", "n_words", "n_removed", *keep])
    return arrow_map(joined, batch, "doc_id long, kept string, n_words long, n_removed long" + ddl(docs, keep))
