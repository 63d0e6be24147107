"""Candidates for repeated windows of k units (words or bytes), without a row for each window.

Each window chooses its anchor: the m-unit gram of least hash inside it. Equal windows choose equal anchors at equal
places, so windows that share no anchor with another place can't repeat. Consecutive windows with equal anchors make a
run, a few percent as many rows as windows; a run that holds its anchor at several places (text that repeats itself)
is marked. Runs of an anchor that occurs once in the corpus are dropped by one count and one join; equal runs are a
class, of which one stands for all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text as T
from seriesforge.llm._frames import arrow_map, kept_aside, staged

RUN = "ah long, rh long, doc_id long, th long, start int, n int, multi boolean"


def keyed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, th, text, and the columns of ``keep``: the text's hash tells rows that share a doc_id apart; equal rows
    get equal results."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("th"), docs["text"].cast("string").alias("text"), *kept_aside(docs, keep))


def units_of(raw: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """The units of a batch end to end (hashes of words, or the bytes), and the first unit of each text."""
    if not words:
        return raw, offsets
    starts, ends, first = T.words_of(raw, offsets)
    return T.word_hashes(raw, starts, ends, T.ROOTS[0]), first


def batch_runs(raw: np.ndarray, offsets: np.ndarray, words: bool, k: int, m: int, block: int = 1 << 21):
    """(ah, rh, text number, start, windows, multi) of the runs of a batch, or None. Of very long texts ``block`` windows
    are looked at at a time; a run ends there too, which only makes two classes of what could be one."""
    units, first = units_of(raw, offsets, words)
    windows = len(units) - k + 1
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    parts = [_runs(units[at:at + block + k - 1], text[at:at + block + k - 1], at, k, m) for at in range(0, windows, block)]
    if not parts:
        return None
    ah, rh, own, start, n, multi = (np.concatenate(c) for c in zip(*parts))
    return ah, rh, own, start - first[own], n, multi


def _runs(units: np.ndarray, text: np.ndarray, offset: int, k: int, m: int):
    n = len(units) - k + 1
    grams = T.Sums(units, T.ROOTS[0]).windows(m)
    anchor = T.window_min(grams, k - m + 1)
    inside = text[:n] == text[k - 1:]
    moved = np.append(True, anchor[1:] != anchor[:-1])
    changed = moved.copy()
    changed[moved] = np.append(True, np.diff(grams[anchor[moved]].view(np.int64)) != 0)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | changed[1:]
    starts = np.flatnonzero(begins)
    edges = np.append(np.flatnonzero(begins | ~inside), n)
    ends = edges[np.searchsorted(edges, starts, side="right")]
    moves = np.cumsum(moved)
    rh = T.Sums(units, T.ROOTS[1]).spans(starts, ends + k - 1)
    return grams[anchor[starts]], rh, text[starts], starts + offset, ends - starts, moves[ends - 1] > moves[starts]


def runs(docs: DataFrame, words: bool, k: int, m: int) -> DataFrame:
    """All runs of all texts of ``keyed`` documents."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
        raw, offsets = T.texts_of(b.column(2))
        ids, th, parts = b.column(0), b.column(1).to_numpy(), []
        for i, j in T.groups(offsets):
            found = batch_runs(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], words, k, m)
            if found is not None and len(found[0]):
                ah, rh, text, start, n, multi = found
                parts.append(pa.record_batch([pa.array(ah.view(np.int64)), pa.array(rh.view(np.int64)), ids.take(pa.array(text + i)), pa.array(th[text + i]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(multi)], names=["ah", "rh", "doc_id", "th", "start", "n", "multi"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None
    return arrow_map(docs, batch, RUN)


def repeated_runs(docs: DataFrame, words: bool, k: int, m: int) -> tuple[DataFrame, DataFrame]:
    """(hits, classes): all runs whose anchor occurs twice or more; and for each class of equal runs (ah, rh) the number
    of copies, the class's first run (doc_id, th, start, n), the number of classes with that anchor and about how many
    units they have together, and ``mixed``: whether its windows may repeat elsewhere than in its copies."""
    found = runs(docs, words, k, m)
    twice = staged(found.groupBy("ah").agg(F.sum(F.col("multi").cast("int") + 1).alias("c")).where("c > 1").select("ah"))
    hits = staged(found.join(twice, "ah"))
    equal = staged(hits.groupBy("ah", "rh").agg(F.count("*").alias("copies"), F.max("multi").alias("multi"), F.min(F.struct("doc_id", "th", "start", "n")).alias("one")))
    among = staged(equal.groupBy("ah").agg(F.count("*").alias("classes"), F.sum(F.col("one.n") + k).alias("together")))
    return hits, staged(equal.join(among, "ah").withColumn("mixed", F.expr("classes > 1 OR multi")))


def by_text(rows: DataFrame, *fields: str) -> DataFrame:
    """One row per text, with its rows' fields as arrays in one order: bounded by the text's own length."""
    packed = rows.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    return packed.select("doc_id", "th", *(F.col("rows")[f].alias(f) for f in fields))


def with_texts(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """keyed documents beside their by_text rows (null doc_ids meet too)."""
    r = rows.withColumnsRenamed({"doc_id": "_doc", "th": "_th"})
    return docs.join(r, docs["doc_id"].eqNullSafe(r["_doc"]) & (docs["th"] == r["_th"]), how).drop("_doc", "_th")


def by_anchor(work: Callable[[pa.RecordBatch], pa.RecordBatch | None], size: Callable[[pa.RecordBatch], np.ndarray], chunk: int):
    """A mapInArrow function over rows sorted by ``ah``: ``work`` gets chunks of about ``chunk`` in size, cut between
    two anchors."""
    def done(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        rows.clear()  # the batches needn't stand beside their copy
        out = work(together)
        if out is not None and out.num_rows:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            ah = b.column("ah").to_numpy()
            sums = np.concatenate(([0], np.cumsum(size(b))))
            cuts = (np.flatnonzero(ah[1:] != ah[:-1]) + 1).tolist()
            if last is not None and last != ah[0]:
                cuts = [0, *cuts]
            at = 0
            for cut in cuts:
                if have + sums[cut] - sums[at] >= chunk:
                    held.append(b.slice(at, cut - at))
                    yield from done(held)
                    have, at = 0, cut
            held.append(b.slice(at))
            have += int(sums[-1] - sums[at])
            last = ah[-1]
        if held:
            yield from done(held)
    return run


def flat(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False)


def owners(b: pa.RecordBatch, name: str) -> np.ndarray:
    """The row of each element of a list column without nulls."""
    return np.repeat(np.arange(b.num_rows), np.diff(b.column(name).offsets.to_numpy()))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return s[new], np.append(e[new[1:] - 1], e[-1])
