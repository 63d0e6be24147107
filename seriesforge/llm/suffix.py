"""Exact substring dedup over bytes by suffix order and longest-previous-factor arrays.

Strings of ``k`` bytes that occur once share no anchor with another place and never become rows (see _anchors). Runs
that are equal as a whole are a class whose first run stands for it. The classes of one anchor come together in one
group, and there the suffixes of their runs are sorted, by prefix doubling up to depth ``k`` (longer matches are found
as several starts), for all groups of a chunk at once. In that order, ties by position, the previous smaller position
of a suffix is its neighbour if the two agree for k bytes: then the longest previous factor has length k at least, and
the neighbour before is an earlier match; the next smaller position can't add one, as a smaller position that agrees
stands before. A suffix with an earlier match is a later copy; one that a later copy points to is an earlier one.

An anchor with too many bytes of classes (a passage with very many variants) doesn't make one group: its strings are counted by
their hash and digest in partial aggregates instead, and found again by a join, which is exact too.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _anchors as A
from seriesforge.llm import _text as T
from seriesforge.llm._frames import arrow_map, staged

LENGTH = 200
#: Bytes of the grams that anchor strings.
GRAM = 48
#: Bytes of an anchor's runs that are sorted together; an anchor with more is counted by digests.
TOGETHER = 1 << 20
#: Bytes of runs sorted at once in a task.
CHUNK = 1 << 20


def _ranks(key: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones; no more than two arrays of the keys' size stand beside them."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.empty(len(key), np.int32)
    new[0] = 0
    new[1:] = key[1:] != key[:-1]
    del key
    out = np.empty(len(new), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def previous_factor(raw: np.ndarray, group: np.ndarray, inside: np.ndarray, k: int) -> np.ndarray:
    """For each position of ``inside`` the nearest smaller position in suffix order, within its group, whose ``k`` bytes
    are the same, or -1: where there is one, the longest previous factor has k bytes or more. ``inside`` tells where k
    bytes may be read as one string."""
    n = len(raw)
    out = np.full(n, -1, np.int64)
    if n < k:
        return out
    # ranks of the first 8 bytes, then of 16, 32, ...; the last step overlaps to reach k exactly
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    rank, have = _ranks(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)), 8
    while have < k:
        step = min(have, k - have)
        key = rank.astype(np.int64) * (n + 2)
        key[:n - step] += rank[step:] + 1
        rank = _ranks(key)
        have += step
    at = np.flatnonzero(inside)
    order = at[np.lexsort((at, rank[at], group[at]))]  # the suffix array of each group, ties by position
    same = (rank[order[1:]] == rank[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    out[order[1:][same]] = order[:-1][same]
    return out


def _strings(k: int):
    """Texts with runs -> the runs' bytes."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = T.texts_of(b.column("text"))
        r = A.owners(b, "start")
        start, n, ah, lone, crowded = (A.flat(b, c) for c in ("start", "n", "ah", "lone", "crowded"))
        at = offsets[r] + start
        data, row = raw.tobytes(), pa.array(r)
        return pa.record_batch([pa.array(ah), b.column("doc_id").take(row), b.column("th").take(row), pa.array(start), pa.array([data[x:x + y + k - 1] for x, y in zip(at.tolist(), n.tolist())], pa.binary()), pa.array(lone), pa.array(crowded)],
                               names=["ah", "doc_id", "th", "start", "bytes", "lone", "crowded"])
    return batch


def _sorted_out(k: int, chunk: int):
    """Strings sorted by anchor -> spans of starts that match elsewhere. Chunks end between two anchors."""
    def work(t: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = T.texts_of(t.column("bytes"))
        ah, start = t.column("ah").to_numpy(), t.column("start").to_numpy()
        run = np.repeat(np.arange(t.num_rows), np.diff(offsets))
        inside = np.zeros(len(raw), bool)
        inside[:max(0, len(raw) - k + 1)] = run[:max(0, len(raw) - k + 1)] == run[k - 1:]
        before = previous_factor(raw, np.cumsum(np.append(0, ah[1:] != ah[:-1]))[run], inside, k)
        later = before >= 0
        first = np.zeros(len(raw), bool)
        first[before[later]] = True
        parts = []
        for hit, flag in ((later, True), (first & ~later, False)):
            edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
            s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # within a run: its last k-1 bytes start nothing
            r = pa.array(run[s])
            parts.append(pa.record_batch([t.column("doc_id").take(r), t.column("th").take(r), pa.array((start[run[s]] + s - offsets[run[s]]).astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.array(np.full(len(s), flag))], names=["doc_id", "th", "start", "n", "later"]))
        return pa.concat_batches(parts)

    return A.by_anchor(work, lambda b: np.diff(T.texts_of(b.column("bytes"))[1]), chunk)


def _windows(k: int):
    """Strings -> a row for each of their k-byte windows: a digest of its bytes, and where it starts."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        start, digests, at, row = b.column("start").to_numpy(), [], [], []
        for i, text in enumerate(b.column("bytes").to_pylist()):
            n = len(text) - k + 1
            digests += [hashlib.blake2b(text[x:x + k], digest_size=16).digest() for x in range(n)]
            at.append(start[i] + np.arange(n, dtype=np.int32))
            row.append(np.full(n, i))
        r = pa.array(np.concatenate(row))
        return pa.record_batch([b.column("ah").take(r), pa.array(digests, pa.binary()), b.column("doc_id").take(r), b.column("th").take(r), pa.array(np.concatenate(at).astype(np.int32)), b.column("lone").take(r)], names=["ah", "digest", "doc_id", "th", "start", "lone"])
    return batch


def repeated_spans(docs: DataFrame, k: int = LENGTH, m: int = GRAM, together: int = TOGETHER, chunk: int = CHUNK) -> DataFrame:
    """keyed documents -> (doc_id, th, start, n, later): n consecutive starts, in bytes, of strings of ``k`` bytes that
    start elsewhere too; ``later`` if also at an earlier place, by doc_id, text hash and start."""
    hits, classes = A.repeated_runs(docs, False, k, m)
    place = F.struct("doc_id", "th", "start")
    copies = hits.join(classes.where("copies > 1").select("ah", "rh", "one"), ["ah", "rh"]).select(
        "doc_id", "th", "start", "n", (place > F.struct("one.doc_id", "one.th", "one.start")).alias("later"))
    fields = ["start", "n", "ah", "lone", "crowded"]
    firsts = classes.where("mixed").select("ah", "one.*", (F.col("copies") == 1).alias("lone"), (F.col("together") > together).alias("crowded"))
    texts = A.with_texts(docs, A.by_text(firsts, *fields)).select("doc_id", "th", "text", *fields)
    strings = staged(arrow_map(texts, _strings(k), "ah long, doc_id long, th long, start int, bytes binary, lone boolean, crowded boolean"))
    found = strings.where("NOT crowded").repartition("ah").sortWithinPartitions("ah", "doc_id", "th", "start").mapInArrow(
        _sorted_out(k, chunk), "doc_id long, th long, start int, n int, later boolean")
    each = staged(arrow_map(strings.where("crowded"), _windows(k), "ah long, digest binary, doc_id long, th long, start int, lone boolean"))
    twice = staged(each.groupBy("ah", "digest").agg(F.count("*").alias("c"), F.min(place).alias("one")).where("c > 1"))
    spread = each.join(twice, ["ah", "digest"]).select("doc_id", "th", "start", F.lit(1).alias("n"), (place > F.col("one")).alias("later"))
    return copies.union(found).union(spread)


def suffix_dedup(docs: DataFrame, k: int = LENGTH, m: int = GRAM, together: int = TOGETHER, chunk: int = CHUNK, keep_first: bool = False) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, spans (array of start and end) for every row of ``docs``.

    A byte goes if a string of ``k`` bytes that covers it starts anywhere else too, in the UTF-8 bytes of any text.
    Null text: empty. Shorter texts lose nothing. Repeated rows are copies of each other. Null doc_ids stay.
    ``keep_first``: the earliest copy of each string stays, and only bytes of later copies go; rows alike in doc_id and
    text are one place then, and all keep what it keeps.
    """
    if not 8 <= m <= k:
        raise ValueError("8 <= m <= k is needed")
    known = A.keyed(docs)
    spans = repeated_spans(known, k, m, together, chunk)
    rows = A.by_text((spans.where("later") if keep_first else spans).select("doc_id", "th", "start", "n").distinct(), "start", "n")
    none = F.array().cast("array<int>")
    joined = A.with_texts(known, rows, "left").select("doc_id", "th", "text", F.coalesce("start", none).alias("start"), F.coalesce("n", none).alias("n"))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        at, start, n = b.column("start").offsets.to_numpy(), A.flat(b, "start").astype(np.int64), A.flat(b, "n").astype(np.int64)
        kept, total, gone, spans = [], [], [], []
        for i, text in enumerate(texts):
            text = text or b""
            s, e = A.merged(start[at[i]:at[i + 1]], start[at[i]:at[i + 1]] + n[at[i]:at[i + 1]] + k - 1)
            left, last, cuts = [], 0, []
            for x, y in zip(s.tolist(), e.tolist()):
                left.append(text[last:x])
                cuts.append({"start": x, "end": y})
                last = y
            left.append(text[last:])
            kept.append(b"".join(left))
            total.append(len(text))
            gone.append(int((e - s).sum()))
            spans.append(cuts)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([b.column("doc_id"), pa.array(kept, pa.binary()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])
    return arrow_map(joined, batch, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>")
