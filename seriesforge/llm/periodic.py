"""Periodic runs of words, by a dictionary of basic factors.

A basic factor is a stretch of L = 2^k words; its name is a number that equal factors of a text share. Names of length 2L
come from pairs of names of length L, and a factor that occurs once in its text is left out from there on, as no longer
one that begins there can recur. For a factor at word i, the successors of its name within twice its length are
arithmetic progressions (two equal factors that overlap are periodic); the first successor that lies L words or more
behind i proposes its distance p, L <= p < 2L, as a period at i. Each run of period p is proposed at the one level with
L <= p < 2L: were the factors at all its words to recur nearer, between L and p, they would overlap the copies at p and
carry their shorter period out of the run (test_periodic holds this against all short words and many periodic ones).

Proposals of one period at consecutive words are one proposal. It is extended to both sides by names of falling lengths,
and equal stretches are kept once with their smallest period. Everything is numpy over a batch of whole texts; a batch
holds up to 2 MB of them or one longer text, and texts need nothing of each other, so there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from seriesforge.llm import _text as T
from seriesforge.llm._frames import arrow_map, ddl, documents

#: Words of the shortest run, and how often its period must fit.
SHORTEST, TIMES = 12, 2
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Factors:
    """Names of basic factors: for each level the words at which a factor begins that recurs in its text."""

    def __init__(self, units: np.ndarray):
        """``units``: numbers of words; equal only for equal words of one text."""
        self.n, self.levels = len(units), []
        at, key, length = np.arange(self.n), units, 1
        while len(at):
            _, name, count = np.unique(key, return_inverse=True, return_counts=True)
            again = count[name] > 1
            at, name = at[again], name[again]
            if not len(at):
                break
            self.levels.append((at, name))
            other, there = self._names(len(self.levels) - 1, at + length)
            at, key = at[there], name[there] * np.int64(len(count)) + other[there]
            length *= 2

    def _names(self, level: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the factors at ``places``, and which of the places have one."""
        at, name = self.levels[level]
        k = np.minimum(np.searchsorted(at, places), len(at) - 1)
        return name[k], at[k] == places

    def equal(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the factors at x and at y, x < y, are equal."""
        a, in_a = self._names(level, x)
        b, in_b = self._names(level, y)
        return in_a & in_b & (a == b)

    def proposals(self) -> tuple[np.ndarray, np.ndarray]:
        """Words and the periods proposed at them."""
        words, periods = [], []
        for level, (at, name) in enumerate(self.levels):
            length = 1 << level
            key = name * np.int64(self.n + 2 * length) + at
            order = np.argsort(key, kind="stable")
            key = key[order]
            later = np.searchsorted(key, key + length)
            inside = later < len(key)
            later = np.minimum(later, len(key) - 1)
            near = inside & (key[later] - key < 2 * length)
            found = order[near]
            i, p = at[found], (key[later] - key)[near]
            by_place = np.argsort(i, kind="stable")
            i, p = i[by_place], p[by_place]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1] + 1) | (p[1:] != p[:-1])
            words.append(i[first])
            periods.append(p[first])
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(words), np.concatenate(periods)

    def runs(self, shortest: int = SHORTEST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and periods of all runs, by start, then period."""
        i, p = self.proposals()
        left, right = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            length = 1 << level
            right[self.equal(level, i + right, i + p + right)] += length
            back = i - left - length
            left[(back >= 0) & self.equal(level, back, back + p)] += length
        start, end = i - left, i + p + right
        long = end - start >= np.maximum(shortest, times * p)
        start, end, p = start[long], end[long], p[long]
        order = np.lexsort((p, end, start))
        start, end, p = start[order], end[order], p[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, p = start[first], end[first], p[first]
        order = np.lexsort((p, start))
        return start[order], end[order], p[order]


def _spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow array: their bytes are all that isn't white space."""
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=to[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(to), pa.py_buffer(T.visible(raw)))


def _of_texts(raw: np.ndarray, offsets: np.ndarray, shortest: int, times: int):
    """Per text: words, runs, and the text without repetitions, as Arrow arrays."""
    n = len(offsets) - 1
    starts, ends, first = T.words_of(raw, offsets)
    words = _spelled(raw, starts, ends)
    text = np.repeat(np.arange(n), np.diff(first))
    codes = np.asarray(words.dictionary_encode().indices, np.int64) if len(words) else np.zeros(0, np.int64)
    run_start, run_end, period = Factors(text * np.int64(len(words) + 1) + codes).runs(shortest, times)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, run_start + period, 1)
    np.add.at(gone, run_end, -1)
    kept = np.cumsum(gone)[:-1] == 0
    owner = text[run_start] if len(run_start) else np.zeros(0, np.int64)
    run_at = np.searchsorted(owner, np.arange(n + 1))
    runs = pa.ListArray.from_arrays(pa.array(run_at, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(run_start - first[owner], pa.int64()), pa.array(run_end - run_start, pa.int64()), pa.array(period, pa.int64())],
        ["start", "length", "period"]))
    kept_at = np.concatenate([[0], np.cumsum(kept)])[first]
    rest = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), words.filter(pa.array(kept)).cast(pa.string())), " ")
    return pa.array(np.diff(first), pa.int64()), runs, rest


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, times: int = TIMES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Runs of words of each text, and the text with every repetition but the first period removed.

    A run is a stretch of consecutive words [^\\x20\\x09-\\x0D]+ with smallest period q, at least ``shortest`` words and
    ``times`` periods long, that no neighbouring word extends with period q. Returns doc_id, n_words, runs (start, length and
    period in words, by start, then period), collapsed (the words outside all runs and in the first periods of those that
    hold them in no other part, joined by one space), and the columns of ``keep``.

    Null, empty and blank texts: no words, no runs, an empty text. Rows are judged one by one: repeated rows and doc_ids
    give repeated results, null doc_ids stay null, an empty table gives no rows, other columns are ignored."""
    given = documents(docs, keep)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = T.texts_of(batch.column(1))
        parts = [_of_texts(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], shortest, times) for a, b in T.groups(offsets)]
        made = [pa.concat_arrays(x) for x in zip(*parts)]
        return pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]],
                                          names=["doc_id", "n_words", "runs", "collapsed", *batch.schema.names[2:]])
    kept = "".join(f", _keep{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = arrow_map(given, one, f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string{kept}")
    return out.withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})
