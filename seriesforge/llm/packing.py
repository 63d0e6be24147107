"""Best-fit packing of documents into token sequences.

Documents become pieces of at most ``capacity`` tokens. Each task packs its share of the pieces online: a fixed number
of bins is open, a bitset has a bit for each amount of free space that an open bin has, and a piece goes to the bin
with the least space that holds it, found by one shift and the lowest bit. When no open bin holds a piece and all are
in use, the fullest bin closes. What is in bins still open when a share ends is packed again with that of other tasks,
until one task's last open bins are all that is left, which are packed once more with the longest pieces first: so the shares
cost no sequences of their own.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm._frames import arrow_map, documents, staged
from seriesforge.llm.bpe import Chunks, byte_letters

CAPACITY, END = 4096, 1
#: Open bins of a task, and pieces of a task.
OPEN, SHARE = 512, 200_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Library(Chunks):
    """The tokenizers library behind a bounded cache of chunks."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize, self.letters = self.tokenizer.model.tokenize, byte_letters()

    def encode_new(self, chunk: bytes) -> bytes:
        """A word of letters goes to the library's model, other chunks through its whole pipeline."""
        if chunk.isalpha() and chunk.islower():  # ASCII
            return array("I", [t.id for t in self.tokenize(chunk.decode())]).tobytes()
        text = chunk.decode("utf-8", "replace")
        if text.isalpha() and is_normalized("NFC", text) and "Σ" not in text and (low := text.lower()).isalpha():
            return array("I", [t.id for t in self.tokenize(low.encode().decode("latin-1").translate(self.letters))]).tobytes()
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document, ended by id 1, in pieces of at most ``capacity``."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([END], "<u4").tobytes()
        rows = []
        for doc, ids in zip(b.column(0).to_pylist(), library(path).encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])):
            ids += end
            for i in range(0, len(ids), 4 * capacity):
                part = ids[i:i + 4 * capacity]
                rows.append((doc, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
        cols = list(zip(*rows))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return arrow_map(documents(docs), batch, PIECE)


class Bins:
    """Open bins by free space. A bin is [used, rows]; a row put in it is closed with it."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.free: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open = 0, 0

    def _take(self, space: int) -> list:
        at = self.free[space]
        found = at.pop()
        if not at:
            self.bits &= ~(1 << space)
        self.open -= 1
        return found

    def put(self, row: int, size: int) -> list | None:
        """Place a row; gives a bin that has closed, if one has."""
        closed = None
        fitting = self.bits >> size
        if fitting:
            bin_ = self._take(size + (fitting & -fitting).bit_length() - 1)
        else:
            bin_ = [0, []]
            if self.open >= self.most and size < self.capacity:
                closed = self._take((self.bits & -self.bits).bit_length() - 1)  # the least space: the fullest
        bin_[1].append((row, bin_[0]))
        bin_[0] += size
        if bin_[0] == self.capacity:
            return bin_
        space = self.capacity - bin_[0]
        self.free[space].append(bin_)
        self.bits |= 1 << space
        self.open += 1
        return closed

    def rest(self) -> list[list]:
        return [b for at in self.free for b in at]


def _pack(capacity: int, most: int, level: int, last: bool):
    """Rows of pieces -> the same with their sequence, place, and whether the sequence was still open at the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = level << 56 | TaskContext.get().partitionId() << 32
        bins, number = Bins(capacity, most), 0
        held: dict[int, tuple] = {}
        count = 0
        out: list[tuple] = []

        def close(b: list, still_open: bool) -> None:
            nonlocal number
            out.extend((*held.pop(r), base + number, offset, still_open) for r, offset in b[1])
            number += 1

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            made = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"])
            out.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held[count] = row
                if (closed := bins.put(count, row[3])) is not None:
                    close(closed, False)
                count += 1
            if len(out) >= 10_000:
                yield batch()
        rest = bins.rest()
        if last:
            left = sorted((-held[r][3], r) for b in rest for r, _ in b[1])
            bins = Bins(capacity, len(left))
            full = [b for size, r in left if (b := bins.put(r, -size)) is not None]
            rest = full + bins.rest()
        for b in rest:
            close(b, not last)
        if out:
            yield batch()
    return run


def pack_pieces(rows: DataFrame, capacity: int = CAPACITY, most: int = OPEN, share: int = SHARE) -> DataFrame:
    """pieces -> the same with sequence_id and offset. ``most`` bins are open in a task, ``share`` pieces go to one."""
    schema = PIECE + ", sequence_id long, offset long, open boolean"
    left, done, level, tasks = staged(rows), None, 0, 1 << 30
    while True:
        tasks = max(1, min(-(-left.count() // share), tasks // 2))  # each level has half as many tasks at most
        packed = staged(left.repartition(tasks).mapInArrow(_pack(capacity, most, level, tasks == 1), schema))
        closed = packed.where("NOT open").drop("open")
        done = closed if done is None else done.union(closed)
        if tasks == 1:
            return done
        left = packed.where("open").select(*rows.columns)
        level += 1


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, most: int = OPEN, share: int = SHARE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Texts of more than ``capacity`` ids are cut into pieces of ``capacity``,
    each a sequence of its own but for the last. Repeated rows and null doc_ids are packed like others. An empty table
    gives no rows. sequence_id: level, task and bin number; unique, not dense.
    """
    return pack_pieces(pieces(docs, path, capacity), capacity, most, share)
