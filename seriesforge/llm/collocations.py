"""Phrases whose words occur together more often than apart, mined by SON partitioning.

The documents of a language are dealt to at most eight shards (by ranges of doc_id, so that neighbours share one). A shard
that has b of a language's B bytes is mined completely at the local support ceil(support * b / B): a phrase that has
the support in the language has the local one in some shard, whatever the shards' sizes, as these add up to B. There are
so few shards that the local support stays far above 1 at any size of the corpus; a shard is mined by as many tasks as it
takes, by levels: pairs of words first, then the phrases of three to five words all of whose pairs are locally frequent,
as no other can be. The union of the locally frequent phrases, with the words of the pairs, is then counted over the
whole corpus, exactly.

Tasks count the phrases of blocks of text by numbers of words, which are exact, and Spark adds up a phrase's counts, in
partial aggregates before the exchange. What a task needs to know of frequent phrases is a set of bits of a fixed size: a
phrase whose bit is set by another one is counted too, in all places, so counts are exact whatever the bits; it is
dropped by its count or, if it has the support, is a right result. Joins and windows do the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesforge.llm import _text as T
from seriesforge.llm._frames import documents, staged

SUPPORT, LONGEST, TOP = 100, 5, 2000
#: Shards at most, and how many neighbouring doc_ids go to one together.
SHARDS, TOGETHER = 8, 4096
#: Size of the sets of bits: 2^26 bits are 8 MB, whatever the number of phrases.
BITS = 26
#: Bytes of text that a task counts together.
BLOCK = 1 << 21
_COUNTS = "lang string, shard int, phrase string, c bigint"
#: What a byte becomes: A-Z in lower case, ends of pieces as \\n, white space within them as a blank.
_AS = np.arange(256, dtype=np.uint8)
_AS[ord("A"):ord("Z") + 1] += 32
_AS[[ord(x) for x in ".,;:!?\n\x0b\x0c\r"]] = 10
_AS[[9, 32]] = 32


class Block:
    """The words of some bytes, their numbers, and which stand in one piece."""

    def __init__(self, raw: np.ndarray):
        raw = _AS[raw]
        cut = (raw == 10) | (raw == 32)
        edge = np.diff(np.concatenate(([True], cut, [True])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        piece = np.cumsum(raw == 10, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
        # words end to end with one blank between: any phrase is a stretch of these bytes, as it is spelt
        to = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=to[1:])
        joined = np.full(to[-1], 32, np.uint8)
        inside = np.ones(to[-1], bool)
        inside[to[1:] - 1] = False
        joined[inside] = raw[~cut]
        self.bytes, self.start, self.end, self.piece = joined, to[:-1], to[1:] - 1, piece
        self.words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer((to - np.arange(len(to)))), pa.py_buffer(raw[~cut]))
        self.code = np.asarray(self.words.dictionary_encode().indices, np.int64) if len(starts) else np.zeros(0, np.int64)

    def within(self, size: int) -> np.ndarray:
        """The words at which a phrase of ``size`` begins that ends in the same piece."""
        n = len(self.code) - size + 1
        return np.flatnonzero(self.piece[:n] == self.piece[size - 1:]) if n > 0 else np.zeros(0, np.int64)

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words at ``at``: of their bytes alone."""
        return _hashes(self.bytes, self.start[at], self.end[at + size - 1])

    def spelt(self, at: np.ndarray, size: int) -> pa.Array:
        return _stretches(self.bytes, self.start[at], self.end[at + size - 1])


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes in order of their starts, a block at a time."""
    return T.word_hashes(raw, starts, ends, T.ROOTS[0])


def _stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=to[1:])
    at = np.arange(to[-1]) + np.repeat(starts - to[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(to), pa.py_buffer(raw[at])).cast(pa.string())


def _salted(h: np.ndarray, lang: str, shard: int) -> np.ndarray:
    """The bits' places of phrases of a language (and a shard, or -1)."""
    key = np.frombuffer(f"{shard}:{lang}".encode(), np.uint8)
    salt = T.Sums(key, T.ROOTS[1]).spans(np.zeros(1, np.int64), np.array([len(key)]))
    return (T.mixed(h + salt) >> T.U(64 - BITS)).astype(np.int64)


def _known(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7)) & 1 == 1


def _counted(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key its number, and one place and the count of each number."""
    _, first, name, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return name, at[first], count


def _pairs(b: Block, lang: str, shard: int):
    """All pairs of words of a block."""
    at = b.within(2)
    if len(at):
        _, one, count = _counted(at, b.code[at] * np.int64(len(b.code)) + b.code[at + 1])
        yield 2, one, count


def _chains(b: Block, lang: str, shard: int, bits: np.ndarray, longest: int):
    """Phrases of three words or more all of whose pairs are known, level by level."""
    at = b.within(2)
    at = at[_known(bits, _salted(b.hashes(at, 2), lang, shard))]
    if not len(at):
        return
    name, _, _ = _counted(at, b.code[at] * np.int64(len(b.code)) + b.code[at + 1])
    pair = np.zeros(len(b.code) + longest, bool)
    pair[at] = True
    for size in range(3, longest + 1):
        on = (at + size - 1 < len(b.code)) & pair[at + size - 2]  # known pairs lie in one piece, so the phrase does
        at, name = at[on], name[on]
        if not len(at):
            return
        name, one, count = _counted(at, name * np.int64(len(b.code)) + b.code[at + size - 1])
        yield size, one, count


def _listed(b: Block, lang: str, shard: int, bits: np.ndarray, longest: int):
    """Words and phrases of any size whose bit is set."""
    for size in range(1, longest + 1):
        at = b.within(size)
        at = at[_known(bits, _salted(b.hashes(at, size), lang, -1))]
        if not len(at):
            continue
        key = b.code[at]
        for j in range(1, size):
            key = _counted(at, key)[0] if j > 1 else key
            key = key * np.int64(len(b.code)) + b.code[at + j]
        _, one, count = _counted(at, key)
        yield size, one, count


def _blocks(texts: Iterator[tuple[str, int, bytes]]) -> Iterator[tuple[str, int, bytes]]:
    """The bytes of a language and shard together, up to about BLOCK of all; longer texts are cut between pieces."""
    held: dict[tuple[str, int], list[bytes]] = {}
    size = 0
    for lang, shard, text in texts:
        while len(text) > BLOCK:
            cut = max(text.rfind(x, 0, BLOCK) for x in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut < 0:
                break  # one piece of more than a block stays whole
            yield lang, shard, text[:cut]
            text = text[cut:]
        held.setdefault((lang, shard), []).append(text)
        size += len(text)
        if size > BLOCK:
            yield from ((k[0], k[1], b"\n".join(v)) for k, v in held.items())
            held, size = {}, 0
    yield from ((k[0], k[1], b"\n".join(v)) for k, v in held.items())


def _counts(docs: DataFrame, rule, bits: Broadcast | None = None, total: bool = False, **given) -> DataFrame:
    """Counts of the phrases that ``rule`` finds, a row for each block at most, those that begin alike together (they
    compress better so); ``total``: all words as a null phrase too."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = given if bits is None else given | {"bits": np.frombuffer(bits.value, np.uint8)}

        def texts():
            for batch in batches:
                raw, offsets = T.texts_of(batch.column("text"))
                langs, shards, data = batch.column("lang").to_pylist(), batch.column("shard").to_pylist(), raw.tobytes()
                for i, (lang, shard) in enumerate(zip(langs, shards)):
                    yield lang, shard, data[offsets[i]:offsets[i + 1]]
        for lang, shard, text in _blocks(texts()):
            b = Block(np.frombuffer(text, np.uint8))
            if total and len(b.code):
                yield _batch(lang, shard, pa.array([None], pa.string()), np.array([len(b.code)]))
            for size, one, count in rule(b, lang, shard, **more):
                for i in range(0, len(one), 1 << 14):
                    yield _batch(lang, shard, b.spelt(one[i:i + (1 << 14)], size), count[i:i + (1 << 14)])
    return docs.select("lang", "shard", "text").mapInArrow(task, _COUNTS)


def _batch(lang: str, shard: int, phrase: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    n = len(phrase)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, shard, np.int32)),
                                       phrase, pa.array(count, pa.int64())], names=["lang", "shard", "phrase", "c"])


def _bits(phrases: DataFrame) -> Broadcast:
    """The set of bits of ``phrases`` (lang, shard, phrase): 2^BITS of them, gathered as words of 64 bits."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = T.texts_of(b.column("phrase"))
            h = _hashes(raw, offsets[:-1], offsets[1:])
            key = np.array([f"{s}:{x}" for x, s in zip(b.column("lang").to_pylist(), b.column("shard").to_pylist())], object)
            place = np.zeros(len(h), np.int64)
            for k in set(key):
                shard, lang = k.split(":", 1)
                place[key == k] = _salted(h[key == k], lang, int(shard))
            yield pa.RecordBatch.from_arrays([pa.array(place >> 6), pa.array(place & 63)], names=["at", "bit"])
    words = phrases.select("lang", "shard", "phrase").mapInArrow(task, "at bigint, bit bigint").groupBy("at").agg(F.bit_or(F.expr("shiftleft(1L, int(bit))")).alias("w"))
    got = words.toArrow()
    bits = np.zeros(1 << BITS - 6, np.int64)
    bits[got.column("at").to_numpy()] = got.column("w").to_numpy()
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def _frequent(counts: DataFrame, support: DataFrame) -> DataFrame:
    """The phrases that have their shard's local support."""
    summed = counts.groupBy("lang", "shard", "phrase").agg(F.sum("c").alias("c"))
    return summed.join(support, ["lang", "shard"]).where("c >= least").select("lang", "shard", "phrase")


def phrase_counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to ``longest`` words that have ``support`` in their language, with their words: lang, size, phrase,
    a; and the words of each language: lang, n."""
    given = documents(docs, ("lang",)).select("doc_id", "text", F.coalesce(F.col("_keep0").cast("string"), F.lit("und")).alias("lang"))
    dealt = given.withColumn("shard", F.coalesce(F.pmod(F.xxhash64(F.floor(F.col("doc_id") / TOGETHER)), F.lit(SHARDS)), F.lit(0)).cast("int"))
    size = dealt.groupBy("lang", "shard").agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b"))
    size = size.withColumn("all", F.greatest(F.sum("b").over(Window.partitionBy("lang")), F.lit(1)))
    least = staged(size.select("lang", "shard", F.greatest(F.expr(f"(b * {support} + `all` - 1) div `all`"), F.lit(1)).alias("least")))
    pairs = staged(_frequent(_counts(dealt, _pairs), least))
    chains = staged(_frequent(_counts(dealt, _chains, _bits(pairs), longest=longest), least)) if longest > 2 else None
    words = pairs.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
    some = pairs.select("lang", "phrase").union(words)
    union = (some if chains is None else some.union(chains.select("lang", "phrase"))).distinct()
    counts = _counts(dealt, _listed, _bits(union.withColumn("shard", F.lit(-1))), total=True, longest=longest)
    all_ = staged(counts.groupBy("lang", "phrase").agg(F.sum("c").alias("a")).where((F.col("a") >= support) | F.col("phrase").isNull()))
    known = all_.where("phrase IS NOT NULL").select("lang", F.size(F.split("phrase", " ")).alias("size"), "phrase", "a")
    return known, all_.where("phrase IS NULL").select("lang", F.col("a").alias("n"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by their lowest score over all cuts, floor(1000 a n / (l r)).

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, these into words ``[^\\x20\\x09]+``. A phrase
    that stands in a longer one as often as everywhere is dropped. Returns lang, rank, phrase, a, l, r, n, score: by score,
    then a, both falling, then phrase in order of its bytes. Null texts are empty, null languages are ``und``; rows count
    as often as they are there, also with null or equal doc_ids; an empty table gives no rows; other columns don't matter."""
    counts, totals = phrase_counts(docs, support, longest)
    words = F.split("phrase", " ")
    long = counts.where("size > 1")
    parts = long.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"), "size")
    parts = parts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                         F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"))
    known = counts.select("lang", "phrase", "a")
    cut = (parts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
           .join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
           .join(totals, "lang"))

    def exact(c: str) -> Column:
        return F.col(c).cast("decimal(19,0)")
    top_, bottom = (exact("a") * exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)"), exact("l") * exact("r")
    scored = cut.withColumn("_top", top_.cast("decimal(38,0)")).withColumn("_bottom", bottom.cast("decimal(38,0)")).withColumn("score", F.expr("_top div _bottom"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    # a phrase inside a longer one as often: then also inside one with one word more
    inside = long.where("size > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("size") - 1), " "))).alias("phrase")).distinct()
    left = lowest.join(inside, ["lang", "phrase", "a"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return left.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
