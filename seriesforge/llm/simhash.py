"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into two 23-bit segments and an 18-bit rest. The perfect (23,12) Golay code gives each
segment the index of its nearest codeword (at most 3 bits off), and the indices of all codewords at most 4 bits off
(5.3 on average). If two segments differ in one bit or none, the nearest codeword of one is among the near codewords
of the other. Two fingerprints with 2 differing bits or fewer, by pigeonhole: if the rests are equal, one segment has at
most one error; if not, the segments have one error together, so one is equal and the other has at most one. So four
families of keys (an exact part, and the codeword index of a segment) meet for every such pair; the bits are then
counted. Keys that very many fingerprints share would make all pairs of them: those fingerprints meet instead on the
words one bit around them (65 keys, all 64 bits exact), which finds the same links and needs no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text as T
from seriesforge.llm._frames import arrow_map, documents, staged
from seriesforge.llm._graph import connected_components

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
SEGMENT, REST = 23, 18
#: A key with more fingerprints than this is left to the 65 exact words around each.
CROWDED = 64
SEED = 42


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words modulo the generator polynomial (11 bits; 0: a codeword)."""
    r = words.astype(np.int64).copy()
    for bit in range(SEGMENT - 1, 10, -1):
        r ^= np.where(r >> bit & 1, GOLAY << bit - 11, 0)
    return r


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest error pattern of each syndrome; patterns of 4 bits or fewer by syndrome, and where each syndrome's begin."""
    from itertools import combinations
    patterns = np.array([sum(1 << b for b in c) for w in range(5) for c in combinations(range(SEGMENT), w)])
    syndromes = _syndromes(patterns)
    nearest = np.zeros(2048, np.int64)
    nearest[syndromes[:2048]] = patterns[:2048]  # weights 0 to 3 hit every syndrome once: the code is perfect
    order = np.argsort(syndromes, kind="stable")
    return nearest, patterns[order], np.searchsorted(syndromes[order], np.arange(2049))


NEAREST, PATTERNS, FIRST = _tables()


def codeword(segments: np.ndarray) -> np.ndarray:
    """Index (the 12 data bits) of the nearest codeword of 23-bit segments."""
    return (segments ^ NEAREST[_syndromes(segments)]) >> 11


def near_codewords(segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index) of all codewords at most 4 bits from each segment."""
    s = _syndromes(segments)
    many = FIRST[s + 1] - FIRST[s]
    at = np.repeat(np.arange(len(segments)), many)
    within = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    return at, (segments[at] ^ PATTERNS[FIRST[s][at] + within]) >> 11


def fingerprints(raw: np.ndarray, offsets: np.ndarray, words: int = 3) -> np.ndarray:
    """Fingerprint of each text: majority bits of the XXH64 of its shingles."""
    out, h = np.zeros(len(offsets) - 1, np.uint64), xxhash.xxh64_intdigest
    low = raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)
    for t in range(len(out)):
        parts = low[offsets[t]:offsets[t + 1]].tobytes().split()
        if not parts:
            continue
        line, n = b" ".join(parts), len(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        del parts
        many = max(1, n - words + 1)
        starts = np.concatenate(([0], ends[:-1] + 1))[:many]
        ends = ends[n - many:]
        votes = np.zeros(64, np.int64)
        for i in range(0, many, 1 << 16):
            part = np.array([h(line[a:b], SEED) for a, b in zip(starts[i:i + (1 << 16)].tolist(), ends[i:i + (1 << 16)].tolist())], "<u8")
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[t] = np.packbits(votes * 2 > many, bitorder="little").view("<u8")[0]
    return out


def simhash(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, th, fp): the hash of every whole text, which tells rows that share a doc_id apart, and its 64-bit SimHash,
    as signed longs."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = T.texts_of(b.column(1))
        return pa.record_batch([b.column(0), b.column(2), pa.array(fingerprints(raw, offsets, words).view(np.int64))], names=["doc_id", "th", "fp"])
    return arrow_map(documents(docs).withColumn("th", F.xxhash64("text")), batch, "doc_id long, th long, fp long")


def _segments(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << SEGMENT) - 1
    u = fp.view(np.uint64)
    return (u & np.uint64(low)).astype(np.int64), (u >> np.uint64(SEGMENT) & np.uint64(low)).astype(np.int64), (u >> np.uint64(2 * SEGMENT)).astype(np.int64)


def _golay_keys(b: pa.RecordBatch) -> pa.RecordBatch:
    """key, fp, probe: the nearest codeword of each family (probe false) and the near ones (true)."""
    fp = b.column(0).to_numpy(zero_copy_only=False)
    s, t, rest = _segments(fp)
    keys, owners, probes = [], [], []
    for family, (exact, coded) in enumerate(((rest, s), (rest, t), (s, t), (t, s))):
        base = np.int64(family) << 40 | exact << 12
        at, index = near_codewords(coded)
        keys += [base | codeword(coded), base[at] | index]
        owners += [fp, fp[at]]
        probes += [np.zeros(len(fp), bool), np.ones(len(at), bool)]
    return pa.record_batch([pa.array(np.concatenate(x)) for x in (keys, owners, probes)], names=["key", "fp", "probe"])


def _around(b: pa.RecordBatch) -> pa.RecordBatch:
    """The word itself and the 64 words one bit off."""
    fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    return pa.record_batch([pa.array((fp[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fp, 65).view(np.int64))], names=["key", "fp"])


def links_within_2(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """fps: distinct fingerprints (column fp). Links (a > b) that connect every two fingerprints with 2 differing bits
    or fewer: each such pair itself, or, for crowded keys, the pair through a third one of the same sphere."""
    keys = staged(arrow_map(fps, _golay_keys, "key long, fp long, probe boolean"))
    index, probe = keys.where("NOT probe").select("key", F.col("fp").alias("b")), keys.where("probe").select("key", F.col("fp").alias("a"))
    full = staged(index.groupBy("key").count().where(F.col("count") > crowded).select("key"))
    open_index = index.join(full, "key", "left_anti")
    pairs = (probe.join(open_index, "key").where("a > b AND bit_count(a ^ b) <= 2").select("a", "b").distinct())
    dense = keys.join(full, "key", "left_semi").select("fp").distinct()
    around = staged(arrow_map(dense, _around, "key long, fp long"))
    least = staged(around.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b"))
    stars = around.join(least, "key").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.union(stars)


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of
    at most ``max_bits``, 2 here, differing bits), th (its text's hash) and component (its component's least fingerprint).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay; a null doc_id stays and is
    nobody's component_id unless its component has no other. Equal fingerprints are one node, so copies cost no pairs.
    An empty table gives no rows.
    """
    if max_bits != 2:
        raise ValueError("the segments are laid out for 2 differing bits")
    marked = staged(simhash(docs, words))
    fps = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = connected_components(links_within_2(fps.select("fp"), crowded)).withColumnsRenamed({"node": "fp"})
    rooted = fps.join(nodes, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = staged(rooted.join(first, "root").select("fp", "component_id", F.col("root").alias("component")))
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "th", "component")


def one_of_each(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each component: that with the smallest doc_id (a null one
    only if there is no other), once if it is repeated."""
    marked = simhash_components(docs, words, max_bits)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("one")
    first = staged(marked.groupBy("component").agg(one).select(F.col("one.doc_id").alias("_doc"), F.col("one.th").alias("_th")))
    known = docs.select(F.struct("*").alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"].cast("string")).alias("th"))
    kept = known.join(first, known["doc_id"].eqNullSafe(first["_doc"]) & (known["th"] == first["_th"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "th"]).select("row.*")
