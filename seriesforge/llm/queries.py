"""Registered queries of the corpus operators: (spark, sf_dir) -> the whole result over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import bpe, sql
from seriesforge.llm._frames import prepare, read
from seriesforge.llm.collocations import collocations
from seriesforge.llm.packing import best_fit_packing
from seriesforge.llm.periodic import periodic_runs
from seriesforge.llm.pii import KINDS, pii_spans
from seriesforge.llm.quality import quality_rules
from seriesforge.llm.simhash import simhash_components
from seriesforge.llm.sketch import edited_fingerprints, written
from seriesforge.llm.substring import substring_dedup
from seriesforge.llm.suffix import suffix_dedup
from seriesforge.llm.toxicity import toxicity
from seriesforge.llm.vectors import similar_vectors
from seriesforge.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(key: str, twin: str | None = None):
    """Register a query, with its DuckDB SQL if there is any."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if twin is not None:
            ORACLE[key] = twin
        return fn
    return deco


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of 3-word shingles, groups at 2 differing bits or fewer."""
    return simhash_components(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op3_substring", sql.SUBSTRING)
def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left after repeated windows of 35 words are removed."""
    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


@query("op9_suffix", sql.SUFFIX)
def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left after repeated strings of 200 bytes are removed."""
    out = suffix_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids of every text and the text they decode to."""
    out = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), VOCABULARY), VOCABULARY)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
                      F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids in as few sequences as best fit finds."""
    return best_fit_packing(read(spark, sf_dir, "documents"), VOCABULARY)


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, and fences by language and source."""
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_warc", sql.WARC)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as segmented archives and read back."""
    return archive_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data: those of the patterns, and those a skip-chain field adds."""
    out = pii_spans(read(spark, sf_dir, "documents"))

    def written(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    return out.select(
        "doc_id", *(F.size(F.expr(f"filter(spans, x -> x.base AND x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of texts restored by a noisy channel; labels of held-out documents are never read."""
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score", "predicted")


@query("op7_vectors")
def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors whose cosine is 0.95 or more."""
    return similar_vectors(read(spark, sf_dir, "embeddings"))


def with_periods(docs: DataFrame) -> DataFrame:
    """The contract's edit: with h the CRC-32 of the decimal doc_id and g = h div 10, the n words of a text from the word
    g mod n on repeat with a period that h gives, if h is divisible by 10. Null doc_ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a, p = F.col("_a"), F.col("_p")
    edited = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    return (docs.select("doc_id", "text", h.alias("_h"))
            .withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
            .withColumn("_a", F.when(n > 0, g % n))
            .withColumn("_p", 1 + F.floor((n - a) / (3 + g % 8)))
            .select("doc_id", F.when(n > 0, F.array_join(edited, " ")).otherwise(F.col("text")).alias("text")))


@query("op12_periodic")
def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words, and texts without their repetitions."""
    out = periodic_runs(with_periods(read(spark, sf_dir, "documents")))
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = out.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(F.array_join(line, ""), "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


@query("op13_fingerprints", sql.FINGERPRINTS)
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of texts and of their edited versions, and how like they are."""
    out = edited_fingerprints(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), written(F.col("sketch")).alias("fingerprint"),
                      written(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op11_collocations", sql.COLLOCATIONS)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language by how much oftener their words stand together than apart."""
    return collocations(read(spark, sf_dir, "documents"))
