"""A corpus pipeline: toxicity, SimHash near-dedup, substring dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
the last the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm._frames import prepare, read, staged
from seriesforge.llm.packing import best_fit_packing
from seriesforge.llm.pii import redact
from seriesforge.llm.queries import QUERIES, VOCABULARY
from seriesforge.llm.simhash import one_of_each
from seriesforge.llm.substring import substring_dedup
from seriesforge.llm.toxicity import toxicity as score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OTHERS = tuple(c for c in COLUMNS if c not in ("doc_id", "text"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is predicted toxic go."""
    prepare(spark)
    scored = score_toxicity(docs, read(spark, sf_dir, "labels"), keep=("text", *OTHERS))
    return scored.where("predicted = 0").select(*COLUMNS)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest doc_id."""
    prepare(spark)
    return one_of_each(docs).select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that repeat go; a text that loses none keeps its white space."""
    prepare(spark)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return substring_dedup(docs, keep=("text", *OTHERS)).withColumn("text", text).withColumn("n_chars", _length(docs)).select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    prepare(spark)
    return redact(docs, keep=OTHERS).withColumn("n_chars", _length(docs)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, packed into sequences."""
    prepare(spark)
    return best_fit_packing(docs, VOCABULARY)


def _length(docs: DataFrame):
    """The text's length, in the type that the input has it in."""
    return F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)


STAGES = [("toxicity", toxicity), ("simhash", simhash), ("substring", substring), ("pii", pii), ("packing", packing)]

#: The stages are beyond SQL (a trained classifier, loopy inference, a tokenizer): tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read back as the next one's input."""
    docs = read(prepare(spark), sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs


QUERIES["pipeline"] = run
