"""Quality rules with adaptive thresholds.

Fixed base rules reject texts that are too short or repeat themselves. The other measures have no fixed cutoff: for
each language and source a quantile sketch of each measure is kept (KLL, merged from the tasks' partial sketches), and
sketches of small groups give way to the merged sketch of their language, or of all. The fence of a rate (signs a word,
repeated lines a line) stands a number of spreads beyond the median (the larger of median minus first decile and sixth
decile minus median); it allows a text as many occurrences as that rate gives over its own size, and beside them one for
each text of the group's median size that it is long, at least one: a single occurrence says nothing of a short text. All
of it comes from the group's sketches, and holds as long as three fifths of its texts are sound. The
fences of the mean word length stand as many lower half-spreads (median minus first decile) and a fixed slack on either
side of the median. Fences are joined back to the texts, which are filtered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text as T
from seriesforge.llm._frames import arrow_map, staged

SYMBOLS = b"#*$%&|<>"
#: Items of a sketch, texts that a group needs for fences of its own, spreads from the median to a fence.
SKETCH, GROUP, SPREADS = 400, 200, 6.0
#: Rate -> what is counted, and over what; the slack of the mean word length (letters), which has a fence on either side.
RATES, SLACK = {"symbol_rate": ("n_symbols", "n_words"), "dup_line_rate": ("n_dup_lines", "n_lines")}, 1.5
#: What is sketched.
SKETCHED = (*RATES, *(size for _, size in RATES.values()), "word_length")
MEASURED = ("doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, "
            "n_dup_lines long, n_repeat_words long")


def measures(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each text of a batch."""
    texts = len(offsets) - 1
    starts, ends, first = T.words_of(raw, offsets)

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])

    letters = ((raw & 0xC0) != 0x80) & ~T._SPACE[raw]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        words = T.Sums(raw, T.ROOTS[0]).spans(starts, ends)
        text = np.repeat(np.arange(texts), np.diff(first))
        at = np.flatnonzero(text[:-2] == text[2:])
        keys = [T.Sums(words, r).windows(3)[at] for r in T.ROOTS]
        order = np.lexsort((keys[1], keys[0], text[at]))
        a, b = at[order[:-1]], at[order[1:]]
        same = (keys[0][order[:-1]] == keys[0][order[1:]]) & (keys[1][order[:-1]] == keys[1][order[1:]]) & (text[a] == text[b])
        twice = np.concatenate((a[same], b[same]))
        for j in range(3):
            repeated[twice + j] = True
    n_repeat = np.diff(np.concatenate(([0], np.cumsum(repeated)))[first])
    lines, dups = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    data = raw.tobytes()
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        seen = [x for x in data[a:b].split(b"\n") if not (x.isspace() or not x)]
        lines[t], dups[t] = len(seen), len(seen) - len(set(seen))
    return [np.diff(first), per_text(letters), per_text(symbol[raw]), lines, dups, n_repeat]


def measured(docs: DataFrame) -> DataFrame:
    """The counts of every whole text, with doc_id, lang and source."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        raw, offsets = T.texts_of(b.column(3))
        parts = [measures(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in T.groups(offsets)]
        cols = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)]
        return pa.record_batch([*b.columns[:3], *cols], names=["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"), docs["text"].cast("string").alias("text"))
    return arrow_map(named, batch, MEASURED)


def fences(rows: DataFrame, sketch: int = SKETCH, group: int = GROUP, spreads: float = SPREADS) -> DataFrame:
    """lang, source -> the fences of each measure, from sketches of the rows that pass the base rules."""
    sketches = staged(rows.groupBy("lang", "source").agg(
        F.count(F.when(~F.col("base_failed"), 1)).alias("n"),
        *(F.kll_sketch_agg_double(F.when(~F.col("base_failed"), F.col(m).cast("double")), F.lit(sketch)).alias(m) for m in SKETCHED)))

    def merged(by: list[str], prefix: str) -> DataFrame:
        return sketches.groupBy(*by).agg(F.sum("n").alias(f"{prefix}_n"), *(F.kll_merge_agg_double(m, F.lit(sketch)).alias(f"{prefix}_{m}") for m in SKETCHED))

    of_lang = merged(["lang"], "lang").withColumnRenamed("lang", "_lang")
    both = sketches.join(of_lang, sketches["lang"].eqNullSafe(of_lang["_lang"]))
    every = merged([], "all").first()  # one row: a sketch a measure

    def quantile(m: str, rank: float):
        if not every["all_n"]:
            return F.lit(None).cast("double")
        best = F.when(F.col("n") >= group, F.col(m)).when(F.col("lang_n") >= group, F.col(f"lang_{m}")).otherwise(F.lit(bytearray(every[f"all_{m}"])))
        return F.kll_sketch_get_quantile_double(best, F.lit(rank))

    limits = []
    for m, (_, size) in RATES.items():
        mid = quantile(m, 0.5)
        spread = F.greatest(mid - quantile(m, 0.1), quantile(m, 0.6) - mid)
        limits += [(mid + spreads * spread).alias(f"{m}_high"), F.greatest(quantile(size, 0.5), F.lit(1.0)).alias(f"{m}_size")]
    mid = quantile("word_length", 0.5)
    width = spreads * (mid - quantile("word_length", 0.1)) + SLACK
    return both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *limits, (mid - width).alias("word_length_low"), (mid + width).alias("word_length_high"))


def quality_rules(docs: DataFrame, min_words: int = 50, max_repeat: float = 0.5, sketch: int = SKETCH, group: int = GROUP, spreads: float = SPREADS) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and kept for every row of ``docs``.

    Null text: no words, so base_failed. Null lang or source is a group like any other. Groups with fewer than ``group``
    texts that pass the base rules use the fences of their language, or of all texts. Repeated rows and null doc_ids
    stay. An empty table gives no rows.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    rows = staged(measured(docs)
                  .withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.lit(max_repeat) * F.col("n_words")))
                  .withColumn("symbol_rate", F.col("n_symbols") / n).withColumn("dup_line_rate", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
                  .withColumn("word_length", F.col("word_chars") / n))
    limits = staged(fences(rows, sketch, group, spreads))
    beside = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    out = F.lit(False)
    for m, (count, size) in RATES.items():
        out = out | (F.col(count) > F.col(f"{m}_high") * F.col(size) + F.greatest(F.lit(1.0), F.col(size) / F.col(f"{m}_size")))
    out = out | (F.col("word_length") > F.col("word_length_high")) | (F.col("word_length") < F.col("word_length_low"))
    return beside.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(out, F.lit(False))).select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
