"""Text folding, tokenising and LIKE helpers for series names.

Token rule (full-text phrase search): lower-case, strip Latin diacritics
(one base letter + one combining mark), split on every character that is not
a letter, a number or a private-use character, drop empty pieces.
Substring rule (LIKE fallback): fold ASCII letters only, ``%`` and ``_`` are
wildcards, no escape character.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token separator class and the LIKE escape character that can
# never occur in a name (so a backslash in a query stays a literal).
TOKEN_SPLIT_REGEX = r"[^\p{L}\p{N}\p{Co}]+"
LIKE_ESCAPE = "\u0001"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

# Latin blocks whose precomposed letters carry a single diacritic.
_LATIN_RANGES = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: precomposed Latin letter -> base.

    Built from the Unicode decomposition rule rather than listed by hand: a
    code point maps to its base letter when its canonical decomposition is
    exactly one ASCII letter followed by one combining mark.
    """
    src, dst = [], []
    for lo, hi in _LATIN_RANGES:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            d = unicodedata.normalize("NFD", ch)
            if (len(d) == 2 and d[0].isascii() and d[0].isalpha()
                    and unicodedata.category(d[1]) == "Mn"):
                src.append(ch)
                dst.append(d[0].lower())
    return "".join(src), "".join(dst)


def fold_accents(col: Column) -> Column:
    src, dst = accent_table()
    return F.translate(F.lower(col), src, dst)


def tokens(col: Column) -> Column:
    """array<string> of search tokens of a name or a query."""
    pieces = F.split(fold_accents(col), TOKEN_SPLIT_REGEX)
    return F.filter(pieces, lambda t: t != F.lit(""))


def token_text(tok: Column) -> Column:
    """' t1 t2 … ' — a phrase is consecutive tokens iff its text is a substring."""
    return F.concat(F.lit(" "), F.array_join(tok, " "), F.lit(" "))


def ascii_fold(col: Column) -> Column:
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def like_contains(name: Column, q: Column) -> Column:
    """SQLite-style ``name LIKE '%q%'``: ASCII case-insensitive, wildcards kept."""
    pattern = F.concat(F.lit("%"), ascii_fold(q), F.lit("%"))
    return F.like(ascii_fold(name), pattern, F.lit(LIKE_ESCAPE))


def like_literal_runs(q: Column) -> Column:
    """Wildcard-free pieces of a LIKE pattern (ASCII-folded), longest first."""
    pieces = F.filter(F.split(ascii_fold(q), "[%_]+"), lambda t: t != F.lit(""))
    return F.array_sort(pieces, lambda a, b: F.length(b) - F.length(a))


def ngrams(col: Column, n: int) -> Column:
    """array of all length-n substrings (by character) of a string column."""
    return F.when(F.length(col) >= n,
                  F.transform(F.sequence(F.lit(1), F.length(col) - (n - 1)),
                              lambda i: F.substring(col, i, n))).otherwise(F.array())


def grams_up_to(col: Column, n: int) -> Column:
    """All distinct substrings of 1 to n characters, and the empty one, which every text holds."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[ngrams(col, k) for k in range(1, n + 1)]))


def widest_grams(col: Column, n: int) -> Column:
    """The distinct n-grams of a text; of a shorter text, the whole text."""
    return F.when(F.length(col) >= n, F.array_distinct(ngrams(col, n))).otherwise(F.array(col))


def sql_accent_literals() -> tuple[str, str]:
    """Accent table as SQL string literals (for the DuckDB twin queries)."""
    src, dst = accent_table()
    return "'" + src.replace("'", "''") + "'", "'" + dst.replace("'", "''") + "'"
