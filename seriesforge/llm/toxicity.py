"""Toxicity of texts behind disguises, by a noisy channel.

A character language model (order 4 over the corpus's letters and word ends, counted over all texts in lower case and
without accents) says what writing looks like, and a
channel model says how writers hide words: digits and signs for letters, spread-out letters, repeated letters, signs put
in. A token that shows such signs becomes a lattice of the characters that each position may stand for, and a Viterbi
search finds the likeliest reading; a run of spread-out letters, of any length, is cut into words by the same search.
Texts with these readings put in are then scored by what labels taught: words, and
beginnings of words, that are commoner in toxic texts enter a logistic regression by their presence and their density.
"""

from __future__ import annotations

import gc
import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm import _text as T
from seriesforge.llm._frames import arrow_map, ddl, documents, staged

#: Codes of the language model at most (0: anything else, as the end of a word), and its order. A corpus with more letters
#: has codes of their own for the commonest; the others share the last SHARED ones.
LETTERS, SHARED, ORDER = 48, 8, 4
#: Labelled texts that the classifier is fitted on at most, by hash of the id; L2 penalty.
FIT_ROWS, PENALTY = 10_000, 2.0
#: Lengths of beginnings of words that are units beside whole words (written with a star); likelihood ratio (G squared, one
#: degree of freedom, p about 0.0001) from which a unit is commoner in toxic texts than chance.
STEMS, SIGNIFICANT = (3, 4, 5, 6, 7, 8), 15.1
#: What a sign may stand for (fixed values).
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
#: Signs that hide a letter, whichever it is, and how many beside each other may.
MASKS, MASKED = "*#%&", 4
#: Channel costs (log): a sign for a letter, a sign put in, a letter written twice on purpose, a letter written twice by mistake
#: or on purpose where one is meant, a spread letter that is a word by itself, whatever letters the corpus has as words, a
#: mask for a letter or for none.
COST = {"sign": 1.0, "put in": 3.5, "double": 0.7, "drop": 2.0, "alone": 9.0, "mask": 1.0}
#: Paths kept a step; characters of a token whose reading is kept for later ones; readings kept per generation.
BEAM, CACHED, KEPT = 48, 72, 100_000
OUTER = ".,;:!?\"'()[]{}#*$%&|<>-_~"
LETTER = re.compile(r"[^\W\d_]")
BETWEEN = re.compile(r"[0-9@$!|+(<€£*#%&_.\-]")
EDGE = re.compile(r"[0-9@$!|+(<€£][^\W\d_]|[^\W\d_][0-9@$€£]|([^\W\d_])\1\1")
#: A sign at an end of a word, once or twice: three of a kind adorn it.
ENDS = re.compile(r"(?:^|(.))(?!\1)([0-9@$!|+(<€£])\2?(?=[^\W\d_])|[^\W\d_]([0-9@$€£])\3?(?!\3)$")
#: Punctuation that ends a token and stands for no letter.
CLOSING = ".,;:?\"')]}>"
SINGLES = re.compile(r"[^\W\d_]+|[\W\d_]+")
REPEATED = re.compile(r"(.)\1+", re.S)
# letters apart, each up to four times: by one or two blanks, line ends or signs
SPREAD = re.compile(r"(?<!\S)(?=.[ \t\r\n._*\-/,]|(.)\1)([^\W_]|[@$!(<|])\2{0,3}(?:[ \t\r\n._*\-/,]{1,2}([^\W_]|[@$!(<|])\3{0,3}){2,}(?=[\s.,;:!?]|$)", re.S)
SEPARATORS = "._*-/,"  # those of SPREAD within a token
APART = re.compile(r"[ \t\r\n._*\-/,]+")
PARTS = re.compile(r"[^\W\d_]+")
MARKS = re.compile("[\u0300-\u036f]+")


def fold(text: str) -> str:
    """Lower case, without accents."""
    return text.lower() if text.isascii() else MARKS.sub("", unicodedata.normalize("NFKD", text.casefold()))


def _disguised(token: str) -> bool:
    """A sign between or beside letters, or a letter three times; in linear time."""
    first = LETTER.search(token)
    if not first:
        return False
    last = len(token) - 1
    while not token[last].isalpha():
        last -= 1
    return BETWEEN.search(token, first.start(), last) is not None or EDGE.search(token) is not None


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _points(column: pa.Array) -> Iterator[np.ndarray]:
    """The code points of a column's folded texts, some MB at a time; 0 for what is no letter."""
    raw, offsets = T.texts_of(column)
    for i, j in T.groups(offsets):
        text = fold(raw[offsets[i]:offsets[j]].tobytes().decode())
        points = np.frombuffer(text.encode(), np.uint8).astype(np.uint32) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        yield np.where(_letters()[points], points, 0)


@lru_cache(maxsize=10_000)
def _letters_of(point: int) -> tuple[int, ...]:
    """The letters that a code point folds to; folding looks at one at a time, but for the order of marks."""
    return tuple(ord(x) for x in fold(chr(point)) if x.isalpha())


def _letter_counts(b: pa.RecordBatch) -> pa.RecordBatch:
    """Counts of the folded letters of a batch's texts: each code point that occurs is folded once."""
    seen: Counter = Counter()
    raw, offsets = T.texts_of(b.column(0))
    for i, j in T.groups(offsets):
        text = raw[offsets[i]:offsets[j]].tobytes()
        n = np.bincount(np.frombuffer(text if text.isascii() else text.decode().encode("utf-32-le"), np.uint8 if text.isascii() else np.uint32))
        for point in np.flatnonzero(n).tolist():
            for letter in _letters_of(point):
                seen[letter] += int(n[point])
    return pa.record_batch([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["letter", "n"])


class Model(NamedTuple):
    """log p(code | three before it), flat; the number of codes; the codes of letters."""
    table: np.ndarray
    size: int
    codes: dict[int, int]


def alphabet(texts: DataFrame) -> tuple[dict[int, int], int]:
    """Code of every folded letter of the texts, and the number of codes."""
    rows = arrow_map(texts, _letter_counts, "letter int, n long").where("letter > 0").groupBy("letter").agg(F.sum("n").alias("n"))
    order = [r["letter"] for r in rows.orderBy(F.desc("n"), "letter").collect()]  # letters of all scripts: at most 140,000
    if len(order) < LETTERS:
        return {x: i + 1 for i, x in enumerate(order)}, max(len(order) + 1, 2)
    own = LETTERS - 1 - SHARED
    return {x: i + 1 if i < own else own + 1 + x % SHARED for i, x in enumerate(order)}, LETTERS


def _gram_counts(codes: dict[int, int], size: int):
    """Counts of the character 4-grams of a task's texts; at most size ** ORDER rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.zeros(0x110000, np.int64)
        code[list(codes)] = list(codes.values())
        total = np.zeros(size ** ORDER, np.int64)
        pad = np.zeros(ORDER - 1, np.int64)
        for b in batches:
            for points in _points(b.column(0)):
                c = np.concatenate([pad, code[points], pad])
                index = c[:len(c) - ORDER + 1].copy()
                for k in range(1, ORDER):
                    index = index * size + c[k:len(c) - ORDER + 1 + k]
                total += np.bincount(index, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["gram", "n"])
    return run


def language_model(docs: DataFrame) -> Model:
    """log p(character | three before it), interpolated over shorter contexts: at most 48^4 numbers, whatever the corpus."""
    texts = documents(docs).select("text")
    codes, size = alphabet(texts)
    rows = texts.mapInArrow(_gram_counts(codes, size), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(size ** ORDER)
    found = rows.toArrow()
    n[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    n = n.reshape((size,) * ORDER)
    p = (n.sum((0, 1, 2)) + 1) / (n.sum() + size)
    for k in range(2, ORDER + 1):
        c = n.sum(tuple(range(ORDER - k)))
        context = c.sum(-1, keepdims=True)
        kinds = (c > 0).sum(-1, keepdims=True)  # Witten-Bell: a context's own variety says how far to trust it
        p = (c + kinds * p) / np.maximum(context + kinds, 1e-9) if k == 2 else np.where(context > 0, (c + kinds * p) / np.maximum(context + kinds, 1e-9), p)
    return Model(np.log(np.maximum(p, 1e-12)).astype(np.float32).ravel(), size, codes)


@lru_cache(maxsize=None)
def _options(ch: str, times: int, spread: bool) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with costs; words may end (a space) between and after spread letters."""
    out: list[tuple[str, float]] = []
    if ch.isalpha():
        kinds, one, two = ch, COST["drop"] if times == 2 else 0.0, 0.0 if times == 2 else COST["double"]
    else:
        kinds, one, two = SIGNS.get(ch, ""), COST["sign"], COST["sign"] * 1.3
        out.append(("", COST["put in"]) if kinds else ("", 0.0))
    for x in kinds:
        out.append((x, one))
        if times >= 2:
            out.append((x * 2, two))
        if spread:
            out += [(f"{x * i} {x * j}", two) for i in (1, 2) for j in (1, 2) if i + j <= times]
    return out + [(f"{x} ", cost) for x, cost in out if x] if spread else out


class Kept(dict):
    """Token -> its reading, kept in two generations of ``most`` tokens of up to CACHED characters."""

    def __init__(self, find: Callable[[str], str], most: int = KEPT):
        super().__init__()
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, token: str) -> str:
        reading = self.old.get(token)
        if reading is None:
            reading = self.find(token)
            reading = token if reading == token else reading  # one string, not two
        if len(token) <= CACHED:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[token] = reading
        return reading


class Looked(NamedTuple):
    """The tokens of some texts, each different one looked at once."""
    numbers: np.ndarray  # which of the different tokens each is
    ends: np.ndarray  # tokens before each text, and in all
    found: list[str | tuple[list[str], dict[str, str]]]  # a token's word, or its words and the readings among them
    apart: list[tuple[list[str], dict[str, str]]]  # of each text's letters apart, words and readings


class Decoder:
    """Readings of disguised tokens under a language model."""

    def __init__(self, model: Model):
        self.model = array("f", model.table.tobytes())
        self.size, self.codes = model.size, model.codes
        own = Counter(self.codes.values())
        self.any_letter = [(chr(x), COST["mask"], [c]) for x, c in self.codes.items() if own[c] == 1]
        self._kept = Kept(self._read)
        self._coded = lru_cache(maxsize=10_000)(self._coded_options)
        self._code_of = {" ": 0} | {chr(x): c for x, c in self.codes.items()}

    def read(self, token: str) -> str:
        """The likeliest letters behind a token; the token itself if it has none."""
        return self._kept[token]

    def _read(self, token: str) -> str:
        token = fold(token)
        runs: list[tuple[str, int]] = []
        at = 0
        for m in REPEATED.finditer(token):
            runs += self._singles(token[at:m.start()])
            ch, times, at = m.group(1), m.end() - m.start(), m.end()
            runs += [(ch, 1)] * times if ch in MASKS and times <= MASKED else [(ch, times)]
        return self._decode(runs + self._singles(token[at:]), False) or token

    @staticmethod
    def _singles(text: str) -> list[tuple[str, int]]:
        """Runs of characters that differ from their neighbours: letters beside each other are one, as they can only be themselves."""
        if not text or text.isalpha():
            return [(text, 1)] if text else []
        return [(x, 1) for part in SINGLES.findall(text) for x in ([part] if part.isalpha() else part)]

    def plain(self, word: str) -> str:
        """The reading of a word of letters alone: itself, but where letters are written twice or more."""
        return self._kept[word] if REPEATED.search(word) else word

    def _code(self, letter: str) -> int:
        point = ord(letter)
        return 0 if letter == " " else self.codes.get(point) or max(self.size - SHARED, 1) + point % min(SHARED, self.size - 1)

    def _coded_options(self, ch: str, times: int, spread: bool) -> list[tuple[str, float, list[int]]]:
        """The options of a run, with the codes of their characters."""
        return [(x, cost, [self._code(c) for c in x]) for x, cost in _options(ch, times, spread)]

    def read_spread(self, letters: str) -> str:
        """The likeliest words behind letters that were written apart, however many, with a space between words."""
        return self._decode([(m.group()[0], m.end() - m.start()) for m in re.finditer(r"(.)\1*", letters)], True) or letters

    def _decode(self, runs: list[tuple[str, int]], spread: bool) -> str:
        """Viterbi over the runs' options. A path is a chain of back pointers, so its cost is linear in the runs."""
        model, size, states = self.model, self.size, self.size ** (ORDER - 1)
        paths: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for ch, times in runs:
            if times == 1 and not spread and ch.isalpha():
                code_of = self._code_of
                options = [(ch, 0.0, [code_of[c] if c in code_of else self._code(c) for c in ch])]
            elif ch in MASKS and times == 1 and not spread:
                options = [("", COST["mask"], []), *self.any_letter]
            else:
                options = self._coded(ch, min(times, 4), spread)
            after: dict[int, tuple[float, tuple | None]] = {}
            if spread and times == 1 and ch.isalpha():
                ended = [(s + (model[x * size] if x % size else 0.0), back, x % size) for x, (s, back) in paths.items()]
                score, back, letter = max(ended, key=lambda p: p[0])
                after[self._code(ch) * size % states] = score - COST["alone"], (back, f" {ch} " if letter else f"{ch} ")
            for state, (score, back) in paths.items():
                for text, cost, codes in options:
                    x, s = state, score - cost
                    for code in codes:
                        x = x * size + code
                        s += model[x]
                        x %= states
                    if x not in after or after[x][0] < s:
                        after[x] = s, (back, text) if text else back
            paths = after if len(after) <= BEAM else dict(sorted(after.items(), key=lambda kv: -kv[1][0])[:BEAM])
        _, back = max(((s + (model[x * size] if x % size else 0.0), back) for x, (s, back) in paths.items()), key=lambda p: p[0])
        out = []
        while back:
            back, text = back
            out.append(text)
        return "".join(reversed(out)).strip()

    def _look(self, token: str) -> str | tuple[list[str], dict[str, str]]:
        """The word that a token of folded text is, if it is that alone; else its words and the readings among them."""
        word, whole = (token, token) if token.isalpha() else (token.strip(OUTER), token.rstrip(CLOSING))  # signs at its ends may be letters
        if word.isalpha() and self.plain(word) == word and (whole == word or not ENDS.search(whole)):
            return word
        out: list[str] = []
        readings: dict[str, str] = {}

        def put(word: str) -> None:
            out.append(word)
            reading = self.plain(word)
            if reading != word:
                readings[word] = reading
                out.append(reading)
        if word.isalpha():
            put(word)
            if whole == word or not ENDS.search(whole):
                return out, readings
            parts, forms = [word], {whole}
        else:
            parts = PARTS.findall(word)
            for part in parts:
                put(part)
            forms = {whole, word} if _disguised(whole) or _disguised(word) else ()
        for form in forms:
            readings[form] = self.read(form)
            if readings[form] not in parts:
                parts.append(readings[form])
                out.append(readings[form])
        return out, readings

    @staticmethod
    def _begins(token: str) -> int:
        """1 for a token that letters apart may begin or go on with, 2 if it may hold several of them, else 0."""
        if token[1:2] not in SEPARATORS and token[1] != token[0]:
            return 0
        rest = token.lstrip(token[0])
        if rest and rest[0] not in SEPARATORS:
            return 0
        return 2 if rest.strip(SEPARATORS) else 1

    def _apart(self, low: str) -> tuple[list[str], dict[str, str]]:
        """The words of letters that stand apart in a folded text, and those readings."""
        out: list[str] = []
        readings: dict[str, str] = {}
        for m in SPREAD.finditer(low):
            spread = m.group()
            letters = APART.sub("", spread)
            if not LETTER.search(letters):
                continue  # numbers
            readings[spread] = self.read_spread(letters)
            out += readings[spread].split()
        return out, readings

    def look(self, texts: list[str]) -> Looked:
        """What the tokens of texts are: most occur several times in a batch, so each is looked at once."""
        lows = [fold(t) for t in texts]
        tokens = [low.split() for low in lows]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in tokens], dtype=np.int64)))
        kinds = pa.array(list(chain.from_iterable(tokens)), pa.large_string()).dictionary_encode()
        numbers, different = kinds.indices.to_numpy(), kinds.dictionary.to_numpy(zero_copy_only=False).tolist()
        begins = np.array([self._begins(t) for t in different], np.int8)[numbers]
        # letters apart need a token that holds several, or two beside each other that may hold one
        maybe = np.concatenate(([0], np.cumsum((begins == 2) | (begins > 0) & (np.append(begins[1:], 0) > 0))))
        return Looked(numbers, ends, [self._look(t) for t in different], [self._apart(low) if some else ([], {}) for low, some in zip(lows, (maybe[ends[1:]] > maybe[ends[:-1]]).tolist())])

    def words_of(self, texts: list[str]) -> list[tuple[list[str], dict[str, str]]]:
        """The words of each text, folded, with readings put in for disguised ones; and those readings."""
        numbers, ends, found, apart = self.look(texts)
        rows = []
        for i, j, (more, others) in zip(ends.tolist(), ends[1:].tolist(), apart):
            out: list[str] = []
            readings: dict[str, str] = {}
            for k in numbers[i:j].tolist():
                if found[k].__class__ is str:
                    out.append(found[k])
                else:
                    out += found[k][0]
                    readings.update(found[k][1])
            rows.append((out + more, readings | others))
        return rows

    def words(self, text: str) -> tuple[list[str], dict[str, str]]:
        """The words of one text, and the readings among them."""
        return self.words_of([text])[0]


_HELD: list[tuple[Model, Decoder]] = []


def held_decoder(model: Model) -> Decoder:
    """One decoder a process for a model, whatever the number of tasks."""
    if not _HELD or _HELD[0][0] is not model:
        _HELD.clear()
        gc.collect()  # a decoder's caches refer to it
        _HELD.append((model, Decoder(model)))
    return _HELD[0][1]


def units_of(words: list[str]) -> dict[str, int]:
    """How often each unit occurs: words, and beginnings of longer words."""
    counts = Counter(w for w in words if len(w) > 2)
    out = Counter(counts)
    for w, n in counts.items():
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def density(count: int, words: int) -> float:
    return math.log1p(1000 * count / max(words, 1))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int, y: np.ndarray, penalty: float = PENALTY, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps on sparse rows (entries row, column, value); each step is solved by
    conjugate gradients, so no matrix of columns by columns is made. The bias has no penalty."""
    n = len(y)
    rows, columns, values = np.concatenate((rows, np.arange(n))), np.concatenate((columns, np.full(n, width))), np.concatenate((values, np.ones(n)))
    w = np.zeros(width + 1)
    ridge = np.full(width + 1, penalty)
    ridge[-1] = 1e-6

    def across(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, values * v[columns], minlength=n)

    def down(u: np.ndarray) -> np.ndarray:
        return np.bincount(columns, values * u[rows], minlength=width + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(across(w), -30, 30)))
        curve = p * (1 - p) + 1e-9
        scale = np.bincount(columns, values ** 2 * curve[rows], minlength=width + 1) + ridge
        step, left = np.zeros(width + 1), down(y - p) - ridge * w
        aim = 1e-9 * max(np.abs(left).max(), 1e-12)
        z = left / scale
        way, size = z, left @ z
        for _ in range(500):
            if np.abs(left).max() <= aim:
                break
            bent = down(curve * across(way)) + ridge * way
            a = size / (way @ bent)
            step, left = step + a * way, left - a * bent
            z = left / scale
            size, before = left @ z, size
            way = z + size / before * way
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def without_empty_stems(counts: dict[str, tuple[int, int]]) -> list[str]:
    """The units, without beginnings that are in the very texts of a longer beginning or whole word that they begin."""
    useless = set()
    for unit, n in counts.items():
        word = unit.removesuffix("*")
        useless |= {f"{word[:k]}*" for k in STEMS if k < len(word) and counts.get(f"{word[:k]}*") == n}
    return sorted(counts.keys() - useless)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic of up to ``rows`` labelled documents whose crc32(doc_id) mod 5 isn't 0: those of the least id hashes.
    Texts that occur several times count once, by their largest label."""
    ids = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    ids = ids.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = staged(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = documents(docs).join(F.broadcast(sample), "doc_id").where("text IS NOT NULL")  # at most `rows` ids and labels
    return texts.groupBy("text").agg(F.max("toxic").alias("toxic"))


def _offsets(parts: list) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))), pa.int32())


def fit(docs: DataFrame, labels: DataFrame, model: Model, rows: int = FIT_ROWS) -> tuple[dict[str, tuple[float, float]], float]:
    """(weights of each unit's presence and density, bias). Units are counted in Spark; all that pass the
    test of significance, of at most ``rows`` texts, are collected for the regression."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def restored(b: pa.RecordBatch) -> pa.RecordBatch:
        decoder = held_decoder(shared.value)
        words = [w for w, _ in decoder.words_of(b.column("text").to_pylist())]
        units = [units_of(w) for w in words]
        held = pa.MapArray.from_arrays(_offsets(units), pa.array(chain.from_iterable(units), pa.string()), pa.array(chain.from_iterable(u.values() for u in units), pa.int32()))
        return pa.record_batch([held, pa.array([len(w) for w in words], pa.int32()), b.column("toxic")], names=["units", "n_words", "toxic"])
    sample = staged(arrow_map(training_rows(docs, labels, rows), restored, "units map<string,int>, n_words int, toxic int"))
    sizes = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    n, k = sizes["n"], sizes["k"]
    nothing = {}, math.log((k + 0.5) / (n - k + 0.5))
    if not k or k == n:
        return nothing
    each = sample.select("toxic", F.explode(F.map_keys("units")).alias("unit")).groupBy("unit").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("k"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    inside, rate = F.col("n"), k / n
    ratio = 2 * (part(F.col("k"), inside * rate) + part(inside - F.col("k"), inside * (1 - rate)) + part(k - F.col("k"), (n - inside) * rate) + part(n - k - inside + F.col("k"), (n - inside) * (1 - rate)))
    found = each.where((F.col("k") > F.col("n") * rate) & (F.when(inside < n, ratio).otherwise(F.lit(0.0)) >= SIGNIFICANT))
    top = without_empty_stems({r["unit"]: (r["n"], r["k"]) for r in found.collect()})
    if not top:
        return nothing
    shared_units = docs.sparkSession.sparkContext.broadcast(top)

    def narrow(b: pa.RecordBatch) -> pa.RecordBatch:
        units = b.column("units")
        ends = units.offsets.to_numpy()
        found = pc.index_in(units.keys.slice(ends[0], ends[-1] - ends[0]), value_set=pa.array(shared_units.value, pa.string()))
        mine = found.is_valid()
        counts = units.items.slice(ends[0], ends[-1] - ends[0])
        kept = np.concatenate(([0], np.cumsum(mine.to_numpy(zero_copy_only=False))))
        offsets = pa.array(kept[ends - ends[0]], pa.int32())
        return pa.record_batch([pa.ListArray.from_arrays(offsets, found.filter(mine)), pa.ListArray.from_arrays(offsets, counts.filter(mine)), b.column("n_words"), b.column("toxic")], names=["at", "count", "n_words", "toxic"])
    texts = arrow_map(sample, narrow, "at array<int>, count array<int>, n_words int, toxic int").collect()
    entries = [(i, at, density(c, r["n_words"])) for i, r in enumerate(texts) for at, c in zip(r["at"], r["count"])]
    at_row, at_column, dense = (np.array(x) for x in zip(*entries))
    *w, bias = logistic(np.concatenate((at_row, at_row)), np.concatenate((at_column, at_column + len(top))), np.concatenate((np.ones(len(dense)), dense)),
                        2 * len(top), np.array([r["toxic"] for r in texts], float)).tolist()
    return dict(zip(top, zip(w[:len(top)], w[len(top):]))), bias


class Scorer:
    """Scores of looked-at texts by the regression's weights."""

    def __init__(self, weights: dict[str, tuple[float, float]], bias: float):
        self.bias, self.column = bias, {u: i for i, u in enumerate(weights)}
        self.weights = np.array(list(weights.values()), float).reshape(-1, 2)
        self.begins: dict[str, int] = {}  # beginnings of units -> the unit of words that begin so, or -1
        for u in weights:
            word = u.removesuffix("*")
            self.begins.update({word[:k]: self.column.get(f"{word[:k]}*", -1) for k in STEMS if k <= len(word)})

    def units(self, word: str) -> list[int]:
        """The units of a word, as columns."""
        own = []
        for k in STEMS:
            found = self.begins.get(word[:k])
            if found is None:
                break
            if found >= 0 and len(word) > k:
                own.append(found)
        if word in self.column and len(word) > 2:
            own.append(self.column[word])
        return own

    def score(self, looked: Looked) -> tuple[np.ndarray, list[list[tuple[str, str]]]]:
        """Each text's score, and those of its readings that hold a unit that is a whole word."""
        numbers, ends, found, apart = looked
        kinds, texts = len(found), len(apart)
        sizes, have, read = np.ones(kinds, np.int64), np.zeros(kinds, np.int64), np.zeros(kinds, bool)
        flat: list[int] = []
        for i, x in enumerate(found):
            if x.__class__ is str:
                own = self.units(x) if x[:3] in self.begins else ()
            else:
                sizes[i], read[i] = len(x[0]), bool(x[1])
                own = [u for w in x[0] for u in self.units(w)]
            if own:
                have[i] = len(own)
                flat += own
        words = np.concatenate(([0], np.cumsum(sizes[numbers])))
        words = words[ends[1:]] - words[ends[:-1]] + [len(w) for w, _ in apart]
        each = have[numbers]
        rows = np.repeat(np.arange(texts), np.diff(ends))
        into = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        units = np.array(flat, np.int64)[np.repeat((np.cumsum(have) - have)[numbers], each) + into]
        more = [(row, u) for row, (w, _) in enumerate(apart) for x in w for u in self.units(x)]
        pairs = np.concatenate((np.repeat(rows, each) * len(self.weights) + units, np.array([row * len(self.weights) + u for row, u in more], np.int64)))
        pairs, counts = np.unique(pairs, return_counts=True)
        rows_of, units = np.divmod(pairs, max(len(self.weights), 1))
        z = self.bias + np.bincount(rows_of, self.weights[units, 0] + self.weights[units, 1] * np.log1p(1000 * counts / np.maximum(words[rows_of], 1)), texts)
        readings: list[dict[str, str]] = [{} for _ in range(texts)]
        at = np.flatnonzero(read[numbers])
        for row, i in zip(rows[at].tolist(), numbers[at].tolist()):
            readings[row].update(found[i][1])
        for row, (_, others) in enumerate(apart):
            readings[row].update(others)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), [[(token, w) for token, w in r.items() if any(x in self.column for x in w.split())] for r in readings]


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, restored (a map from disguised tokens to their readings that are units of the regression,
    or for spread letters hold one), score,
    predicted, and the columns of ``keep`` for every row of ``docs``.

    Null and empty texts have the score of texts without any unit. Without labels of both kinds, all texts have the
    labels' smoothed rate. Repeated rows and null doc_ids stay. An empty table gives no rows.
    """
    model = language_model(docs)
    weights, bias = fit(docs, labels, model, rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(weights, bias))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        decoder = held_decoder(shared.value)
        scores, found = scorer.value.score(decoder.look([t or "" for t in b.column(1).to_pylist()]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.map_(pa.string(), pa.string())), pa.array(scores, pa.float64()), pa.array(scores >= 0.5).cast(pa.int32()), *b.columns[2:]],
                                          names=["doc_id", "restored", "score", "predicted", *keep])
    return arrow_map(documents(docs, keep), batch, "doc_id long, restored map<string,string>, score double, predicted int" + ddl(docs, keep))
