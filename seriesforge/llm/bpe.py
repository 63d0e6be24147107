"""BPE encoding and decoding over a public vocabulary file.

A text is cut at ASCII white space (the vocabulary's own rules drop white space and look at nothing beyond it), each
chunk that a worker has not met lately is normalised and split into words: a word's symbols form a doubly linked
list, the merges that could be done wait in a priority queue by rank and place, and an entry is skipped when one of
its symbols has changed meanwhile. Decoding concatenates the vocabulary's strings, with a space between, as the file
names no decoder.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seriesforge.llm._frames import arrow_map, documents

#: Chunks kept per generation of a worker's cache, and the longest chunk kept.
CACHE, CACHED_BYTES = 400_000, 64
#: The words of a lower-case ASCII chunk without apostrophes, and the signs that may stand after a word.
PIECES, AFTER = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+"), b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space of Unicode (fixed values).
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Young(dict):
    """Chunk -> ids; chunks that aren't there are asked for."""

    def __init__(self, find: Callable[[bytes], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, chunk: bytes) -> bytes:
        return self.find(chunk)


class Chunks:
    """Chunk of a text (bytes without white space) -> its ids, kept per worker in two generations of ``most`` chunks.

    The vocabularies this serves drop white space, lower case, and have no rule that looks beyond white space. So a
    text's ids are those of its chunks; A-Z are lowered first, unless a special token might be spelt or an accent follow
    (lower letters and accents compose more often); and the words of a chunk are kept apart where that is plain."""

    def __init__(self, most: int = CACHE):
        self.now, self.most = Young(self.find), most
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []  # chunks that are dropped again after a batch

    @staticmethod
    def parts(chunk: bytes) -> list[bytes] | tuple[bytes, ...]:
        """The words of a chunk where the vocabularies' rule is plain: lower-case ASCII without apostrophes, or a word of
        letters with ASCII signs after it. Else the chunk itself."""
        if chunk.isalpha() or b"'" in chunk or b"<|" in chunk:
            return (chunk,)
        if chunk.isascii():
            return PIECES.findall(chunk) if chunk == chunk.lower() and chunk.decode().isprintable() else (chunk,)
        word = chunk.rstrip(AFTER)
        return (word, chunk[len(word):]) if word != chunk and word.decode("utf-8", "replace").lower().isalpha() else (chunk,)

    def encode_new(self, chunk: bytes) -> bytes:
        """The little-endian unsigned 32-bit ids of a chunk."""
        raise NotImplementedError

    def find(self, chunk: bytes) -> bytes:
        """The ids of a chunk that isn't in the young generation; it is kept there."""
        ids = self.old.get(chunk)
        if ids is None:
            parts = (chunk,) if chunk.isalpha() else self.parts(chunk)
            ids = b"".join([self.now[p] for p in parts]) if len(parts) > 1 else self.encode_new(chunk)
        self.now[chunk] = ids
        if len(chunk) > CACHED_BYTES:
            self.long.append(chunk)
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes of little-endian unsigned 32-bit numbers."""
        look = self.now.__getitem__
        out = [b"".join(map(look, (t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).split())) for t in texts]
        for c in self.long:
            self.now.pop(c, None)
        self.long.clear()
        if len(self.now) >= self.most:
            self.old, self.now = self.now, Young(self.find)
        return out


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for the characters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe(Chunks):
    """Vocabulary, merges and rules of a tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", _WHITE))
        self.white = regex.compile(f"[{_WHITE}]+")
        letters = byte_letters()
        self.symbol = [vocab[letters[b]] for b in range(256)]
        self.last = [vocab[letters[b] + self.end] for b in range(256)]

    def _merge(self, word: bytes) -> list[int]:
        ids = [self.symbol[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if (found := ranks.get((ids[i], ids[i + 1]))):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: a neighbour was merged away meanwhile
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := ranks.get((new, ids[k]))):
                    heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := ranks.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
        return [x for x in ids if x >= 0]

    def _piece(self, text: str) -> list[int]:
        text = self.white.sub(" ", unicodedata.normalize("NFC", text))
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # a sigma's lower case is the same everywhere
        return [i for w in self.words.findall(text) for i in self._merge(w.encode())]

    def _chunk(self, chunk: bytes) -> list[int]:
        if chunk.isalpha() and chunk.islower():
            return self._merge(chunk)  # ASCII letters: one word, normal as it is
        text = chunk.decode("utf-8", "replace")
        if "<|" not in text:
            return self._piece(text)
        return [i for part in self.specials.split(text) for i in ([self.added[part]] if part in self.added else self._piece(part))]

    def encode_new(self, chunk: bytes) -> bytes:
        return np.array(self._chunk(chunk), "<u4").tobytes()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One per worker and file."""
    return Bpe(path)


def _ids_array(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, no special tokens added. Null and empty texts have no ids; repeated
    rows and null doc_ids stay. ``path`` is the vocabulary file, the same on all machines."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        own = bpe(path)
        return pa.record_batch([b.column(0), _ids_array(own.encode([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]))], names=["doc_id", "ids"])
    return arrow_map(documents(docs), batch, "doc_id long, ids array<int>")


def _texts_of_ids(own: Bpe, ids: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The ids, and the text of each row. The ids become Python numbers all at once: one by one takes Arrow several times
    as long as the decoding."""
    ids = ids.fill_null([]) if ids.null_count else ids
    flat, at = ids.flatten().to_numpy(zero_copy_only=False).tolist(), (ids.offsets.to_numpy() - ids.offsets[0].as_py()).tolist()
    return ids, pa.array([own.decode(flat[x:y]) for x, y in zip(at, at[1:])], pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the vocabulary's strings of each row's ids. Null ids give an empty text."""
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column(0), *_texts_of_ids(bpe(path), b.column(1))], names=["doc_id", "ids", "text"])
    return arrow_map(encoded.select("doc_id", "ids"), batch, "doc_id long, ids array<int>, text string")
