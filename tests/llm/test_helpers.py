"""Batch helpers against plain Python."""
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from seriesforge.llm import _anchors as A, _text as T
from seriesforge.llm._graph import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def joined(texts):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return raw, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 48 for x in b)), min_size=1, max_size=6))
def test_words(texts):
    raw, offsets = joined(texts)
    starts, ends, first = T.words_of(raw, offsets)
    data = raw.tobytes()
    for t, text in enumerate(texts):
        assert [data[a:b] for a, b in zip(starts[first[t]:first[t + 1]], ends[first[t]:first[t + 1]])] == WORD.findall(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60), st.integers(1, 9))
def test_window_min(values, width):
    v = (np.array(values, np.uint64) << np.uint64(40)) + np.uint64(7)
    got = T.window_min(v, width, block=16)
    assert got.tolist() == [i + int(np.argmin(v[i:i + width])) for i in range(len(v) - width + 1)]


def test_hashes_tell_windows_apart():
    units = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], np.uint64)
    h = T.Sums(units, T.ROOTS[0]).windows(3)
    assert h[0] == h[3] and len(set(h.tolist())) == 4
    assert (T.Sums(units[1:], T.ROOTS[0]).windows(3) == h[1:]).all()


def test_blocks():
    """Runs of a text that is looked at in blocks cover the same windows, with the same anchors."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "c", "def", "g"]) for _ in range(400)).encode(), b"", b"x " * 50]
    raw, offsets = joined(texts)

    def windows(found):
        return {(int(t), int(s) + i): int(a) for a, _, t, s, n, _ in zip(*found) for i in range(n)}
    for words in (True, False):
        whole, parts = (windows(A.batch_runs(raw, offsets, words, 20, 8, b)) for b in (1 << 21, 37))
        assert whole == parts and len(whole) == sum(max(0, (len(t.split()) if words else len(t)) - 19) for t in texts)
    starts, ends, _ = T.words_of(raw, offsets)
    assert (T.word_hashes(raw, starts, ends, T.ROOTS[0], 16) == T.Sums(raw, T.ROOTS[0]).spans(starts, ends)).all()


def test_merged():
    s, e = A.merged(np.array([5, 0, 3, 9]), np.array([7, 2, 6, 10]))
    assert list(zip(s.tolist(), e.tolist())) == [(0, 2), (3, 7), (9, 10)]


def test_components(lab):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(700, 700 + i) for i in range(1, 90)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {r["node"]: r["root"] for r in connected_components(lab.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked if find(x) != x}
    assert connected_components(lab.createDataFrame([], "a long, b long")).count() == 0
