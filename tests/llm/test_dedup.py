"""SimHash, substring and suffix dedup against brute force."""
import collections
import random
import re

import numpy as np
import pytest
import xxhash

from seriesforge.llm import simhash as S, substring as W, suffix as X

from .conftest import key

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_print(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(low)
    if not words:
        return 0
    rows = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in rows]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay():
    x = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    nearest = x ^ S.NEAREST[S._syndromes(x)]
    assert (S._syndromes(nearest) == 0).all() and (np.bitwise_count(nearest ^ x) <= 3).all()
    at, index = S.near_codewords(x)
    for b in range(23):
        other = S.codeword(x ^ (1 << b))
        met = np.zeros(len(x), bool)
        met[at[index == other[at]]] = True
        assert met.all()


@pytest.mark.parametrize("crowded", [0, 2, 64])
def test_links(lab, crowded):
    rng = random.Random(2)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for f in list(prints):
        for _ in range(12):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            prints.add(g)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in prints]
    links = {(r["a"], r["b"]) for r in S.links_within_2(lab.createDataFrame(signed, "fp long"), crowded).collect()}
    parent = {f[0]: f[0] for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        assert a > b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
        parent[find(a)] = find(b)
    for i, (a,) in enumerate(signed):
        for (b,) in signed[i + 1:]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
                assert find(a) == find(b)
                assert crowded < 64 or (max(a, b), min(a, b)) in links


def near_texts():
    rng = random.Random(7)
    rows, words = [], [f"Wörd{i}" for i in range(400)]
    for g in range(6):
        base = [rng.choice(words) for _ in range(300)]
        for c in range(5):
            text = list(base)
            for _ in range(c):
                text[rng.randrange(300)] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    return rows + [(100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, "ONE"), (105, "one two"), (None, "one two"), (7, rows[7][1]), (106, "long " * 30_000)]


def test_simhash(make_docs):
    rows = near_texts()
    prints = [shingle_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=key)
    got = S.simhash_components(make_docs(rows)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=key) == want
    one = S.one_of_each(make_docs(rows))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(least.values()))
    assert one.columns == make_docs(rows).columns


def test_empty(make_docs):
    none = make_docs([(1, "a")]).limit(0)
    assert S.simhash_components(none).count() == 0 and S.one_of_each(none).count() == 0
    assert W.substring_dedup(none).count() == 0 and X.suffix_dedup(none).count() == 0


def copied_texts(seed, joint=" "):
    rng = random.Random(seed)
    words = [f"{c}{i}" for c in "abé" for i in range(30)]
    passages = [[rng.choice(words) for _ in range(rng.randint(4, 40))] for _ in range(5)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 20))]
        rows.append((i, joint.join(text) + "\n" * (i % 2)))
    return rows + [(50, None), (51, ""), (52, "x " * 100), (53, "ab " * 60 + "cd"), (54, "x " * 40), (3, rows[3][1]), (4, "another text"), (None, rows[5][1]), (55, rows[6][1]), (56, "w" * 3000)]


def brute_words(rows, k):
    texts = [WORD.findall((t or "").encode()) for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + k]) for w in texts for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [any(seen[tuple(w[j:j + k])] > 1 for j in range(max(0, i - k + 1), min(i, len(w) - k) + 1)) for i in range(len(w))]
        out.append((d, b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)))
    return sorted(out, key=key)


@pytest.mark.parametrize("together,chunk", [(1 << 19, 1 << 20), (0, 1 << 20), (1 << 19, 50)])
def test_substring(make_docs, together, chunk, monkeypatch):
    monkeypatch.setattr(W.repeated_spans, "__defaults__", (W.WINDOW, W.GRAM, together, chunk))
    rows = copied_texts(3)
    got = W.substring_dedup(make_docs(rows), k=7, m=3).collect()
    assert sorted(map(tuple, got), key=key) == brute_words(rows, 7)


def test_substring_keeps_columns(make_docs):
    rows = copied_texts(4)
    got = W.substring_dedup(make_docs(rows), k=7, m=3, keep=("text", "lang", "row", "start")).collect()
    assert sorted((r["row"], r["text"]) for r in got if r["text"] is not None) == sorted((i, t) for i, (_, t) in enumerate(rows) if t is not None)


def test_paths_are_compacted(lab, make_docs):
    """A passage that stands in three texts whole is one path."""
    from seriesforge.llm import _anchors as A
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, f"{' '.join(f'a{i}_{j}' for j in range(20))} {passage} {' '.join(f'b{i}_{j}' for j in range(20))}") for i in range(3)]
    spans = W.repeated_spans(A.keyed(make_docs(rows)), 10, 4).collect()
    assert len({r["path"] for r in spans}) == 1
    for d in range(3):
        own = sorted((r["start"], r["start"] + r["n"]) for r in spans if r["doc_id"] == d)
        assert own[0][0] == 20 and max(e for _, e in own) == 20 + 191


def brute_bytes(rows, k, keep_first=False):
    texts = [(t or "").encode() for _, t in rows]
    seen, first = collections.Counter(), {}
    for n, t in enumerate(texts):
        for i in range(len(t) - k + 1):
            seen[t[i:i + k]] += 1
            first.setdefault(t[i:i + k], (n, i))
    out = []
    for n, ((d, _), t) in enumerate(zip(rows, texts)):
        gone = bytearray(len(t))
        for i in range(len(t) - k + 1):
            w = t[i:i + k]
            if seen[w] > 1 and not (keep_first and first[w] == (n, i)):
                gone[i:i + k] = b"\1" * k
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((d, bytes(x for x, g in zip(t, gone) if not g), len(t), sum(gone), tuple(spans)))
    return sorted(out, key=key)


def bytes_got(df):
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], tuple(map(tuple, r["spans"]))) for r in df.collect()), key=key)


@pytest.mark.parametrize("together,chunk", [(1 << 22, 1 << 20), (0, 1 << 20), (1 << 22, 300)])
def test_suffix(make_docs, together, chunk):
    rows = copied_texts(5)
    assert bytes_got(X.suffix_dedup(make_docs(rows), k=24, m=8, together=together, chunk=chunk)) == brute_bytes(rows, 24)


@pytest.mark.parametrize("together", [1 << 22, 0])
def test_suffix_keeps_the_first(make_docs, together):
    rows = [r for r in copied_texts(6) if r[0] is not None and r[0] not in (3, 4)]
    got = bytes_got(X.suffix_dedup(make_docs(rows), k=24, m=8, together=together, keep_first=True))
    assert got == brute_bytes(sorted(rows, key=key), 24, keep_first=True)


def test_previous_factor():
    raw = np.frombuffer(b"abcabcabcxabcabc" * 3, np.uint8)
    n = len(raw)
    inside = np.arange(n) <= n - 9
    got = X.previous_factor(raw, np.zeros(n, np.int64), inside, 9)
    data = raw.tobytes()
    for i in range(n):
        earlier = [j for j in range(i) if inside[i] and data[j:j + 9] == data[i:i + 9]]
        assert got[i] == (max(earlier) if earlier else -1)
