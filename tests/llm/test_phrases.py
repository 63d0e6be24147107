"""Periodic runs, collocations and paragraph sketches against brute force."""
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesforge.llm import collocations as C, periodic as P, sketch as K
from seriesforge.llm._frames import read
from seriesforge.llm.queries import QUERIES, with_periods

from .conftest import DOCUMENTS

SF = "/root/testdata/sf0.001"


def words_of(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def brute_runs(w, shortest=12):
    """(start, length, smallest period) of all runs, by comparing each word with the one a period on."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(shortest, 2 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def factor_runs(w, shortest):
    s, e, p = P.Factors(np.array([ord(c) for c in w], np.int64)).runs(shortest)
    return list(zip(s.tolist(), (e - s).tolist(), p.tolist()))


def test_runs_of_all_short_words():
    for letters, longest in (("ab", 12), ("abc", 8)):
        for n in range(longest + 1):
            for w in itertools.product(letters, repeat=n):
                assert factor_runs("".join(w), 1) == brute_runs(w, 1)


def test_runs_of_periodic_words():
    rnd = random.Random(5)
    for _ in range(1500):
        letters = rnd.choice(["ab", "aab", "aaaab", "abc", "abcdefgh"])
        root = "".join(rnd.choice(letters) for _ in range(rnd.randint(1, 40)))
        if rnd.random() < .3:  # few distinct factors: as many repetitions within a period as there can be
            slope, turn = rnd.random(), rnd.randrange(len(root))
            root = "".join("ab"[int((i + 1) * slope) - int(i * slope)] for i in range(len(root)))
            root = root[turn:] + root[:turn]
        w = "".join(rnd.choice([root, root, root[:rnd.randint(0, 9)], "a", "c"]) for _ in range(rnd.randint(0, 7)))
        assert factor_runs(w, 1) == brute_runs(w, 1) and factor_runs(w, 12) == brute_runs(w)


def without_repeats(w, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_texts(make_docs):
    rnd = random.Random(2)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a " * 11), (5, "a " * 12), (5, "a " * 12), (None, "é\tü\n" * 9), (7, "x y z " * 2000 + "q"),
            (8, " ".join(str(rnd.randrange(900)) for _ in range(300)) * 3), (9, "b " * 11 + " b")]
    got = P.periodic_runs(make_docs(rows), keep=("score",)).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "n_words", "runs", "collapsed", "score"]
    want = collections.Counter()
    for i, t in rows:
        w = words_of(t)
        runs = brute_runs(w)
        want[i, len(w), tuple(runs), without_repeats(w, runs)] += 1
    assert want == collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got)
    assert P.periodic_runs(make_docs([(1, "a")]).limit(0)).collect() == []


def test_periodic_query(lab):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_periodic"](lab, SF).collect()}
    some = 0
    for r in read(lab, SF, "documents").collect():
        w, h = words_of(r["text"]), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        if len(w) > 2500:
            continue
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        some += bool(runs)
        assert got[r["doc_id"]] == (
            len(runs), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(without_repeats(w, runs).encode()).hexdigest())
    assert some > 10


def test_edit_of_odd_texts(lab):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(ids[0], None), (ids[1], "  "), (ids[2], "a"), (None, "b  c")]
    out = {r["doc_id"]: r["text"] for r in with_periods(lab.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {ids[0]: None, ids[1]: "  ", ids[2]: "a", None: "b  c"}


def brute_collocations(rows, support, longest, top):
    out = []
    f = collections.defaultdict(collections.Counter)
    for _, text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    f["und" if lang is None else lang][w[i:i + n]] += 1
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= support}
        inside = {x[i:j] for x, v in cand.items() for i in range(len(x)) for j in range(i + 2, len(x) + 1) if j - i < len(x) and cand[x[i:j]] <= v}
        scored = []
        for k, a in cand.items():
            if k not in inside:
                score, cut = min((1000 * a * n // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
                scored.append((-score, -a, " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("support,top", [(3, 2000), (7, 15)])
def test_collocations(lab, monkeypatch, support, top):
    monkeypatch.setattr(C, "TOGETHER", 3)  # many shards
    rnd = random.Random(support)
    rows = []
    for i in range(160):
        text = "".join(rnd.choice(["the ", "The\t", "of ", "new york ", "x y z w v ", "a a ", "é ", ". ", ",", "\n", "q! ", "\x0b", "b c "]) for _ in range(rnd.randint(0, 60)))
        rows.append((rnd.choice([i, i, None, 5]), rnd.choice([text, text, text, None]), rnd.choice(["en", "en", "fr", None])))
    rows += [rows[0]] * 5 + [(900, "big one " * 4000, "de"), (901, "a.", "de"), (902, "", "es")]
    docs = lab.createDataFrame([(i, t, x, "s", 0, 1, 2) for i, t, x in rows], DOCUMENTS + ", phrase int, shard int")
    got = C.collocations(docs, support=support, top=top)
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, support, 5, top)


def test_collocations_of_nothing(lab):
    none = lab.createDataFrame([], DOCUMENTS)
    assert C.collocations(none).collect() == []
    assert C.collocations(lab.createDataFrame([(1, None, None, "s", 0)], DOCUMENTS)).collect() == []


def test_blocks_cut_long_texts_between_pieces(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 50)
    text = b"aa bb. " * 40
    parts = [t for _, _, t in C._blocks(iter([("en", 0, text), ("fr", 1, b"x" * 80), ("en", 0, b"cc")]))]
    assert max(map(len, parts)) <= 80
    pairs = collections.Counter(bytes(b.bytes[b.start[i]:b.end[i + 1]]) for p in parts for b in [C.Block(np.frombuffer(p, np.uint8))] for i in b.within(2))
    assert pairs == {b"aa bb": 40}


def test_sketches_recover_differences(lab):
    rnd = random.Random(4)
    rows = []
    for n, m, common in [(0, 0, 0), (1, 0, 0), (0, 3, 0), (3, 4, 10), (10, 0, 30), (60, 80, 5), (400, 3, 50), (0, 0, 700), (900, 900, 900)]:
        own, other, both = ([rnd.randrange(1 << 60) for _ in range(k)] for k in (n, m, common))
        rows.append((sorted(own), sorted(other), own + both, both[::-1] + other))
    # digests that share all the bits which choose cells: they can't be told apart until tables are split
    alike = [(k << 6) | 5 for k in rnd.sample(range(1 << 54), 40)]
    rows.append((sorted(alike), [], alike, []))
    frame = lab.createDataFrame(rows, "here array<long>, there array<long>, a array<long>, b array<long>")
    got = frame.select("here", "there", K.difference(F.col("a"), F.col("b")).alias("d"), K.likeness(F.col("a"), F.col("b")).alias("near"),
                       F.size("a").alias("n"), F.size("b").alias("m")).collect()
    for r in got:
        assert sorted(r["d"]["here"]) == r["here"] and sorted(r["d"]["there"]) == r["there"]
        assert r["near"] == (1.0 if r["n"] + r["m"] == 0 else (r["n"] + r["m"] - len(r["here"]) - len(r["there"])) / (r["n"] + r["m"]))


def paragraphs(text):
    return {int(hashlib.md5(p.encode()).hexdigest()[:15], 16) for p in re.findall(r"[^\n\x0b-\r]{160,}?[.!?]+[ \t]+|[^\n\x0b-\r]+", text or "")}


@pytest.mark.parametrize("of", [2, 500])
def test_edited_fingerprints(make_docs, monkeypatch, of):
    monkeypatch.setattr(K, "RANGE_ROWS", of)
    rnd = random.Random(of)
    line = [("word%d " % rnd.randrange(50)) * rnd.randint(1, 40) + rnd.choice([".", "!", ". "]) for _ in range(40)]
    rows = [(None, "first"), (None, None), (3, ""), (3, "é😀ü" * 5), (3, "é😀ü" * 5), (-7, "a\nb\nc"), (2**62, "\n".join(line * 20)), (-(1 << 63), "z")]
    rows += [(rnd.randrange(10**9), "\n".join(rnd.sample(line, rnd.randint(0, 12)))) for _ in range(60)]
    got = K.edited_fingerprints(make_docs(rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = paragraphs(t), paragraphs(edited), paragraphs(after)

        def near(x, y):
            return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0
        want[i, len(t), edited, near(a, b), near(a, c)] += 1
    assert want == collections.Counter((r.doc_id, r.n_chars, r.edited, r.near_edited, r.near_next) for r in got)
    for r in got:
        assert [c.n for c in r.sketch] != [] and sum(c.n for c in r.sketch) == K.TABLES * len(r.digests)
    assert K.edited_fingerprints(make_docs([(1, "a")]).limit(0)).collect() == []


def test_a_lone_document_is_its_own_next(make_docs):
    r = K.edited_fingerprints(make_docs([(9, "one\ntwo\nthree\nfour")])).first()
    assert r.near_next == 1.0 and r.edited == "one\ntwo\ntone\ntwo\nt"


def test_sketches_run_without_python(lab):
    plan = QUERIES["op13_fingerprints"](lab, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and plan.count("hashpartitioning") == 1
