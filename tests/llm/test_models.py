"""Vectors against brute force; toxicity by held-out accuracy; the pipeline stage by stage."""
import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seriesforge.llm import toxicity as X, vectors as V
from seriesforge.llm._frames import read

from .conftest import DOCUMENTS, key

SF = "/root/testdata/sf0.1"


def brute(rows, threshold=0.95):
    sound = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    by_length = collections.defaultdict(list)
    for k in sound:
        by_length[len(rows[k][1])].append(k)
    for ks in by_length.values():
        m = np.array([np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ks])
        m /= np.linalg.norm(m, axis=1)[:, None]
        s = m @ m.T >= threshold
        np.fill_diagonal(s, False)
        for a, k in enumerate(ks):
            hits = np.flatnonzero(s[a])
            links[k] = len(hits)
            for j in hits:
                parent[find(k)] = find(ks[j])
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], least.get(find(k))) for k, (i, _) in enumerate(rows)), key=key)


def vector_rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((5, 6))
    rows = [(k if k % 50 else None, (base[k % 5] + rng.standard_normal(6) * 0.15).tolist() if k % 3 else base[k % 5].tolist()) for k in range(300)]
    return rows + [(7, rows[7][1]), (1000, None), (1001, []), (1002, [0.0] * 6), (1003, [float("nan")] * 6), (1004, [1.0, None]), (1005, [2.0]), (1006, [5.0]), (1007, [-1.0]),
                   (1008, [1e300] * 6), (1009, [1.0] * 6), (1000, None), (1010, [float("inf"), 1.0])]


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors(lab, block):
    rows = vector_rows()
    df = lab.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, id string, copies int")
    got = V.similar_vectors(df, block=block).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert V.similar_vectors(df.limit(0)).count() == 0


def test_recall(lab):
    """On the given vectors at least 0.9 of the links are found, and nothing else."""
    df = read(lab, SF, "embeddings")
    want = {i: n for i, n, _ in brute([(r["vec_id"], r["embedding"]) for r in df.collect()])}
    got = {r["vec_id"]: r["n_links"] for r in V.similar_vectors(df).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_multi_sequence():
    rng = np.random.default_rng(5)
    index = V.MultiIndex(rng.standard_normal((9, 3)), rng.standard_normal((9, 4)))
    rows = rng.standard_normal((20, 7))
    d = [V._distances(h, b) for h, b in zip(index.halves(rows), index.books)]
    whole = (d[0][:, :, None] + d[1][:, None, :]).reshape(20, 81)
    visits = index.visits(rows, 30)
    assert (visits == whole.argsort(1, kind="stable")[:, :30]).all()
    assert (index.ranks(rows, visits[:, 12]) == 13).all()


# ---- toxicity


def test_held_out(lab):
    docs, labels = read(lab, SF, "documents"), read(lab, SF, "labels")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in X.toxicity(docs, labels).collect() if r["doc_id"] in toxic and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    yes, no = [r["score"] for r in rows if toxic[r["doc_id"]]], [r["score"] for r in rows if not toxic[r["doc_id"]]]
    auc = np.mean([(p > np.array(no)).mean() + 0.5 * (p == np.array(no)).mean() for p in yes])
    assert auc > 0.93
    assert sum(s >= 0.5 for s in yes) > 0.85 * len(yes) and sum(s >= 0.5 for s in no) <= 0.01 * len(no)


def test_held_out_labels_are_not_read(lab):
    docs, labels = read(lab, SF, "documents"), read(lab, SF, "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (sorted((r["toxic"], r["text"][:50]) for r in X.training_rows(docs, x, 500).collect()) for x in (labels, flipped))
    assert a == b and len(a) > 300


def test_readings(lab):
    decoder = X.Decoder(X.language_model(read(lab, SF, "documents")))
    for token, word in [("1d1ot", "idiot"), ("m0r0n", "moron"), ("$tupid", "stupid"), ("tr@sh", "trash"), ("trrraaash", "trash"), ("p@thet1c", "pathetic"), ("cl0wn", "clown"), ("s-c-u-m", "scum"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("id!ot", "idiot")]:
        assert decoder.read(token) == word
    words, readings = decoder.words("the s t u p i d man. M O R O N, idiot.then trash### plain-word")
    assert {"stupid", "moron", "idiot", "trash", "plain", "the", "man"} <= set(words) and readings["s t u p i d"] == "stupid"


def test_signs_at_the_ends_masks_and_spacings(lab):
    """What ``words`` makes of whole texts: signs that begin or end a word, masks, and letters apart in many ways."""
    decoder = X.Decoder(X.language_model(read(lab, SF, "documents")))
    for text, word in [("you $tupid man", "stupid"), ("!diot", "idiot"), ("a <lown.", "clown"), ("$cum.", "scum"), ("$tup1d", "stupid"), ("($tupid)", "stupid"), ("id*ot", "idiot"), ("st*pid", "stupid"), ("m#r*n", "moron"),
                       ("tr&sh!", "trash"), ("i d ii oo t", "idiot"), ("s  t  u  p  i  d", "stupid"), ("s\nt\nu\np\ni\nd", "stupid"), ("s, t, u, p, i, d", "stupid"), ("s/t/u/p/i/d", "stupid"), ("( l o w n", "clown"),
                       ("| d | o t", "idiot"), ("s\r\nc\r\nu\r\nm", "scum")]:
        assert word in decoder.words(text)[0], (text, decoder.words(text))
    for text in ("1, 2, 3, 4, 5 and 6 7 8 9", "**bold** words, \"quoted\" ones; and 100% of $100"):
        assert decoder.words(text)[1] == {}, decoder.words(text)
    assert "**" not in "".join(decoder.words("a" + "*" * 90_000 + "b")[0])


def test_viterbi_finds_the_likeliest_reading(lab):
    """Against every path of short lattices."""
    decoder = X.Decoder(X.language_model(read(lab, SF, "documents")))
    model, size = decoder.model, decoder.size

    def score(text, cost):
        x, s = 0, -cost
        for code in map(decoder._code, text):
            x = x * size + code
            s += model[x]
            x %= size ** 3
        return s + (model[x * size] if x % size else 0.0)
    for token in ["1d1ot", "$tupid", "m0rr0n", "tr@sh", "s-c-um", "c1l|wn", "a$$", "id*ot", "(lown", "b00kk5"]:
        runs = [(m.group()[0], len(m.group())) for m in re.finditer(r"(.)\1*", token)]
        options = [[("", X.COST["mask"]), *((x, c) for x, c, _ in decoder.any_letter)] if ch == "*" else X._options(ch, n, False) for ch, n in runs]
        best = max(score("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*options))
        reading = decoder.read(token)
        mine = max(score(reading, sum(c for _, c in path)) for path in itertools.product(*options) if "".join(x for x, _ in path) == reading)
        assert abs(best - mine) < 1e-6, (token, reading)


def test_spread_words(lab):
    """Spread letters beside other single letters, several spread words in a row, and runs of any length."""
    decoder = X.Decoder(X.language_model(read(lab, SF, "documents")))
    for text, want in [("you are a s t u p i d man", {"stupid"}), ("i d i o t i said", {"idiot"}), ("s t u p i d m o r o n", {"stupid", "moron"}), ("s-t-u-p-1-d-i-d-1-0-t", {"stupid", "idiot"})]:
        assert want <= set(decoder.words(text)[0]), text
    words = decoder.words("s t u p i d m o r o n " * 40 + "t r a s h c l o w n " * 2000)[0]
    assert words.count("trash") == words.count("clown") == 2000
    taught = ["idiot", "moron", "stupid", "trash", "scum", "pathetic", "clown"]
    beside = [(w, form) for w in taught for c in "abcdefghijklmnopqrstuvwxyz" for form in (f"{c}{w}", f"{w}{c}")]
    assert sum(w in decoder.words(" ".join(form))[0] for w, form in beside) > 0.9 * len(beside)


def test_letters_beyond_a_to_z(lab):
    """Accents fold, letters of any script are letters, doubled letters and long tokens are decoded."""
    texts = ["quiet cretín and дурак stand here, a cretín and a stupid idiot", "Straße und Süden, ein дурак sagt nichts von idiot oder stupid", "little people will see all the good books"] * 30
    docs = lab.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCUMENTS)
    decoder = X.Decoder(X.language_model(docs))
    for token, word in [("cr3tín", "cretin"), ("CR3TÍN", "cretin"), ("дуррак", "дурак"), ("д-у-р-а-к", "дурак"), ("stuupid", "stupid"), ("iddiot", "idiot"), ("s" * 80 + "tupid", "stupid"), ("st" + ".-" * 60 + "up1d", "stupid"), ("1d" + "i" * 90 + "ot", "idiot")]:
        assert word in decoder.words(f"the {token} man")[0], (token, decoder.words(token))
    assert "cretin" in decoder.words("cretín")[0] and "дурак" in decoder.words("а д у р а к и")[0]
    assert decoder.words("little people will see all the good books")[1] == {}
    long = decoder.words("ab1" * 50_000 + " x")[0]
    assert max(map(len, long)) >= 100_000
    many = X.Decoder(X.language_model(lab.createDataFrame([(1, "".join(map(chr, range(0x4e00, 0x4e00 + 300))) + " cretín idiot " * 30, "en", "a", 1)], DOCUMENTS)))
    assert many.read("cr3tín") == "cretin" and many.read("\u4e01\u4e02") == "\u4e01\u4e02"


def test_large_vocabulary(lab):
    """As many words as labels teach have weight, and none of their beginnings that say nothing more."""
    rng = np.random.default_rng(8)
    bad = ["".join(rng.choice(list("bcdfgklmnprstvz"), 1)[0] + rng.choice(list("aeiou"), 1)[0] for _ in range(4)) + "x" for _ in range(150)]
    rows = [(i, f"quiet words number {i // 26} stand here with line {i}", "en", "a", 1) for i in range(8000)]
    rows += [(10_000 + i, f"quiet {bad[i % 150]} words stand here with line {i}", "en", "a", 1) for i in range(1800)]
    docs = lab.createDataFrame(rows, DOCUMENTS)
    labels = lab.createDataFrame([(r[0], 1, int(r[0] >= 10_000)) for r in rows], "doc_id long, quality int, toxic int")
    weights, bias = X.fit(docs, labels, X.language_model(docs))
    assert sum(w in weights or any(w[:k] + "*" in weights for k in X.STEMS) for w in set(bad)) > 0.95 * len(set(bad))
    assert X.without_empty_stems({"nasty": (9, 8), "nas*": (9, 8), "nast*": (9, 8), "idi*": (12, 9), "idiot": (9, 9)}) == ["idi*", "idiot", "nasty"]
    got = X.logistic(np.array([0, 1, 2, 3]), np.array([0, 0, 1, 1]), np.ones(4), 2, np.array([1, 1, 0, 1.0]))
    assert abs(got[0] - got[1]) > 0.1 and got[0] > got[1]


def test_tokens_of_a_batch_are_looked_at_once(lab):
    """A batch's words and scores are those of its texts one by one, and each different token is looked at once."""
    docs = read(lab, SF, "documents")
    decoder = X.Decoder(X.language_model(docs))
    texts = [r["text"] for r in docs.limit(60).collect()] + ["", "a b", "the s t u p i d man, s.t.u", "ii dd", "x. y. z", "(n o p e", "1d1ot 1d1ot little", "st*pid $$$ -- 'it's'", "a\u2003b\x1cc d"]
    one_by_one = [decoder.words(t) for t in texts]
    seen, look = collections.Counter(), decoder._look
    decoder._look = lambda token: seen.update([token]) or look(token)
    sort = lambda rows: [(sorted(w), r) for w, r in rows]
    assert sort(decoder.words_of(texts * 2)) == sort(one_by_one * 2)
    assert max(seen.values()) == 1 and len(seen) == len({x for t in texts for x in X.fold(t).split()})
    for text, (words, readings) in zip(texts, one_by_one):  # no letters apart are passed over
        apart, others = decoder._apart(X.fold(text))
        assert not collections.Counter(apart) - collections.Counter(words) and others.items() <= readings.items()
    weights = {"the": (0.2, 0.1), "the*": (0.3, -0.2), "stu*": (1.0, 0.5), "stupid": (2.0, 0.1), "idiot": (1.5, 0.0), "thanand": (0.7, 0.2)}
    scores, restored = X.Scorer(weights, -1.0).score(decoder.look(texts))
    for (words, readings), score, kept in zip(one_by_one, scores, restored):
        counts = X.units_of(words)
        z = sum(a + b * X.density(counts[u], len(words)) for u, (a, b) in weights.items() if counts[u]) - 1
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9 and dict(kept) == {t: w for t, w in readings.items() if set(w.split()) & weights.keys()}
    assert X.Scorer({}, 0.5).score(decoder.look(["", "a word"]))[0].tolist() == [1 / (1 + np.exp(-0.5))] * 2


def test_letters_are_counted_by_code_point(lab):
    """As they are in the folded texts, whatever a code point folds to."""
    texts = ["Straße ﬁn ½ ÉÉ e\u0301\u0323 한글 ǅ İi ΣΑΣ x²", "plain ASCII Text", "", "क्षत्रिय ﷺ Ⅷ"]
    docs = lab.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate([*texts, None])], DOCUMENTS)
    counts = collections.Counter(ord(c) for t in texts for c in X.fold(t) if c.isalpha())
    codes, size = X.alphabet(X.documents(docs).select("text"))
    assert codes.keys() == counts.keys() or size == X.LETTERS
    batch = pa.record_batch([pa.array([*texts, None])], names=["text"])
    got = X._letter_counts(batch)
    assert dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist())) == counts
    folded, fold = [], X.fold
    X._letters_of.cache_clear()
    try:
        X.fold = lambda t: folded.append(t) or fold(t)
        X._letter_counts(batch)
    finally:
        X.fold = fold
    assert folded and max(map(len, folded)) == 1


def test_toxicity_cases(lab):
    clean = [(i, f"quiet words number {chr(97 + i % 26)}{chr(97 + i // 26)} stand here", "en", "a", 1) for i in range(200)]
    bad = [(1000 + i, f"quiet nasty words number {chr(97 + i % 26)}{chr(97 + i // 26)} stand here", "en", "a", 1) for i in range(100)]
    odd = [(2000, None, "en", "a", 1), (2001, "", "en", "a", 1), (2002, "n4sty thing", "en", "a", 1), (2003, "n a s t y", "en", "a", 1), (None, "quiet words", "en", "a", 1), (3, clean[3][1], "en", "a", 1), (2004, "x " * 40_000, "en", "a", 1)]
    docs = lab.createDataFrame(clean + bad + odd, DOCUMENTS)
    labels = lab.createDataFrame([(r[0], 1, int(r[0] >= 1000)) for r in clean + bad] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = collections.defaultdict(list)
    for r in X.toxicity(docs, labels).collect():
        got[r["doc_id"]].append(r)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert sum(map(len, got.values())) == len(clean + bad + odd)
    assert all(got[r[0]][0]["predicted"] for r in bad) and not any(got[r[0]][0]["predicted"] for r in clean)
    assert got[2002][0]["predicted"] and got[2003][0]["predicted"] and not got[2000][0]["predicted"] and not got[2004][0]["predicted"]
    assert got[2000][0]["score"] == got[2001][0]["score"]
    assert X.toxicity(docs.limit(0), labels).count() == 0
    assert {r["predicted"] for r in X.toxicity(docs, labels.limit(0)).collect()} <= {0, 1}
