"""Quality, WARC and PII against plain Python."""
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from seriesforge.llm import pii as P, quality as Q, warc as W

from .conftest import DOCUMENTS, key

# ---- quality


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(zip(words, words[1:], words[2:]))
    rep = [any(0 <= j <= len(words) - 3 and tri[tuple(words[j:j + 3])] > 1 for j in range(i - 2, i + 1)) for i in range(len(words))]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), sum(rep),
            len(words) < 50 or 100 * sum(rep) > 50 * len(words))


def prose(rng, n, symbols=0.0):
    return "\n".join(" ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 8))) + ("###" if rng.random() < symbols else "") for _ in range(10)) for _ in range(n // 10))


def test_quality(lab):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        text = prose(rng, rng.choice([20, 60, 200]), 0.5 if i % 9 == 0 else 0.0)
        rows.append((i, text, ["en", "de", None][i % 3], ["hot", "hot", "hot", f"s{i}", None][i % 5], 1))
    rows += [(500, None, "en", "hot", 0), (501, "", None, None, 0), (502, "same line here\n" * 80, "en", "hot", 0), (None, rows[1][1], "xx", "new", 0), (1, rows[1][1], "en", "hot", 0), (503, "w" * 90_000 + " x" * 60, "en", "hot", 0)]
    got = Q.quality_rules(lab.createDataFrame(rows, DOCUMENTS), group=20).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r["doc_id"], *(r[n] for n in names)) for r in got), key=key) == sorted(((r[0], *counts(r[1])) for r in rows), key=key)
    for r in got:
        if r["base_failed"]:
            assert not r["kept"]
        elif r["doc_id"] is not None and r["doc_id"] < 400:
            assert r["kept"] == (r["doc_id"] % 9 != 0), r
    assert not next(r["kept"] for r in got if r["doc_id"] == 503)  # one endless word


def test_fences_follow_the_group(lab):
    """Where most texts of a source have symbols, symbols don't tell."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 100, 0.6 if i % 2 else 0.0), "en", "shop" if i % 2 else "news", 1) for i in range(200)]
    rows += [(1000, prose(rng, 100, 0.6), "en", "news", 1)]
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_rules(lab.createDataFrame(rows, DOCUMENTS), group=20).collect()}
    assert all(kept[i] for i in range(200)) and not kept[1000]


def test_fences_of_rates(lab):
    """Where a group has no signs and repeats no lines, few are enough; where its texts often do, they are not."""
    rng = random.Random(4)

    def signs(text, n):
        return text.replace(" ", " # ", n)
    rows = [(i, prose(rng, 200), "en", "news", 1) for i in range(60)]
    rows += [(100 + i, signs(prose(rng, 200), i % 12), "en", "shop", 1) for i in range(60)]
    rows += [(200 + k, signs(prose(rng, 200), 12), "en", s, 1) for k, s in enumerate(("news", "shop"))]
    for k, n in ((300, 1), (301, 5)):  # of 20 lines
        text = prose(rng, 10 * (20 - n))
        rows.append((k, "\n".join([text, *text.split("\n")[:n]]), "en", "news", 1))
    kept = {r["doc_id"]: r["kept"] for r in Q.quality_rules(lab.createDataFrame(rows, DOCUMENTS), group=20, max_repeat=0.9).collect()}
    assert all(kept[i] for i in range(60)) and all(kept[100 + i] for i in range(60))
    assert not kept[200] and kept[201] and kept[300] and not kept[301]


def test_kept_by_exact_quantiles(lab):
    """``kept`` of groups that their sketches hold whole, against sorted lists; a repeated line or a sign in a short text is
    no reason, the same rate in a long one may be."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        lines = [x.replace(" ", " # ", rng.choice([0, 0, 0, 1, 3])) for x in prose(rng, rng.choice([60, 100, 400])).split("\n")]
        again = rng.choice([0, 0, 0, 1, 2, len(lines) // 4])
        rows.append((i, "\n".join(lines + lines[:again]), "en", f"s{i % 2}", 1))
    rows += [(1000 + k, "\n".join(x := prose(rng, 60).split("\n")) + "\n" + x[0], "en", f"s{k}", 1) for k in range(2)]
    rows += [(2000 + k, "\n".join((x := prose(rng, 4000).split("\n")) + x[:200]), "en", f"s{k}", 1) for k in range(2)]
    got = {r["doc_id"]: r["kept"] for r in Q.quality_rules(lab.createDataFrame(rows, DOCUMENTS), group=20).collect()}
    want = {}
    for source in ("s0", "s1"):
        of = {i: (*counts(t), len([x for x in t.split("\n") if x])) for i, t, _, s, _ in rows if s == source}
        sound = [c for c in of.values() if not c[5]]

        def at(values, rank):
            return sorted(values)[max(0, int(np.ceil(rank * len(sound))) - 1)]
        reasons = dict.fromkeys(of, False)
        for n, size in ((2, 0), (3, 6)):
            rates, typical = [c[n] / c[size] for c in sound], at([c[size] for c in sound], 0.5)
            high = (mid := at(rates, 0.5)) + 6 * max(mid - at(rates, 0.1), at(rates, 0.6) - mid)
            for i, c in of.items():
                reasons[i] |= c[n] > high * c[size] + max(1, c[size] / typical)
        long = [c[1] / c[0] for c in sound]
        width = 6 * (at(long, 0.5) - at(long, 0.1)) + 1.5
        want |= {i: not c[5] and not reasons[i] and abs(c[1] / c[0] - at(long, 0.5)) <= width for i, c in of.items()}
    assert got == want and 0.5 < sum(want.values()) / len(want) < 1
    assert got[1000] and got[1001] and not got[2000] and not got[2001]


def test_quality_empty(lab):
    assert Q.quality_rules(lab.createDataFrame([], DOCUMENTS)).count() == 0
    assert Q.quality_rules(lab.createDataFrame([(1, "too short", None, None, 1)], DOCUMENTS)).first()["kept"] is False


# ---- WARC

PAGES = [(1, "http://a/WARC/1.1", "x" * 300 + "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1" * 50), (2, None, None), (3, "u", "x" * 300 + "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\nWARC/1.1" * 50),
         (4, "http://é x\r\n", "é€😀" * 4000), (5, "", "short"), (6, "", "short"), (None, "", "é€😀" * 4000), (None, "z", "y" * 200), (4, "", "é€😀" * 4000), (4, "", "é€😀" * 4000),
         (7, "q", "\r\n\r\n" * 100), (8, "q", "0\r\n\r\n" * 100), (9, "q", "WARC/1.1"), (10, "q", "long " * 60_000)]


def page_rows(pages, least=100):
    first, many = {}, collections.Counter((h or "") for _, _, h in pages)
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        data, one = (h or "").encode(), first.get(h or "")
        revisit = len(data) >= least and many[h or ""] > 1 and one is not None and one != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", one if revisit else None, None))
    return sorted(out, key=key)


@pytest.mark.parametrize("segment", [64, 777, 32_768])
def test_warc(lab, segment):
    df = lab.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, digest int")
    assert sorted(map(tuple, W.archive_round_trip(df, segment=segment).collect()), key=key) == page_rows(PAGES)


def test_warc_empty(lab):
    assert W.archive_round_trip(lab.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chunks():
    rng = random.Random(3)
    for _ in range(200):
        data = "".join(rng.choice(["WARC/1.1\r\n", "é", "x", "\r\n", "WARC/"]) for _ in range(rng.randint(0, 40))).encode()
        body = W.chunked(data, rng.randint(1, 30))
        assert W.dechunked(body) == data and W.VERSION + b"\r\n" not in body
    for broken in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc"):
        with pytest.raises(ValueError):
            W.dechunked(broken)


def test_missing_segment(lab, scratch):
    """A record whose segments don't add up is told, not read as if it were whole."""
    lines = W.records("1", "0", "u", b"abc" * 100, "d" * 64, None, 64)
    for name, keep in (("gap", lines[:2] + lines[3:]), ("no end", lines[:-1]), ("twice", lines + lines[1:2])):
        path = f"{scratch}/{name}"
        lab.createDataFrame([(x.decode(),) for x in keep], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
        rows = W.read_warc(lab, path).collect()
        assert len(rows) == 1 and rows[0]["error"] and rows[0]["payload"] is None


def test_broken_records_are_rows(lab, scratch):
    """Each broken record is a row with an error; the others are read as ever."""
    def sound(k):
        return W.records(str(k), "0", "u", b"%d abc" % k, hashlib.sha256(b"%d abc" % k).hexdigest(), None)[0].decode()
    good = [sound(k) for k in range(4)]
    segments = [x.decode() for x in W.records("9", "0", "u", b"abc" * 100, "d" * 64, None, 64)]
    broken = {
        "too long": sound(10).replace("Content-Length: ", "Content-Length: 1"), "too short": sound(11) + "more", "no length": re.sub("Content-Length: [0-9]+\r\n", "", sound(12)),
        "odd length": re.sub("Content-Length: [0-9]+", "Content-Length: ten", sound(13)), "a line without a name": sound(14).replace("WARC-Date: ", "WARC-Date"[:4] + " "),
        "no id": re.sub("WARC-Record-ID: [^\r]+\r\n", "", sound(15)), "no type": sound(16).replace("WARC-Type: response\r\n", ""), "odd number": sound(17).replace("WARC-Type", "WARC-Segment-Number: x\r\nWARC-Type"),
        "no header": "WARC/1.1\r\n\r\n\r\n", "other version": sound(18).replace("WARC/1.1\r\n", "WARC/1.1\r\nodd\r\n")}
    path = f"{scratch}/broken"
    lines = [good[0], *broken.values(), *good[1:], segments[0], segments[1].replace("Content-Length: ", "Content-Length: 9"), *segments[2:]]
    lab.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    rows = W.read_warc(lab, path).collect()
    assert sorted(r["payload"] for r in rows if r["error"] is None) == [b"%d abc" % k for k in range(4)]
    assert len([r for r in rows if r["error"]]) == len(broken) + 1 and all(r["payload"] is None for r in rows if r["error"])
    assert {r["record_id"] for r in rows if r["error"]} >= {None, "<urn:page:9.dddddddddddddddd/0>"}


# ---- PII

PATTERNS = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def matches(text):
    out = []
    for k, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            twice = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))]
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 16 <= len(digits) <= 19 and sum(twice) % 10 == 0, "phone": lambda: 8 <= len(digits) <= 15}[name]():
                out.append((k, *m.span()))
    return out


def test_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("00112259.@+- ()ab%.-. é٣²") for _ in range(rng.randint(0, 50)))
        assert P.patterns(text)[0] == matches(text), text
    assert P.patterns("1" * 200_000 + "." + "a" * 200_000 + "@")[0] == []


def pii_rows():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        phone = f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
        text = f"call {phone} or mail a.{i}@mail{i % 7}.example.com now, from {rng.randint(1, 255)}.{rng.randint(1, 255)}.3.4 or so"
        if i % 10 == 0:
            text += f" again: {phone[3:]} it is"
        rows.append((i, text))
    return rows + [(200, None), (201, ""), (202, "no data"), (None, rows[3][1]), (4, rows[4][1]), (203, "7" * 50_000), (204, "room 12 of 300")]


def test_pii(make_docs):
    rows = pii_rows()
    got = P.pii_spans(make_docs(rows)).collect()
    assert sorted(((r["doc_id"], [(P.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["spans"] if s["base"]]) for r in got), key=lambda x: (x[0] is None, x[0] or 0)) == \
        sorted(((d, matches(t or "")) for d, t in rows), key=lambda x: (x[0] is None, x[0] or 0))
    texts = dict(rows)
    added = {r["doc_id"]: [texts[r["doc_id"]][s["start"]:s["end"]] for s in r["spans"] if not s["base"]] for r in got if any(not s["base"] for s in r["spans"])}
    assert set(added) == set(range(0, 120, 10))  # the number that comes again without its country code
    assert all(a[0].endswith(texts[d].split(" 555-")[-1].split()[0]) for d, a in added.items())
    assert P.pii_spans(make_docs(rows).limit(0)).count() == 0


def test_pii_many_copies(make_docs):
    """A number that a pattern catches once is found wherever it comes again, however often."""
    bare = ["555-0199" if k % 2 else "555-0199," for k in range(50)]
    text = "call +1 (222) 555-0199 now " + " then some words and ".join(bare) + " and no more of 12 things"
    rows = pii_rows() + [(300, text)]
    got = {r["doc_id"]: r["spans"] for r in P.pii_spans(make_docs(rows)).collect()}[300]
    assert [text[s["start"]:s["end"]] for s in got if not s["base"]] == ["555-0199"] * 50 and {s["kind"] for s in got} == {"phone"}
    # bare copies whose shape nothing else in the corpus shows
    rare = "mail +44-20-7946-0958-1 here " + "and 44-20-7946-0958-1 there " * 50
    got = P.pii_spans(make_docs([(1, rare), (2, "5 of 9 rooms")])).collect()
    assert [sum(not s["base"] for s in r["spans"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [50, 0]


def test_redact(make_docs):
    rows = pii_rows()
    got = {r["row"]: r for r in P.redact(make_docs(rows), keep=("lang", "row", "score")).collect()}
    assert len(got) == len(rows)
    for i, (_, text) in enumerate(rows):
        assert (got[i]["text"] is None) == (text is None)
        assert not matches(got[i]["text"] or "")


def test_beliefs_agree():
    """Two like tokens, one of them known: the other follows; without the edge it doesn't."""
    node = np.log(np.array([[0.5, 0.5], [0.4, 0.6]]))
    potential = np.array([[[2.0, -2.0], [-2.0, 2.0]]])
    edge, none = np.array([[0, 1]]), np.zeros((0, 2), np.int64)
    known = np.array([0, -1])
    p = P.beliefs(node, edge, np.zeros(1, int), potential, known, rounds=30)
    exact = 0.4 * np.exp(2) / (0.4 * np.exp(2) + 0.6 * np.exp(-2))
    assert abs(p[1, 0] - exact) < 1e-6 and P.beliefs(node, none, np.zeros(0, int), potential, known)[1, 0] < 0.5
