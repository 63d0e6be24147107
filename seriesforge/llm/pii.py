"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels on.

Nodes are the tokens of a text that hold a digit or an at sign. Their labels are the four kinds and "other". A node's
potential comes from its shape, a chain edge joins neighbouring tokens, and skip edges join each token to hubs: one hub a
text for every form that repeats in it, and one for tokens whose digits differ in the same place. A hub has no shape of
its own, so every copy is two edges from any other, however many there are; sum-product message passing over the loopy
graph makes the labels of a text agree. Potentials of shapes and chain edges are fitted on counts of the pattern matches
over the whole corpus (a token that no pattern covers but that is like a covered one counts for nothing there: whether
it is data too is the question); skip edges favour equal labels by a fixed strength. Shapes are hashed into a fixed
number of buckets, so the model's size is fixed too. Tokens that patterns cover are clamped to their kind; tokens that a pattern caught and its check refused have a shape of their own. Other tokens
whose belief in a kind is high enough are added; pattern spans always stay.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm._frames import arrow_map, ddl, documents

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
#: Buckets of hashed shapes; smoothing of counts; log strength of skip edges (two of them, by a hub, join
#: two copies: 0.91 for a copy without evidence of its own); rounds of messages; belief needed.
BUCKETS, SMOOTH, SKIP, ROUNDS, BELIEF = 1 << 14, 0.5, 4.5, 12, 0.9
LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"[0-9.]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
NODES = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: whatever stands before an at sign is one run of its letters, so only at signs are looked at."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    return out


def _addresses(text: str) -> list[tuple[int, int, bool]]:
    """Leftmost runs of four dotted numbers, and whether all are at most 255."""
    out = []
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, parts = run.start(), []
        for part in run.group().split("."):
            parts = [*parts, (at, part)] if part else []
            if len(parts) == 4:
                sound = all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for _, p in parts)
                out.append((parts[0][0], at + len(part), sound))
                parts = []
            at += len(part) + 1
    return out


def patterns(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((kind, start, end) of each match, by kind and start; (start, end) of matches that failed their check)."""
    found, failed = [], []
    if "@" in text:
        found += [(0, s, e) for s, e in _emails(text)]
    for s, e, sound in _addresses(text):
        found.append((1, s, e)) if sound else failed.append((s, e))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            found.append((2, *m.span())) if luhn(digits) else failed.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isascii() and c.isdigit() for c in m.group()) <= 15:
                found.append((3, *m.span()))
            else:
                failed.append(m.span())
    return found, failed


def _covered(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the sorted tokens overlap one of the spans."""
    out = np.zeros(len(starts), bool)
    for s, e in spans:
        out[np.searchsorted(ends, s, side="right"):np.searchsorted(starts, e, side="left")] = True
    return out


RUNS = re.compile(r"[0-9]+|[^\W\d_]+")


def _shape(token: str) -> str:
    return RUNS.sub(lambda m: f"d{min(m.end() - m.start(), 20)}" if m.group()[0].isdigit() else "a", token)[:64]


class Graph:
    """Nodes and edges of the texts of a batch, as one graph."""

    def __init__(self) -> None:
        self.bucket: list[int] = []
        self.label: list[int] = []  # of pattern matches; OTHER elsewhere
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []  # hub, node
        self.place: list[tuple[int, int, int]] = []  # text, start, end
        self.share: list[float] = []  # what a node's shape counts for: copies of a form are one piece of evidence
        self.hubs = 0

    def add(self, number: int, text: str, found, failed) -> None:
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text)] if len(text) < 1 << 16 else list(_long_tokens(text))
        if not tokens:
            return
        starts, ends = (np.array(x) for x in zip(*tokens))
        label = np.full(len(tokens), OTHER)
        for kind in reversed(range(len(KINDS))):
            label[_covered([(s, e) for k, s, e in found if k == kind], starts, ends)] = kind
        refused = _covered(failed, starts, ends)
        base = len(self.label)
        like: dict[str, list[int]] = {}
        copies: Counter = Counter()
        forms = []
        for i, (s, e) in enumerate(tokens):
            word = text[s:e].strip(".,;:!?\"'")
            self.bucket.append(zlib.crc32(f"{int(refused[i])}{_shape(word)}".encode()) % BUCKETS)
            self.place.append((number, s, e))
            if i and s - tokens[i - 1][1] == 1:
                self.chain.append((base + i - 1, base + i))
            forms.append(word.lower() if len(word) >= 4 else "")
            if not forms[-1]:
                continue
            copies[forms[-1]] += int(label[i] == OTHER)
            digits = "".join(c for c in word if c.isdigit())
            keys = [forms[-1]]
            if 6 <= len(digits) <= 24:
                keys += [f"{digits[:j]}?{digits[j + 1:]}" for j in range(len(digits))]
            for k in keys:
                like.setdefault(k, []).append(base + i)
        for nodes in dict.fromkeys(tuple(nodes) for nodes in like.values() if len(nodes) > 1):  # equal sets share a hub
            self.skip += [(self.hubs, i) for i in nodes]
            self.hubs += 1
        self.share += [1 / max(copies[form], 1) for form in forms]
        self.label += label.tolist()


def _long_tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens that hold a digit or an at sign, in one pass whatever their length."""
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        if NODES.search(m.group()):
            yield m.span()


def _graph(texts: list[str | None]) -> tuple[Graph, list]:
    graph, bases = Graph(), []
    for i, text in enumerate(texts):
        found, failed = patterns(text) if text and NODES.search(text) else ([], [])
        bases.append(found)
        if text and NODES.search(text):
            graph.add(i, text, found, failed)
    return graph, bases


def _counts(b: pa.RecordBatch) -> pa.RecordBatch | None:
    """What a batch adds to the counts: shapes by label, and label pairs of chain edges."""
    graph, _ = _graph(b.column(1).to_pylist())
    label = np.array(graph.label, np.int64)
    if not len(label):
        return None
    wide = OTHER + 1
    sure = np.ones(len(label), bool)
    if graph.skip:
        hub, node = np.array(graph.skip).T
        known = np.zeros(graph.hubs, bool)
        known[hub[label[node] != OTHER]] = True
        sure[node[known[hub] & (label[node] == OTHER)]] = False
    keys = [(np.array(graph.bucket) * wide + label)[sure]]
    if graph.chain:
        e = np.array(graph.chain)
        e = e[sure[e].all(1)]
        keys.append(BUCKETS * wide + label[e[:, 0]] * wide + label[e[:, 1]])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return pa.record_batch([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Log potentials of shapes, and of chain and skip edges, from counts over all texts: at most BUCKETS x 5 + 25 rows."""
    wide = OTHER + 1
    counts = np.zeros(BUCKETS * wide + wide * wide)
    for row in arrow_map(documents(docs), _counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        counts[row["key"]] = row["n"]
    node, edges = counts[:BUCKETS * wide].reshape(BUCKETS, wide), counts[BUCKETS * wide:].reshape(wide, wide)
    prior = node.sum(0) + SMOOTH
    node = np.log(node + SMOOTH * prior / prior.sum()) - np.log(node.sum(1, keepdims=True) + SMOOTH)
    pair = edges + edges.T + SMOOTH  # both ways
    share = pair / pair.sum()
    own = np.log(share.sum(1))
    # how much likelier a pair of labels is than by chance
    return {"node": node, "edge": np.stack([np.log(share) - own[:, None] - own[None, :], SKIP * np.eye(wide)])}


def beliefs(node: np.ndarray, edges: np.ndarray, kind: np.ndarray, potential: np.ndarray, clamped: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Marginals by loopy sum-product. node: log potentials; edges: pairs of nodes with the number of their potential;
    clamped: label or -1."""
    node = node.copy()
    fixed = np.flatnonzero(clamped >= 0)
    node[fixed] = -50
    node[fixed, clamped[fixed]] = 0
    if len(edges):
        src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        table = potential[np.concatenate((kind, kind))]
        sent = np.zeros((len(src), node.shape[1]))
        for _ in range(rounds):
            total = node.copy()
            np.add.at(total, dst, sent)
            out = (total[src] - sent[back])[:, :, None] + table
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            sent = 0.5 * sent + 0.5 * (new - new.max(1, keepdims=True))
        np.add.at(node, dst, sent)
    node = np.exp(node - node.max(1, keepdims=True))
    return node / node.sum(1, keepdims=True)


def added_spans(graph: Graph, texts: list[str | None], model: dict[str, np.ndarray], belief: float = BELIEF) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the field adds to the patterns'."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not graph.label:
        return out
    label = np.array(graph.label)
    edges = np.array(graph.chain + [(len(label) + hub, i) for hub, i in graph.skip], np.int64).reshape(-1, 2)
    kind = np.concatenate((np.zeros(len(graph.chain), int), np.ones(len(graph.skip), int)))
    node = np.vstack((model["node"][np.array(graph.bucket)] * np.array(graph.share)[:, None], np.zeros((graph.hubs, OTHER + 1))))
    clamped = np.concatenate((np.where(label == OTHER, -1, label), np.full(graph.hubs, -1)))
    p = beliefs(node, edges, kind, model["edge"], clamped)[:len(label)]
    best = p.argmax(1)
    sure = (label == OTHER) & (best != OTHER) & (p.max(1) >= belief)
    last = None
    for i in np.flatnonzero(sure).tolist():
        n, s, e = graph.place[i]
        word = texts[n][s:e]
        s, e = s + len(word) - len(word.lstrip(".,;:!?\"'")), e - len(word) + len(word.rstrip(".,;:!?\"'"))
        if last == (i - 1, int(best[i])) and out[n] and s - out[n][-1][2] == 1:
            out[n][-1] = (out[n][-1][0], out[n][-1][1], e)
        else:
            out[n].append((int(best[i]), s, e))
        last = (i, int(best[i]))
    return [[x for x in spans if sum(c.isdigit() for c in texts[n][x[1]:x[2]]) >= 4 or "@" in texts[n][x[1]:x[2]]] for n, spans in enumerate(out)]


def redacted(text: str | None, spans: list[dict]) -> str | None:
    """``text`` with each span replaced by its kind's name in angle brackets; of spans that overlap, one stands for all."""
    if not text or not spans:
        return text
    out, last = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], -x["end"])):
        if s["start"] >= last:
            out += [text[last:s["start"]], f"<{s['kind']}>"]
        last = max(last, s["end"])
    return "".join(out) + text[last:]


def _found(docs: DataFrame, belief: float):
    """texts -> the spans of each, as dicts."""
    model = fit(docs)

    def run(texts: list[str | None]) -> list[list[dict]]:
        graph, bases = _graph(texts)
        rows = []
        for base, more in zip(bases, added_spans(graph, texts, model, belief)):
            all_ = sorted([(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in more])
            rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in all_])
        return rows
    return run


def pii_spans(docs: DataFrame, belief: float = BELIEF) -> DataFrame:
    """doc_id and spans (array of kind, start, end, base; code points, end exclusive; by kind as listed, then start) for
    every row of ``docs``. ``base``: found by a pattern; the others are the field's.

    Null and empty texts have no spans. Repeated rows and null doc_ids stay and get equal spans. An empty table gives no
    rows.
    """
    found = _found(docs, belief)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        return pa.record_batch([b.column(0), pa.array(found(b.column(1).to_pylist()), kind)], names=["doc_id", "spans"])
    return arrow_map(documents(docs), batch, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame, keep: tuple[str, ...] = (), belief: float = BELIEF) -> DataFrame:
    """doc_id, text without personal data, and the columns of ``keep``. Null texts stay null."""
    found = _found(docs, belief)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).to_pylist()
        clean = [redacted(t, s) for t, s in zip(texts, found(texts))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(clean, pa.string()), *b.columns[2:]], names=["doc_id", "text", *keep])
    return arrow_map(documents(docs, keep), batch, "doc_id long, text string" + ddl(docs, keep))
