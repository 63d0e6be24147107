"""The registered corpus queries over the given tables: DuckDB twins, contract columns, and the pipeline."""
import collections
import hashlib
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest

from seriesforge.llm import pii as P
from seriesforge.llm._frames import read
from seriesforge.llm.queries import ORACLE, QUERIES
from tools_check import digest, norm

from .test_dedup import brute_words, shingle_print
from .test_rules import matches

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(lab, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](lab, SF).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and digest(norm(got)) == digest(norm(want))


COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op3_substring": "doc_id n_words n_removed kept_sha256", "op4_toxicity": "doc_id held_out score predicted",
    "op5_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_warc": "page_id payload_bytes payload_digest record_type refers_to", "op7_vectors": "vec_id n_links component_id kept",
    "op8_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op9_suffix": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op12_periodic": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(lab, name):
    out = QUERIES[name](lab, SF)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    table = {"op6_warc": "pages", "op7_vectors": "embeddings"}.get(name, "documents")
    key = COLUMNS[name].split()[0]
    assert out.select(key).distinct().count() == read(lab, SF, table).count()


def test_pii_digest(lab):
    texts = {r["doc_id"]: r["text"] or "" for r in read(lab, SF, "documents").collect()}
    for r in QUERIES["op10_pii"](lab, SF).collect():
        base = [f"{P.KINDS[k]}:{s}:{e}" for k, s, e in matches(texts[r["doc_id"]])]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]
        assert set(base) <= set(r["spans"].split(",")) and [r[f"n_{k}"] for k in P.KINDS] == [sum(x.startswith(k) for x in base) for k in P.KINDS]


def test_pipeline(lab):
    """Each stage against brute force on what the stage before kept; the last row for row as run() gives it."""
    docs = read(lab, SF, "documents")
    seen, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        from seriesforge.llm._frames import staged
        seen.append(staged(stage(lab, seen[-1], SF)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring", "pii", "packing"]
    start, safe, single, cut, clean = ({r["doc_id"]: r for r in d.collect()} for d in seen[:5])
    assert all(d.columns == columns and d.schema == docs.schema for d in seen[:5])

    toxic = {r["doc_id"]: r["predicted"] for r in QUERIES["op4_toxicity"](lab, SF).collect()}
    assert {i: r for i, r in start.items() if not toxic[i]} == safe

    prints = {i: shingle_print(r["text"]) for i, r in safe.items()}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: safe[i] for i in ids if find(i) == i} == single

    for i, kept, _, gone in brute_words([(i, r["text"]) for i, r in single.items()], 35):
        assert cut[i]["text"] == (kept if gone else single[i]["text"]) and cut[i]["n_chars"] == len(cut[i]["text"])

    for i, r in cut.items():
        spans = sorted((s, e, k) for k, s, e in matches(r["text"]))
        text, last = "", 0
        for s, e, k in spans:
            if s >= last:
                text += r["text"][last:s] + f"<{P.KINDS[k]}>"
            last = max(last, e)
        text += r["text"][last:]
        if clean[i]["text"] != text:  # what the field added is gone too
            assert len(re.findall(r"<(?:email|ip|card|phone)>", clean[i]["text"])) > len(spans)

    from seriesforge.llm.packing import Library
    from seriesforge.llm.queries import VOCABULARY
    own, pieces = Library(VOCABULARY), collections.defaultdict(list)
    for r in seen[5].collect():
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert pieces.keys() == clean.keys()
    for i, r in clean.items():
        ids_ = np.append(np.frombuffer(own.encode([r["text"].encode()])[0], "<u4"), np.uint32(1))
        assert sorted(pieces[i]) == [(n // 4096, n, len(ids_[n:n + 4096]), zlib.crc32(ids_[n:n + 4096].tobytes())) for n in range(0, len(ids_), 4096)]
    whole = corpus_pipeline.run(lab, SF).select("doc_id", "piece", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((i, p[0], p[3]) for i, ps in pieces.items() for p in ps)
