"""Queries that SQL can't express, held against plain Python, one row at a time, over the whole smallest tables."""

import hashlib
import json
import math
import os
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from strandloom.operators import chunking as C
from strandloom.plans import chunks, graphs, logs, lookups, selection, streams


def rows(sf_dir, name, *columns):
    return pq.read_table(os.path.join(sf_dir, f"{name}.parquet"), columns=list(columns)).to_pylist()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def limited(events, limit=5, seconds=6 * 3600):
    by = defaultdict(list)
    for e in events:
        by[e["user_id"]].append((e["ts"], e["event_id"]))
    out = []
    for user, calls in by.items():
        taken = []
        for t, i in sorted(calls):
            ok = sum((t - x).total_seconds() < seconds for x in taken) < limit
            taken += [t] if ok else []
            out.append((user, i, ok))
    return sorted(out, key=repr)


def test_rate_limit(spark, sf_dir):
    want = limited(rows(sf_dir, "events", "user_id", "ts", "event_id"))
    assert got(logs.rate_limit(spark, sf_dir)) == want and got(streams.stream_rate_limit(spark, sf_dir)) == want
    assert 0 < sum(not ok for *_, ok in want) < len(want) or len(want) < 5_000


def test_merkle_root(spark, sf_dir):
    by = defaultdict(list)
    for e in sorted(rows(sf_dir, "events", "user_id", "event_id", "event_type"), key=lambda e: e["event_id"]):
        by[e["user_id"]].append(sha(e["event_type"]))
    for user, level in by.items():
        while len(level) > 1:
            level = [sha(a + b) for a, b in zip(level[::2], level[1::2] + level[-1:])]
        by[user] = level[0]
    assert dict(graphs.merkle_root(spark, sf_dir).collect()) == dict(by)


@pytest.mark.parametrize("query, cut, limit", [("chunk_paragraphs", C.chunk_text, 500), ("chunk_windows", C.chunk_recursive, 800), ("chunk_code", C.chunk_code, 2000)])
def test_chunks_hold_every_word(spark, sf_dir, query, cut, limit):
    """No word of a text is lost, none is made up, and each chunk is within the limit (windows: with the overlap before)."""
    docs = {r["doc_id"]: r["text"] for r in rows(sf_dir, "documents", "doc_id", "text", "doc_type") if query != "chunk_code" or r["doc_type"] == "code_comment"}
    found = defaultdict(list)
    for r in getattr(chunks, query)(spark, sf_dir).collect():
        found[r.doc_id].append((r.chunk_index, r.start, r.chunk))
    squeezed = lambda t: re.sub(r"\s", "", t)
    for i, text in docs.items():
        parts = cut(text) if text and text.strip() else []
        assert [(n, d) for n, _, d in sorted(found.pop(i, []))] == [(n, sha(p)) for n, p in enumerate(parts)]
        assert all(len(p) <= (limit if query != "chunk_windows" else 2 * limit) for p in parts)
        if query == "chunk_windows":
            bare = lambda t: {w.rstrip(".") for w in t.split()}  # noqa: E731 - windows are cut at ". ", which goes
            assert bare(" ".join(parts)) >= {w for w in bare(text or "") if len(w) < 50}
        else:
            assert squeezed("".join(parts)) == squeezed(text or "")
    assert not found


def test_chunk_json(spark, sf_dir):
    texts = {r["ingest_id"]: r["payload_json"] for r in rows(sf_dir, "workflow_events", "ingest_id", "payload_json")}
    n = Counter(r.ingest_id for r in chunks.chunk_json(spark, sf_dir).collect())
    assert set(n) == {i for i, t in texts.items() if t and t.strip()}
    big = {f"k{i}": "x" * 300 for i in range(40)}
    parts = [json.loads(p) for p in C.chunk_json(json.dumps(big))]
    assert {k: v for p in parts for k, v in p.items()} == big and len(parts) > 5 and all(len(json.dumps(p)) <= 2000 for p in parts)
    assert [x for p in C.chunk_json(json.dumps(list(range(2000)))) for x in json.loads(p)] == list(range(2000))


def test_chunk_spans(spark, sf_dir):
    want = []
    for r in rows(sf_dir, "documents", "doc_id", "text"):
        raw = (r["text"] or "").encode()
        half = len(raw) // 2
        for s, e in ((0, half), (half, len(raw))) if r["text"] is not None else ():
            if (c := raw[s:e].decode("utf-8", "replace")).strip():
                want.append((r["doc_id"], s, sha(c)))
    assert got(chunks.chunk_spans(spark, sf_dir).select("doc_id", "start", "chunk")) == sorted(want, key=repr)


def plain_mmr(parts, near):
    bags = [Counter(re.findall("[a-z0-9_]+", p.lower())) for p in parts]
    bags.append(sum(bags, Counter()))
    norm = lambda b: math.sqrt(sum(x * x for x in b.values()))
    cos = lambda a, b: sum(n * b[w] for w, n in a.items()) / (norm(a) * norm(b)) if a and b else 0.0
    taken = []
    while len(taken) < min(max(1, int(0.3 * len(parts))), len(parts)):
        best = None
        for i in range(len(parts)):
            if i not in taken:
                seen = [cos(bags[i], bags[j]) if near is None or abs(i - j) <= near else 0.5 for j in taken]
                value = 0.5 * cos(bags[i], bags[-1]) - 0.5 * ((max if near is None else min)(seen) if seen else 0.0)
                if best is None or value > best[0] + 1e-12:
                    best = (value, i)
        taken.append(best[1])
    return sorted(taken)


@pytest.mark.parametrize("near", [None, 10])
def test_mmr(spark, sf_dir, near):
    texts = {r["doc_id"]: r["text"] for r in rows(sf_dir, "documents", "doc_id", "text")}
    query = chunks.mmr_extract if near is None else chunks.mmr_near
    found = {r.doc_id: (r.n_sentences, r.summary) for r in query(spark, sf_dir).collect()}
    for i, t in texts.items():
        parts = [s for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()] if t else []
        if len(parts) < 60:  # the plain version is slow
            assert found[i] == (len(parts), sha(" ".join(parts[k] for k in plain_mmr(parts, near)) if parts else ""))
    long = [f"Sentence {k} says w{k % 7} and v{k % 11}." for k in range(500)]
    kept = C.mmr(long, near=near)
    assert len(kept) == 150 and len(set(kept)) == 150 and len(C.mmr(long, pool=200, near=near)) == 60


def test_kv_compact(spark, sf_dir):
    texts = {r["ingest_id"]: r["payload_json"] for r in rows(sf_dir, "workflow_events", "ingest_id", "payload_json")}
    for r in chunks.kv_compact(spark, sf_dir).collect():
        try:
            value = json.loads(texts[r.ingest_id])
        except (TypeError, ValueError):
            value = None
        if not isinstance(value, dict) or not value:
            assert r.compacted == texts[r.ingest_id]
            continue
        kept = json.loads(r.compacted)
        assert len(kept) == max(1, len(value) // 2) and all(value[k] == v for k, v in kept.items()) and list(kept) == [k for k in value if k in kept]
        named = sum(any(h in k.lower() for h in ("id", "name", "type", "status", "error", "path")) for k in value)
        assert sum(any(h in k.lower() for h in ("id", "name", "type", "status", "error", "path")) for k in kept) == min(named, len(kept))


def test_budget_skip(spark, sf_dir):
    by = defaultdict(list)
    for r in rows(sf_dir, "documents", "doc_id", "text", "source"):
        if r["source"] is not None:
            by[r["source"]].append((len((r["text"] or "").encode()) // 4 + 1, r["doc_id"]))
    want = []
    for source, items in by.items():
        left = 4000
        for n, i in sorted(items):
            want.append((source, i, n <= left))
            left -= n if n <= left else 0
    assert got(chunks.budget_skip(spark, sf_dir)) == sorted(want, key=repr)
    mixed = spark.createDataFrame([("a", k, n) for k, n in enumerate([5, 9, 3, 4, 1])], "g string, k int, n int")
    assert [r.taken for r in C.packed_budget(mixed, "g", "k", ["k"], "n", 10).orderBy("k").collect()] == [True, False, True, False, True]
    assert [r.taken for r in C.packed_budget(mixed, "g", "k", ["k"], "n", 10, stop=True).orderBy("k").collect()] == [True, False, False, False, False]


def test_sliding_dedup(spark, sf_dir):
    by = defaultdict(list)
    for r in sorted(rows(sf_dir, "embeddings", "vec_id", "label", "embedding"), key=lambda r: r["vec_id"]):
        by[r["label"]].append((r["vec_id"], r["embedding"]))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = []
    for label, vectors in by.items():
        kept = []
        for i, v in vectors:
            ok = not any(cos(v, u) > 0.2 for u in kept[-20:])
            kept += [v] if ok else []
            want.append((label, i, ok))
    assert got(chunks.sliding_dedup(spark, sf_dir)) == sorted(want, key=repr)
    added = []
    for label, vectors in by.items():
        kept, seen = [], set()
        for i, v in vectors:
            copy, ok = i // 3 in seen, not any(cos(v, u) > 0.2 for u in kept[-20:])
            seen.add(i // 3)
            kept += [v] if ok and not copy else []
            added.append((label, i, "copy" if copy else "added" if ok else "near"))
    assert got(lookups.check_and_add(spark, sf_dir)) == sorted(added, key=repr) and len({x[2] for x in added}) == 3


def test_snippet_pack(spark, sf_dir):
    by = defaultdict(list)
    for r in sorted(rows(sf_dir, "documents", "doc_id", "text", "source"), key=lambda r: r["doc_id"]):
        if r["source"] is not None:
            by[r["source"]].append((r["doc_id"], r["text"] or ""))
    want = []
    size = lambda t: len(t.encode()) // 4 + 1
    for source, items in by.items():
        left, seen = 2000, set()
        for i, t in items:
            if " ".join(t.split()) in seen:
                continue
            seen.add(" ".join(t.split()))
            if size(t) > left:
                lines = t.split("\n")
                n = max((k for k in range(1, len(lines) + 1) if size("\n".join(lines[:k])) <= left), default=0)
                want += [(source, i, sha("\n".join(lines[:n])))] if n and "\n".join(lines[:n]) else []
                break
            left -= size(t)
            want.append((source, i, sha(t)))
    assert got(selection.snippet_pack(spark, sf_dir)) == sorted(want, key=repr)
