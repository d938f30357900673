"""Queries do the whole job: held against plain Python over all rows of the tables, not against the queries' SQL."""

import math
import re
from collections import Counter, defaultdict

import duckdb
from pyspark.sql import functions as F

from strandloom.operators import governance, graphs as G, retrieval as R
from strandloom.plans import findings, graphs, retrieval


def edges_of(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW file_dependencies AS SELECT * FROM read_parquet('{sf_dir}/file_dependencies.parquet')")
    out = defaultdict(set)
    for src, dst in con.execute(f"WITH {graphs._FILES} SELECT src, dst FROM files").fetchall():
        out[src].add(dst)
    return out


def steps(out, root, depth=10**9, blocked=frozenset()):
    """Least steps to each node; nodes in blocked are reached, but not passed."""
    seen, frontier, n = {}, [root], 0
    while frontier and n < depth:
        n, new = n + 1, []
        for a in frontier:
            for b in () if a in blocked else out.get(a, ()):
                if b not in seen:
                    seen[b] = n
                    new.append(b)
        frontier = new
    return seen


def test_hops_from_every_source(spark, sf_dir):
    out = edges_of(sf_dir)
    want = {(r, b, n) for r in out for b, n in steps(out, r).items()}
    got = [tuple(r) for r in graphs.hops(spark, sf_dir).select("root", "node", "hops").collect()]
    assert len(got) == len(want) and set(got) == want and len({r for r, _, _ in got}) == len(out) > 3


def test_call_paths_from_every_source(spark, sf_dir):
    out = edges_of(sf_dir)
    want = {(r, b): n for r in out for b, n in steps(out, r).items() if b != r}
    got = {(r.root, r.node): r.path.split(" > ") for r in graphs.call_paths(spark, sf_dir).collect()}
    assert {k: len(p) - 1 for k, p in got.items()} == want
    assert all(p[0] == r and p[-1] == b and all(y in out[x] for x, y in zip(p, p[1:])) for (r, b), p in got.items())


def test_taint_from_every_source(spark, sf_dir):
    assert {r.root for r in graphs.taint(spark, sf_dir).select("root").distinct().collect()} == {r for r in edges_of(sf_dir) if not r.endswith(".h")}


def test_taint_goes_as_far_as_it_flows(spark, sf_dir):
    out = edges_of(sf_dir)
    want = {(r, b, n) for r in out for b, n in steps(out, r, blocked={x for x in out if x.endswith(".h")}).items()}
    assert max(n for _, _, n in want) > 6 and {tuple(r) for r in graphs.taint(spark, sf_dir).select("root", "node", "hops").collect()} == want


def test_scopes_from_near_to_far(spark):
    defs = spark.createDataFrame([(1, "a", 1, 1, 1), (2, "b", 2, 1, 1), (3, "b", 2, 1, 1), (4, "c", 9, 9, 1), (5, "d", 9, 9, 9), (6, "a", 2, 1, 1), (7, None, 1, 1, 1)], "def_id long, name string, file long, module long, crate long")
    uses = spark.createDataFrame([(i, n, 1, 1, 1) for i, n in enumerate("abcde")] + [(5, None, 1, 1, 1), (6, "c", None, None, 1)], "use_id long, name string, file long, module long, crate long")
    got = G.resolved(uses, defs, "name", [*((s, s, s) for s in ("file", "module", "crate")), ("workspace", None, None)])
    assert sorted(map(tuple, got.collect())) == [(0, 1, "file", 1.0), (1, 2, "module", 0.5), (1, 3, "module", 0.5), (2, 4, "crate", 1.0), (3, 5, "workspace", 1.0), (6, 4, "crate", 1.0)]


def test_symbol_resolve_and_call_sites_of_all_lines(spark, sf_dir):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    held = defaultdict(list)
    for i, name in con.execute("SELECT p_partkey, p_brand FROM part").fetchall():
        held[name, i // 100].append(i)
    lines = con.execute("SELECT l_orderkey * 10 + l_linenumber, p_brand, p_partkey // 100 FROM lineitem JOIN part ON l_partkey = p_partkey").fetchall()
    want = sorted((u, i, "file", round(1 / len(held[n, f]), 6)) for u, n, f in lines for i in held[n, f])
    assert sorted(map(tuple, graphs.symbol_resolve(spark, sf_dir).collect())) == want
    assert sorted(map(tuple, graphs.call_sites(spark, sf_dir).collect())) == sorted(con.execute("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey").fetchall())


def test_personal_data_in_each_form(spark):
    forms = {
        "email": ["a.b@c.org", "A+B@C.DE"],
        "phone": ["415-555-2671", "415.555.2671", "415 555 2671", "4155552671", "(415) 555 2671", "+1 415 555 2671", "1-415-555-2671"],
        "ssn": ["917-37-9430", "917 37 9430", "917379430", "91737 9430"],
        "credit_card": ["4111-1111-1111-1111", "4111 1111 1111 1111", "4111111111111111"],
        "ip_address": ["10.0.0.255"],
        "password": ["password: hunter2", "pwd: x", "PASSWD=Secret1", "pwd (415) 555 2671", "password 917 37 9430"],
        "api_key": ["api_key=abcdefghijklmnop", "API-KEY: 'ABCDEFGHIJKLMNOP'", "apikey abcdefgh_12345-78", "secret=abcd-415-555-2671-efgh", "secret: 4111111111111111"],
    }
    rows = [(kind, x) for kind, xs in forms.items() for x in xs]
    df = spark.createDataFrame([(k, f"see {x} now") for k, x in rows], "kind string, text string")
    out = df.select("kind", "text", governance.redact(F.col("text")).alias("done"), *(c.alias(n) for n, c in governance.pii_counts(F.col("text")).items())).collect()
    assert set(governance.PII) == set(forms) and [r.text for r in out if r[r.kind] != 1] == []
    left = "see {}[{}] now"
    assert [r.done for r in out if r.done.replace("+[", "[").replace("([", "[") != left.format("", r.kind.upper())] == []
    clean = spark.createDataFrame([("AB-1234 and 12345678 of 1.2.3 in secretary passwords",), (None,)], "text string").select(*(c.alias(n) for n, c in governance.pii_counts(F.col("text")).items()))
    assert [sum(r) for r in clean.collect()] == [0, 0]


def asked_of(sf_dir):
    """Texts and types by id, and the keywords of those whose id is divisible by 20."""
    docs = {i: ((t or "").lower(), k) for i, t, k in duckdb.sql(f"SELECT doc_id, text, doc_type FROM read_parquet('{sf_dir}/documents.parquet')").fetchall()}
    words = lambda t: re.findall("[a-z0-9_]+", t)
    asked = {i: list(dict.fromkeys(w for w in words(t) if len(w) >= 3 and w not in retrieval.STOP))[:16] for i, (t, _) in docs.items() if i % 20 == 0}
    return docs, asked, words


def best(scores, k):
    return {q: sorted(((-s, i) for i, s in x.items() if s > 0 and i != q))[:k] for q, x in scores.items()}


def test_lexical_searches_ask_every_twentieth_document(spark, sf_dir):
    docs, asked, words = asked_of(sf_dir)
    got = defaultdict(list)
    for r in retrieval.term_score(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.doc_id))
    assert len(got) == len(asked) and got == best({q: {i: 2.0 * sum(w in t for w in ws) for i, (t, _) in docs.items()} for q, ws in asked.items()}, 10)

    tf = {i: Counter(words(t)) for i, (t, _) in docs.items()}
    df, mean = Counter(w for c in tf.values() for w in c), sum(sum(c.values()) for c in tf.values()) / len(tf)
    part = lambda c, w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    want = {q: {i: sum(part(c, w) for w in ws if w in c) for i, c in tf.items()} for q, ws in asked.items()}
    rows = retrieval.bm25(spark, sf_dir).collect()
    assert {r.query_id for r in rows} == set(asked) and len(rows) == sum(len(x) for x in best(want, 10).values())
    assert all(abs(r.score - want[r.query_id][r.doc_id]) < 1e-5 and abs(r.score + best(want, 10)[r.query_id][r["rank"] - 1][0]) < 1e-5 for r in rows)


def test_schema_score_asks_every_twentieth_document(spark, sf_dir):
    docs, asked, _ = asked_of(sf_dir)
    bonus = {i: 4.0 * ("register" in t) + 3.0 * ("driver" in t) + 0.5 * (k == "page") for i, (t, k) in docs.items()}
    got = defaultdict(list)
    for r in findings.schema_score(spark, sf_dir).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.doc_id))
    assert got == best({q: {i: sum(w in t for w in ws) + bonus[i] for i, (t, _) in docs.items()} for q, ws in asked.items()}, 20)


def test_searches_in_blocks_and_all_users(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha beta_gamma"), (2, "alphabet"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(i, "alpha gamma") for i in range(9)], "query_id long, query string")
    monkeypatch.setattr(R.in_blocks, "__defaults__", (2,))
    assert sorted((r.query_id, r.doc_id, r.score) for r in R.term_score(docs, q).collect()) == [x for i in range(9) for x in ((i, 1, 4.0), (i, 2, 2.0))]
    assert R.bm25(docs, q).count() == 9
    asked = set(asked_of(sf_dir)[1])
    assert set() < {r.query_id for r in retrieval.semi_candidates(spark, sf_dir).collect()} <= asked  # a filter: some have none
    for f in (retrieval.rrf_hybrid, retrieval.merge_fused, retrieval.confidence, retrieval.jaccard, retrieval.rerank):
        assert {r.query_id for r in f(spark, sf_dir).select("query_id").distinct().collect()} == asked, f.__name__
