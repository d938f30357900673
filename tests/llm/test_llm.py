import json
import os
import random

import brute_llm
import compare
import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from strandloom.llm import leakage, near_duplicates as D, packing as P, queries, subjects as S


def rows(sf_dir, name):
    return pq.read_table(os.path.join(sf_dir, f"{name}.parquet")).to_pylist()


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    assert compare.compare(queries.QUERIES[name](spark, sf_dir), compare.connect(sf_dir).sql(queries.SQL[name])) == ""


def test_p4_against_plain(spark, sf_dir):
    assert got(queries.p4_found(spark, sf_dir)) == brute_llm.near_pairs([(r["exp_id"], brute_llm.experience_words(r)) for r in rows(sf_dir, "experience")])


def random_records(seed, n=160):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randrange(8, 40))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randrange(8)):
            words[r.randrange(len(words))] = f"w{r.randrange(400)}"
        out.append((i % 150, r.sample(words, len(words))))  # some ids come twice, with other words
    return out


@pytest.mark.parametrize("block", [3, 20_000])
def test_p4_with_split_blocks(spark, block):
    """Tiny blocks split every token's sets into parts: no pair may be lost."""
    data = random_records(block)
    data += [(900 + i, data[0][1]) for i in range(5)] + [(990, None), (991, []), (None, data[0][1])]
    df = spark.createDataFrame([(i, None if w is None else sorted(set(w)), "x") for i, w in data], "id long, words array<string>, key string")
    expected = brute_llm.near_pairs([(i, frozenset(w)) for i, w in data if i is not None and w])
    assert got(D.near_duplicate_pairs(df, block=block)) == expected
    assert got(D.near_duplicate_pairs(df, block=block, limit=0)) == expected  # word numbers joined instead of broadcast
    assert got(D.near_duplicate_pairs(df.limit(0))) == set()


def test_p4_groups(spark):
    data = random_records(7)
    df = spark.createDataFrame([(i, sorted(set(w))) for i, w in {i: w for i, w in data}.items()], "id long, words array<string>")
    pairs = got(D.near_duplicate_pairs(df))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    for r in D.near_duplicate_groups(df).collect():
        assert r.group_id == find(r.id) and r.n_links == sum(r.id in p for p in pairs) and r.class_id <= r.id


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 60), st.sampled_from([0.65, 0.8, 0.5]))
def test_trie_loses_nothing(seed, n, t):
    r = np.random.RandomState(seed)
    sets = [set(map(int, r.choice(200, r.randint(1, 30), replace=False))) for _ in range(n)]
    for i in range(n // 2):
        sets[n - 1 - i] = (sets[i] | {int(r.randint(200))}) - {int(r.randint(200))}
    sets = [s or {1} for s in sets]
    hashes = r.randint(0, 2**62, 200)
    tokens = np.concatenate([hashes[sorted(s)] for s in sets])
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    group = np.arange(n) % 2
    a, b = D.trie_self_join(group, D.fold_signatures(tokens, row, n), np.array([len(s) for s in sets]), t)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert len(found) == len(a)
    for i in range(n):
        for j in range(i + 1, n):
            if group[i] == group[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                assert (i, j) in found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 80))
def test_best_fit_decreasing(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    bins, left = P.best_fit_decreasing(sizes, capacity), []
    for s, b in zip(sizes, bins):
        fits = [r for r in left if r >= s]
        if fits:
            assert left[b] == min(fits)
        else:
            assert b == len(left)
            left.append(capacity)
        left[b] -= s
    assert all(r >= 0 for r in left)


def test_p6_round_trip(spark, sf_dir):
    df = queries.p6_windows(spark, sf_dir)
    counts = {r["doc_id"]: len(P.encoding(P.TOKENIZER).encode_ordinary(r["text"] or "")) for r in rows(sf_dir, "documents")}
    packed = df.toPandas()
    for name, c in ((r["budget_name"], r["max_tokens"]) for r in rows(sf_dir, "context_budgets")):
        own = packed[packed.budget_name == name]
        assert own.groupby("doc_id").tokens.sum().to_dict() == counts
        fill = own.groupby("window_id").tokens.sum()
        assert fill.max() <= c and (own[own.part > 0].doc_id.isin([d for d, n in counts.items() if n > c])).all()
        assert len(fill) <= -(-sum(counts.values()) // c) * 1.05 + 1


def test_p6_edges(spark):
    docs = spark.createDataFrame([(1, 25), (2, 0), (3, None), (4, 7), (4, 7), (None, 3), (5, 10)], "doc_id long, tokens long")
    out = P.pack_documents(docs, {"a": 10, "none": None, "zero": 0}, shard=2)
    r = {(x.doc_id, x.part): (x.start_token, x.tokens) for x in out.collect()}
    assert r == {(1, 0): (0, 10), (1, 1): (10, 10), (1, 2): (20, 5), (2, 0): (0, 0), (3, 0): (0, 0), (4, 0): (0, 7), (5, 0): (0, 10)}
    assert P.pack_documents(docs.limit(0), {"a": 10}).count() == 0 and P.pack_documents(docs, {}).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 5000)], "doc_id long, text string")
    assert {x.doc_id: x.tokens > 4000 for x in P.token_counts(texts).collect()} == {1: False, 2: False, 3: True}


def test_p7_against_plain(spark, sf_dir):
    docs, items = rows(sf_dir, "documents"), rows(sf_dir, "eval_items")
    assert got(queries.p7_found(spark, sf_dir)) == brute_llm.leaks([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])


def test_p7_edges(spark):
    passage = "Eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn"
    docs = [(1, "x <b>EINS zwei-drei, vier FÜNF sechs; sieben acht neun (zehn) elf zwolf</b> y"), (2, passage.replace("sechs", "sechs sechs")), (3, None), (4, ""), (5, "word " * 50_000 + passage), (6, passage.replace(" ", "_")), (1, "again"), (7, passage.rsplit(" ", 2)[0])]
    items = [(10, passage), (11, "too short"), (12, None), (13, passage), (None, passage), (10, passage)]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    expected = {(a, b) for a in (1, 5, 6) for b in (10, 13)}
    assert got(leakage.leaked_items(d, i)) == expected and got(leakage.leaked_items(d, i, at_once=1)) == expected
    assert got(leakage.leaked_items(d.limit(0), i)) == set() and got(leakage.leaked_items(d, i.limit(0))) == set()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=20), max_size=5))
def test_wu_manber(text, items):
    named = [(i, " ".join(w)) for i, w in enumerate(items)]
    assert leakage.WuManber(named, 4).search(" ".join(text)) == {i for _, i in brute_llm.leaks([(0, " ".join(text))], named, 4)}


AREAS = {"sea": ("the harbour", "the anchor", "the tide table", "the deck"), "soil": ("the compost", "the ploughed field", "the seed drill", "the hedge"), "sky": ("the telescope", "the comet", "the eclipse", "the orbit")}
DOES = {"sea": ("rusts in salt water", "drifts past the buoy"), "soil": ("needs rain in spring", "feeds the worms"), "sky": ("crosses the meridian", "fades before dawn")}


def test_p8_held_out(spark):
    """Noisy labels for a sixth of invented documents; accuracy is measured on all."""
    r = random.Random(3)
    docs, truth, labels = [], set(), []
    for i in range(900):
        own = r.sample(sorted(AREAS), r.choice([0, 1, 1, 2]))
        lines = []
        for a in own:
            lines += [f"{r.choice(AREAS[a]).capitalize()} {r.choice(DOES[a])} since {r.randrange(99)}." for _ in range(4)]
        lines += [r.choice(["Same result as last time.", "More on this below.", "See note 5 for details."]) for _ in range(3)]
        if own:
            other = r.choice(sorted(AREAS))
            lines.append(f"{r.choice(AREAS[own[0]]).capitalize()} {r.choice(DOES[own[0]])}, but not {r.choice(AREAS[other])}.")
        r.shuffle(lines)
        docs.append((i, "\n".join(lines)))
        truth |= {(i, a) for a in own}
        if i % 6 == 0:
            for a in own:
                labels.append((i, r.choice([a, a, a, a, a, a, a, r.choice(sorted(AREAS))]).upper() + " ", "x"))
    docs += [(9000, None), (9001, ""), (9002, "<p></p> 1 2 3"), (9003, "the anchor rusts in salt water. " * 3000)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    s = spark.createDataFrame([(a, a) for a in AREAS], "subject string, description string")
    lab = spark.createDataFrame([*labels, (1, "unknown", "x"), (None, "sea", "x"), (77777, "sea", "x")], "doc_id long, subject string, annotator string")
    found = got(S.subject_areas(d, s, lab))
    assert (9003, "sea") in found and not {x for x in found if x[0] in (9000, 9001, 9002)}
    found = {x for x in found if x[0] < 9000}
    assert len(found & truth) / len(found) > 0.95 and len(found & truth) / len(truth) > 0.95
    p = S.subject_posteriors(d, s, lab)
    assert p.filter("posterior < 0 OR posterior > 1 OR share <= 0 OR share > 1").count() == 0
    assert got(S.subject_areas(d.limit(0), s, lab)) == set() and got(S.subject_areas(d, s, lab.limit(0))) == set() and got(S.subject_areas(d, s.limit(0), lab)) == set()


def test_p8_on_labels(spark, sf_dir):
    """On the given tables most labels agree with the areas found."""
    found = got(queries.p8_found(spark, os.path.join(os.path.dirname(sf_dir), "sf0.01")))
    told = {(r["doc_id"], r["subject"].strip().lower().replace(" ", "_")) for r in rows(os.path.join(os.path.dirname(sf_dir), "sf0.01"), "subject_labels") if r["subject"]}
    assert len(told & found) / len(told) > 0.85


def test_sentences():
    assert S.sentences("[001] [INFO] Étude du bus.\n- see A1 now! ok\nuser: hi there\n<p>x y.</p>") == [(["etude", "du", "bus"], True), (["see", "now"], True), (["ok"], False), (["hi", "there"], False), (["x", "y"], True)]
    assert json.dumps(S.sentences("")) == "[]"
