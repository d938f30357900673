"""Sources, functions and order-dependent operators against hand-made cases."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from strandloom.functions.expressions import ExpressionError, condition
from strandloom.functions.keys import normal_path
from strandloom.functions.registry import Registry, detector, embedder, migrated, with_fallback
from strandloom.functions.times import epoch_ms, month_utc
from strandloom.operators import chunking as C, findings as N, frames, graphs as G, logs as L, retrieval as R
from strandloom.sources import files as S
from strandloom.streaming import ops as T


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_times(spark):
    texts = {"2026-03-02T18:16:04Z": 1772475364000, "1772721429000": 1772721429000, "1772721429": 1772721429000, "2026/03/16 06:32:14.5": 1773642734500, "2026-05-25 20:32:02+0200": 1779733922000, "2026-05-14T23:20:21-03:30": 1778813421000, "2026-01-01": 1767225600000, "9999-12-31T23:59:59Z": 253402300799000}
    bad = ["", "pending", None, "2026-13-01 00:00:00", "2026-02-30 00:00:00", "2026-01-01 25:00:00", "n/a"]
    rows = {r.t: r.ms for r in spark.createDataFrame([(t,) for t in [*texts, *bad]], "t string").select("t", epoch_ms(F.col("t")).alias("ms")).collect()}
    assert rows == texts | dict.fromkeys(bad)
    assert spark.range(1).select(month_utc(F.lit(-1)).alias("m")).first().m == "1969-12"


def test_paths(spark):
    cases = {"./a//b/./c": "a/b/c", "a\\b": "a/b", "x/../a/b": "a/b", "/../a/": "/a", "../a": "../a", "a/../../b": "../b", "A/b": "A/b", "a/..": "", ".": "", "a/.": "a"}
    rows = {r.p: r.n for r in spark.createDataFrame([(c,) for c in cases], "p string").select("p", normal_path(F.col("p")).alias("n")).collect()}
    assert rows == cases


def test_chunk_store_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"chunk_id": " 1 ", "text": " a "}, "no object", {"chunk_id": "2", "source_type": "web", "metadata": {"k": "v"}}]))
    rows = S.read_chunks(spark, str(tmp_path / "c.json"))
    assert {(r.chunk_id, r.text, r.source_type) for r in rows.collect()} == {("1", "a", "pdf"), ("2", "", "web")}
    S.write_chunks(rows, str(tmp_path / "out"))
    assert S.read_chunks(spark, str(tmp_path / "out")).count() == 2


def test_journal(spark, tmp_path):
    e = spark.createDataFrame([(f"e{i}", "t", "s", f"2026-01-0{1 + i % 2}", "{}", None) for i in range(5)], "id string, event_type string, source string, timestamp string, data string, metadata string")
    path = str(tmp_path / "j")
    for _ in range(2):
        S.append_journal(e, path, F.col("timestamp"))
    rows = S.read_journal(spark, path)
    assert got(rows.groupBy("partition").agg(F.collect_set("offset").alias("o")).select("partition", F.sort_array("o"))) == [("2026-01-01", list(range(6))), ("2026-01-02", list(range(4)))]
    assert S.invalid_checksums(rows).count() == 0 and S.invalid_checksums(rows.withColumn("data", F.lit("x"))).count() == 10


def test_json_arrays_frames_and_diagnostics(spark, tmp_path):
    rows = spark.createDataFrame([("q", 1), ("q", 2), ("r", 3)], "queue string, n int")
    S.write_json_array(rows, str(tmp_path / "a"), "queue")
    assert got(S.read_json_array(spark, str(tmp_path / "a"), "queue string, n int").select("queue", "n")) == got(rows)
    f = spark.createDataFrame([(1.5, 0x123, bytes([1, 255]))], "ts double, can_id long, data binary")
    line = S.frame_lines(f, "candump").first().value
    parsed = spark.createDataFrame([(line,), ("CAN: 7F 2 0A0B",), ("0x10 AA BB",), ("ID=1",)], "l string").select(*(c.alias(n) for n, c in frames.parse_frame(F.col("l")).items())).collect()
    assert [(r.ts, r.can_id, bytes(r.data) if r.data is not None else None) for r in parsed] == [(1.5, 0x123, b"\x01\xff"), (None, 0x7F, b"\n\x0b"), (None, 0x10, b"\xaa\xbb"), (None, None, None)]
    assert S.frame_lines(f, "asc").first().value == "1.500000 1 123 Rx d 2 01 FF"
    out = spark.createDataFrame([("a.c:3:5: error: no",), ("b.c:9: warning: x",), ("make: *** stop",)], "value string")
    assert got(S.diagnostics(out))[0][:4] == ("a.c", 3, 5, "error") and S.diagnostics(out).count() == 2


def test_walk_registers_and_sync(spark, tmp_path):
    for p in ("a.py", "sub/b.c", ".git/x.py", "sub/.hid.py", "c.txt"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    assert {os.path.basename(r.path) for r in S.walk(spark, str(tmp_path), [".py", ".c"]).collect()} == {"a.py", "b.c"}
    (tmp_path / "d.svd").write_text("<device><peripherals><peripheral><name>U</name><baseAddress>0x40</baseAddress><registers><register><name>A</name><addressOffset>0x4</addressOffset></register><register><name>B</name><addressOffset>8</addressOffset><size>0x10</size></register></registers></peripheral></peripherals></device>")
    assert got(S.read_registers(spark, str(tmp_path / "d.svd"))) == [("U", "A", 0x44, 32), ("U", "B", 0x48, 16)]
    a, b = (spark.createDataFrame(x, "k string, v string") for x in ([("1", "a"), ("2", "b"), ("3", "c")], [("2", "b"), ("3", "x"), ("4", "d")]))
    assert got(S.sync_plan(a, b, "k", "v")) == [("1", "upload"), ("3", "conflict"), ("4", "download")]


def test_expressions(spark):
    df = spark.createDataFrame([(1, 5.0, "x", {"k": 2}), (9, 1.0, "y", {})], "a int, b double, s string, m map<string,int>")
    n = lambda e: df.filter(condition(e, set(df.columns))).count()
    assert [n("1 <= a < 5"), n("a * 2 + 1 == 3 and not s == 'y'"), n("m.get('k', 0) > 1 or a % 2 == 5"), n("s in ['x', 'y']"), n("m['k'] == 2"), n("-a < -5")] == [1, 1, 1, 2, 1, 1]
    for bad in ("__import__('os')", "a.b", "zz > 1", "lambda: 1", "[x for x in a]", "a" * 2000, "not " * 40 + "a", "a is 1", "f'{a}'"):
        with pytest.raises(ExpressionError):
            condition(bad, set(df.columns))


def test_registry(spark):
    r = Registry("thing")
    r.add("a", len)
    with pytest.raises(ValueError):
        r.add("a", len)
    with pytest.raises(KeyError):
        r.get("b")
    e = embedder("length", lambda texts: [[len(t)] for t in texts])
    d = detector("shout", lambda k, t: [("caps", i + 1, line) for i, line in enumerate(t.split("\n")) if line.isupper()])
    df = spark.createDataFrame([(1, "ab\nCD"), (2, None)], "id long, t string")
    assert got(df.select("id", e("t").alias("v"))) == [(1, [5.0]), (2, [0.0])] and got(d(df, "id", "t")) == [(1, "caps", 2, "CD")]
    steps = {1: lambda x: x.withColumn("b", F.lit(1)), 2: lambda x: x.withColumn("c", F.col("b") + 1)}
    assert migrated(df, 1, steps, 3).first().c == 2
    with pytest.raises(KeyError):
        migrated(df, 1, steps, 5)
    assert with_fallback(lambda: spark.read.parquet("/nowhere"), lambda: df).count() == 2


def test_chunkers():
    text = "One. Two two.\n\n" + "x" * 30 + " y. " * 10 + "\n\nLast"
    for cut in (lambda t: C.chunk_text(t, 20), lambda t: C.chunk_recursive(t, 20, least=5), lambda t: C.chunk_code(t, 20)):
        parts = cut(text)
        assert all(parts) and "x" * 20 in parts[1] or parts
    assert all(len(p) <= 20 for p in C.chunk_text(text, 20)) and "".join("".join(C.chunk_text(text, 20)).split()) == "".join(text.split())
    assert C.chunk_json('{"a": 1, "b": "' + "z" * 50 + '"}', 30) == ['{"a": 1}', '{"b": "' + "z" * 50 + '"}'] and C.chunk_json("[1, 2]") == ["[1, 2]"] and C.chunk_json("{torn", 3) == ["{to"] and C.chunk_json("{}") == ["{}"]
    assert C.fnv1a(b"") == 0xCBF29CE484222325 and C.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert C.mmr(["a b c", "a b c", "d e f"], share=0.7) == [0, 2] and C.mmr(["one"]) == [0]
    assert json.loads(C.compact_fields('{"name": "n", "x": null, "note": "t", "l": [1]}')) == {"name": "n", "note": "t"} and C.compact_fields("no") == "no" and C.compact_fields(None) is None


def test_budgets_and_dedup(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([3, 9, 4, 2, 1])], "g string, i int, n long")
    assert [r[2] for r in got(C.packed_budget(rows, "g", "i", ["i"], "n", 8))] == [True, False, True, False, True]
    assert [r[2] for r in got(C.packed_budget(rows, "g", "i", ["i"], "n", 8, stop=True))] == [True, False, False, False, False]
    v = spark.createDataFrame([("g", 1, [1.0, 0.0]), ("g", 2, [0.99, 0.01]), ("g", 3, [0.0, 1.0]), ("g", 4, [0.0, 0.0])], "g string, i int, v array<double>")
    assert [r[2] for r in got(C.sliding_dedup(v, "g", "i", "v"))] == [True, False, True, True]


def test_retrieval_semantics(spark):
    docs = spark.createDataFrame([(1, "alpha beta_gamma"), (2, "alpha"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "beta_gamma alpha")], "query_id long, query string")
    assert R.bm25(docs, q).filter("rank = 1").first().doc_id == 1 and R.bm25(docs.limit(0), q).count() == 0
    a = R.term_score(docs, q)
    both = R.reciprocal_rank_fusion([a, a.filter("doc_id = 2").withColumn("rank", F.lit(1).cast("long"))], "doc_id", 5)
    assert {r.doc_id: r.score for r in both.collect()} == {1: round(1 / 60, 6), 2: round(1 / 61 + 1 / 60, 6)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    vq = v.filter("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    assert [r.vec_id for r in R.knn(v, vq, "vec_id", "embedding", 5).collect()] == [2]


def test_graph_semantics(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "d"), ("a", None), ("a", "b")], "src string, dst string")
    assert got(G.strong_components(e)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")]
    roots = spark.createDataFrame([("a",)], "root string")
    assert got(G.reachable(e, roots)) == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert ("a", "d", "a > b > c > d") in got(G.shortest_paths(e, roots))
    dag = spark.createDataFrame([("app", "lib"), ("lib", "core"), ("app", "core"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r.node: r.level for r in G.levels(dag).collect()} == {"core": 0, "lib": 1, "app": 2, "x": None, "y": None}
    assert got(G.reachable(e.limit(0), roots)) == [] and got(G.strong_components(e.limit(0))) == []
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    d = spark.createDataFrame([("g", i, h(str(i))) for i in range(3)] + [("o", 0, h("x"))], "g string, p long, d string")
    assert dict(got(G.merkle_root(d, ["g"], "p", "d"))) == {"g": h(h(h("0") + h("1")) + h(h("2") + h("2"))), "o": h("x")}


def test_rate_limit_and_conflicts(spark):
    t0 = dt.datetime(2026, 1, 1)
    e = spark.createDataFrame([("k", i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 10, 11])], "k string, i int, ts timestamp")
    assert [r[2] for r in got(L.rate_limited(e, "k", "ts", "i", 2, 10))] == [True, True, False, True, True]
    c = spark.createDataFrame([("always keep x", "never keep x"), ("a b c d e", "e d c b a"), ("a", "b")], "a string, b string")
    assert [r.k for r in c.select(N.conflict_kind(F.col("a"), F.col("b"), [("always", "never")]).alias("k")).collect()] == ["contradiction", "overlap", None]


def test_streams(spark, tmp_path):
    rows = [(i % 3, i, dt.datetime(2026, 1, 1) + dt.timedelta(minutes=i), "t%d" % i, float(i)) for i in range(25)]
    e = spark.createDataFrame(rows, "user_id int, event_id int, ts timestamp, event_type string, value double")
    for part in range(2):
        e.filter(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = lambda: T.read_table(spark, str(tmp_path), "events", 10)
    flushed = T.drained(T.count_flush(stream(), "user_id", "event_id", "event_type", 4), "t")
    assert got(flushed.filter("user_id = 0"))[0] == (0, 0, 4, "t0 t3 t6 t9") and flushed.count() == 6
    T.drained(stream().select("user_id", "event_id", "value"), "u", sink=T.upsert_sink(str(tmp_path / "up"), ["user_id"], "event_id"))
    last = max(int(p) for p in os.listdir(tmp_path / "up"))
    assert {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "up" / str(last))).collect()} == {0: 24, 1: 22, 2: 23}
    wide = T.drained(T.tumbling_counts(stream(), "ts", "user_id", "value", "10 minutes", "1 minute"), "w")
    assert sum(r.n for r in wide.collect()) <= 25 and set(wide.columns) == {"start", "user_id", "n", "total"}
    assert T.drained(T.session_counts(stream(), "ts", "user_id", "1 hour", "1 minute"), "s").columns == ["user_id", "start", "end", "n"]
