import json
import os

import brute
import pyarrow.parquet as pq
import pytest

from strandloom.operators.activities import _READ_SQL, activity_changes, read_events
from strandloom.operators.change_feed import apply_changes
from strandloom.operators.intervals import busy_periods
from strandloom.operators.references import orphans
from strandloom.operators.schema_drift import canonical_names, match_step, schema_changes, similarity_flooding, unified_payloads, with_names
from strandloom.plans import problems


def rows(sf_dir, name):
    return pq.read_table(os.path.join(sf_dir, f"{name}.parquet")).to_pylist()


def got(df):
    return [tuple(r) for r in df.collect()]


def test_p2_against_plain(spark, sf_dir):
    found = got(problems.p2_found(spark, sf_dir))
    assert len(found) == len(set(found))
    assert set(found) == brute.orphans(*(rows(sf_dir, t) for t in ("sessions", "threads", "file_index_state", "file_dependencies")))


def test_p2_edges(spark):
    s = spark.createDataFrame(
        [(" S1", "2026-01-02 00:00:00", "2026-01-02 00:00:00", "active"), ("s1", "2026-01-02 00:00:00", "2026-01-05T00:00:00Z", "Deleted "), ("s1", None, "2026-01-07 00:00:00", "active"), (None, None, None, None), ("s2", "bad", None, None)],
        "id string, created_at string, updated_at string, status string",
    )
    t = spark.createDataFrame(
        [("a", "S1 ", "2026-01-05 00:00:00", 1), ("b", "s1", "2026-01-07 00:00:00", 1), ("c", "s1", "2026-01-01 23:59:59", 1), ("d", "s3", "x", 1), ("e", " ", "2026-01-05 00:00:00", 1), ("f", None, None, 1), ("g", "s2", "2020-01-01 00:00:00", 1), ("a", "S1 ", "2026-01-05 00:00:00", 1), ("h", "s1", None, 1), ("i", "s1", "2026-01-02 00:00:00", 1)],
        "id string, session_id string, created_at string, key int",
    )
    f = spark.createDataFrame([("a/b.c", None, 100.0), ("a/b.c", 200.0, None), ("x.c", 50.0, None)], "path string, indexed_at double, deleted_at double")
    d = spark.createDataFrame(
        [(1, "./a//b.c", "call", 150.0), (2, "a\\b.c", "call", 200.0), (3, "q/../a/./b.c", "call", 99.9), (4, "X.c", "call", None), (5, "json", "system", 1.0), (6, "x.c", "import", 49.0), (7, "x.c", None, 50.0), (8, "/../x.c", "call", 1.8e12)],
        "dep_id long, target_path string, dep_type string, recorded_at double",
    )
    assert set(got(orphans(s, t, f, d))) == {
        ("threads", "a", "deleted", "2026-01"), ("threads", "c", "late", "2026-01"), ("threads", "d", "missing", "unknown"),
        ("file_dependencies", "1", "deleted", "1970-01"), ("file_dependencies", "4", "missing", "unknown"), ("file_dependencies", "6", "late", "1970-01"), ("file_dependencies", "8", "missing", "2027-01"),
    }
    assert got(orphans(s.limit(0), t.limit(0), f.limit(0), d.limit(0))) == []


@pytest.mark.parametrize("range_turns", [7, 50, 10_000])
def test_p2_ranges_and_salts(spark, range_turns):
    """Many ranges, some of which cut through a key's turns; a key with a third of all references is met by several tasks."""
    from strandloom.operators.references import DELETED, EVER, LATE, THERE, orphan_references

    turns = spark.range(100).selectExpr("concat('k', id) key", "id").selectExpr("key", f"explode(array(named_struct('at', {EVER}L, 'state', {LATE}), named_struct('at', id, 'state', {THERE}), named_struct('at', id + 10, 'state', {DELETED}))) t").select("key", "t.at", "t.state")
    hot = spark.range(200).selectExpr("'hot' key", f"if(id = 0, {EVER}L, id) at", f"if(id % 2 = 1, {THERE}, {DELETED}) state")
    refs = spark.range(3000).selectExpr("'t' ref_table", "cast(id as string) record_key", "if(id % 3 = 0, 'hot', concat('k', id % 130)) key", "if(id % 11 = 0, null, id % 211) at")
    found = set(got(orphan_references(refs, turns.unionByName(hot), range_turns=range_turns, batch=100)))
    expected = set()
    for i in range(3000):
        k, at = i % 130, None if i % 11 == 0 else i % 211
        if i % 3 == 0:
            why = "" if at is None or min(at, 199) % 2 == 1 else "deleted"
        else:
            why = "missing" if k >= 100 else "" if at is None else "late" if at < k else "" if at < k + 10 else "deleted"
        if why:
            expected.add(("t", str(i), why, at))
    assert found == expected
    assert got(orphan_references(refs, turns.limit(0))) and got(orphan_references(refs.limit(0), turns)) == []


def test_p2_one_path_indexed_very_often(spark):
    """A hundred thousand turns of one path within a day lie in many ranges."""
    files = spark.range(50_000).selectExpr("'a/b.c' path", "cast(id as double) indexed_at", "id + 0.5d deleted_at")
    deps = spark.range(400).selectExpr("id dep_id", "'./a/b.c' target_path", "'call' dep_type", "id * 100 + if(id % 2 = 0, 0.2d, 0.7d) recorded_at")
    none = spark.createDataFrame([], "id string, created_at string, updated_at string, status string, session_id string")
    assert {int(r[1]) for r in got(orphans(none, none, files, deps))} == set(range(1, 400, 2))


def test_p3_against_plain(spark, sf_dir):
    found = got(problems.p3_found(spark, sf_dir))
    assert len(found) == len(set(found))
    assert set(found) == brute.periods((r["target_name"], r["started_at"], r["completed_at"]) for r in rows(sf_dir, "flash_transactions"))


@pytest.mark.parametrize("seed", [1, 7])
def test_p3_spans_of_a_hot_entity(spark, seed):
    import random

    r = random.Random(seed)
    spans = [("hot" if r.random() < 0.5 else f"e{r.randrange(5)}", s := r.randrange(-50, 400), s + r.choice([0, 1, 3, 9, 120])) for _ in range(300)] + [(None, 1, 2), ("n", None, 5), ("n", 5, None)]
    df = spark.createDataFrame([(*x, "extra") for x in spans], "entity string, start long, end long, kind string")
    expected = set()
    for e in {x[0] for x in spans if x[0]}:
        merged = []
        for s, t in sorted((s, t) for n, s, t in spans if n == e and s is not None and t is not None and t > s):
            if not merged or s > merged[-1][1]:
                merged.append([s, t])
            merged[-1][1] = max(merged[-1][1], t)
        expected |= {(e, "period", *m) for m in merged} | {(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    assert set(got(busy_periods(df))) == expected
    assert got(busy_periods(df.limit(0))) == []


def test_p5_against_plain(spark, sf_dir):
    names = {"activity_id": ["activity_id"], "status": ["status"], "attempt": ["attempt"]}
    for r in problems.p1_found(spark, sf_dir).filter("change = 'renamed' AND event_type LIKE 'activity%'").orderBy("file_no").collect():
        for paths in names.values():
            if r["field"] in paths and r["detail"] not in paths:
                paths.append(r["detail"])
    found = got(problems.p5_found(spark, sf_dir))
    assert len(found) == len(set(found))
    assert set(found) == brute.activities(rows(sf_dir, "workflow_events"), names)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_p5_random_changes(spark, chunk):
    import random

    r = random.Random(chunk)
    ops = [(f"w{r.randrange(2)}", f"k{r.randrange(4)}", n, r.choice(["insert", "update", "update", "delete", None]), r.choice([None, "x", "y"]), r.choice([None, 1, 2])) for n in range(200)]
    base = [("w0", "k0", "b", 9, -5), ("w0", "k9", None, None, -5)]
    state = {(s, k): (v, a, n) for s, k, v, a, n in base}
    for s, k, n, op, v, a in ops:
        if op == "insert":
            state[s, k] = (v, a, n)
        elif op == "delete":
            state.pop((s, k), None)
        elif op == "update" and (s, k) in state:
            old = state[s, k]
            state[s, k] = (old[0] if v is None else v, old[1] if a is None else a, n)
    df = spark.createDataFrame([(*x, 0) for x in ops] + [(None, "k1", 5, "insert", "x", 1, 0), ("w0", None, 5, "insert", "x", 1, 0)], "s string, k string, n long, op string, v string, a int, m int")
    bd = spark.createDataFrame(base, "s string, k string, v string, a int, n long")
    assert set(got(apply_changes(df, "s", "k", "n", "op", ["v", "a"], base=bd, chunk=chunk))) == {(*k, *v) for k, v in state.items()}
    assert set(got(apply_changes(df.limit(0), "s", "k", "n", "op", ["v", "a"], base=bd, chunk=chunk))) == set(map(tuple, base))


def events(spark, files):
    """files: [(feed, file_no, version, event type, [payloads])]."""
    data = [(i, f, n, v, e, p if isinstance(p, (str, type(None))) else json.dumps(p), "x") for i, (f, n, v, e, p) in enumerate((f, n, v, e, p) for f, n, v, e, ps in files for p in ps)]
    return spark.createDataFrame(data, "ingest_id long, feed string, file_no int, schema_version int, event_type string, payload_json string, path string")


def test_p1_changes(spark):
    one = [{"id": f"act-{i}", "n": i, "w": f"wkr-{i}", "o": {"z": True}, "l": [1]} for i in range(6)]
    two = [{"ref": {"id": f"act-{i}"}, "n": str(i), "t": f"{i}f2017037b38", "o": {"z": True}, "l": [1]} for i in range(6)]
    df = events(spark, [
        ("f", 1, 1, "e", [*one, '{"torn": ', None, "[1]", json.dumps(json.dumps(one[0]))]),
        ("f", 3, 2, "e", [*two, {"ref": {"id": None}, "n": 4, "x": None}]),
        ("f", 3, 1, "e", [{"old": 1}] * 9),
        ("f", 4, 2, "other", [{"q": 1}]),
        ("g", 1, 1, "e", [{}]), ("g", 2, 1, "e", [{"q": None}]),
    ])
    assert set(got(schema_changes(df))) == {
        ("f", 3, "e", "renamed", "id", "ref.id"), ("f", 3, "e", "retyped", "n", "string"), ("f", 3, "e", "removed", "w", ""),
        ("f", 3, "e", "added", "t", ""), ("f", 3, "e", "added", "x", ""), ("g", 2, "e", "added", "q", ""),
    }
    assert got(schema_changes(df.limit(0))) == []
    wide = unified_payloads(df, ["ingest_id", "event_type"])
    assert {"f_id", "f_n", "f_o__z", "f_l"} <= set(wide.columns) and "f_ref__id" not in wide.columns
    assert wide.filter("f_id like 'act-%'").count() == 13 and dict(wide.dtypes)["f_o__z"] == "boolean"


def test_p1_names_and_flooding(spark):
    changes = spark.createDataFrame([("f", 5, "e", "renamed", "b", "c"), ("f", 2, "e", "renamed", "a", "b"), ("f", 9, "e", "renamed", "c", "a"), ("f", 9, "e", "added", "q", ""), ("g", 1, "e", "renamed", "a", "z")], "feed string, file_no int, event_type string, change string, field string, detail string")
    names = canonical_names(changes)
    assert set(got(names)) == {("f", "e", "b", "a"), ("f", "e", "c", "a"), ("g", "e", "z", "a")} and got(canonical_names(changes.limit(0))) == []
    left, right = [("r", "holds", "a"), ("r", "holds", "b")], [("s", "holds", "x"), ("s", "holds", "y")]
    start = {("r", "s"): 1.0, ("a", "x"): 0.6, ("a", "y"): 0.5, ("b", "y"): 0.6, ("b", "x"): 0.1}
    end = similarity_flooding(start, left, right)
    assert end["a", "x"] > end["a", "y"] and end["b", "y"] > end["b", "x"]


@pytest.mark.parametrize("limit", [0, 100])
def test_p1_names_join(spark, monkeypatch, limit):
    """Few names are broadcast, many shuffled with a copy for each part: the same rows."""
    from strandloom.operators import schema_drift

    monkeypatch.setattr(schema_drift, "BROADCAST_NAMES", limit)
    events_ = spark.range(200).selectExpr("if(id % 3 = 0, 'hot', concat('f', id % 7)) feed", "'e' event_type", "id")
    names = spark.createDataFrame([("hot", "e", "b", "a"), ("f1", "e", "c", "d"), ("f1", "x", "c", "d")], "feed string, event_type string, path string, first string")
    rows_ = with_names(events_, names, "id").collect()
    assert len(rows_) == 200 and all((r.names or {}) == {"hot": {"b": "a"}, "f1": {"c": "d"}}.get(r.feed, {}) for r in rows_)


def test_p1_flooding_decides():
    """Two comers have the same kind of values: by names alone one is taken, by what stands around it the other."""
    old = {"e": {"box.ref": "string", "box.left": "number", "box.right": "number", "keep": "string"}}
    new = {"e": {"crate.code": "string", "crate.left": "number", "crate.right": "number", "keep": "string", "xref": "string"}}
    alike = lambda kind, what, a, b: 1.0
    assert match_step(old, new, alike)["e", "box.ref"] == "crate.code"
    names_only = lambda initial, left, right: {(x, y): initial.get((("name", "", x[2]), ("name", "", y[2])), 0.0) if x[0] == "field" else s for (x, y), s in initial.items()}
    assert match_step(old, new, alike, flood=names_only)["e", "box.ref"] == "xref"
    assert match_step(old, new, alike, flood=lambda initial, left, right: initial) == {}
    assert match_step(old, new, lambda *_: 0.1) == {}


def test_p5_types_under_other_names(spark):
    df = events(spark, [("f", 1, 1, "activity_scheduled", [{"task": ["a"], "status": ["s"], "attempt": "3 u"}, {"task": "b", "status": None, "attempt": True}])])
    df = df.selectExpr("'w' workflow_id", "ingest_id version", "ingest_id", "feed", "file_no", "schema_version", "event_type", "payload_json")
    read = df.mapInArrow(read_events, _READ_SQL).filter("n IS NULL")
    names = spark.createDataFrame([("f", "activity_scheduled", "task", "activity_id")], "feed string, event_type string, path string, first string")
    got_ = {tuple(r[3:]) for r in activity_changes(read, names).collect()}
    assert got_ == {("insert", "a", "s", 3), ("insert", "b", None, None)}


def test_p5_and_p1_with_nulls_and_nothing(spark):
    from strandloom.operators.activities import current_activities

    df = spark.createDataFrame(
        [(1, "f", 1, "w", 1, 1, "activity_scheduled", '{"activity_id": "a", "status": "s", "attempt": 1}'), (None, "f", 1, "w", 1, 1, "activity_cancelled", '{"activity_id": "a"}'), (2, None, 1, "w", 2, 1, "activity_started", '{"activity_id": "a", "status": "r"}'), (3, "f", None, "w", 3, None, None, None), (4, "f", 1, None, 4, 1, "activity_scheduled", '{"activity_id": "b"}'), (5, "f", 1, "w", None, 1, "activity_scheduled", '{"activity_id": "c"}'), (6, "f", 1, "w", 6, 1, "activity_scheduled", '{"activity_id": null}'), (7, "f", 1, "w", 7, 1, "activity_started", '{"activity_id": "zz", "status": "r"}')],
        "ingest_id long, feed string, file_no int, workflow_id string, version long, schema_version int, event_type string, payload_json string",
    )
    assert got(current_activities(df)) == [("w", "a", "r", 1, 2)]
    assert got(current_activities(df.limit(0))) == [] and got(schema_changes(df)) == []
