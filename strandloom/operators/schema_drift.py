"""Schemas that drift between files: field profiles, similarity flooding, one consistent table.

The rows are read once. Each task folds its payloads into counts per (feed, file, schema version, event type, path, type) and
into fixed-size value profiles (256 signature buckets and three moments), so that only those counts are shuffled: their size
follows the number of distinct shapes, not the rows, and a feed that holds a third of all rows costs its share of the map side.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandloom.functions.payloads import FIELD_TYPES, field_type, leaves, read_payload
from strandloom.session import cut_lineage

CHANGES = "feed string, file_no int, event_type string, change string, field string, detail string"
COUNTS = "feed string, file_no int, schema_version int, event_type string, path string, type string, bucket int, n long, s1 double, s2 double"
#: Most names that are broadcast.
BROADCAST_NAMES = 100_000
BUCKETS = 256
_FLUSH = 200_000
_HEAD = re.compile(r"([A-Za-z]*)(.?)")
_NUMBER = re.compile(r"[+-]?\d+(?:\.\d+)?(?=$|[ _%a-zA-Z]{1,4}$)")
COUNTED_TYPES = pa.schema([("feed", pa.string()), ("file_no", pa.int32()), ("schema_version", pa.int32()), ("event_type", pa.string()), ("path", pa.string()), ("type", pa.string()), ("bucket", pa.int32()), ("n", pa.int64()), ("s1", pa.float64()), ("s2", pa.float64())])
COUNTED = tuple(COUNTED_TYPES.names)


def value_signature(text: str) -> str:
    """What kind of text it is: a number, a whole first word, a prefix with its separator, or a code of some length."""
    if number := _NUMBER.match(text):
        return "num" + text[number.end() :]
    word, after = _HEAD.match(text).groups()
    if word and not after.isalnum():
        return word + after
    return f"#{len(text)}"


@lru_cache(20_000)
def _weigh_text(value: str) -> tuple[str, float | None]:
    sign = value_signature(value)
    if sign.startswith("num"):
        size = float(_NUMBER.match(value).group())
        return sign, math.copysign(math.log(abs(size) + 1), size) if math.isfinite(size) else None
    return sign, None


def _weigh(value: object) -> tuple[str, float | None]:
    """The signature of a value and the number in it, on a log scale."""
    kind = field_type(value)
    if kind == "number":
        whole = isinstance(value, int) or float(value).is_integer()
        return ("int" if whole else "frac"), math.copysign(math.log(abs(value) + 1), value) if math.isfinite(value) else None
    if kind == "string":
        return _weigh_text(value) if len(value) <= 200 else _weigh_text.__wrapped__(value)
    return str(value) if kind == "boolean" else "null", None


def profile_partitions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows (feed, file_no, schema_version, event_type, payload) into COUNTS rows."""

    def read() -> Iterator[tuple[list, list[list]]]:
        for batch in batches:
            *keys, payloads = (c.to_pylist() for c in batch.columns)
            values = map(read_payload, payloads)
            yield [(i, None if v is None else list(leaves(v))) for i, v in enumerate(values)], keys

    return (out for out in profile_read(read()) if out is not None)


def profile_read(batches: Iterable[tuple[list, list[list]]]) -> Iterator[pa.RecordBatch | None]:
    """Fold payloads that were read already into COUNTS rows; None after each batch that gives none yet.

    batches: (row, leaves or None where it can't be read) of the payloads that count, and the columns feed, file_no, schema_version and event_type.
    file_no >= 0: a shape; path null marks the file's schema version, path '' the event type's readable rows. file_no = -1: a
    value profile, with the signature's bucket, or bucket -1 for the moments.
    """
    shapes: dict[tuple, int] = defaultdict(int)
    signs: dict[tuple, Counter] = defaultdict(Counter)
    moments: dict[tuple, list[float]] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, -1, n, 0.0, 0.0) for k, n in shapes.items()]
        for (feed, kind, path, what), c in signs.items():
            merged: Counter = Counter()
            for sign, n in c.items():
                merged[zlib.crc32(sign.encode("utf-8", "replace")) % BUCKETS] += n
            rows += [(feed, -1, -1, kind, path, what, b, n, 0.0, 0.0) for b, n in merged.items()]
        rows += [(feed, -1, -1, kind, path, what, -1, int(n), s1, s2) for (feed, kind, path, what), (n, s1, s2) in moments.items()]
        columns = zip(*rows) if rows else [[]] * len(COUNTED)
        for d in (shapes, signs, moments):
            d.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, COUNTED_TYPES)], names=list(COUNTED))

    for values, (feeds, files, versions, kinds) in batches:
        for i, fields in values:
            feed, file_no, version, kind = feeds[i], files[i], versions[i], kinds[i]
            if feed is None or file_no is None or version is None:
                continue
            shapes[feed, file_no, version, None, None, None] += 1
            if kind is None or fields is None:
                continue
            shapes[feed, file_no, version, kind, "", None] += 1
            for path, leaf in fields:
                what = field_type(leaf)
                shapes[feed, file_no, version, kind, path, what] += 1
                if what is None:
                    continue
                key = (feed, kind, path, what)
                for item in leaf if what == "array" else (leaf,):
                    sign, size = _weigh(item)
                    signs[key][sign] += 1
                    if size is not None:
                        m = moments.setdefault(key, [0, 0.0, 0.0])
                        m[0] += 1
                        m[1] += size
                        m[2] += size * size
        full = len(shapes) + len(moments) + sum(map(len, signs.values())) > _FLUSH
        yield out() if full else None
    yield out()


def profile_likeness(kind: str, a: tuple[dict[int, int], list[float]], b: tuple[dict[int, int], list[float]]) -> float:
    """How alike two fields' values are, 0 to 1: shared share of signatures, times the overlap of their numbers."""
    if kind == "boolean":
        return 1.0
    (ha, ma), (hb, mb) = a, b
    na, nb = sum(ha.values()), sum(hb.values())
    if not na or not nb:
        return 1.0 if na == nb else 0.0
    shared = sum(min(n / na, hb.get(k, 0) / nb) for k, n in ha.items())
    # few values seen: a shared vocabulary counts even where its shares differ by chance
    seen = min(sum(n for k, n in ha.items() if k in hb) / na, sum(n for k, n in hb.items() if k in ha) / nb)
    alike = max(shared, 0.9 * seen)
    if ma[0] and mb[0]:
        (ua, va), (ub, vb) = ((m[1] / m[0], max(m[2] / m[0] - (m[1] / m[0]) ** 2, 0.0) + 0.02) for m in (ma, mb))
        alike *= math.sqrt(2 * math.sqrt(va * vb) / (va + vb)) * math.exp(-0.25 * (ua - ub) ** 2 / (va + vb))
    return alike


def name_likeness(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names."""
    if a == b:
        return 1.0
    pa_, pb_ = ({x[i : i + 2] for i in range(len(x) - 1)} for x in (f"^{a.lower()}$", f"^{b.lower()}$"))
    return 2 * len(pa_ & pb_) / (len(pa_) + len(pb_))


def similarity_flooding(initial: dict[tuple, float], left: list[tuple], right: list[tuple], rounds: int = 60, eps: float = 1e-4) -> dict[tuple, float]:
    """Fixpoint of the match scores of node pairs.

    left and right: edges (from, label, to) of the two schema graphs. Pairs are neighbours where both members are joined by
    edges of one label; along each label and direction a pair passes on its score divided by the mean number of such edges of
    its two members. Only pairs in ``initial`` take part.
    """
    by_label: dict[str, list[tuple]] = defaultdict(list)
    degree: Counter = Counter()
    for side, edges in enumerate((left, right)):
        for x, label, y in edges:
            degree[side, x, label, ">"] += 1
            degree[side, y, label, "<"] += 1
    for x, label, y in right:
        by_label[label].append((x, y))
    flows: list[tuple[tuple, tuple, float]] = []
    for x, label, y in left:
        for u, v in by_label[label]:
            if (x, u) in initial and (y, v) in initial:
                down, up = degree[0, x, label, ">"] + degree[1, u, label, ">"], degree[0, y, label, "<"] + degree[1, v, label, "<"]
                flows += [((x, u), (y, v), 2 / down), ((y, v), (x, u), 2 / up)]
    score = dict(initial)
    for _ in range(rounds):
        new = {p: initial[p] + s for p, s in score.items()}
        for p, q, share in flows:
            new[q] += (initial[p] + score[p]) * share
        top = max(new.values(), default=1.0) or 1.0
        new = {p: s / top for p, s in new.items()}
        moved = math.sqrt(sum((new[p] - score[p]) ** 2 for p in new))
        score = new
        if moved < eps:
            break
    return score


#: The side of a field that is gone or new without a partner.
NOTHING = ""
#: Initial likeness of values and of names in the pairs of a field with NOTHING (no rename ends lower than these do), and the weight of names.
NO_VALUES, NO_NAME, NAMES_WEIGH = 0.55, 0.1, 0.2


def _graph(shapes: dict[str, dict[str, str | None]], lone: dict[str, set[str]]) -> list[tuple]:
    """Edges of the schema graph: event types hold objects, objects hold fields; a field has a type, a name and values.

    lone: event type -> types of the other side's fields that may have no partner here; the event type then holds NOTHING too, in an
    object unlike any other.
    """
    edges = []
    for kind, fields in shapes.items():
        for path, what in fields.items():
            *outer, name = path.split(".")
            holder = ("event", kind, "")
            for depth in range(len(outer)):
                inner = ("object", kind, ".".join(outer[: depth + 1]))
                edges.append((holder, "holds", inner))
                holder = inner
            leaf = ("field", kind, path)
            edges += [(holder, "holds", leaf), (leaf, "type", ("type", "", what or "")), (leaf, "name", ("name", "", path)), (leaf, "values", ("values", kind, path))]
        if lone.get(kind):
            holder, leaf = ("object", kind, NOTHING), ("field", kind, NOTHING)
            edges += [(("event", kind, ""), "holds", holder), (holder, "holds", leaf), (leaf, "name", ("name", "", NOTHING)), (leaf, "values", ("values", kind, NOTHING))]
            edges += [(leaf, "type", ("type", "", what)) for what in sorted(lone[kind])]
    return list(dict.fromkeys(edges))


def step_scores(old: dict[str, dict[str, str | None]], new: dict[str, dict[str, str | None]], likeness: Callable[[str, str, str, str], float], flood=similarity_flooding) -> dict[tuple[str, str, str], float]:
    """(event type, old path or NOTHING, new path or NOTHING) -> flooded score, of all that may become of the fields that go and come.

    Names, types, nesting and kinds of values are nodes beside the fields: what they are alike reaches a pair of fields by
    flooding only. A field without partner is a pair with NOTHING, whose values and name are alike to a fixed degree.
    """
    gone = {(k, a): t for k in old for a, t in old[k].items() if a not in new[k] and t is not None}
    come = {(k, b): t for k in old for b, t in new[k].items() if b not in old[k] and t is not None}
    pairs = [(k, a, b) for (k, a), ta in gone.items() for (k2, b), tb in come.items() if k2 == k and tb == ta]
    if not pairs:
        return {}
    lone_l, lone_r, alone = defaultdict(set), defaultdict(set), set()
    for k, a, b in pairs:
        lone_l[k].add(gone[k, a])
        lone_r[k].add(gone[k, a])
        alone |= {(k, a, NOTHING), (k, NOTHING, b)}
    pairs += sorted(alone)
    left, right = _graph(old, lone_l), _graph(new, lone_r)
    initial: dict[tuple, float] = {}
    kept = [(k, p, p) for k in old for p in old[k] if p in new[k]]
    for k, a, b in [*kept, *pairs]:
        single = NOTHING in (a, b)
        alike = NO_VALUES if single else 1.0 if a == b else likeness(k, gone[k, a], a, b)
        named = NO_NAME if single else name_likeness(a, b)
        initial[("field", k, a), ("field", k, b)] = 0.1
        initial[("values", k, a), ("values", k, b)] = alike
        initial[("name", "", a), ("name", "", b)] = NAMES_WEIGH * named
    nodes_l, nodes_r = ({n for x, _, y in g for n in (x, y)} for g in (left, right))
    for x in nodes_l:
        if x[0] == "type" and x in nodes_r:
            initial[x, x] = 1.0
        elif x[0] in ("event", "object"):
            for y in nodes_r:
                if y[0] in ("event", "object") and y[1] == x[1]:
                    unlike = ("object", x[1], NOTHING) in (x, y)
                    initial[x, y] = 0.1 if unlike else max(name_likeness(x[2], y[2]), 0.1)
    score = flood(initial, left, right)
    return {(k, a, b): score[("field", k, a), ("field", k, b)] for k, a, b in pairs}


def match_step(old: dict[str, dict[str, str | None]], new: dict[str, dict[str, str | None]], likeness: Callable[[str, str, str, str], float], flood=similarity_flooding) -> dict[tuple[str, str], str]:
    """(event type, old path) -> new path of the renamed fields of one step.

    old and new: event type -> path -> type. likeness(event type, type, old path, new path) compares the values. Each field
    that goes or comes takes the best flooded of its pairs that is still open, NOTHING among them; pairs of two fields are the
    renames. Ties go to the pair with NOTHING, then to the first by name.
    """
    score = step_scores(old, new, likeness, flood)
    found: dict[tuple[str, str], str] = {}
    gone, come = set(), set()
    for kind, a, b in sorted(score, key=lambda c: (-round(score[c], 9), bool(c[1] and c[2]), c)):
        if (kind, a) in gone or (kind, b) in come:
            continue
        if a != NOTHING:
            gone.add((kind, a))
        if b != NOTHING:
            come.add((kind, b))
        if NOTHING not in (a, b):
            found[kind, a] = b
    return found


def step_changes(steps: pd.DataFrame, profiles: pd.DataFrame) -> pd.DataFrame:
    """The changes between one file of a feed and the files before it.

    steps: feed, file_no, event_type, old and new (arrays of path and type). profiles: kind, name, what and profile (array
    of bucket, n, s1, s2) of the fields that may be renamed.
    """
    held = {}
    for kind, path, what, profile in profiles[["kind", "name", "what", "profile"]].itertuples(index=False, name=None):
        hist, moments = {}, [0, 0.0, 0.0]
        for r in profile:
            if r["bucket"] == -1:
                moments = [r["n"], r["s1"], r["s2"]]
            else:
                hist[r["bucket"]] = r["n"]
        held[kind, path, what] = (hist, moments)
    empty = ({}, [0, 0.0, 0.0])
    old, new = ({k: {f["path"]: f["type"] for f in fields} for k, fields in zip(steps["event_type"], steps[c])} for c in ("old", "new"))
    renamed = match_step(old, new, lambda kind, what, a, b: profile_likeness(what, held.get((kind, a, what), empty), held.get((kind, b, what), empty)))
    out: list[tuple] = []
    for kind in sorted(old):
        a, b = old[kind], new[kind]
        gone = {p: renamed.get((kind, p)) for p in a.keys() - b.keys()}
        out += [(kind, "renamed", p, q) if q else (kind, "removed", p, "") for p, q in gone.items()]
        out += [(kind, "added", p, "") for p in b.keys() - a.keys() - set(gone.values())]
        out += [(kind, "retyped", p, b[p]) for p in a.keys() & b.keys() if a[p] and b[p] and a[p] != b[p]]
    frame = pd.DataFrame(out, columns=["event_type", "change", "field", "detail"])
    frame.insert(0, "feed", steps["feed"].iloc[0] if len(steps) else None)
    frame.insert(1, "file_no", steps["file_no"].iloc[0] if len(steps) else 0)
    return frame


def field_counts(events: DataFrame) -> DataFrame:
    """COUNTS of rows with feed, file_no, schema_version, event_type and payload_json."""
    read = events.select("feed", F.col("file_no").cast("int"), F.col("schema_version").cast("int"), "event_type", "payload_json")
    return merged_counts(read.mapInArrow(profile_partitions, COUNTS))


def merged_counts(parts: DataFrame) -> DataFrame:
    """The tasks' COUNTS rows summed."""
    keys = ["feed", "file_no", "schema_version", "event_type", "path", "type", "bucket"]
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def file_shapes(counts: DataFrame) -> DataFrame:
    """(feed, file_no, event_type, shape): fields and types at the file's highest schema version, an array sorted by path."""
    rows = counts.filter("file_no >= 0")
    top = rows.filter("event_type IS NULL").groupBy("feed", "file_no").agg(F.max("schema_version").alias("schema_version"))
    seen = rows.filter("event_type IS NOT NULL").join(top, ["feed", "file_no", "schema_version"])
    rank = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(FIELD_TYPES) for x in (t, -i)]), F.col("type"))
    best = F.max(F.when(F.col("type").isNotNull(), F.struct("n", rank.alias("rank"), "type")))["type"]
    fields = seen.groupBy("feed", "file_no", "event_type", "path").agg(best.alias("type"))
    held = F.filter(F.collect_list(F.struct("path", "type")), lambda f: f["path"] != "")
    return fields.groupBy("feed", "file_no", "event_type").agg(F.sort_array(held).alias("shape"))


def changes_of(counts: DataFrame) -> DataFrame:
    """CHANGES from COUNTS. Only files whose shape differs from the one before are matched, a feed's file in a task of its own;
    a file's group holds its event types' fields and their profiles of fixed size, so a feed may have any number of files."""
    before = F.lag("shape").over(W.partitionBy("feed", "event_type").orderBy("file_no"))
    steps = file_shapes(counts).withColumn("old", before).filter("old <> shape").select("feed", "file_no", "event_type", "old", F.col("shape").alias("new"))
    without = lambda a, b: F.filter(a, lambda f: ~F.array_contains(F.transform(b, lambda g: g["path"]), f["path"]))
    gone, come = without(F.col("old"), F.col("new")), without(F.col("new"), F.col("old"))
    types = lambda fields: F.filter(F.transform(fields, lambda f: f["type"]), lambda t: t.isNotNull())
    wanted = steps.select("feed", "file_no", "event_type", gone.alias("gone"), come.alias("come")).filter(F.arrays_overlap(types(F.col("gone")), types(F.col("come"))))
    wanted = wanted.select("feed", "file_no", "event_type", F.explode(F.concat("gone", "come")).alias("f")).select("feed", "file_no", "event_type", "f.path", "f.type")
    profiles = counts.filter("file_no = -1").groupBy("feed", "event_type", "path", "type").agg(F.collect_list(F.struct("bucket", "n", "s1", "s2")).alias("profile"))
    held = wanted.join(profiles, ["feed", "event_type", "path", "type"])
    held = held.select(F.col("feed").alias("_feed"), F.col("file_no").alias("_file"), F.col("event_type").alias("kind"), F.col("path").alias("name"), F.col("type").alias("what"), "profile")
    return steps.groupBy("feed", "file_no").cogroup(held.groupBy("_feed", "_file")).applyInPandas(step_changes, CHANGES)


def schema_changes(events: DataFrame) -> DataFrame:
    """Each change of an event type's fields between the consecutive files of a feed, by similarity flooding.

    events: feed, file_no, schema_version, event_type, payload_json; further columns are ignored. Rows with null feed, file or
    version are in no file; unreadable payloads (null, torn, no object) have no fields, but their row still counts for the
    file's highest schema version. Repeated rows change nothing. A field whose values are all null exists without a type and is
    never retyped; where two types are equally frequent, the first of string, number, boolean, array holds. Empty input gives
    no rows.
    """
    return changes_of(cut_lineage(field_counts(events)))


def canonical_names(changes: DataFrame) -> DataFrame:
    """(feed, event_type, path, first): each later name of a field and the name its feed first gave it, from CHANGES rows.

    One group holds the renames of a feed's event type; they stay on the executors.
    """

    def follow(renames: pd.DataFrame) -> pd.DataFrame:
        own: dict[str, str] = {}
        for _, old, new in sorted(renames[["file_no", "field", "detail"]].itertuples(index=False, name=None)):
            if (first := own.get(old, old)) != new:
                own[new] = first
        return pd.DataFrame({"feed": renames["feed"].iloc[0], "event_type": renames["event_type"].iloc[0], "path": list(own), "first": list(own.values())})

    renames = changes.filter("change = 'renamed'").select("feed", "event_type", "file_no", "field", "detail")
    return renames.groupBy("feed", "event_type").applyInPandas(follow, "feed string, event_type string, path string, first string")


def with_names(events: DataFrame, names: DataFrame, ident: str, spread: int = 32) -> DataFrame:
    """events (feed, event_type, ...) with ``names``: a map from later to first names (null without any).

    Names are broadcast where there are at most BROADCAST_NAMES rows of them. Beyond, both sides are shuffled by feed, event type
    and a part of ``spread`` by a hash of ``ident``, with a copy of the names in each part, as one feed may hold a third of all rows.
    """
    maps = names.groupBy("feed", "event_type").agg(F.map_from_entries(F.collect_list(F.struct("path", "first"))).alias("names"))
    if names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        return events.join(F.broadcast(maps), ["feed", "event_type"], "left")
    parts = maps.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    own = events.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(spread)).cast("int"))
    return own.join(parts.hint("shuffle_hash"), ["feed", "event_type", "_part"], "left").drop("_part")


def unified_payloads(events: DataFrame, keep: list[str], changes: DataFrame | None = None) -> DataFrame:
    """All readable payloads as one table with consistent fields.

    Each field bears the name its feed first gave it; the column's type is the one most of its values have over all feeds
    (numbers as double, lists as JSON text), other values are cast where they can be, else null. Columns are ``keep`` and one
    ``f_<path>`` for each field (dots as two underscores), in order of name. Only the list of columns comes to the driver.
    """
    import json

    counts = cut_lineage(field_counts(events))
    names = cut_lineage(canonical_names(changes_of(counts) if changes is None else changes))
    seen = counts.filter("file_no >= 0 AND path <> '' AND type IS NOT NULL").groupBy("feed", "event_type", "path", "type").agg(F.sum("n").alias("n"))
    voted = seen.join(names, ["feed", "event_type", "path"], "left").groupBy(F.coalesce("first", "path").alias("path"), "type").agg(F.sum("n").alias("n")).collect()
    votes: dict[str, Counter] = defaultdict(Counter)
    for path, what, n in voted:  # one row a column of the result and type
        votes[path][what] += n
    order = {t: i for i, t in enumerate(FIELD_TYPES)}
    kinds = {p: min(c, key=lambda t: (-c[t], order[t])) for p, c in sorted(votes.items())}
    column = {p: "f_" + p.replace(".", "__") for p in kinds}
    types = {"string": pa.string(), "number": pa.float64(), "boolean": pa.bool_(), "array": pa.string()}
    words = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}

    def cast(value: object, kind: str) -> object:
        if value is None:
            return None
        if isinstance(value, list) and kind != "array" and len(value) == 1:
            value = value[0]
        if kind == "array":
            return json.dumps(value if isinstance(value, list) else [value])
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value)
        if kind == "boolean":
            return value if isinstance(value, bool) else words.get(str(value).strip().lower())
        if isinstance(value, (int, float)):
            return float(value)
        number = _NUMBER.match(value.strip()) if isinstance(value, str) else None
        return float(number.group()) if number else None

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, names_ = (batch.column(i).to_pylist() for i in (-2, -1))
            held: dict[str, list] = {p: [] for p in kinds}
            good = []
            for i, (payload, known) in enumerate(zip(payloads, names_)):
                if (value := read_payload(payload)) is None:
                    continue
                good.append(i)
                own, row = dict(known or ()), {}
                for path, leaf in leaves(value):
                    name = own.get(path, path)
                    if name in kinds and row.get(name) is None:
                        row[name] = cast(leaf, kinds[name])
                for p, list_ in held.items():
                    list_.append(row.get(p))
            kept = [batch.column(i).take(pa.array(good, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v, types[kinds[p]]) for p, v in held.items())], names=[*keep, *column.values()])

    sql = {"string": "string", "number": "double", "boolean": "boolean", "array": "string"}
    source = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join([*(f"`{k}` {source[k]}" for k in keep), *(f"`{column[p]}` {sql[k]}" for p, k in kinds.items())])
    read = events.select("feed", "event_type", "payload_json", *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    named = with_names(read, names, "payload_json")
    return named.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "payload_json", "names").mapInArrow(rows, schema)
