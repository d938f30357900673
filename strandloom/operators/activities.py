"""Activity changes read from workflow events whose payload fields drift."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions.payloads import leaves, read_payload
from strandloom.operators.change_feed import apply_changes, last_copies
from strandloom.operators.schema_drift import COUNTED, COUNTS, COUNTED_TYPES, canonical_names, changes_of, merged_counts, profile_read, with_names
from strandloom.session import cut_lineage, stored

OPS = {"activity_scheduled": "insert", "activity_started": "update", "activity_completed": "update", "activity_failed": "update", "activity_cancelled": "delete"}
FIELDS = ("activity_id", "status", "attempt")
_EVENT = ("workflow_id", "version", "ingest_id", "feed", "event_type", "op")
_READ_SQL = f"workflow_id string, version long, ingest_id long, op string, fields array<struct<path:string,text:string,num:int>>, {COUNTS}"
_LEAF = pa.struct([("path", pa.string()), ("text", pa.string()), ("num", pa.int32())])
_READ = pa.schema([("workflow_id", pa.string()), ("version", pa.int64()), ("ingest_id", pa.int64()), ("op", pa.string()), ("fields", pa.list_(_LEAF)), *((f.name, f.type) for f in COUNTED_TYPES)])
_STARTS = frozenset("+-0123456789 \t")
_INT = re.compile(r"[+-]?\d+")


def as_text(value: object) -> str | None:
    if isinstance(value, list):
        value = value[0] if len(value) == 1 else json.dumps(value) if value else None
    if value is None or isinstance(value, str):
        return value
    return str(value) if type(value) is int else json.dumps(value)


def as_int(value: object) -> int | None:
    """A whole number in whatever type: 3, 3.0, "3", "3 u" or [3]; else None."""
    if isinstance(value, list):
        value = value[0] if len(value) == 1 else None
    if isinstance(value, str):
        found = _INT.match(value.strip()) if value[:1] in _STARTS else None
        value = int(found.group()) if found else None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) >= 2**31:
        return None
    return int(value)


def read_events(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_READ rows of (workflow_id, version, ingest_id, feed, file_no, schema_version, event_type, payload): one for each readable
    event of a workflow, with the leaves of activity events as text and number, and the COUNTS of the activity events' fields."""

    held: dict[str, list] = {c: [] for c in _EVENT}
    ends, paths, texts, numbers = [0], [], [], []

    def wide(made: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(n, f.type) for f in _READ], schema=_READ)

    def events() -> pa.RecordBatch:
        made = {c: pa.array(x, _READ.field(c).type) for c, x in held.items()}
        leaf = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string()), pa.array(numbers, pa.int32())], fields=list(_LEAF))
        made["fields"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf)
        out = wide(made, len(held["workflow_id"]))
        for x in (*held.values(), paths, texts, numbers):
            x.clear()
        ends[:] = [0]
        return out

    def profiled() -> Iterator[tuple[list, list[list]]]:
        """The activity events for the profile; on the way, what every event is read as goes into ``held``."""
        add = [held[c].append for c in _EVENT]
        for batch in batches:
            wf, version, ingest, *keys, payloads = (c.to_pylist() for c in batch.columns)
            read = []
            for i, (w, v, n, feed, kind, payload) in enumerate(zip(wf, version, ingest, keys[0], keys[3], payloads)):
                op = OPS.get(kind)
                value = read_payload(payload)
                fields = None
                if op is not None:
                    fields = None if value is None else list(leaves(value))
                    read.append((i, fields))
                if value is None or w is None or v is None:
                    continue
                for put, x in zip(add, (w, v, n, feed, kind, op)):
                    put(x)
                for path, x in fields or ():
                    if x is not None:
                        paths.append(path)
                        if type(x) is str:
                            texts.append(x)
                            numbers.append(as_int(x) if x[:1] in _STARTS else None)
                        else:
                            texts.append(as_text(x))
                            numbers.append(as_int(x))
                ends.append(len(paths))
            yield read, keys

    for counts in profile_read(profiled()):
        if counts is not None:
            yield wide(dict(zip(counts.schema.names, counts.columns)), counts.num_rows)
        if len(ends) > 10_000:
            yield events()
    yield events()


def activity_changes(events: DataFrame, names: DataFrame) -> DataFrame:
    """Readable events (as of read_events) as changes; other event types stay with a null op, as they may be the copy that counts.

    A field is the leaf of its first name, else one that bears it under a later name (names: feed, event_type, path, first).
    """
    read = with_names(events.select(*_EVENT, "fields"), names, "ingest_id")

    def field(name: str, part: str) -> Column:
        own = F.filter("fields", lambda f: f["path"] == name)
        later = F.filter("fields", lambda f: F.element_at("names", f["path"]) == name)
        return F.coalesce(F.get(own, 0), F.get(later, 0))[part].alias(name)

    return read.select("workflow_id", "version", "ingest_id", "op", field("activity_id", "text"), field("status", "text"), field("attempt", "num"))


def current_activities(events: DataFrame) -> DataFrame:
    """The current row of each activity that still exists: workflow_id, activity_id, status, attempt, version.

    Field names come from the schema changes found by similarity flooding. Payloads are read once: events and counts of their
    fields are kept as one table. Unreadable events and events with a null workflow or version are ignored; of the copies of a
    (workflow_id, version) the last readable by ingest_id counts, whatever its type; an activity event without an activity_id
    does nothing.
    """
    columns = ["workflow_id", F.col("version").cast("bigint"), F.col("ingest_id").cast("bigint"), "feed", F.col("file_no").cast("int"), F.col("schema_version").cast("int"), "event_type", "payload_json"]
    read = stored(events.select(*columns).mapInArrow(read_events, _READ_SQL))
    counts = cut_lineage(merged_counts(read.filter("n IS NOT NULL").select(*COUNTED)))
    names = cut_lineage(canonical_names(changes_of(counts)).filter(F.col("first").isin(*FIELDS)))
    changes = last_copies(activity_changes(read.filter("n IS NULL"), names), ["workflow_id", "version"], "ingest_id")
    return apply_changes(changes, "workflow_id", "activity_id", "version", "op", ["status", "attempt"]).select("workflow_id", "activity_id", "status", F.col("attempt").cast("int"), "version")
