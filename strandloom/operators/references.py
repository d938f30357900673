"""References to records that do not exist: missing, late or deleted keys."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.functions.keys import folded, normal_path
from strandloom.functions.times import epoch_ms, month_utc
from strandloom.operators.intervals import busy_periods
from strandloom.session import cut_lineage, numbered

EVER, NEVER = -(2**63) + 1, 2**63 - 1
DAY_US = 86_400_000_000
#: Turns of parents per range, references per task, most ranges (whose bounds are broadcast).
RANGE_TURNS, BATCH, MAX_RANGES = 50_000, 200_000, 1_000_000
#: What holds for a key from a turn on, and for a reference.
THERE, MISSING, LATE, DELETED = 0, 1, 2, 3
REASONS = np.array(["", "missing", "late", "deleted"], dtype=object)


def places(keys: np.ndarray, times: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the rows sorted by (key, time) aren't after each wanted (key, at), by binary search for all at once."""
    lo, hi = (np.searchsorted(keys, wanted, side=s) for s in ("left", "right"))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        right = open_ & (times[np.minimum(mid, len(times) - 1)] <= at)
        lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    return lo


def probe(keys: np.ndarray, times: np.ndarray, states: np.ndarray, wanted: np.ndarray, at: np.ndarray, timed: np.ndarray) -> np.ndarray:
    """Index into REASONS for each reference, by binary search in the sorted turns of a range.

    keys, times, states: a range's turns, sorted by key and time. wanted, at, timed: key and instant of each reference, and
    whether the instant is known (else only MISSING can be told).
    """
    if not len(keys):
        return np.full(len(wanted), MISSING, np.int8)
    i = places(keys, times, wanted, np.where(timed, at, NEVER)) - 1
    known = (i >= 0) & (keys[np.maximum(i, 0)] == wanted)
    return np.where(known, np.where(timed, states[np.maximum(i, 0)], THERE), MISSING).astype(np.int8)


def orphan_references(references: DataFrame, turns: DataFrame, range_turns: int = RANGE_TURNS, batch: int = BATCH) -> DataFrame:
    """(ref_table, record_key, reason, at) of the references whose parent doesn't exist at their time.

    references: ref_table, record_key, key, at (microseconds, null: unknown). turns: key, at, state (THERE, LATE or DELETED from
    then on), one row per (key, at), each key's first at EVER. References with a null key are no cases; with an unknown time
    only ``missing`` can be told. Repeated references give one row. Either table may be empty.

    Turns are ranked over the whole table by (key, at) and cut into ranges of equal size, each stored as sorted arrays; a key
    with very many turns lies in several. A range starts with a turn, so a reference's last turn is always in its own range.
    References meet their range in batches of about ``batch`` rows: a range with more references (one parent may draw a third
    of all) is met by several tasks, each with a copy of the range's arrays. The first turns of at most MAX_RANGES ranges are
    broadcast; with more turns than that ranges get larger.
    """
    refs = references.select("ref_table", "record_key", "key", "at").filter("key IS NOT NULL").distinct()
    placed = numbered(turns.select("key", "at", "state"), ["key", "at"], "r")
    size = max(range_turns, math.ceil(placed.count() / MAX_RANGES))
    placed = placed.withColumn("range", F.floor(F.col("r") / size).cast("int"))
    first = placed.filter((F.col("r") % size == 0) & (F.col("r") > 0)).select("key", "at").orderBy("key", "at").toArrow()
    if first.num_rows:
        held = references.sparkSession.sparkContext.broadcast((np.array(first.column("key").to_pylist(), dtype=object), np.asarray(first.column("at"))))

        @F.pandas_udf("int")
        def in_range(keys: pd.Series, at: pd.Series) -> pd.Series:
            return pd.Series(places(*held.value, keys.to_numpy(dtype=object), at.to_numpy(dtype=np.int64)).astype(np.int32))

        where: Column = in_range("key", F.coalesce("at", F.lit(NEVER)))
    else:
        where = F.lit(0)
    refs = cut_lineage(refs.withColumn("range", where))
    tasks = refs.groupBy("range").agg(F.ceil(F.count("*") / batch).cast("int").alias("tasks"))  # a row a range at most
    refs = refs.join(F.broadcast(tasks), "range").withColumn("task", F.pmod(F.xxhash64("ref_table", "record_key", "at"), F.col("tasks")).cast("int"))
    stored = placed.groupBy("range").agg(F.sort_array(F.collect_list(F.struct("key", "at", "state"))).alias("t"))
    stored = stored.join(F.broadcast(tasks), "range").select(F.col("range").alias("_range"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("_task"), F.col("t.key").alias("keys"), F.col("t.at").alias("times"), F.col("t.state").alias("states"))

    def meet(refs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        keys, times, states = (np.asarray(held[c].iloc[0] if len(held) else [], dtype=t) for c, t in (("keys", object), ("times", np.int64), ("states", np.int8)))
        timed = refs["at"].notna().to_numpy()
        code = probe(keys, times, states, refs["key"].to_numpy(dtype=object), refs["at"].fillna(0).to_numpy(dtype=np.int64), timed)
        hit = code != THERE
        return pd.DataFrame({"ref_table": refs["ref_table"][hit], "record_key": refs["record_key"][hit], "reason": REASONS[code[hit]], "at": refs["at"][hit].astype("Int64")})

    return refs.groupBy("range", "task").cogroup(stored.groupBy("_range", "_task")).applyInPandas(meet, "ref_table string, record_key string, reason string, at long")


def session_turns(sessions: DataFrame) -> DataFrame:
    """Turns of sessions: there from created_at on, away from a deletion until the next row of another status.

    Of rows at the same instant one that isn't deleted holds. Without a readable created_at a session was always there; a row
    without a readable updated_at has no say in deletions. Turns are found within a key's days; only a day's first and last
    row are compared across days.
    """
    rows = sessions.select(folded(F.col("id")).alias("key"), (epoch_ms(F.col("created_at")) * 1000).alias("made"), (epoch_ms(F.col("updated_at")) * 1000).alias("at"), F.coalesce(folded(F.col("status")) == "deleted", F.lit(False)).alias("gone")).filter("key <> ''")
    rows = cut_lineage(rows.groupBy("key", "at").agg(F.min("made").alias("made"), F.min("gone").alias("gone")))
    first = rows.groupBy("key").agg(F.coalesce(F.min("made"), F.lit(EVER)).alias("first"))
    steps = rows.filter("at IS NOT NULL").withColumn("day", F.floor(F.col("at") / DAY_US))
    daily = W.partitionBy("key", "day").orderBy("at")
    ends = steps.groupBy("key", "day").agg(F.max_by("gone", "at").alias("end"))
    before = ends.select("key", "day", F.lag("end").over(W.partitionBy("key").orderBy("day")).alias("eve"))
    steps = steps.withColumn("was", F.lag("gone").over(daily)).join(before, ["key", "day"])
    turned = steps.filter(~F.coalesce("was", "eve", F.lit(False)).eqNullSafe(F.col("gone"))).select("key", "at", "gone").join(first, "key")
    state = lambda gone: F.when(gone, DELETED).otherwise(THERE)
    made = turned.filter("at <= first").groupBy("key").agg(F.max_by("gone", "at").alias("gone"))
    born = first.join(made, "key", "left").select("key", F.col("first").alias("at"), state(F.coalesce("gone", F.lit(False))).alias("state"))
    later = turned.filter("at > first").select("key", "at", state(F.col("gone")).alias("state"))
    return born.unionByName(later).unionByName(first.filter(F.col("first") > EVER).select("key", F.lit(EVER).alias("at"), F.lit(LATE).alias("state")))


def file_turns(files: DataFrame) -> DataFrame:
    """Turns of indexed paths: there while a row has indexed_at null or not later and deleted_at null or later.

    A null indexed_at counts as earlier than any time.
    """
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    rows = files.select(normal_path(F.col("path")).alias("key"), F.coalesce(us("indexed_at"), F.lit(EVER)).alias("start"), F.coalesce(us("deleted_at"), F.lit(NEVER)).alias("end")).filter("key IS NOT NULL")
    rows = cut_lineage(rows.groupBy("key", "start").agg(F.max("end").alias("end")))
    first = rows.groupBy("key").agg(F.min("start").alias("at")).withColumn("state", F.lit(DELETED))
    early = first.filter(F.col("at") > EVER).select("key", F.lit(EVER).alias("at"), F.lit(LATE).alias("state"))
    there = busy_periods(rows, "key").filter("kind = 'period'").select("entity", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(THERE).alias("state")), F.struct(F.col("end").alias("at"), F.lit(DELETED).alias("state")))).alias("t"))
    turns = first.unionByName(early).unionByName(there.select(F.col("entity").alias("key"), "t.at", "t.state").filter(F.col("at") < NEVER))
    return turns.groupBy("key", "at").agg(F.min("state").alias("state"))


def thread_references(threads: DataFrame) -> DataFrame:
    key = folded(F.col("session_id"))
    return threads.select(F.lit("threads").alias("ref_table"), F.col("id").alias("record_key"), F.when(key != "", key).alias("key"), (epoch_ms(F.col("created_at")) * 1000).alias("at"))


def dependency_references(dependencies: DataFrame) -> DataFrame:
    """recorded_at above 1e11 is in milliseconds, else in seconds; dependencies of type system are none."""
    at = F.col("recorded_at")
    us = F.round(F.when(at > 1e11, at / 1000).otherwise(at) * 1_000_000).cast("bigint")
    path = F.col("target_path")
    rows = dependencies.filter("dep_type IS NULL OR lower(trim(dep_type)) <> 'system'")
    return rows.select(F.lit("file_dependencies").alias("ref_table"), F.col("dep_id").cast("string").alias("record_key"), F.when(F.trim(path) != "", normal_path(path)).alias("key"), F.when(~F.isnan(at), us).alias("at"))


def orphans(sessions: DataFrame, threads: DataFrame, files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """ref_table, record_key, reason, period of each orphan reference of both tables."""
    found = orphan_references(thread_references(threads), session_turns(sessions)).unionByName(orphan_references(dependency_references(dependencies), file_turns(files)))
    period = F.coalesce(month_utc(F.floor(F.col("at") / 1000)), F.lit("unknown"))
    return found.select("ref_table", "record_key", "reason", period.alias("period")).distinct()
