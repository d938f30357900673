"""Append-only event logs: scans, paging, ordering checks, diffs, folds, integrity and trailing windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.session import numbered


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (then in the session's)."""
    return F.unix_micros(time.cast("timestamp"))


def scan(log: DataFrame, types: list[str] | None = None, since=None, until=None, predicate: Column | None = None, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Rows of the given types with since <= time <= until (both inclusive) for which the predicate holds."""
    out = log
    if types is not None:
        out = out.filter(F.col(kind).isin(types))
    if since is not None:
        out = out.filter(F.col(time) >= F.lit(since))
    if until is not None:
        out = out.filter(F.col(time) <= F.lit(until))
    return out if predicate is None else out.filter(predicate)


def partition_name(time: Column, by: str) -> Column:
    """Partition of a log by day, hour or ISO week (with the ISO year), else 'main'."""
    if by == "day":
        return F.date_format(time, "yyyy-MM-dd")
    if by == "hour":
        return F.date_format(time, "yyyy-MM-dd-HH")
    if by == "week":
        thursday = F.date_add(F.date_trunc("week", time).cast("date"), 3)
        return F.format_string("%d-W%02d", F.year(thursday), F.weekofyear(time))
    return F.lit("main")


def with_offsets(log: DataFrame, partition: list[str], order: list[str], name: str = "offset", start: int = 0) -> DataFrame:
    """Gap-free offsets per partition in a total order."""
    return log.withColumn(name, (F.row_number().over(W.partitionBy(*partition).orderBy(*order)) - 1 + start).cast("bigint"))


def page(log: DataFrame, offset: int, limit: int, by: str = "offset") -> DataFrame:
    """A page of every partition: offset and limit hold for each by itself."""
    return log.filter((F.col(by) >= offset) & (F.col(by) < offset + limit))


def partition_bounds(log: DataFrame, partition: str, time: str, order: str) -> DataFrame:
    """Rows, and the times of the first and last line in file order (not the least and greatest time)."""
    return log.groupBy(partition).agg(F.count("*").alias("n"), F.min_by(time, order).alias("first_ts"), F.max_by(time, order).alias("last_ts"))


def sequence_gaps(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, expected, actual) where a sequence isn't its predecessor plus one; repeated numbers count too."""
    rows = with_previous(log.select(key, sequence), key, [sequence], [sequence])
    return rows.select(key, (F.col(f"previous_{sequence}") + 1).alias("expected"), F.col(sequence).alias("actual")).filter("expected IS NOT NULL AND expected <> actual")


def with_previous(log: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """``log`` with ``previous_<column>`` of the row before in the key's ``order`` (total up to equal rows; null for the first).

    Rows are ranked over the whole table by range partitions and joined with the next rank, so no key is sorted in one task.
    """
    rows = numbered(log, [key, *order], "_r")
    before = rows.select((F.col("_r") + 1).alias("_r"), F.col(key).alias("_k"), *(F.col(c).alias(f"_p_{c}") for c in columns))
    both = rows.join(before, "_r", "left")
    own = F.col("_k") == F.col(key)
    return both.select(*log.columns, *(F.when(own, F.col(f"_p_{c}")).alias(f"previous_{c}") for c in columns))


def last_n(log: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key; order is descending and total."""
    return log.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, modified or removed between two snapshots with unique keys."""
    both = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_in_a")).join(new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_in_b")), key, "full_outer")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def replay_diff(a: DataFrame, b: DataFrame, offset: str, digest: str) -> DataFrame:
    """snapshot_diff of two replays by offset."""
    return snapshot_diff(a, b, offset, digest)


def order_mismatches(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str, partition: str) -> DataFrame:
    """(partition, key, place_a, place_b): common keys whose place differs between two orders."""
    common = a.select(partition, key, order_a).join(b.select(partition, key, order_b), [partition, key])
    place = lambda c: F.row_number().over(W.partitionBy(partition).orderBy(c, key)).cast("bigint")
    return common.select(partition, key, place(order_a).alias("place_a"), place(order_b).alias("place_b")).filter("place_a <> place_b")


def fold_state(log: DataFrame, key: str, order: str, field: str, value: str) -> DataFrame:
    """Last value of each field of a key, in order; nulls overwrite too."""
    return log.groupBy(key, field).agg(F.max_by(F.struct(value), order)[value].alias(value))


def row_checksum(*columns: Column) -> Column:
    """SHA-256 of the columns as text, joined by bars; null is written as an empty text."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def chain_breaks(log: DataFrame, key: str, order: str, digest: str, previous: str) -> DataFrame:
    """(key, first_break, n_breaks): rows whose ``previous`` isn't the predecessor's digest; a first row needs ''."""
    rows = with_previous(log.select(key, order, digest, previous), key, [order], [digest])
    return rows.withColumn("_want", F.coalesce(f"previous_{digest}", F.lit(""))).filter(~F.col(previous).eqNullSafe(F.col("_want"))).groupBy(key).agg(F.min(order).alias("first_break"), F.count("*").alias("n_breaks"))


def trailing_count(log: DataFrame, key: list[str], time: str, seconds: float, flag: Column, name: str = "trailing") -> DataFrame:
    """How many flagged rows of the key lie within ``seconds`` before a row, itself included."""
    us = micros(F.col(time))
    window = W.partitionBy(*key).orderBy(us).rangeBetween(-int(seconds * 1_000_000), 0)
    return log.withColumn(name, F.count_if(flag).over(window))


def trailing_rate(log: DataFrame, key: str, time: str, seconds: float) -> DataFrame:
    """(key, n, rate): messages a second over the last ``seconds`` of a key, (n - 1) / (last - first); 0 for fewer than two."""
    us = micros(F.col(time))
    last = log.groupBy(key).agg(F.max(us).alias("_top"))
    rows = log.join(last, key).filter(us >= F.col("_top") - int(seconds * 1_000_000)).groupBy(key).agg(F.count("*").alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi"))
    rate = F.when((F.col("n") >= 2) & (F.col("hi") > F.col("lo")), (F.col("n") - 1) / ((F.col("hi") - F.col("lo")) / 1e6)).otherwise(F.lit(0.0))
    return rows.select(key, "n", F.round(rate, 6).alias("rate"))


def rate_limited(log: DataFrame, key: str, time: str, order: str, limit: int, seconds: float) -> DataFrame:
    """(key, order, allowed): at most ``limit`` allowed calls in any trailing window; rejected calls don't consume.

    Each decision depends on earlier ones, so a key is folded in order, in Arrow batches by one task; the state is one deque of
    at most ``limit`` times.
    """
    from collections import deque

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_us", order])
        recent: deque = deque()
        allowed = []
        for t in pdf["_us"].to_numpy():
            while recent and recent[0] <= t - seconds * 1e6:
                recent.popleft()
            ok = len(recent) < limit
            if ok:
                recent.append(t)
            allowed.append(ok)
        return pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": allowed})

    types = dict(log.dtypes)
    return log.select(key, order, micros(F.col(time)).alias("_us")).groupBy(key).applyInPandas(fold, f"{key} {types[key]}, {order} {types[order]}, allowed boolean")


def flush_groups(stream: DataFrame, key: str, order: str, boundary: Column) -> DataFrame:
    """Group number of each token: a boundary token closes its group."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return stream.withColumn("flush", F.coalesce(F.sum(boundary.cast("int")).over(before), F.lit(0)).cast("bigint"))


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Upsert: the row that comes last by ``order`` (total) of each key, with partial aggregation before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def correlated(log: DataFrame, key: str, time: str, ident: str, seconds: float) -> DataFrame:
    """(ident, n_near): other rows of the key less than ``seconds`` away, by a range window instead of a self join."""
    reach = int(seconds * 1_000_000) - 1
    width = 60 * (reach + 1)
    rows = log.select(key, ident, micros(F.col(time)).alias("_us")).withColumn("_c", F.floor(F.col("_us") / width))
    # a slice of time takes the rows of its neighbours that reach into it, so few keys still make many groups
    own = F.struct(F.col("_c").alias("c"), F.lit(True).alias("own"))
    edge = lambda near, step: F.when(near, F.struct((F.col("_c") + step).alias("c"), F.lit(False).alias("own")))
    place = F.col("_us") - F.col("_c") * width
    copies = F.filter(F.array(own, edge(place <= reach, -1), edge(place >= width - reach, 1)), lambda x: x.isNotNull())
    spread = rows.select(key, ident, "_us", F.explode(copies).alias("_x"))
    near = F.count("*").over(W.partitionBy(key, "_x.c").orderBy("_us").rangeBetween(-reach, reach)) - 1
    return spread.withColumn("n_near", near).filter("_x.own").select(ident, "n_near")


def causal_lookback(log: DataFrame, key: str, time: str, ident: str, symptom: Column, seconds: float) -> DataFrame:
    """(ident, symptom_id, score): rows strictly before the key's next symptom, scored 0.4 * (1 - d) within a second and 0.2
    within ``seconds``; others are left out."""
    us = micros(F.col(time))
    after = W.partitionBy(key).orderBy(us, ident).rowsBetween(1, W.unboundedFollowing)
    nxt = F.first(F.when(symptom, F.struct(us.alias("us"), F.col(ident).alias("id"))), ignorenulls=True).over(after)
    d = (F.col("n.us") - us) / 1e6
    rows = log.withColumn("n", nxt).filter(F.col("n").isNotNull() & (d > 0) & (d <= seconds))
    return rows.select(ident, F.col("n.id").alias("symptom_id"), F.round(F.when(d < 1, 0.4 * (1 - d)).otherwise(F.lit(0.2)), 6).alias("score"))
