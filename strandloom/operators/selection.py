"""Smaller selections, resolutions and checks that the other families share."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def entities(text: Column, patterns: dict[str, tuple[str, int]]) -> dict[str, Column]:
    """Distinct matches of each pattern's first group in order of appearance, at most the given number of each."""
    return {n: F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1))), 1, most) for n, (p, most) in patterns.items()}


def within_tokens(text: Column, budget: int) -> Column:
    """Longest prefix whose estimate (characters over four, rounded down, plus one) is within the budget: closed form."""
    return F.substring(text, 1, max(0, 4 * budget - 1))


def table_quality(confidence: Column, has_headers: Column, fill: Column, ragged: Column, has_box: Column, suspect: Column) -> Column:
    """Confidence lowered by a factor for each defect of an extracted table, at most 0.98."""
    score = confidence * F.when(has_headers, 1.0).otherwise(0.7) * F.when(fill < 0.5, 0.8).otherwise(1.0) * F.when(ragged, 0.75).otherwise(1.0) * F.when(has_box, 1.0).otherwise(0.85) * F.when(suspect, 0.7).otherwise(1.0)
    return F.least(score, F.lit(0.98))


def trivial(text: Column, pattern: str, least: int = 10) -> Column:
    """Null, shorter than ``least`` or matching the pattern as a whole."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) < least) | F.lower(t).rlike(f"^(?:{pattern})$")


def read_until(log: DataFrame, key: str, order: str, stop: Column) -> DataFrame:
    """Rows of each key up to and with the first that stops; all where none does."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return log.withColumn("_seen", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0))).filter("_seen = 0").drop("_seen")


def preferred_definition(uses: DataFrame, definitions: DataFrame, name: str) -> DataFrame:
    """(use_id, def_id, cross_file): one definition a use, another file's first, then the least id. Definitions are reduced to
    two a name before the join: the least id of all and the least in another file than that."""
    least = definitions.groupBy(name).agg(F.min(F.struct("def_id", "def_file")).alias("a"))
    rest = definitions.join(least, name).filter(F.col("def_file") != F.col("a.def_file")).groupBy(name).agg(F.min(F.struct("def_id", "def_file")).alias("b"))
    both = uses.join(least, name).join(rest, name, "left")
    pick = F.when(F.col("a.def_file") != F.col("use_file"), F.col("a")).otherwise(F.coalesce("b", "a"))
    return both.select("use_id", pick["def_id"].alias("def_id"), (pick["def_file"] != F.col("use_file")).alias("cross_file"))


def fan_in(branches: DataFrame, join: str, done: Column, ok: Column, quorum: int) -> DataFrame:
    """Per join: whether ALL, ANY, QUORUM succeeded and ALL_COMPLETED holds."""
    n = branches.groupBy(join).agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if(ok).alias("ok"))
    return n.select(join, (F.col("ok") == F.col("n")).alias("all_ok"), (F.col("ok") > 0).alias("any_ok"), (F.col("ok") >= quorum).alias("quorum_ok"), (F.col("done") == F.col("n")).alias("all_done"))


def latest_versions(rows: DataFrame, key: list[str], version: str, order: str, copies: str) -> DataFrame:
    """Latest version of each key (on a tie the later row) with the copies of all its rows summed."""
    rest = [c for c in rows.columns if c not in (*key, copies)]
    out = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, order)).alias("_r"), F.sum(copies).alias(copies))
    return out.select(*key, *(F.col(f"_r.{c}").alias(c) for c in rest), copies)


def positional_differences(a: DataFrame, b: DataFrame, place: str, digest: str) -> DataFrame:
    """Places at which two sequences of digests differ, those only one of them has included."""
    both = a.select(place, F.col(digest).alias("_a")).join(b.select(place, F.col(digest).alias("_b")), place, "full_outer")
    return both.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(place)


def kept_episodes(rows: DataFrame, key: str, order: str, importance: str, last: int, above: float, most: int) -> DataFrame:
    """The last ``last`` rows of a key and those of more importance than ``above``; of these the last ``most``."""
    w = W.partitionBy(key).orderBy(F.desc(order))
    first = rows.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= last) | (F.col(importance) > above))
    return first.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def within_bytes(rows: DataFrame, group: str, order: list[Column], body: Column, most: int, limit: int) -> DataFrame:
    """The first ``most`` rows of a group whose bodies together stay within ``limit`` bytes (rows are cut from the end)."""
    w = W.partitionBy(group).orderBy(*order)
    run = F.sum(F.octet_length(body)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumns({"_n": F.row_number().over(w), "bytes": run}).filter((F.col("_n") <= most) & (F.col("bytes") <= limit)).drop("_n")


def bloom_size(n: float, p: float) -> tuple[int, int]:
    """Bits and hash functions of a Bloom filter for n keys at a false positive rate p."""
    bits = math.floor(-n * math.log(p) / math.log(2) ** 2) + 1
    return bits, max(1, math.floor(bits / n * math.log(2)))


def bloom_filtered(rows: DataFrame, keys: DataFrame, key: str, expected: int = 100_000, p: float = 0.01) -> DataFrame:
    """``rows`` whose key may be in ``keys``: no match is lost, about p of the others pass. The filter is one array of fixed size
    for ``expected`` keys, gathered bit by bit over the tasks; use it before an exact semi join."""
    bits, k = bloom_size(expected, p)

    def places(column: Column) -> list[Column]:
        a, b = F.xxhash64(column), F.hash(column).cast("bigint")
        return [F.pmod(F.shiftright(a, 1) + i * b, F.lit(bits)) for i in range(k)]

    words = keys.select(F.explode(F.array(*places(F.col(key)))).alias("b")).groupBy(F.floor(F.col("b") / 63).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 63 as int))")).alias("m"))
    held = np.zeros(bits // 63 + 1, np.int64)
    for w, m in words.collect():  # at most bits / 63 rows
        held[w] = m
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for i in range(k):
                b = np.asarray(batch.column(batch.num_columns - k + i))
                ok &= (shared.value[b // 63] >> (b % 63)) & 1 == 1
            yield batch.select(range(batch.num_columns - k)).filter(pa.array(ok))

    probed = rows.select("*", *(c.alias(f"_b{i}") for i, c in enumerate(places(F.col(key)))))
    return probed.mapInArrow(keep, rows.schema)


def fuzzy_score(query: str, text: Column) -> Column:
    """1 for an equal text, 0.8 where it holds the query, 0.6 where the query's letters occur in order, else 0."""
    t, q = F.lower(F.coalesce(text, F.lit(""))), query.lower()
    chain = "".join(("\\" + c if not c.isalnum() else c) + ".*" for c in q)
    return F.when(t == q, 1.0).when(t.contains(q), 0.8).when(t.rlike("(?s)" + chain), 0.6).otherwise(0.0)


def trimmed_list(items: Column) -> Column:
    """Trimmed texts in order, blanks and repetitions dropped."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def packed_snippets(rows: DataFrame, group: str, ident: str, order: list[str], text: str, budget: int) -> DataFrame:
    """(group, ident, snippet): snippets in order while their token estimates fit, equal texts (white space aside) once; the
    first that doesn't fit is cut at a line and ends the group.

    A snippet takes a token at least, so a group's first ``budget`` + 1 different texts decide; those beyond the running sum are left
    out too, before any text is shuffled. ident must be unique.
    """
    kinds = dict(rows.dtypes)
    norm = F.md5(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))
    sizes = rows.select(group, *dict.fromkeys([ident, *order]), norm.alias("_t"), (F.floor(F.octet_length(F.coalesce(F.col(text), F.lit(""))) / 4) + 1).alias("_n"))
    first = sizes.groupBy(group, "_t").agg(F.min(F.struct(*(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), F.col(ident).alias("_i"), "_n")).alias("_f"))
    lead = W.partitionBy(group).orderBy(*(f"_f._o{i}" for i in range(len(order))), "_f._i")
    few = first.withColumn("_r", F.row_number().over(lead)).filter(F.col("_r") <= budget + 1)
    few = few.withColumn("_before", F.coalesce(F.sum("_f._n").over(lead.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") <= budget)
    rows = rows.join(few.select(F.col("_f._i").alias(ident)), ident, "left_semi")
    size = lambda s: len(s.encode()) // 4 + 1

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, seen, out = budget, set(), []
        for g, i, t in pdf.sort_values(order)[[group, ident, text]].itertuples(index=False):
            t = t or ""
            if (norm := " ".join(t.split())) in seen:
                continue
            seen.add(norm)
            if size(t) <= left:
                left -= size(t)
                out.append((g, i, t))
                continue
            cut = ""
            for line in t.split("\n"):
                longer = f"{cut}\n{line}" if cut else line
                if size(longer) > left:
                    break
                cut = longer
            if cut:
                out.append((g, i, cut))
            break
        return pd.DataFrame(out, columns=[group, ident, "snippet"])

    return rows.select(*dict.fromkeys([group, ident, *order, text])).groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, {ident} {kinds[ident]}, snippet string")


def trust_scores(rows: DataFrame, tool: str, ok: Column, severe: Column, critical: Column, age_days: Column, decay: float = 0.02) -> DataFrame:
    """(tool, score): success rate times recency max(0.5, 1 - age * decay), 0.3 less a severe incident, 0 after a critical one."""
    n = rows.groupBy(tool).agg(F.avg(ok.cast("double")).alias("rate"), F.count_if(severe).alias("severe"), F.max(critical.cast("int")).alias("critical"), F.min(age_days).alias("age"))
    score = F.greatest(F.col("rate") * F.greatest(F.lit(0.5), 1 - F.col("age") * decay) - 0.3 * F.col("severe"), F.lit(0.0))
    return n.select(tool, F.round(F.when(F.col("critical") == 1, 0.0).otherwise(score), 6).alias("score"))


def collectable(snapshots: DataFrame, ident: str, referenced: Column, age: Column, accessed: str, oldest: float, most: int) -> DataFrame:
    """Snapshots to drop: unreferenced ones older than ``oldest``, and the least recently accessed unreferenced beyond ``most``."""
    old = snapshots.filter(~referenced & (age > oldest)).select(ident)
    beyond = snapshots.orderBy(F.desc(accessed), ident).limit(most).select(ident)
    return old.union(snapshots.filter(~referenced).join(beyond, ident, "left_anti").select(ident)).distinct()


def stale_keys(cache: DataFrame, updates: DataFrame, document: str, generation: str) -> DataFrame:
    """Cached keys whose document was updated in a later generation."""
    newest = updates.groupBy(document).agg(F.max(generation).alias("_g"))
    return cache.join(newest, document).filter(F.col("_g") > F.col(generation)).drop("_g")
