"""Applying a feed of inserts, updates and deletes: a signed multiset of before- and after-images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Versions of one table in a chunk. Versions are unique once copies are removed, so no chunk of a key can hold more rows.
CHUNK = 65_536


def last_copies(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with equal ``keys`` the one with the highest ``order`` (null lowest), aggregated on the map side first."""
    rest = [c for c in changes.columns if c not in (*keys, order)]
    picked = changes.groupBy(*keys).agg(F.max(F.struct(F.coalesce(F.col(order), F.lit(-(2**63))).alias("_o"), *rest)).alias("_r"))
    return picked.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def apply_changes(changes: DataFrame, scope: str, key: str, order: str, op: str, values: list[str], base: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """Current rows (scope, key, *values, order) after changes applied in ``order``.

    changes: one row per (scope, order), the copies already removed. ``op``: 'insert' puts the row or replaces it whole,
    'update' sets the values that aren't null and does nothing to an absent row, 'delete' removes it; any other op, and rows
    with a null scope, key or order, do nothing. base: rows in the result's columns from before all changes (their order is
    lower); empty tables are allowed on both sides.

    Each change that takes effect contributes the row before it with -1 and the row after it with +1; the multiplicities are
    summed with the base's, and rows with a positive sum remain. The images come from running values within chunks of
    ``chunk`` consecutive orders of a key; only one row per chunk crosses chunks, and equal images of neighbouring changes
    cancel in the map-side sum. A key with a third of all changes is thus spread over many groups of bounded size.
    """
    v = [f"_v{i}" for i in range(len(values))]
    rows = changes.filter(F.col(op).isin("insert", "update", "delete") & F.col(scope).isNotNull() & F.col(key).isNotNull() & F.col(order).isNotNull())
    rows = rows.select(F.col(scope).alias("_s"), F.col(key).alias("_k"), F.col(order).cast("bigint").alias("_n"), F.col(op).alias("_op"), *(F.col(c).alias(x) for c, x in zip(values, v)))
    if base is not None:
        start = base.select(F.col(scope).alias("_s"), F.col(key).alias("_k"), F.col(order).cast("bigint").alias("_n"), F.lit("base").alias("_op"), *(F.col(c).alias(x) for c, x in zip(values, v)))
        rows = rows.unionByName(start)
    rows = rows.withColumn("_c", F.floor(F.col("_n") / chunk))
    put, gone = F.col("_op").isin("insert", "base"), F.col("_op") == "delete"
    inside = W.partitionBy("_s", "_k", "_c").orderBy("_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_e", F.sum((put | gone).cast("int")).over(inside))
    epoch = W.partitionBy("_s", "_k", "_c", "_e").orderBy("_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.select("*", F.first("_op").over(epoch).alias("_head"), F.max("_n").over(epoch).alias("_at"), *(F.last(x, ignorenulls=True).over(epoch).alias(f"{x}_run") for x in v))

    # what a chunk leaves behind: its last epoch, or, with no insert or delete in it, the values it sets
    ends = rows.groupBy("_s", "_k", "_c").agg(F.max(F.struct("_n", "_e", "_head", *(f"{x}_run" for x in v))).alias("z"))
    ends = ends.select("_s", "_k", "_c", F.col("z._n").alias("_n"), F.when(F.col("z._e") > 0, F.col("z._head")).alias("_head"), *(F.col(f"z.{x}_run").alias(x) for x in v))
    over = W.partitionBy("_s", "_k").orderBy("_c")
    ends = ends.withColumn("_e", F.count("_head").over(over.rowsBetween(W.unboundedPreceding, W.currentRow)))
    within = W.partitionBy("_s", "_k", "_e").orderBy("_c").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = ends.select("_s", "_k", "_c", F.max("_head").over(within).alias("_head"), F.max("_n").over(within).alias("_n"), *(F.last(x, ignorenulls=True).over(within).alias(x) for x in v))
    carried = ends.select("_s", "_k", "_c", *(F.lag(c).over(over).alias(f"{c}_in") for c in ("_head", "_n", *v))).filter(F.col("_head_in").isNotNull())
    rows = rows.join(carried.hint("merge"), ["_s", "_k", "_c"], "left")  # grows with long-lived keys, so it is never broadcast

    early = F.col("_e") == 0
    alive = F.coalesce(F.when(early, F.col("_head_in")).otherwise(F.col("_head")) != "delete", F.lit(False))
    image = F.struct(F.col("_n").alias("_n"), *(F.when(early, F.coalesce(f"{x}_run", f"{x}_in")).otherwise(F.col(f"{x}_run")).alias(x) for x in v))
    rows = rows.withColumn("_after", F.when(alive, image))
    entering: Column = F.when(F.col("_head_in") != "delete", F.struct(F.col("_n_in").alias("_n"), *(F.col(f"{x}_in").alias(x) for x in v)))
    step = W.partitionBy("_s", "_k", "_c").orderBy("_n")
    rows = rows.withColumn("_before", F.when(F.row_number().over(step) == 1, entering).otherwise(F.lag("_after").over(step)))
    signed = rows.select("_s", "_k", F.explode(F.array(F.struct(F.when(F.col("_op") != "base", F.col("_before")).alias("i"), F.lit(-1).alias("m")), F.struct(F.col("_after").alias("i"), F.lit(1).alias("m")))).alias("x"))
    signed = signed.filter("x.i IS NOT NULL").select("_s", "_k", "x.i._n", *(f"x.i.{x}" for x in v), "x.m")
    kept = signed.groupBy("_s", "_k", "_n", *v).agg(F.sum("m").alias("m")).filter("m > 0")
    return kept.select(F.col("_s").alias(scope), F.col("_k").alias(key), *(F.col(x).alias(c) for c, x in zip(values, v)), F.col("_n").alias(order))
