"""Lookups and housekeeping: aliases, matched entries, expired partitions, Merkle proofs, deduplication before adding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandloom.operators.chunking import sliding_dedup
from strandloom.operators.graphs import Grown
from strandloom.session import cut_lineage


def alias_resolved(uses: DataFrame, aliases: DataFrame, definitions: DataFrame, project: DataFrame) -> DataFrame:
    """(use_id, target, how): what a name used in a file stands for, the first of: the file's alias, a definition of exactly that
    name, the first definition whose last part is the name, the project's entry; null where there is none.

    uses: (use_id, file, name). aliases: (file, name, target, place). definitions: (qualified, place). project: (name, target,
    place). Of several, the one of the least place holds, reduced to one row a key before the joins. Null names stand for nothing.
    """
    first = lambda df, keys, value: df.groupBy(*keys).agg(F.min_by(value, "place").alias("_t"))
    own = first(aliases, ["file", "name"], "target").withColumnRenamed("_t", "_alias")
    exact = definitions.select(F.col("qualified").alias("name")).distinct().withColumn("_exact", F.col("name"))
    parts = definitions.filter(F.col("qualified").contains(".")).select(F.element_at(F.split("qualified", r"\."), -1).alias("name"), "qualified", "place")
    suffix = first(parts, ["name"], "qualified").withColumnRenamed("_t", "_suffix")
    named = first(project, ["name"], "target").withColumnRenamed("_t", "_project")
    names = uses.select("file", "name").distinct().join(own, ["file", "name"], "left").join(exact, "name", "left").join(suffix, "name", "left").join(named, "name", "left")
    ways = [("alias", "_alias"), ("exact", "_exact"), ("suffix", "_suffix"), ("project", "_project")]
    how = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(w)) for w, c in ways))
    known = names.select("file", "name", F.coalesce(*(c for _, c in ways)).alias("target"), how.alias("how"))
    return uses.join(known, ["file", "name"], "left").select("use_id", "target", "how")


def entries_of(hits: DataFrame, entries: DataFrame, key: str, matched: str) -> DataFrame:
    """entries that were hit, once each, with ``matched_on``: what they were matched on, sorted; hits without an entry are skipped."""
    on = hits.groupBy(key).agg(F.sort_array(F.collect_set(matched)).alias("matched_on"))
    return entries.join(on, key)


def partition_actions(log: DataFrame, partition: Column, time: str, cutoff: Column) -> DataFrame:
    """(partition, n, last_ts, action): 'delete' for a partition whose last row lies before the cutoff, 'compact' for one that the
    cutoff cuts, else 'keep'."""
    p = log.groupBy(partition.alias("partition")).agg(F.count("*").alias("n"), F.min(time).alias("_first"), F.max(time).alias("last_ts"))
    action = F.when(F.col("last_ts") < cutoff, "delete").when(F.col("_first") < cutoff, "compact").otherwise("keep")
    return p.select("partition", "n", "last_ts", action.alias("action"))


def merkle_levels(rows: DataFrame, group: list[str], place: str, digest: str) -> DataFrame:
    """(group, level, p, d): all nodes of each group's tree, leaves at level 0; an odd last node is paired with itself."""
    level = cut_lineage(rows.select(*group, F.lit(0).alias("level"), F.col(place).cast("bigint").alias("p"), F.col(digest).alias("d")))
    tree = Grown()
    n = level.count()
    while n:
        tree.add(level, n)
        many = level.groupBy(*group, (F.col("level") + 1).alias("level"), F.floor(F.col("p") / 2).alias("q")).agg(F.min_by("d", "p").alias("a"), F.max_by("d", "p").alias("b"), F.max("p").alias("top"))
        many = many.withColumn("_last", F.max("top").over(W.partitionBy(*group)))  # a group of one node is done
        level = cut_lineage(many.filter("_last > 0").select(*group, "level", F.col("q").alias("p"), F.sha2(F.concat("a", "b"), 256).alias("d")))
        n = level.count()
    return tree.all() if tree.parts else level


def merkle_proofs(tree: DataFrame, group: list[str]) -> DataFrame:
    """(group, p, digest, proof, root, valid): for each leaf the sibling digests from leaf to root, and whether hashing up them gives
    the root; a tree of one leaf has an empty proof, which isn't valid."""
    height = tree.groupBy(*group).agg(F.max("level").alias("height"), F.max_by("d", "level").alias("root"))
    leaves = tree.filter("level = 0").select(*group, F.col("p").alias("leaf"), F.col("d").alias("digest")).join(height, group)
    steps = leaves.filter("height > 0").select(*group, "leaf", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"))
    steps = steps.withColumn("at", F.floor(F.col("leaf") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint"))
    steps = steps.withColumn("p", F.col("at").bitwiseXOR(F.lit(1).cast("bigint")))
    own = tree.select(*group, "level", F.col("p").alias("at"), F.col("d").alias("_own"))
    found = steps.join(tree.select(*group, "level", "p", "d"), [*group, "level", "p"], "left").join(own, [*group, "level", "at"])
    each = F.struct("level", F.coalesce("d", "_own").alias("d"), (F.col("at") % 2 == 1).alias("left"))
    proof = found.groupBy(*group, "leaf").agg(F.sort_array(F.collect_list(each)).alias("proof"))  # one entry a level
    up = F.aggregate("proof", F.col("digest"), lambda h, x: F.sha2(F.when(x["left"], F.concat(x["d"], h)).otherwise(F.concat(h, x["d"])), 256))
    rows = leaves.join(proof, [*group, "leaf"], "left")
    return rows.select(*group, F.col("leaf").alias("p"), "digest", "proof", "root", F.coalesce(up == F.col("root"), F.lit(False)).alias("valid"))


def checked_and_added(rows: DataFrame, group: str, order: str, content: Column, vector: str, window: int = 20, likeness: float = 0.95) -> DataFrame:
    """(group, order, outcome): 'copy' for content that came before in the group, 'near' for a vector too like one of the last
    ``window`` added ones, else 'added'. Each row is checked once; copies are found by an aggregate before any vector is compared."""
    named = rows.withColumn("_c", F.sha2(content.cast("string"), 256))
    first = named.groupBy(group, "_c").agg(F.min(order).alias(order))
    fresh = rows.join(first.select(group, order), [group, order], "left_semi")
    kept = sliding_dedup(fresh, group, order, vector, window, likeness)
    out = rows.select(group, order).join(kept, [group, order], "left")
    return out.select(group, order, F.when(F.col("kept").isNull(), "copy").when(F.col("kept"), "added").otherwise("near").alias("outcome"))


def first_callers(edges: DataFrame, place: str, least: int = 3) -> DataFrame:
    """(node, n_in, first_caller): nodes with at least ``least`` distinct callers, and the caller of the least place."""
    n = edges.groupBy("dst", "src").agg(F.min(place).alias("_p")).groupBy("dst").agg(F.count("*").alias("n_in"), F.min_by("src", F.struct("_p", "src")).alias("first_caller"))
    return n.filter(F.col("n_in") >= least).withColumnRenamed("dst", "node")


def sampled_labels(rows: DataFrame, metric: str, label: str, order: str, most: int, spill: int = 4) -> DataFrame:
    """rows with ``kept``: labels seen first among the ``most`` of a metric stay, others go to one of ``spill`` overflow labels."""
    first = rows.groupBy(metric, label).agg(F.min(order).alias("_f"))
    known = first.withColumn("_r", F.row_number().over(W.partitionBy(metric).orderBy("_f", label))).filter(F.col("_r") <= most)
    named = rows.join(known.select(metric, label, F.lit(True).alias("_in")), [metric, label], "left")
    spilled = F.concat(F.lit("_overflow_"), F.pmod(F.col(label).cast("bigint"), F.lit(spill)))
    return named.withColumn("kept", F.when(F.col("_in"), F.col(label).cast("string")).otherwise(spilled)).drop("_in")


def boosted(confidence: Column, by: float, most: float = 1.0) -> Column:
    """Confidence after use: raised by a share of what it lacks, at most ``most``."""
    return F.least(confidence + (F.lit(1.0) - confidence) * by, F.lit(most))
