"""Quality of ranked results, experiments and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ranking_quality(retrieved: DataFrame, relevant: DataFrame, key: str, cuts: tuple[int, ...] = (1, 3, 5, 10), discount: str = "sqrt") -> DataFrame:
    """Per query: precision, recall, hit and F1 at each cut, reciprocal rank and nDCG at the last cut.

    retrieved: (query_id, key, rank from 1). relevant: distinct (query_id, key). Precision divides by the cut. The gain at rank r
    is 1 / sqrt(r) ('sqrt') or 1 / log2(r + 1) ('log2'). Queries without relevant rows are left out; without hits all is 0.
    """
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return judged_quality(retrieved.join(relevant.select("query_id", key, F.lit(1).alias("rel")), ["query_id", key], "left"), n, cuts, discount)


def label_judged(retrieved: DataFrame, labels: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(judged, n) for judged_quality where rows with the query's own label are relevant to it: only retrieved rows are looked at,
    and the others of a label are counted, so that no query is set against all rows of its label. Query ids are keys."""
    own = labels.select(F.col(key).alias("query_id"), F.col(label).alias("_own"))
    n = own.join(labels.groupBy(F.col(label).alias("_own")).agg((F.count("*") - 1).alias("n_relevant")), "_own").filter("n_relevant > 0")
    n = n.join(retrieved.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "n_relevant")
    judged = retrieved.join(own, "query_id").join(labels.select(key, label), key).withColumn("rel", (F.col(label) == F.col("_own")).cast("int"))
    return judged.select("query_id", key, "rank", "rel"), n


def judged_quality(judged: DataFrame, n: DataFrame, cuts: tuple[int, ...] = (1, 3, 5, 10), discount: str = "sqrt") -> DataFrame:
    """ranking_quality of (query_id, rank, rel 1 or not) and (query_id, n_relevant)."""
    gain = 1 / F.sqrt("rank") if discount == "sqrt" else 1 / F.log2(F.col("rank") + 1)
    top = cuts[-1]
    hits = judged.groupBy("query_id").agg(
        *(F.count_if((F.col("rank") <= c) & (F.col("rel") == 1)).alias(f"h{c}") for c in cuts),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= top), gain).otherwise(0.0)).alias("dcg"),
    )
    ideal_gain = (lambda i: 1 / F.sqrt(i)) if discount == "sqrt" else (lambda i: 1 / F.log2(i + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(top)).cast("int")), F.lit(0.0), lambda s, i: s + ideal_gain(i))
    rows = n.join(hits, "query_id", "left").fillna(0)
    out = [F.col("query_id"), "n_relevant"]
    for c in cuts:
        p, r = F.col(f"h{c}") / c, F.col(f"h{c}") / F.col("n_relevant")
        out += [F.round(p, 6).alias(f"precision_{c}"), F.round(r, 6).alias(f"recall_{c}"), (F.col(f"h{c}") > 0).cast("int").alias(f"hit_{c}"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias(f"f1_{c}")]
    return rows.select(*out, F.round(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def golden_hits(retrieved: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Per query, from the overlap of the first ten with the expected keys: at 1 any hit counts, at k min(k, expected) hits."""
    n = expected.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return judged_golden(retrieved.join(expected.select("query_id", key, F.lit(1).alias("rel")), ["query_id", key], "left"), n)


def judged_golden(judged: DataFrame, n: DataFrame) -> DataFrame:
    """golden_hits of (query_id, rank, rel 1 or not) and (query_id, n_relevant)."""
    overlap = judged.filter("rank <= 10 AND rel = 1").groupBy("query_id").agg(F.count("*").alias("o"))
    rows = n.withColumnRenamed("n_relevant", "n").join(overlap, "query_id", "left").fillna(0, ["o"])
    return rows.select("query_id", *((F.col("o") >= F.least(F.lit(k), F.col("n"))).cast("int").alias(f"golden_hit_{k}") for k in (1, 5, 10)))


def drift(runs: DataFrame, series: str, run: str, value: str, tolerated: float = 0.1) -> DataFrame:
    """Runs whose value fell by more than ``tolerated`` of the series' previous run."""
    before = F.lag(value).over(W.partitionBy(series).orderBy(run))
    return runs.withColumn("previous", before).filter((F.col("previous") > 0) & (F.col("previous") - F.col(value) > tolerated * F.col("previous")))


def variant_summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample variance and the 95 % interval (z = 1.96) of each variant."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.var_samp(value), 6).alias("variance"), F.round(F.avg(value) - half, 6).alias("lower"), F.round(F.avg(value) + half, 6).alias("upper"))


def welch(rows: DataFrame, by: str, variant: str, value: str, a: str, b: str) -> DataFrame:
    """(by, t, significant): Welch's t of two variants; significant beyond |t| > 1.96."""
    part = lambda v, f: f(F.when(F.col(variant) == v, F.col(value)))
    m = rows.groupBy(by).agg(*(part(v, f).alias(f"{n}{i}") for i, v in enumerate((a, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    t = (F.col("m1") - F.col("m0")) / F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    return m.select(by, F.round(t, 6).alias("t"), (F.abs(t) > 1.96).alias("significant"))


def bucket_share(key: Column, salt: str) -> Column:
    """md5 of 'salt:key' modulo 10,000 over 10,000, from the two halves of the digest."""
    digest = F.md5(F.concat(F.lit(salt + ":"), key.cast("string")))
    half = lambda at: F.pmod(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)"), F.lit(10_000).cast("decimal(20,0)")).cast("bigint")
    return F.pmod(half(1) * 1616 + half(17), F.lit(10_000)) / 10_000


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float], cumulative: bool = False) -> DataFrame:
    """Counts per bucket (first bound not below the value, the overflow last), or cumulated, with sum and count."""
    v = F.col(value)
    low = [None, *bounds]
    cells = [F.count_if((v <= b) & (F.lit(True) if cumulative or lo is None else v > lo)).alias(f"le_{i}") for i, (lo, b) in enumerate(zip(low, bounds))]
    over = F.count(value) if cumulative else F.count_if(v > bounds[-1])
    return rows.groupBy(*by).agg(*cells, over.alias("le_inf"), F.round(F.sum(value), 4).alias("total"), F.count(value).alias("n"))


def label_overflow(rows: DataFrame, metric: str, label: str, order: str, limit: int) -> DataFrame:
    """(metric, label, first_seen, kept): the first ``limit`` distinct labels of a metric are kept, later ones overflow."""
    first = rows.groupBy(metric, label).agg(F.min(order).alias("first_seen"))
    n = F.row_number().over(W.partitionBy(metric).orderBy("first_seen", label))
    return first.withColumn("kept", n <= limit)


def gauge_value(ops: DataFrame, gauge: str, order: str, op: str, value: str) -> DataFrame:
    """Last 'set' of a gauge plus later 'inc' less later 'dec'; 0 where nothing was set."""
    last = ops.filter(F.col(op) == "set").groupBy(gauge).agg(F.max_by(F.struct(F.col(order).alias("o"), F.col(value).alias("v")), order).alias("s"))
    signed = F.when(F.col(op) == "inc", F.col(value)).when(F.col(op) == "dec", -F.col(value)).otherwise(0.0)
    late = ops.join(last, gauge, "left").groupBy(gauge).agg(F.first("s.v").alias("base"), F.sum(F.when(F.col("s").isNull() | (F.col(order) > F.col("s.o")), signed).otherwise(0.0)).alias("delta"))
    return late.select(gauge, F.round(F.coalesce("base", F.lit(0.0)) + F.col("delta"), 4).alias("value"))


def divergence(p: DataFrame, q: DataFrame, key: str, weight: str, floor: float = 1e-10) -> DataFrame:
    """Kullback-Leibler divergence sum p ln(p / q) of two distributions, and the sum of p * (p / q)."""
    both = p.select(key, F.col(weight).alias("p")).join(q.select(key, F.col(weight).alias("q")), key, "full_outer").fillna(floor, ["p", "q"])
    return both.agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 6).alias("kl"), F.round(F.sum(F.col("p") * F.col("p") / F.col("q")), 6).alias("ratio_sum"))


def ring_owner(keys: DataFrame, key: str, nodes: list[str], vnodes: int = 100) -> DataFrame:
    """(key, node) on a consistent-hash ring: the first virtual node at or after the key's hash, else the first of all.

    The ring (nodes times vnodes entries, given by the caller) is one sorted array; keys look it up without a join.
    """
    import hashlib

    ring = sorted((int(hashlib.sha256(f"{n}:{i}".encode()).hexdigest()[:15], 16), n) for n in nodes for i in range(vnodes))
    places, owners = F.array(*(F.lit(h) for h, _ in ring)), F.array(*(F.lit(n) for _, n in ring))
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("bigint")
    at = F.size(F.filter(places, lambda x: x < F.col("_h")))
    return keys.select(key, h.alias("_h")).select(key, F.coalesce(F.get(owners, at), F.get(owners, F.lit(0))).alias("node"))


def exposition(rows: DataFrame, name: str, labels: list[str], value: Column) -> DataFrame:
    """Text lines 'name{label="value",...} number', labels in order of name, backslash and quote escaped."""
    esc = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1")
    pairs = [F.concat(F.lit(f'{c}="'), esc(c), F.lit('"')) for c in sorted(labels)]
    return rows.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), value.cast("string")).alias("line"))
