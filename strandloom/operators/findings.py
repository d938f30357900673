"""Findings: rules over text, deduplication, ranking, limits, diffs and grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Weight of each severity (fixed values).
SEVERITY = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.3, "info": 0.1}


def severity_weight(severity: Column) -> Column:
    """Unknown severities weigh nothing."""
    out = F.lit(0.0)
    for name, w in SEVERITY.items():
        out = F.when(F.lower(severity) == name, F.lit(w)).otherwise(out)
    return out


def lines_of(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content): lines numbered from 1; empty ones are kept, null texts have none."""
    return documents.select(key, F.posexplode(F.split(text, "\n")).alias("line", "content")).withColumn("line", (F.col("line") + 1).cast("bigint"))


def grep(documents: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, line, column, content) of the lines that match; column is the first match's place from 1. Documents without any
    match are dropped before their lines are unrolled."""
    rows = lines_of(documents.filter(F.col(text).rlike(pattern)), key, text).filter(F.col("content").rlike(pattern))
    return rows.select(key, "line", F.regexp_instr("content", F.lit(pattern)).cast("bigint").alias("column"), "content")


def apply_rules(documents: DataFrame, key: str, text: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(key, rule, severity, line) for each rule (name, pattern, severity) and matching line; one scan for all rules."""
    hits = F.filter(F.array(*(F.when(F.col("content").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, p, s in rules)), lambda x: x.isNotNull())
    anything = "|".join(f"(?:{p})" for _, p, _ in rules)
    return lines_of(documents.filter(F.col(text).rlike(anything)), key, text).select(key, "line", F.explode(hits).alias("h")).select(key, "h.rule", "h.severity", "line")


def first_of(findings: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First finding of each key by a total order."""
    return findings.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def limited_per(findings: DataFrame, file: str, order: list[Column], n: int) -> DataFrame:
    """At most n findings of a file, the first by ``order``: give the input's order to limit before sorting."""
    return findings.withColumn("_n", F.row_number().over(W.partitionBy(file).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def severity_pivot(findings: DataFrame, by: list[str], severity: str, fold_info: bool = False) -> DataFrame:
    """Counts by severity; with fold_info infos count as low."""
    s = F.when(F.lit(fold_info) & (F.col(severity) == "info"), "low").otherwise(F.col(severity))
    return findings.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(s == name).alias(name) for name in SEVERITY))


def multiset_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, resolved, remaining, regressed): copies of a finding gone, left and come between two runs."""
    b, a = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((before, "b"), (after, "a")))
    both = b.join(a, keys, "full_outer").fillna(0, ["a", "b"])
    zero = F.lit(0).cast("bigint")
    return both.select(*keys, F.greatest(F.col("b") - F.col("a"), zero).alias("resolved"), F.least("a", "b").alias("remaining"), F.greatest(F.col("a") - F.col("b"), zero).alias("regressed"))


def grouped(findings: DataFrame, parts: list[str], order: str, severity: str, confidence: str) -> DataFrame:
    """Findings grouped by a digest of ``parts``: count, first and last seen, representative by severity, then confidence."""
    digest = F.sha2(F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)), 256)
    best = F.struct(-severity_weight(F.col(severity)), -F.col(confidence), F.col(order))
    return findings.groupBy(digest.alias("group_key")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"), F.min_by(order, best).alias("representative"))


def conflict_kind(a: Column, b: Column, contradictions: list[tuple[str, str]], least: float = 0.8) -> Column:
    """Of two rule texts: contradiction (one matches a pattern, the other its opposite), overlap (Jaccard above ``least``) or null."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    against = F.lit(False)
    for p, q in contradictions:
        against = against | (a.rlike(p) & b.rlike(q)) | (a.rlike(q) & b.rlike(p))
    shared = F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(F.array_union(words(a), words(b))), F.lit(1))
    return F.when(a == b, None).when(against, "contradiction").when(shared > least, "overlap")
