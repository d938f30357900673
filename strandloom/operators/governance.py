"""Memory governance: retention, confidence decay, provenance, personal data, compression candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Patterns of personal data and secrets, applied in this order (fixed values); none needs look-around. Passwords come last, as they
#: take any text after the word, and keys before the numbers that may stand in them.
PII = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "api_key": r"(?i)(?:api[_-]?key|apikey|secret)[=:\s]+['\"]?[A-Z0-9_-]{16,}['\"]?",
    "phone": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"\b[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}\b",
    "credit_card": r"\b(?:[0-9]{4}[-\s]?){3}[0-9]{4}\b",
    "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "password": r"(?i)(?:password|pwd|passwd)[=:\s]+\S+",
}
#: Provenance levels from weakest to strongest (fixed values).
LEVELS = ["none", "low", "medium", "high", "verified"]


def pii_counts(text: Column, patterns: dict[str, str] = PII) -> dict[str, Column]:
    """Matches of each pattern; null text has none."""
    return {name: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("bigint") for name, p in patterns.items()}


def redact(text: Column, patterns: dict[str, str] = PII) -> Column:
    """Each match replaced by its type in brackets, pattern by pattern, so that later ones see earlier replacements."""
    for name, p in patterns.items():
        text = F.regexp_replace(text, p, f"[{name.upper()}]")
    return text


def decayed(initial: Column, days: Column, how: str, rate: float, step: float = 7.0) -> Column:
    """Confidence after ``days``, kept within 0 and 1: linear, exponential, step (a loss of ``rate`` every ``step`` days) or none."""
    value = {
        "linear": initial - rate * days,
        "exponential": initial * F.pow(F.lit(1.0 - rate), days),
        "step": initial - rate * F.floor(days / step),
        "none": initial,
    }[how]
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def retention(rows: DataFrame, kind: str, age_seconds: Column, policy: DataFrame, default_ttl: float = 86_400.0) -> DataFrame:
    """rows with ttl, expired, remaining and deletable. policy: one row per kind (a fixed table), ttl seconds and auto_cleanup."""
    joined = rows.join(F.broadcast(policy.withColumnRenamed("kind", kind)), kind, "left")
    ttl = F.coalesce("ttl", F.lit(default_ttl))
    expired = age_seconds >= ttl
    return joined.withColumns({"ttl": ttl, "expired": expired, "remaining": F.greatest(F.lit(0.0), ttl - age_seconds), "deletable": expired & F.coalesce("auto_cleanup", F.lit(False))})


def level_rank(level: Column) -> Column:
    """Ordinal of a provenance level; unknown levels rank lowest."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.lower(level)) - 1, F.lit(0)).cast("int")


def compression_priority(size: Column, idle_seconds: Column, saving: Column, caps: tuple[float, float, float] = (30_720.0, 7_776_000.0, 1_048_576.0)) -> Column:
    """0.4 of the saving, 0.3 of the idle time and 0.3 of the size, each against its cap."""
    part = lambda x, cap: F.least(x / cap, F.lit(1.0))
    return 0.4 * part(saving, caps[0]) + 0.3 * part(idle_seconds, caps[1]) + 0.3 * part(size, caps[2])


def latest_per_item(blobs: DataFrame, item: str, time: str, ident: str) -> DataFrame:
    """Blobs that aren't the latest of their item (prunable), by a window instead of a correlated subquery."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(item).orderBy(F.desc(time), F.desc(ident)))
    return blobs.withColumn("_n", n).filter("_n > 1").drop("_n")


def reference_counts(blobs: DataFrame, item: str, digest: Column) -> DataFrame:
    """(item, digest, refs): equal blobs of an item are stored once."""
    return blobs.groupBy(item, digest.alias("digest")).agg(F.count("*").alias("refs"))


def accept_compression(before: Column, after: Column, least_saving: int = 100, ratio: float = 0.95) -> Column:
    """Accepted where at least ``least_saving`` is saved or the ratio lies below ``ratio``."""
    return (before - after >= least_saving) | ((before > 0) & (after / before < ratio))


def sample_size(n: Column, least: int = 10, most: int = 100) -> Column:
    """One per cent of n, at least ``least`` and at most ``most``."""
    return F.least(F.greatest(F.lit(least), F.floor(n * 0.01)), F.lit(most)).cast("bigint")
