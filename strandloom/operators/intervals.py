"""Overlapping and gapped intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions.times import epoch_ms
from strandloom.session import cut_lineage, numbered

YEAR_2101_MS = 4_133_980_800_000


def busy_periods(spans: DataFrame, entity: str = "entity", start: str = "start", end: str = "end") -> DataFrame:
    """(entity, kind, start, end): maximal ``period``s of the union of the spans, and the ``gap``s between an entity's periods.

    spans: bigint starts and ends in one unit; further columns are ignored. Spans that overlap or touch belong together. Spans
    with a null entity, start or end, and those whose end isn't later than the start, are left out. Repeated rows and ties
    change nothing; an empty table gives no rows.

    Of equal starts only the latest end is kept, then of equal ends the earliest start, on the map side first. Starts and ends
    are then ranked independently over the whole table, by (entity, start) and by (entity, end): an entity has the same ranks in
    both. A gap, or a new entity, lies where the next-ranked start exceeds the current-ranked end; the boundaries on both sides,
    ranked again, pair up to periods. Ranks come from range partitions, so an entity with a third of all rows is spread out.
    """
    rows = spans.select(F.col(entity).alias("entity"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).filter("entity IS NOT NULL AND e > s")
    rows = rows.groupBy("entity", "s").agg(F.max("e").alias("e")).groupBy("entity", "e").agg(F.min("s").alias("s"))
    rows = cut_lineage(rows)
    starts = numbered(rows.select("entity", "s"), ["entity", "s"], "r")
    ends = numbered(rows.select(F.col("entity").alias("whose"), "e"), ["whose", "e"], "r").select((F.col("r") + 1).alias("r"), "whose", F.col("e").alias("before"))
    both = starts.join(ends, "r", "full_outer")  # before the first start there is no end, and after the last end no start
    bounds = numbered(both.filter("whose IS NULL OR entity IS NULL OR entity <> whose OR s > before").select("r", "entity", "s", "whose", "before"), ["r"], "k")
    after = bounds.select((F.col("k") - 1).alias("k"), F.col("entity").alias("next_entity"), F.col("s").alias("next"), F.col("before").alias("last"))
    pairs = bounds.filter("entity IS NOT NULL").join(after, "k")
    found = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start"), F.col("last").alias("end")),
        F.when(F.col("next_entity") == F.col("entity"), F.struct(F.lit("gap").alias("kind"), F.col("last").alias("start"), F.col("next").alias("end"))),
    )
    return pairs.select("entity", F.explode(found).alias("x")).filter("x IS NOT NULL").select("entity", "x.kind", "x.start", "x.end")


def target_key(name: Column) -> Column:
    """Lower case, without outer blanks, blanks and underscores as hyphens."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s_]", "-")


def target_periods(transactions: DataFrame) -> DataFrame:
    """target_name, kind, start_ms, end_ms of the flash transactions' spans from started_at to completed_at.

    Rows with unreadable times, a time after the year 2100 or an end not later than the start don't count, nor do rows without
    a target name (null or blank).
    """
    spans = transactions.select(target_key(F.col("target_name")).alias("entity"), epoch_ms(F.col("started_at")).alias("start"), epoch_ms(F.col("completed_at")).alias("end"))
    spans = spans.filter((F.col("entity") != "") & (F.col("start") < YEAR_2101_MS) & (F.col("end") < YEAR_2101_MS))
    return busy_periods(spans).select(F.col("entity").alias("target_name"), "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))
