"""Times written in several notations, read on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(text: Column) -> Column:
    """Epoch milliseconds of a time in text, or null where it can't be read.

    Reads ISO dates with blank or T, slashes or hyphens, up to nine fractional digits, ``Z``, ``+hh:mm``, ``+hhmm`` or no
    offset (then UTC), and digits alone (seconds up to 1e11, else milliseconds).
    """
    t = F.trim(text)
    shape = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ](\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?\s*(?:Z|z|UTC|([+-]\d{2}):?(\d{2}))?$"
    parts = F.split(F.regexp_replace(t, shape, "#$1-$2-$3#$4#$5:$6"), "#")  # one match; other texts stay without a first '#'
    clock = F.when(parts[2] == "", F.lit("00:00:00")).otherwise(parts[2])
    zone = F.when(parts[3] == ":", F.lit("Z")).otherwise(parts[3])
    iso = F.concat(parts[1], F.lit(" "), clock, zone)
    digits = t.try_cast("bigint")
    return (
        F.when(t.rlike(r"^\d{1,17}$"), F.when(digits <= 100_000_000_000, digits * 1000).otherwise(digits))
        .when((F.size(parts) == 4) & (parts[0] == ""), F.unix_millis(iso.try_cast("timestamp")))
    )


def month_utc(ms: Column) -> Column:
    """'YYYY-MM' in UTC of epoch milliseconds, whatever the session's zone."""
    return F.date_format(F.make_date(F.lit(1970), F.lit(1), F.lit(1)) + F.floor(ms / 86_400_000).cast("int"), "yyyy-MM")
