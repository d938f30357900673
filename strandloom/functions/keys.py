"""Spellings of keys brought to one form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def folded(text: Column) -> Column:
    """Without outer blanks and case."""
    return F.lower(F.trim(text))


def normal_path(path: Column) -> Column:
    """Slashes of one kind, without ``.``, resolved ``..`` and repeated slashes; case is kept.

    ``..`` above a relative path's start stays; above the root it is dropped. Null gives null.
    """
    slashed = F.regexp_replace(path, r"[\\/]+", "/")
    plain = F.regexp_replace(F.regexp_replace(slashed, r"(?<=^|/)(?:\./)+", ""), r"(?:/\.)?/?$", "")
    rooted = slashed.startswith("/")
    parts = F.filter(F.split(slashed, "/"), lambda x: ~x.isin("", "."))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x)))
        .when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(rooted, acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(slashed.isin(".", "/"), F.replace(slashed, F.lit("."), F.lit(""))).when(slashed.contains(".."), F.concat(F.when(rooted, "/").otherwise(""), F.array_join(resolved, "/"))).otherwise(plain)
