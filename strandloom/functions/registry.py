"""Extension points: named functions that callers may add to, all working on Columns or DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F


class Registry:
    """Named functions of one kind: embedders, stores, compressors, detectors, query handlers, predicates."""

    def __init__(self, kind: str):
        self.kind, self._held = kind, {}

    def add(self, name: str, function: Callable) -> Callable:
        if name in self._held:
            raise ValueError(f"{self.kind} {name} is there already")
        self._held[name] = function
        return function

    def get(self, name: str) -> Callable:
        if name not in self._held:
            raise KeyError(f"no {self.kind} {name}; there are {', '.join(sorted(self._held)) or 'none'}")
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)


embedders, compressors, detectors, handlers, predicates = (Registry(k) for k in ("embedder", "compressor", "detector", "handler", "predicate"))


def embedder(name: str, encode: Callable[[list[str]], Iterable[Iterable[float]]]) -> Callable[[Column], Column]:
    """Register a batch function from texts to vectors as a vectorised UDF; nulls are encoded as empty texts."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encode(texts.fillna("").tolist())])

    return embedders.add(name, run)


def detector(name: str, find: Callable[[str, str], Iterable[tuple[str, int, str]]]) -> Callable[[DataFrame, str, str], DataFrame]:
    """Register a function (key, text) -> findings (rule, line, message), run in Arrow batches: (key, rule, line, message)."""

    def run(rows: DataFrame, key: str, text: str) -> DataFrame:
        def each(batches):
            for pdf in batches:
                out = [(k, *f) for k, t in zip(pdf[key], pdf[text]) if t is not None for f in find(str(k), t)]
                yield pd.DataFrame(out, columns=[key, "rule", "line", "message"])

        return rows.select(key, text).mapInPandas(each, f"{key} {dict(rows.dtypes)[key]}, rule string, line int, message string")

    return detectors.add(name, run)


def migrated(rows: DataFrame, version: int, steps: dict[int, Callable[[DataFrame], DataFrame]], target: int) -> DataFrame:
    """Apply the migrations version -> version + 1 up to the target; a missing step is an error."""
    missing = [v for v in range(version, target) if v not in steps]
    if missing:
        raise KeyError(f"no migration from version {missing[0]}")
    return reduce(lambda df, v: steps[v](df), range(version, target), rows)


def with_fallback(first: Callable[[], DataFrame], second: Callable[[], DataFrame]) -> DataFrame:
    """The first source if it can be read, else the second; one row is read to find out."""
    try:
        df = first()
        df.limit(1).count()
        return df
    except (AnalysisException, FileNotFoundError):  # not there or not readable as such; other failures are the caller's
        return second()
