"""Cleaning of streams: what a batch fit has learnt is applied to each row, and duplicates go within a watermark."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fitted:
    """Medians of columns and spellings of columns, as a batch had them."""

    medians: Mapping[str, float | None]
    spellings: Sequence[tuple]

    def transform(self, df: DataFrame) -> DataFrame:
        """Works on batches and streams alike: projections and broadcast joins only."""
        from ..operators import fuzzy

        out = df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(c) if self.medians.get(c) is not None else c for c in df.columns))
        return fuzzy.apply_mapping(out, self.spellings)


def fit(df: DataFrame, numbers: Sequence[str], texts: Sequence[str] = (), threshold: float = 90) -> Fitted:
    from ..operators import fuzzy, quantiles

    return Fitted({c: quantiles.medians(df, F.col(c), "m").first()["m"] for c in numbers}, fuzzy.token_set_mapping(df, list(texts), threshold))


def project(stream: DataFrame, functions: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Applies Column functions to columns of a stream."""
    return stream.select(*(functions[c](F.col(c)).alias(c) if c in functions else c for c in stream.columns))


def without_duplicates(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, by: Sequence[str], width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rows a window and key; late rows beyond the delay don't count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
