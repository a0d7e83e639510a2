"""Slices of time of the keys that hold most rows, so that an ordered fold of such a key isn't one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slicing:
    """A key of more than least_rows rows and more than a 1 / hot_keys share of all is cut into so many slices."""

    least_rows: int = 1_000_000
    hot_keys: int = 10_000
    slices: int = 256


def cut_hot_keys(events: DataFrame, keys: list[str], at: str, slicing: Slicing = Slicing()) -> tuple[DataFrame, DataFrame | None]:  # noqa: B008
    """(events of other keys, events of hot keys with __slice int), the second None where no key is hot.

    Slices of a key follow each other in time: they end at approximate quantiles of its own times, so
    they are about equally full; rows of the same time are in one slice, those of a null time in the first. A key
    that is null in part is never hot. Rows per key are counted by a job while the result is declared;
    the hot keys, slicing.hot_keys at most, are broadcast with their edges.
    """
    counts = events.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    total, most = counts.agg(F.sum("__rows"), F.max("__rows")).first()
    least = max(slicing.least_rows, (total or 0) // slicing.hot_keys)
    if (most or 0) <= least:
        return events, None
    hot = F.broadcast(counts.filter(F.col("__rows") > least).select(*keys))
    shares = [i / slicing.slices for i in range(1, slicing.slices)]
    edges = events.join(hot, keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(at, shares, 10_000).alias("__edges"))
    cut = events.join(F.broadcast(edges), keys).withColumn("__slice", F.size(F.filter("__edges", lambda e: e < F.col(at))))
    return events.join(hot, keys, "left_anti"), cut.select(*events.columns, "__slice")
