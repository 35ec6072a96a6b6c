"""Outcome labels from intervals and charted values in a prediction window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import BUCKET, overlapping


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether an interval meets the open window (low, high); an interval without end is a point."""
    return (start < high) & (F.coalesce(end, start) > low)


def interval_overlap(entities: DataFrame, intervals: DataFrame, low: Column, high: Column, start: str = "starttime", end: str = "endtime", key: str = "stay_id", name: str = "label",
                     on: str | None = None, bucket_seconds: float | None = None) -> DataFrame:
    """(key, name): whether any of the entity's intervals meets its window. Pre-filter ``intervals`` by code. With ``on``, a
    coarser key that both tables have (an admission), the intervals are those of that key, found by time bucket."""
    if on:
        point = F.coalesce(F.col(end), F.col(start))
        met = overlapping(entities.select(key, on, low.alias("_low"), high.alias("_high")), intervals.select(on, F.col(start).alias("_start"), point.alias("_end")),
                          (F.col("_low"), F.col("_high")), (F.col("_start"), F.col("_end")), on, bucket_seconds or BUCKET)
        hits = met.select(key).distinct().withColumn(name, F.lit(True))
        return entities.select(key).distinct().join(hits, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    hits = intervals.join(entities, key).groupBy(key).agg(F.bool_or(overlaps(F.col(start), F.col(end), low, high)).alias(name))
    return entities.select(key).distinct().join(hits, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _all_joined(parts: list[tuple[DataFrame, str]], key: str) -> tuple[DataFrame, list[str]]:
    out, names = parts[0][0].select(key, F.col(parts[0][1]).alias("_p0")), ["_p0"]
    for k, (df, c) in enumerate(parts[1:], 1):
        out = out.join(df.select(key, F.col(c).alias(f"_p{k}")), key, "full")
        names.append(f"_p{k}")
    return out, names


def any_of(parts: list[tuple[DataFrame, str]], key: str = "stay_id", name: str = "label") -> DataFrame:
    """(key, name): whether any of the tables' flags holds; an absent or null flag doesn't."""
    out, names = _all_joined(parts, key)
    hit = F.lit(False)
    for n in names:
        hit = hit | F.coalesce(n, F.lit(False))
    return out.select(key, hit.alias(name))


def all_of(parts: list[tuple[DataFrame, str]], key: str = "stay_id", name: str = "label") -> DataFrame:
    """(key, name): whether all of the tables' flags hold."""
    out, names = _all_joined(parts, key)
    hit = F.lit(True)
    for n in names:
        hit = hit & F.coalesce(n, F.lit(False))
    return out.select(key, hit.alias(name))
