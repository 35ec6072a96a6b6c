"""Time since an origin, windows around it, and dense (entity, bucket) grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def hours_since(t: Column, t0: Column, bucket_seconds: int = 3600) -> Column:
    """Bucket number of ``t`` from ``t0`` on; times before ``t0`` fall into bucket 0."""
    return F.greatest(F.lit(0), F.floor((micros(t) - micros(t0)) / (bucket_seconds * 1e6))).cast("int")


def in_window(t: Column, t0: Column, start_seconds: float, end_seconds: float, closed: str = "left") -> Column:
    """Whether ``t`` lies start to end seconds after ``t0``: closed on the left, on both sides, or on none."""
    d = micros(t) - micros(t0)
    low, high = int(start_seconds * 1e6), int(end_seconds * 1e6)
    if closed == "left":
        return (d >= low) & (d < high)
    if closed == "both":
        return d.between(low, high)
    return (d > low) & (d < high)


def attach_events(events: DataFrame, stays: DataFrame, time: str, start: str = "intime", end: str | None = "outtime", key: str | list[str] = "stay_id", closed: str = "both",
                  bucket_seconds: float | None = None) -> DataFrame:
    """Events joined to the stays of their key whose time range holds them.

    With a key coarser than the stay (an admission with several stays), the range decides; ``bucket_seconds`` then joins on
    (key, time bucket), so that an event meets the stays near it and not all of its key. Spark broadcasts the stays where
    their size allows and joins by shuffle where not. Without ``end`` only the start counts."""
    if bucket_seconds and end:
        return intervals.points_in(events, stays, time, start, end, key, closed, bucket_seconds)
    ok = F.col(time) >= F.col(start)
    if end:
        ok = ok & ((F.col(time) <= F.col(end)) if closed == "both" else (F.col(time) < F.col(end)))
    return events.join(stays, key).where(ok)


def dense_grid(entities: DataFrame, buckets: int, name: str = "hr") -> DataFrame:
    """A row for each entity and bucket 0 to ``buckets - 1``; a projection, no shuffle."""
    return entities.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))


def fill_grid(observed: DataFrame, entities: DataFrame, buckets: int, keys: tuple[str, str] = ("stay_id", "hr"), fill: dict | None = None) -> DataFrame:
    """``observed`` plus the grid cells that it lacks, with ``fill`` or null in them; cells off the grid go."""
    entity, bucket = keys
    grid = dense_grid(entities.select(entity).distinct(), buckets, bucket)
    out = grid.join(observed, list(keys), "left")
    return out.fillna(fill) if fill else out


def hourly_flags(kinds: dict[str, DataFrame], keys: tuple[str, str] = ("stay_id", "hr")) -> DataFrame:
    """(keys, a 0/1 flag for each kind): the kinds of events that fell into each bucket."""
    union = None
    for name, df in kinds.items():
        rows = df.select(*keys, *[F.lit(int(k == name)).alias(k) for k in kinds])
        union = rows if union is None else union.unionByName(rows)
    return union.groupBy(*keys).agg(*[F.max(k).alias(k) for k in kinds])


def assemble_hourly(driver: DataFrame, *others: DataFrame, keys: tuple[str, str] = ("stay_id", "hr")) -> DataFrame:
    """``driver`` with the columns of ``others``; buckets that the driver lacks are lost, as its rows decide."""
    for other in others:
        driver = driver.join(other, list(keys), "left")
    return driver
