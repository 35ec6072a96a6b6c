"""Joins of points and intervals with intervals on a key that has very many of them (an admission with all its stays).

An equi-join on the key alone compares all pairs of a key and puts a busy key into one task. Here intervals are dealt into
time buckets, a row for each bucket that they meet, points into the one that holds them, and both sides join on (key,
bucket): a busy key is as many keys as it has buckets, and only neighbours in time are compared. Two intervals that share
several buckets meet in all of them and count in the first that both have, so nothing is said twice and no distinct is
needed.

``bucket_seconds`` should be well under the intervals' usual length, a tenth, say: shorter buckets mean more rows for each
interval, longer ones more pairs to compare. It never decides a result. Intervals without start, or that end before they
start, match nothing; an interval without end is open only where the function says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of a bucket unless told otherwise.
BUCKET = 6 * 3600


def _bucket(t: Column, seconds: float) -> Column:
    return F.floor(F.unix_micros(t.cast("timestamp")) / int(seconds * 1_000_000))


def dealt(intervals: DataFrame, start: Column, end: Column, seconds: float, name: str = "_bucket") -> DataFrame:
    """A row for each bucket from that of ``start`` to that of ``end``; none where either is null or they are reversed."""
    first, last = _bucket(start, seconds), _bucket(end, seconds)
    return intervals.where(start <= end).withColumn(name, F.explode(F.sequence(first, last)))


def points_in(points: DataFrame, intervals: DataFrame, time: str, start: str, end: str, key: str | list[str], closed: str = "both", bucket_seconds: float = BUCKET) -> DataFrame:
    """``points`` joined to the intervals of their key that hold them: closed on both sides, or on the left alone."""
    keys = [key] if isinstance(key, str) else list(key)
    inside = (F.col(time) >= F.col(start)) & ((F.col(time) <= F.col(end)) if closed == "both" else (F.col(time) < F.col(end)))
    here = points.withColumn("_bucket", _bucket(F.col(time), bucket_seconds))
    return here.join(dealt(intervals, F.col(start), F.col(end), bucket_seconds), [*keys, "_bucket"]).where(inside).drop("_bucket")


def overlapping(a: DataFrame, b: DataFrame, a_range: tuple[Column, Column], b_range: tuple[Column, Column], key: str | list[str], bucket_seconds: float = BUCKET) -> DataFrame:
    """The pairs of a key whose open ranges meet: each starts before the other ends. A range of no length is a point. The
    two sides share no column names but the key's."""
    keys = [key] if isinstance(key, str) else list(key)

    def side(df: DataFrame, limits: tuple[Column, Column], s: str) -> DataFrame:
        named = df.withColumns({f"_{s}_low": limits[0], f"_{s}_high": limits[1]})
        return dealt(named, F.col(f"_{s}_low"), F.col(f"_{s}_high"), bucket_seconds).withColumn(f"_{s}_first", _bucket(F.col(f"_{s}_low"), bucket_seconds))

    meet = (F.col("_a_low") < F.col("_b_high")) & (F.col("_b_low") < F.col("_a_high"))
    owner = F.col("_bucket") == F.greatest("_a_first", "_b_first")
    out = side(a, a_range, "a").join(side(b, b_range, "b"), [*keys, "_bucket"]).where(meet & owner)
    return out.drop("_bucket", *[f"_{s}_{c}" for s in "ab" for c in ("low", "high", "first")])
