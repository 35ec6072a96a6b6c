"""Item-coded measurements to channels: rules, hourly pivots, signed sums."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Channel:
    """Items that make a channel, the valid range (closed, or open if ``strict``), the aggregate, a unit change."""

    name: str
    items: tuple
    low: float | None = None
    high: float | None = None
    agg: str = "max"
    transform: Callable[[Column], Column] | None = None
    strict: bool = False


def fahrenheit(c: Column) -> Column:
    return (c - 32) * 5 / 9


def _valid(ch: Channel, value: Column) -> Column:
    ok = F.lit(True)
    if ch.low is not None:
        ok = ok & ((value > ch.low) if ch.strict else (value >= ch.low))
    if ch.high is not None:
        ok = ok & ((value < ch.high) if ch.strict else (value <= ch.high))
    return ok


def filter_items(df: DataFrame, channels: list[Channel], item: str = "itemid", value: str = "valuenum", low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows of the channels' items with values strictly between ``low`` and ``high``; both reach the Parquet scan."""
    out = df.where(F.col(item).isin([i for c in channels for i in c.items]))
    if low is not None:
        out = out.where(F.col(value) > low)
    return out.where(F.col(value) < high) if high is not None else out


def channel_expr(rules: list[Channel], item: Column, value: Column) -> Column:
    """The value of one channel, or null: the first rule whose item and range fit, unit changed."""
    out = None
    for r in rules:
        hit, v = item.isin(list(r.items)) & _valid(r, value), r.transform(value) if r.transform else value
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out


def hourly_pivot(df: DataFrame, channels: list[Channel], keys=("stay_id", "hr"), item: str = "itemid", value: str = "valuenum") -> DataFrame:
    """A column for each channel and a row for each key, in one pass: conditional aggregates with map-side partials.
    Rules of one name (units, devices) share a column."""
    by: dict[str, list[Channel]] = {}
    for c in channels:
        by.setdefault(c.name, []).append(c)
    kinds = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}
    return df.groupBy(*keys).agg(*[kinds[r[0].agg](channel_expr(r, F.col(item), F.col(value))).alias(n) for n, r in by.items()])


def with_item_label(df: DataFrame, items: DataFrame, item: str = "itemid") -> DataFrame:
    """``df`` with the label of its item; Spark broadcasts the dimension while its size allows."""
    return df.join(items, item)


def signed_value(label: Column, value: Column, include: list[str], negate: list[str], exclude: list[str] = ()) -> Column:
    """The value where a label holds an included word, negated where it holds a negating one (irrigants, say), null where
    it holds an excluded word or none."""
    low = F.lower(label)

    def has(words) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        return hit

    return F.when(has(exclude), None).when(has(negate), -value).when(has(include), value)


def hourly_sum(df: DataFrame, value: Column, keys=("stay_id", "hr"), floor: float = 0.0, most: float | None = 1500.0, name: str = "total") -> DataFrame:
    """Sums by key, not below ``floor``; keys whose sum exceeds ``most`` are left out."""
    out = df.groupBy(*keys).agg(F.greatest(F.sum(value), F.lit(floor)).alias(name))
    return out.where(F.col(name) <= most) if most is not None else out


def exclude_status(df: DataFrame, column: str, statuses: list[str]) -> DataFrame:
    """Rows whose status is none of ``statuses``; a null status is left out too, as NOT IN does."""
    return df.where(~F.col(column).isin(statuses))
