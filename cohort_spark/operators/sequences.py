"""Stays as sequences and flat vectors of fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timegrid import dense_grid


def assemble(df: DataFrame, columns: list[str], static: list[str] = (), labels: list[str] = (), length: int = 6, key: str = "stay_id", order: str = "hr") -> DataFrame:
    """(key, seq, static, label): the first ``length`` rows of each stay as arrays, padded at the end with zeros; static
    columns and labels from the first row."""
    row = F.struct(F.col(order).alias("o"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    first = [F.min_by(F.array(*[F.col(c).cast("double") for c in cols]), order).alias(name) for name, cols in (("static", static), ("label", labels)) if cols]
    seq = F.transform(F.slice(F.sort_array(F.collect_list(row)), 1, length), lambda r: r["x"]).alias("seq")
    out = df.groupBy(key).agg(seq, *first)
    pad = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), length - F.size("seq"))
    return out.withColumn("seq", F.concat("seq", pad))


def tile_static(df: DataFrame, seq: str = "seq", static: str = "static") -> DataFrame:
    """``df`` with the static vector appended at every step."""
    return df.withColumn(seq, F.transform(seq, lambda x: F.concat(x, F.col(static))))


def _stats(c: str, order: str) -> list[Column]:
    return [F.max_by(c, order).alias(f"last_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]


def flatten(df: DataFrame, columns: list[str], static: list[str] = (), labels: list[str] = (), length: int = 6, key: str = "stay_id", order: str = "hr") -> DataFrame:
    """One row for each stay: last, mean, population deviation, min and max of each column over exactly ``length`` buckets
    (missing ones are zeros, later ones are cut off), static columns and labels from the first row."""
    grid = dense_grid(df.select(key).distinct(), length, order)
    rows = grid.join(df.select(key, order, *columns).where(F.col(order) < length), [key, order], "left").fillna(0.0, subset=columns)
    flat = rows.groupBy(key).agg(*[x for c in columns for x in _stats(c, order)])
    rest = [*static, *labels]
    return flat.join(df.groupBy(key).agg(*[F.min_by(c, order).alias(c) for c in rest]), key) if rest else flat
