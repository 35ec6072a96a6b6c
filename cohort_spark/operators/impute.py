"""Missing values: masks, forward and backward fill, training medians, constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def add_masks(df: DataFrame, columns: list[str]) -> DataFrame:
    """{c}_mask: 1 where the value is there."""
    return df.withColumns({f"{c}_mask": F.col(c).isNotNull().cast("byte") for c in columns})


def fill_constants(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def _ordered(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def forward_fill(df: DataFrame, columns: list[str], key: str = "stay_id", order: str = "hr") -> DataFrame:
    """The last value seen so far; one window, one sort for all columns."""
    w = _ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, True).over(w) for c in columns})


def fill_both(df: DataFrame, columns: list[str], key: str = "stay_id", order: str = "hr") -> DataFrame:
    """Forward fill, then backward fill of what is left."""
    back = _ordered(key, order).rowsBetween(0, Window.unboundedFollowing)
    ahead = _ordered(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, True).over(ahead), F.first(c, True).over(back)) for c in columns})


def train_medians(train: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row of medians, nulls skipped: exact with linear interpolation, or a sketch for very large inputs."""
    if exact:
        typed = train.select(*[F.col(c).cast("double").alias(c) for c in columns])
        long = typed.unpivot([], columns, "column", "value")
        medians = ranks.exact_quantiles(long, ["column"], "value", [0.5])
        return medians.groupBy().agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(c) for c in columns])
    return train.agg(*[F.percentile_approx(c, 0.5, 100_000).alias(c) for c in columns])


def fill_medians(df: DataFrame, medians: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with nulls replaced by the one row of medians."""
    m = medians.select(*[F.col(c).alias(f"_m_{c}") for c in columns])
    return df.crossJoin(F.broadcast(m)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns}).drop(*m.columns)  # one row
