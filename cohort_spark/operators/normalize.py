"""z-scores with training statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(train: DataFrame, columns: list[str]) -> DataFrame:
    """(col, mu, sd): means and sample deviations, all in one pass; a mean that is null is 0, a deviation that is null, 0 or
    NaN is 1."""
    sums = train.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"m_{c}").alias("m"), F.col(f"s_{c}").alias("s")) for c in columns])).alias("r")
    s = F.col("r.s")
    return sums.select(rows).select("r.col", F.coalesce("r.m", F.lit(0.0)).alias("mu"), F.when(s.isNull() | F.isnan(s) | (s == 0), 1.0).otherwise(s).alias("sd"))


def apply(df: DataFrame, stats: DataFrame, columns: list[str], binary: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the columns as z-scores; masks and binary columns pass."""
    done = [c for c in columns if not c.endswith("_mask") and c not in binary]
    wide = stats.groupBy().agg(*[x for c in done for x in (F.max(F.when(F.col("col") == c, F.col("mu"))).alias(f"_m_{c}"), F.max(F.when(F.col("col") == c, F.col("sd"))).alias(f"_s_{c}"))])
    return df.crossJoin(F.broadcast(wide)).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in done}).drop(*wide.columns)  # one row
