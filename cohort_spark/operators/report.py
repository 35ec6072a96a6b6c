"""Cohort summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohort_summary(df: DataFrame, labels: list[str], by: str = "era", key: str = "stay_id") -> DataFrame:
    """(by, n_rows, n_stays, prevalence of each label in percent of stays): labels are taken per stay first."""
    stays = df.groupBy(by, key).agg(F.count("*").alias("_n"), *[F.max(F.col(c).cast("int")).alias(c) for c in labels])
    return stays.groupBy(by).agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_stays"), *[(100 * F.avg(c)).alias(f"pct_{c}") for c in labels])
