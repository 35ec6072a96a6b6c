"""Where queries register with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def nearest(value: Column, digits: int) -> Column:
    """A double rounded as the SQL does: scaled in doubles, then half away from 0. Spark's own round takes the decimal text of
    a value, and so differs where that ends in a 5 and the scaled double doesn't."""
    scaled = value * float(10**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / float(10**digits)).otherwise(value)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as the SQL does."""
    return df.withColumns({n: nearest(F.col(n), digits) for n, k in df.dtypes if k == "double"})
