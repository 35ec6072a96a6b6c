"""Per-entity window features and per-bucket derived features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """One feature: its aggregate (sum, max, min, avg, count, flag, nunique, nunique_approx), what it is of, for which rows,
    and what entities without such rows get."""

    name: str
    kind: str
    value: str | None = None
    where: str | None = None
    default: float | None = None


def _aggregate(s: Spec) -> Column:
    ok = F.expr(s.where) if s.where else F.lit(True)
    v = F.when(ok, F.expr(s.value)) if s.value else None
    kinds = {
        "sum": lambda: F.sum(v), "max": lambda: F.max(v), "min": lambda: F.min(v), "avg": lambda: F.avg(v), "count": lambda: F.count_if(ok),
        "flag": lambda: F.max(F.coalesce(ok, F.lit(False)).cast("int")), "nunique": lambda: F.count_distinct(v), "nunique_approx": lambda: F.approx_count_distinct(v),
    }
    return kinds[s.kind]().alias(s.name)


def window_agg(facts: DataFrame, specs: list[Spec], key: str = "stay_id", entities: DataFrame | None = None) -> DataFrame:
    """All specs over one source in one aggregate. With ``entities``, those without facts are kept, with the defaults; facts
    are aggregated before the join, so nothing fans out."""
    out = facts.groupBy(key).agg(*[_aggregate(s) for s in specs])
    if entities is not None:
        out = entities.select(key).distinct().join(out, key, "left")
    return out.fillna({s.name: s.default for s in specs if s.default is not None})


def assemble(base: DataFrame, *tables: DataFrame, key: str = "stay_id", fill: dict | None = None) -> DataFrame:
    """``base`` with the columns of per-entity tables, left joined on one key, so partitionings are reused."""
    for t in tables:
        base = base.join(t, key, "left")
    return base.fillna(fill) if fill else base


def one_hot(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """A 0/1 column for each (name: exact value); null is 0 everywhere."""
    return df.withColumns({n: F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for n, v in values.items()})


def regex_bucket(column: Column, patterns: list[tuple[str, str]], other: str = "OTHER") -> Column:
    """The name of the first pattern found in the upper-cased column; ``other`` for none and for null."""
    out = None
    for name, pattern in patterns:
        hit = F.upper(column).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.coalesce(out, F.lit(other))


#: The ethnicity buckets, in order of precedence.
ETHNICITY = [("WHITE", "WHITE"), ("BLACK", "BLACK|AFRICAN"), ("HISPANIC", "HISPANIC|LATINO"), ("ASIAN", "ASIAN")]


def per_weight(amount: Column, weight: Column, default: float = 70.0) -> Column:
    return amount / F.coalesce(weight, F.lit(default))


def select_present(df: DataFrame, wanted: list[str], drop: list[str] = ()) -> DataFrame:
    """The wanted columns that there are, in that order, without those to drop."""
    return df.select(*[c for c in wanted if c in df.columns and c not in drop])


def first_observed(df: DataFrame, columns: list[str], key: str = "stay_id", order: str = "hr", suffix: str = "_baseline") -> DataFrame:
    """(key, each column's first value that is not null)."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"{c}{suffix}") for c in columns])


def delta_ratio(df: DataFrame, columns: list[str], suffix: str = "_baseline", cap: float = 10.0) -> DataFrame:
    """{c}_delta and {c}_ratio to the baseline. The ratio is 1 for a zero baseline or if it isn't finite, and ``cap`` at
    most; a null value or baseline leaves both null. There is no lower cap."""
    out = {}
    for c in columns:
        v, b = F.col(c), F.col(f"{c}{suffix}")
        ratio = F.when(b == 0, 1.0).otherwise(v / b)
        out[f"{c}_delta"] = v - b
        out[f"{c}_ratio"] = F.when(F.isnan(ratio) | (F.abs(ratio) == float("inf")), 1.0).when(ratio > cap, float(cap)).otherwise(ratio)
    return df.withColumns(out)


def time_since_last(df: DataFrame, columns: list[str], key: str = "stay_id", order: str = "hr", suffix: str = "_time_delta") -> DataFrame:
    """Buckets since the last observed value, counted from the start where there is none yet."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"{c}{suffix}": F.col(order) - F.coalesce(F.last(F.when(F.col(c).isNotNull(), F.col(order)), True).over(w), F.lit(0)) for c in columns})


def rolling(df: DataFrame, specs: dict[str, tuple[str, str, int]], key: str = "stay_id", order: str = "hr") -> DataFrame:
    """{name: (column, "mean" or "std", rows)} over the last rows; the deviation of one row is 0."""
    out = {}
    for name, (c, kind, n) in specs.items():
        w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - n, 0)
        out[name] = F.avg(c).over(w) if kind == "mean" else F.coalesce(F.stddev_samp(c).over(w), F.lit(0.0))
    return df.withColumns(out)
