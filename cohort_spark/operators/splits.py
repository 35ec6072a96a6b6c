"""Chronological splits without leaks, samples, membership tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


#: Binary logarithm of how many more bands times have than other values: all dates of a study lie between two powers of two.
TIME_BITS = 13


def _ranked(df: DataFrame, order: list[str], group: str, bits: int | None = None) -> DataFrame:
    """``df`` with _rank, its row number in ``order`` over all groups, and _n, the number of rows.

    ``group`` leads the order (an era, say) and has few values. Inside it, rows fall into bands of the first order column,
    which are functions of the value; counts of earlier groups and bands come before, and only rows of one band are sorted
    together. The bands decide how even the work is, never the ranks. Null values come first.
    """
    times = dict(df.dtypes)[order[0]].startswith(("timestamp", "date"))
    key = F.unix_micros(F.col(order[0]).cast("timestamp")) if times else F.col(order[0])
    bits = ranks.band_bits(df) if bits is None else bits
    if bits:
        rows = ranks.banded(df.withColumn("_key", key.cast("double")), "_key", min(ranks.MOST_BITS, bits + (TIME_BITS if times else 0))).drop("_key", "_wide")
        rows = rows.withColumn("_band", F.coalesce("_narrow", F.lit(-(2**50)))).drop("_narrow")
    else:
        rows = df.withColumn("_band", F.lit(0).cast("long"))
    sizes = rows.groupBy(group, "_band").agg(F.count("*").alias("_size"))
    placed = ranks.running(sizes, [group], "_band", ["_size"])
    whole = sizes.groupBy(group).agg(F.sum("_size").alias("_in_group"))  # a row for each group
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumns({"_earlier": F.coalesce(F.sum("_in_group").over(earlier), F.lit(0)), "_n": F.sum("_in_group").over(Window.partitionBy(F.lit(1)))}).drop("_in_group")
    placed = placed.join(F.broadcast(whole), group).select(group, "_band", "_n", (F.col("_earlier") + F.col("_size_upto") - F.col("_size")).alias("_before"))
    inner = Window.partitionBy(group, "_band").orderBy(*order)
    out = rows.join(placed, [group, "_band"])
    return out.withColumn("_rank", F.row_number().over(inner) + F.col("_before")).drop("_band", "_before")


def chronological(stays: DataFrame, share: float = 0.8, era: str = "era", order: tuple[str, ...] = ("intime", "stay_id"), names=("train", "val")) -> DataFrame:
    """``stays`` with split: the first int(share * n) by era and time are train, the rest val."""
    out = _ranked(stays, list(order), era)
    cut = F.floor(F.col("_n") * F.lit(share))
    return out.withColumn("split", F.when(F.col("_rank") <= cut, names[0]).otherwise(names[1])).drop("_n", "_rank")


def adaptation(stays: DataFrame, shares=(0.3, 0.1), unit: str = "stay_id", order: tuple[str, ...] = ("intime",), names=("adapt_train", "adapt_val", "eval_post")) -> DataFrame:
    """``stays`` of the new era with split: the first shares of the units by first time, the rest for evaluation. With a
    unit of several stays (a subject) all its stays go together."""
    units = stays.groupBy(unit).agg(*[F.min(c).alias(c) for c in order if c != unit]).withColumn("_g", F.lit(1))
    ranked = _ranked(units, [*order, unit], "_g")
    a, b = F.floor(F.col("_n") * F.lit(shares[0])), F.floor(F.col("_n") * F.lit(shares[1]))
    split = F.when(F.col("_rank") <= a, names[0]).when(F.col("_rank") <= a + b, names[1]).otherwise(names[2])
    return stays.join(ranked.select(unit, split.alias("split")), unit)


def replay_buffer(stays: DataFrame, size: int = 500, key: str = "stay_id") -> DataFrame:
    """The last ``size`` stays in id order, as split "buffer"."""
    return stays.orderBy(F.desc(key)).limit(size).withColumn("split", F.lit("buffer"))


def with_buffer(buffer: DataFrame, train: DataFrame) -> DataFrame:
    """What an adapted model trains on."""
    return buffer.unionByName(train, allowMissingColumns=True)


def purge_subjects(df: DataFrame, split: str = "split", subject: str = "subject_id", order=("train", "val", "test")) -> DataFrame:
    """``df`` without rows of later splits whose subject occurs in an earlier one."""
    rank = F.coalesce(*[F.when(F.col(split) == s, k) for k, s in enumerate(order)])
    first = df.where(rank.isNotNull()).groupBy(subject).agg(F.min(rank).alias("_first"))
    return df.join(first, subject).where(rank == F.col("_first")).drop("_first")


def take(df: DataFrame, assignment: DataFrame, split: str, key: str = "stay_id") -> DataFrame:
    """Rows whose id an assignment table (key, split) puts into ``split``."""
    return df.join(assignment.where(F.col("split") == split).select(key), key, "left_semi")


def overlap(assignment: DataFrame, key: str = "stay_id") -> DataFrame:
    """Ids in more than one split: an empty table for disjoint splits."""
    return assignment.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def assert_disjoint(assignment: DataFrame, key: str = "stay_id") -> None:
    found = overlap(assignment, key).limit(5).collect()
    if found:
        raise ValueError(f"in more than one split: {[r[0] for r in found]}")


def write_assignment(df: DataFrame, path: str) -> None:
    df.select("stay_id", "subject_id", "split").write.mode("overwrite").parquet(path)


def balanced_sample(df: DataFrame, n: int, key: str = "id", label: str = "label", y: str = "y", seed: int = 0, order=None) -> DataFrame:
    """At most n // 2 positives and negatives for each label, by a hash of seed and id, the same in every run."""
    by = order if order is not None else F.xxhash64(F.lit(seed), F.col(key))
    w = Window.partitionBy(label, y).orderBy(by, key)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n // 2).drop("_k")
