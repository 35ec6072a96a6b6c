"""Running sums, ranks and exact quantiles without a task that sorts a whole group.

A value's band is a function of the value alone: its sign, exponent and leading digits, as one number that grows with the
value. Totals of wide bands come first, then those of narrow bands inside each wide one, then the rows of each narrow band;
where a few thousand narrow bands are enough, there are no wide ones. How many bands a power of two has grows with the size
of the tables that the plan reads, up to 2 ** 31, where a narrow band holds 2 ** 21 different doubles at most, however they
are distributed. Tables of SMALL bytes at most, which one task can sort whatever their keys, need no bands and the shuffles
between them. Nothing is sampled and no job runs while a plan is built. The bands decide how even the work is, never a
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Input bytes for each narrow band of a power of two, and the binary logarithms of their least and largest number.
BAND_BYTES, LEAST_BITS, MOST_BITS = 1 << 18, 4, 31
#: Bytes of all tables below a plan up to which a key's rows are sorted by one task.
SMALL = 1 << 22
#: Bits up to which narrow bands, a few thousand for each key, need no wide ones above them.
ONE_LEVEL = 12
#: Sizes beyond which exponents are not looked at; such values share the outermost bands.
_LEAST, _MOST = 1e-300, 1e300


def position(value: Column) -> Column:
    """A number from -2200 to 4000 that never falls as ``value`` grows: the exponent plus the part beyond the power of two,
    shifted and signed. NaN comes last, as in Spark's order."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    inside = exponent + size / F.pow(F.lit(2.0), exponent) + 1099
    inside = F.when(size < _LEAST, 0.0).when(size > _MOST, 2200.0).otherwise(inside)
    return F.when(F.isnan(value), 4000.0).when(value < 0, -inside).otherwise(inside)


def band_bits(rows: DataFrame) -> int:
    """Binary logarithm of the narrow bands for each power of two, from the sizes of the tables below ``rows``, which Spark
    knows without a job; 0 for small tables, whose keys are one band each."""
    leaves = rows._jdf.queryExecution().analyzed().collectLeaves()
    sizes = (int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    size = sum(min(x, 1 << 50) for x in sizes)  # a leaf of unknown size claims more than any table has
    return max(LEAST_BITS, min(MOST_BITS, (size // BAND_BYTES).bit_length())) if size > SMALL else 0


def banded(rows: DataFrame, value: str, bits: int) -> DataFrame:
    """``rows`` with the wide and the narrow band of ``value``."""
    at = rows.withColumn("_at", position(F.col(value).cast("double")))
    return at.withColumns({"_wide": F.floor(F.col("_at") * (1 << bits // 2)), "_narrow": F.floor(F.col("_at") * (1 << bits))}).drop("_at")


def running(counts: DataFrame, keys: list[str], value: str, columns: list[str], descending: bool = False, bits: int | None = None) -> DataFrame:
    """``counts``, a row for each key and value, with {c}_upto, the running sum of each column in order of ``value``, and
    {c}_all, its total by key. ``bits`` sets the number of bands instead of the input's size."""

    def sums(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])

    def order(by: list[str], c: str) -> Window:
        return Window.partitionBy(*by).orderBy(F.desc(c) if descending else F.asc(c))

    def before(by: list[str], c: str) -> dict[str, Column]:
        rows = order(by, c).rowsBetween(Window.unboundedPreceding, -1)
        return {f"_{x}_before": F.coalesce(F.sum(x).over(rows), F.lit(0)) for x in columns}

    bits = band_bits(counts) if bits is None else bits
    if not bits:
        whole, upto = Window.partitionBy(*keys), order(keys, value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({f"{c}_{n}": F.sum(c).over(w) for n, w in (("upto", upto), ("all", whole)) for c in columns})
    rows = banded(counts, value, bits)
    totals = {f"{c}_all": F.sum(c).over(Window.partitionBy(*keys)) for c in columns}
    if bits <= ONE_LEVEL:
        rows, narrow = rows.drop("_wide"), [*keys, "_narrow"]
        fine = sums(rows, narrow).withColumns(before(keys, "_narrow") | totals).drop(*columns)
        return _upto(rows.join(fine, narrow), order(narrow, value), columns, {c: F.col(f"_{c}_before") for c in columns})
    wide, narrow = [*keys, "_wide"], [*keys, "_wide", "_narrow"]
    fine = sums(rows, narrow)
    broad = sums(fine, wide).withColumns(before(keys, "_wide") | totals)
    broad = broad.select(*wide, *[F.col(f"_{c}_before").alias(f"_{c}_start") for c in columns], *[f"{c}_all" for c in columns])
    fine = fine.withColumns(before(wide, "_narrow")).drop(*columns).join(broad, wide)
    return _upto(rows.join(fine, narrow), order(narrow, value), columns, {c: F.col(f"_{c}_start") + F.col(f"_{c}_before") for c in columns})


def _upto(rows: DataFrame, order: Window, columns: list[str], before: dict[str, Column]) -> DataFrame:
    """``rows`` with {c}_upto: what comes before their band, and the running sum inside it."""
    inner = order.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"{c}_upto": before[c] + F.sum(c).over(inner) for c in columns})
    return out.drop("_wide", "_narrow", *[f"_{c}_{end}" for c in columns for end in ("before", "start")])


def quantiles(ranked: DataFrame, keys: list[str], value: str, n: str, shares: list[float]) -> DataFrame:
    """(keys, q): exact quantiles with linear interpolation, as an array in the order of ``shares``, from ``running`` rows
    with ``n`` values each. Only the rows that hold one of the places, two for each share, are aggregated."""
    upto, total = F.col(f"{n}_upto"), F.col(f"{n}_all")

    def holds(place: Column) -> Column:
        return (upto - F.col(n) <= place) & (place < upto)

    some = F.lit(False)
    for q in shares:
        h = F.lit(float(q)) * (total - 1)
        some = some | (holds(F.floor(h)) | holds(F.ceil(h)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.lit(float(q)).alias("_share")) for k, q in enumerate(shares)])).alias("_s")
    few = ranked.where(some).select(*keys, value, n, upto, total, each).select("*", "_s._k", (F.col("_s._share") * (total - 1)).alias("_h"))
    ends = few.groupBy(*keys, "_k").agg(*[F.max(F.when(holds(f("_h")), F.col(value))).alias(c) for c, f in (("_a", F.floor), ("_b", F.ceil))], F.max(F.col("_h") - F.floor("_h")).alias("_w"))
    rows = F.sort_array(F.collect_list(F.struct("_k", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("q"))))  # one for each share
    return ends.groupBy(*keys).agg(F.transform(rows, lambda r: r["q"]).alias("q"))


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q) of ``value``, nulls skipped."""
    there = rows.where(F.col(value).isNotNull())
    counts = there.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return quantiles(running(counts, keys, value, ["n"]), keys, value, "n", shares)
