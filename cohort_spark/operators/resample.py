"""Bootstrap and jackknife of metric differences, from hashed weights that every run repeats.

A replicate is a weight for each id, a hash of both, so weights never travel: a worker makes them for the rows it holds, a
short vector over all replicates for each row. Rows are dealt by score into bands of about BAND_ROWS rows, read off the
counts of narrow ranges of scores; a band is sorted by score and scanned once, for all replicates at a time. What it hands
on is its class totals and its part of the area, a vector over replicates each. Prefix sums of the totals over the bands
make the rest of the area; average precision scans the bands again, each behind the totals of those above it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bca_percentiles
from . import evaluate, ranks

#: Rows of a band of scores, unless one narrow range of scores has more; rows that a worker weighs at once.
BAND_ROWS, AT_ONCE = 20_000, 1024

#: Attribution rows that a worker multiplies at once, groups of one product at most, and groups whose sums a task keeps
#: before it sends them (16 KB each at 1,000 replicates).
ROWS_AT_ONCE, GROUPS_AT_ONCE, GROUPS = 1 << 17, 2048, 4096

#: Cumulative Poisson(1) probabilities: a uniform number's place among them is the row's weight.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _weights(ids: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Poisson(1) weights from a scramble of id and replicate: a row for each id, a column for each replicate."""
    salt = (replicates.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    x = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] + salt[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(float) / 2.0**53, "right")


def _binned(df: DataFrame, bins: int | None) -> DataFrame:
    """Scores on a grid, so that a replicate needs counts by grid point only; None keeps scores as they are."""
    return df if bins is None else df.withColumn("prob", F.round(F.col("prob") * bins) / bins)


class _Scan:
    """One band of one model and label, by descending score: totals, area and precision of all replicates."""

    def __init__(self, key: tuple, replicates: int, tp: np.ndarray | None = None, fp: np.ndarray | None = None):
        zero = np.zeros(replicates)
        self.key, self.numbers = key, np.arange(replicates)
        self.tp, self.fp = (zero if tp is None else tp), (zero if fp is None else fp)
        self.area, self.ap, self.p, self.n = zero.copy(), zero.copy(), zero.copy(), zero.copy()
        self.score, self.last = None, (zero, zero)  # the score that may go on in the next rows, and its weights so far

    def add(self, ids: np.ndarray, scores: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(ids), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            w = _weights(ids[part], self.numbers).astype(float)
            bits = (scores[part] + 0.0).view(np.int64)  # equal for NaN, and for both zeros
            starts = np.flatnonzero(np.r_[True, bits[1:] != bits[:-1]])
            positive = (y[part] == 1)[:, None]
            p, n = np.add.reduceat(w * positive, starts), np.add.reduceat(w * ~positive, starts)
            if self.score == bits[0]:
                p[0] += self.last[0]
                n[0] += self.last[1]
            else:
                self._close()
            self.score, self.last = bits[-1], (p[-1], n[-1])
            self._take(p[:-1], n[:-1])

    def _take(self, p: np.ndarray, n: np.ndarray) -> None:
        """Count finished scores, a row each."""
        if not len(p):
            return
        tp, fp = self.tp + np.cumsum(p, axis=0), self.fp + np.cumsum(n, axis=0)
        self.area += (n * (tp - p / 2)).sum(axis=0)
        self.ap += np.where(p > 0, p * tp / np.maximum(tp + fp, 1), 0).sum(axis=0)
        self.tp, self.fp = tp[-1], fp[-1]
        self.p += p.sum(axis=0)
        self.n += n.sum(axis=0)

    def _close(self) -> None:
        if self.score is not None:
            self._take(self.last[0][None, :], self.last[1][None, :])
            self.score = None

    def row(self) -> list:
        self._close()
        return [*self.key, self.p, self.n, self.area, self.ap]


_PARTS = ["p", "n", "area", "ap"]


def _scan_bands(rows: DataFrame, replicates: int) -> DataFrame:
    """(model, label, band, p, n, area, ap) of ``rows`` (model, label, band, prob, id, y, tp, fp). Rows without an id carry
    the totals above their band; they come first."""
    dealt = rows.repartition("model", "label", "band").sortWithinPartitions("model", "label", "band", F.col("id").isNotNull(), F.desc("prob"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, done = None, []
        for b in batches:
            if b.empty:
                continue
            keys = b[["model", "label", "band"]]
            turns = np.flatnonzero(np.r_[True, (keys.to_numpy()[1:] != keys.to_numpy()[:-1]).any(axis=1)])
            for low, high in zip(turns, [*turns[1:], len(b)]):
                key, part = tuple(keys.iloc[low]), b.iloc[low:high]
                if current is None or current.key != key:
                    if current is not None:
                        done.append(current.row())
                    current = _Scan(key, replicates)
                if pd.isna(part["id"].iloc[0]):
                    current.tp, current.fp = (np.asarray(part[c].iloc[0], float) for c in ("tp", "fp"))
                    part = part.iloc[1:]
                current.add(part["id"].to_numpy(np.int64), part["prob"].to_numpy(float), part["y"].to_numpy(np.int64))
            if len(done) >= 64:
                yield pd.DataFrame(done, columns=["model", "label", "band", *_PARTS])
                done = []
        if current is not None:
            yield pd.DataFrame([*done, current.row()], columns=["model", "label", "band", *_PARTS])

    return dealt.mapInPandas(scan, "model string, label string, band long, " + ", ".join(f"{c} array<double>" for c in _PARTS))


def _dealt(df: DataFrame) -> DataFrame:
    """Rows (model, label, band, prob, id, y, tp, fp) of ``df`` that have a score and a class; bands ascend as scores fall."""
    known = df.where("prob is not null and y is not null").select("model", "label", F.col("id").cast("long").alias("id"), F.col("prob").cast("double").alias("prob"), F.col("y").cast("int").alias("y"))
    rows = ranks.banded(known, "prob", ranks.band_bits(known) + 4).drop("_wide").withColumnRenamed("_narrow", "range")
    keys = ["model", "label"]
    sizes = rows.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    bands = ranks.running(sizes, keys, "range", ["n"], descending=True).select(*keys, "range", F.floor((F.col("n_upto") - F.col("n")) / BAND_ROWS).alias("band"))
    none = F.lit(None).cast("array<double>")
    return rows.join(bands, [*keys, "range"]).select(*keys, "band", "prob", "id", "y", none.alias("tp"), none.alias("fp"))


def replicate_metric(df: DataFrame, replicates: int, metric: str = "auroc", bins: int | None = None) -> DataFrame:
    """(model, label, b, value): the weighted metric of each bootstrap replicate, auroc or ap; null without both classes, or
    for ap without positives."""
    rows = _dealt(_binned(df, bins))
    keys = ["model", "label"]

    def by_replicate(scanned: DataFrame) -> DataFrame:
        one = scanned.select(*keys, "band", F.posexplode(F.arrays_zip(*_PARTS)).alias("b", "z"))
        return one.select(*keys, "band", "b", "z.*")

    above = Window.partitionBy(*keys, "b").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    totals = by_replicate(_scan_bands(rows, replicates)).withColumns({c: F.coalesce(F.sum(x).over(above), F.lit(0.0)) for c, x in (("tp", "p"), ("fp", "n"))})
    if metric == "auroc":
        area, p, n = F.sum(F.col("area") + F.col("n") * F.col("tp")), F.sum("p"), F.sum("n")
        return totals.groupBy(*keys, "b").agg(F.when((p > 0) & (n > 0), area / (p * n)).alias("value"))
    starts = totals.groupBy(*keys, "band").agg(F.array_sort(F.collect_list(F.struct("b", "tp", "fp"))).alias("s"))
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("prob", "double"), ("id", "long"), ("y", "int"))]
    starts = starts.select(*keys, "band", *nothing, *[F.col(f"s.{c}").alias(c) for c in ("tp", "fp")])
    scanned = by_replicate(_scan_bands(rows.unionByName(starts), replicates))
    return scanned.groupBy(*keys, "b").agg(F.when(F.sum("p") > 0, F.sum("ap") / F.sum("p")).alias("value"))


def paired_bootstrap(df: DataFrame, a: str, b: str, replicates: int = 1000, metric: str = "auroc", level: float = 0.95, bins: int | None = None) -> DataFrame:
    """(label, value_a, low_a, high_a, value_b, low_b, high_b, point, low, high, p, win, n): both models' metrics and the
    difference b - a with percentile intervals, the share of replicates whose difference is at or below 0 and above it.
    Replicates without both classes are left out of the counts."""
    f = evaluate.auroc if metric == "auroc" else evaluate.average_precision
    name = "auroc" if metric == "auroc" else "ap"

    def both(t: DataFrame, keys: list[str], value: str) -> DataFrame:
        sides = [F.max(F.when(F.col("model") == m, F.col(value))).alias(c) for m, c in ((a, "value_a"), (b, "value_b"))]
        return t.groupBy(*keys).agg(*sides).withColumn("d", F.col("value_b") - F.col("value_a"))

    two = df.where(F.col("model").isin(a, b))
    point = both(f(two), ["label"], name).withColumnRenamed("d", "point")
    reps = both(replicate_metric(two, replicates, metric, bins), ["label", "b"], "value").where("d is not null")
    tail = (1 - level) / 2
    ends = [F.percentile(c, F.lit(q)).alias(f"{e}{s}") for c, s in (("value_a", "_a"), ("value_b", "_b"), ("d", "")) for e, q in (("low", tail), ("high", 1 - tail))]  # of the replicates
    out = reps.groupBy("label").agg(*ends, F.avg((F.col("d") <= 0).cast("double")).alias("p"), F.avg((F.col("d") > 0).cast("double")).alias("win"), F.count("*").alias("n"))
    return point.join(out, "label")


def placements(df: DataFrame, keys: list[str] = ("model", "label")) -> DataFrame:
    """``df`` with v: for a positive the share of negatives below it, for a negative the share of positives above it, ties
    half."""
    keys = list(keys)
    c = evaluate._cumulative(df, keys).select(*keys, "prob", "p", "n", "tp", "fp", "np", "nn")
    below = (F.col("nn") - F.col("fp") + F.col("n") / 2) / F.when(F.col("nn") > 0, F.col("nn"))
    above = (F.col("tp") - F.col("p") / 2) / F.when(F.col("np") > 0, F.col("np"))
    return df.join(c, [*keys, "prob"]).withColumn("v", F.when(F.col("y") == 1, below).otherwise(above)).drop("p", "n", "tp", "fp")


def jackknife(df: DataFrame, keys: list[str] = ("model", "label")) -> DataFrame:
    """(keys, id, y, loo): the AUROC without each row, in closed form over all rows."""
    keys = list(keys)
    area = evaluate.auroc(df, keys)
    m = F.when(F.col("y") == 1, F.col("np")).otherwise(F.col("nn"))
    return placements(df, keys).join(area, keys).where(m > 1).select(*keys, "id", "y", ((m * F.col("auroc") - F.col("v")) / (m - 1)).alias("loo"))


def bca(df: DataFrame, a: str, b: str, replicates: int = 1000, level: float = 0.95, bins: int | None = None) -> DataFrame:
    """(label, point, low, high): bias-corrected and accelerated interval of the AUROC difference b - a.

    The acceleration needs the jackknife values' sums of deviations squared and cubed; their powers about the point estimate,
    which all of them are close to, add up in one aggregate and are moved to the mean afterwards."""
    two = df.where(F.col("model").isin(a, b))

    def diff(t: DataFrame, keys: list[str], value: str) -> DataFrame:
        return t.groupBy(*keys).agg((F.max(F.when(F.col("model") == b, F.col(value))) - F.max(F.when(F.col("model") == a, F.col(value)))).alias("d"))

    point = diff(evaluate.auroc(two), ["label"], "auroc").withColumnRenamed("d", "point")
    loo = diff(jackknife(two), ["label", "id", "y"], "loo").where("d is not null")
    off = F.col("point") - F.col("d")
    sums = loo.join(point, "label").groupBy("label").agg(F.count("*").alias("m"), F.avg(off).alias("o"), F.sum(off**2).alias("s2"), F.sum(off**3).alias("s3"))
    square = F.col("s2") - F.col("m") * F.col("o") ** 2
    cube = F.col("s3") - 3 * F.col("o") * F.col("s2") + 2 * F.col("m") * F.col("o") ** 3
    accel = sums.select("label", F.when(square > 0, cube / (6 * F.pow(square, F.lit(1.5)))).alias("accel"))
    reps = diff(replicate_metric(two, replicates, "auroc", bins), ["label", "b"], "value").where("d is not null").join(point, "label")
    stats = reps.groupBy("label").agg(F.avg((F.col("d") < F.col("point")).cast("double")).alias("below"), F.sort_array(F.collect_list("d")).alias("ds")).join(accel, "label").join(point, "label")

    def ends(below: float, acceleration: float, ds: list[float]) -> tuple[float, float]:  # a row for each label
        low, high = bca_percentiles(below, acceleration or 0.0, level)
        return tuple(float(x) for x in np.percentile(ds, [low, high]))

    return stats.withColumn("e", F.udf(ends, "struct<low:double,high:double>")("below", "accel", "ds")).select("label", "point", "e.*")


class _Sums:
    """Sums of weights times absolute values and of weights, of all replicates, for each (label, feature, model) of a task's
    rows. The first place of a vector has weight 1 everywhere: it is the table itself."""

    def __init__(self, replicates: int):
        self.numbers, self.sums = np.arange(replicates), {}

    def add(self, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Count rows (id, label, feature, model, value); yields what was counted once that is too much to keep. Groups of one
        label are the rows of a matrix and ids its columns, and the product with the ids' weights is what is added."""
        codes, names = zip(*(self._coded(rows[c]) for c in ("label", "feature", "model")))
        sizes = [len(n) for n in names]
        groups, group = np.unique(np.ravel_multi_index(codes, sizes), return_inverse=True)
        ids, at = np.unique(rows["id"].fill_null(0).to_numpy(), return_inverse=True)
        at = 2 * at + rows["id"].is_valid().to_numpy()  # a row without an id is in no replicate
        value, block = rows["value"].to_numpy(), np.stack([group // GROUPS_AT_ONCE, codes[0]])
        order = np.lexsort((at, *block))
        turns = np.flatnonzero(np.r_[True, (np.diff(block[:, order]) != 0).any(axis=0), True])
        for low, high in zip(turns, turns[1:]):
            part = order[low:high]
            here, row = np.unique(group[part], return_inverse=True)
            cases, column = np.unique(at[part], return_inverse=True)  # ascending, as ``part`` is
            both = np.zeros((2, len(here), 1 + len(self.numbers)))
            step = min(AT_ONCE, (1 << 20) // len(here))
            for first in range(0, len(cases), step):
                some = cases[first : first + step]
                w = np.ones((len(some), both.shape[2]))
                w[:, 1:] = _weights(ids[some // 2], self.numbers) * (some % 2)[:, None]
                those = slice(*np.searchsorted(column, [first, first + step]))
                place = row[those] * len(some) + column[those] - first
                for total, v in zip(both, (value[part[those]], None)):
                    total += np.bincount(place, v, len(here) * len(some)).reshape(len(here), -1) @ w
            for k, which in enumerate(zip(*np.unravel_index(groups[here], sizes))):
                key = tuple(n[c] for n, c in zip(names, which))
                self.sums[key] = self.sums[key] + both[:, k] if key in self.sums else both[:, k].copy()
            if len(self.sums) > GROUPS:
                yield from self.take()

    @staticmethod
    def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, list]:
        coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def take(self) -> Iterator[pa.RecordBatch]:
        """All sums so far, which are then forgotten; a few hundred groups at a time."""
        kept, self.sums = list(self.sums.items()), {}
        for at in range(0, len(kept), 256):
            keys, both = zip(*kept[at : at + 256])
            ends = np.arange(len(keys) + 1, dtype=np.int32) * (1 + len(self.numbers))
            vectors = [pa.ListArray.from_arrays(ends, np.concatenate([b[i] for b in both])) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*keys)), *vectors], ["label", "feature", "model", "s", "w"])


def bootstrap_mean_delta(attr: DataFrame, source: str, adapted: str, replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """(label, feature, delta, low, high): change of mean absolute attribution with its percentile interval. A null label or
    feature is a group like any other; rows without an id count in the change alone.

    Each task multiplies its rows' weights with their absolute values and sends sums for each (label, feature, model): once
    each, if it meets no more than GROUPS of them. The vectors of a (label, feature) are then added up, one from each task.
    """
    kind = "label string, feature string, model string, s array<double>, w array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n = _Sums(replicates), [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS_AT_ONCE:
                yield from task.add(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from task.add(pa.Table.from_batches(held))
        yield from task.take()

    tail = (1 - level) / 2

    def interval(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        (s_a, w_a), (s_b, w_b) = ([sum(parts.loc[parts["model"] == m, c], np.zeros(1 + replicates)) for c in "sw"] for m in (source, adapted))
        there = (w_a > 0) & (w_b > 0)
        d = s_b[there] / w_b[there] - s_a[there] / w_a[there]
        drawn = np.sort(d[1:])
        out = [[*key, d[0], _between(drawn, tail), _between(drawn, 1 - tail)]] if len(drawn) else []
        return pd.DataFrame(out, columns=["label", "feature", "delta", "low", "high"])

    two = attr.where(F.col("model").isin(source, adapted) & F.col("value").isNotNull())
    rows = two.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in ("label", "feature", "model")], F.abs(F.col("value").cast("double")).alias("value"))
    sums = rows.mapInArrow(run, kind)
    return sums.groupBy("label", "feature").applyInPandas(interval, "label string, feature string, delta double, low double, high double")


def _between(ordered: np.ndarray, share: float) -> float:
    """A quantile with linear interpolation."""
    h = share * (len(ordered) - 1)
    low, high = ordered[math.floor(h)], ordered[math.ceil(h)]
    return low if low == high or h == math.floor(h) else (math.ceil(h) - h) * low + (h - math.floor(h)) * high


def verdict(intervals: DataFrame, better: str = "better", worse: str = "worse") -> DataFrame:
    return intervals.withColumn("verdict", F.when(F.col("low") > 0, better).when(F.col("high") < 0, worse).otherwise("undecided"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def significance(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, up, down): intervals above and below 0."""
    return intervals.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("low") > 0).alias("up"), F.count_if(F.col("high") < 0).alias("down"))
