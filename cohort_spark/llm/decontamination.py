"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared where they share a seed of MIN_TILE words. For such a pair,
running Karp-Rabin hashes find the longest matches of yet unmarked words, which are marked as tiles without
overlap, longest first, until no match of MIN_TILE words is left; a match that an earlier tile cuts off goes on with the
length that it has left. The item's share of words under tiles decides; as tiles may lie in any order, reordered
passages count too.

The benchmark is the query set: it is dealt into blocks of a bounded number of characters, and each block is
broadcast and held against all documents in one pass that shuffles nothing. More items mean more blocks, one after the
other.

Words are runs of letters, digits and underscores, in lower case. Defined results: null and empty texts, and
items of fewer than MIN_TILE words, match nothing; repeated rows give repeated results; repeated item rows count as
one item each; an empty table on either side gives no row; other columns of the input are kept by ``flag``, which replaces
a column of the name that it is given for its result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_words, mix, read, windows_hash

MIN_TILE = 5
#: Share of an item's words under tiles from which on the document is contaminated.
COVERAGE = 0.5
#: Characters of benchmark text in a broadcast block.
BLOCK_CHARS = 16_000_000

_words = re.compile(r"\w+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tokens(text: str | None) -> np.ndarray:
    return hash_words(_words(text.lower()) if text else [])


class Rolling:
    """Karp-Rabin hashes of a sequence's windows of any width, from one prefix sum."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        powers = np.full(n + 1, _BASE, np.uint64)
        powers[0] = 1
        self.inverse = np.full(n + 1, _INVERSE, np.uint64)
        self.inverse[0] = 1
        self.inverse = np.cumprod(self.inverse)
        self.sums = np.r_[np.uint64(0), np.cumsum(seq * np.cumprod(powers)[:n])]

    def windows(self, width: int, starts: np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + width] - self.sums[starts]) * self.inverse[starts])


def _free(marked: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows without a marked word."""
    n = len(marked) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    total = np.r_[0, np.cumsum(marked)]
    return np.flatnonzero(total[width:] == total[:-width])


def _shared_part(item: np.ndarray, doc: np.ndarray, shortest: int) -> np.ndarray:
    """Positions of the document's words that lie in a window of ``shortest`` words that the item has too, -1 between
    stretches of them. Every match lies in one stretch."""
    windows = windows_hash(doc, shortest)
    hits = np.flatnonzero(np.isin(windows, windows_hash(item, shortest)))
    if not len(hits):
        return np.empty(0, np.int64)
    edges = np.zeros(len(doc) + 1, np.int64)
    np.add.at(edges, hits, 1)
    np.add.at(edges, hits + shortest, -1)
    at = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
    return np.insert(at, np.flatnonzero(np.diff(at) > 1) + 1, -1)


def tile(item: np.ndarray, doc: np.ndarray, shortest: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in doc, words) of greedy string tiling, longest first; of equally long ones the first
    in the item, then in the document.

    Each round finds the largest width at which unmarked windows of both sides have equal running hashes (if one width has
    a match, all smaller ones have), and marks that width's matches without overlap. What a mark cuts off is found again in
    a later round with the length that it has left. There are at most as many rounds as tiles of different length.
    """
    if min(len(item), len(doc)) < shortest:
        return []
    at = _shared_part(item, doc, shortest)
    words = np.where(at >= 0, doc[at], 0)
    in_item, in_doc = np.zeros(len(item), bool), at < 0
    a, b, tiles = Rolling(item), Rolling(words), []

    def meets(width: int) -> bool:
        i, d = _free(in_item, width), _free(in_doc, width)
        return bool(len(i) and len(d)) and bool(np.isin(a.windows(width, i), b.windows(width, d)).any())

    most = min(len(item), len(at))
    while most >= shortest and meets(shortest):
        low, high = shortest, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if meets(middle) else (low, middle - 1)
        i, d = _free(in_item, low), _free(in_doc, low)
        hi, hd = a.windows(low, i), b.windows(low, d)
        order = np.argsort(hd, kind="stable")
        hd, d = hd[order], d[order]
        for p, first, last in zip(i.tolist(), np.searchsorted(hd, hi, "left").tolist(), np.searchsorted(hd, hi, "right").tolist()):
            if first == last or in_item[p : p + low].any():
                continue
            for q in d[first:last].tolist():
                if not in_doc[q : q + low].any() and np.array_equal(item[p : p + low], words[q : q + low]):
                    in_item[p : p + low] = in_doc[q : q + low] = True
                    tiles.append((p, int(at[q]), low))
                    break
        most = low if tiles and tiles[-1][2] == low else low - 1  # a collision of hashes alone marks nothing
    return sorted(tiles, key=lambda t: (-t[2], t[0], t[1]))


class Items:
    """A block of benchmark items with the seeds that lead to them."""

    def __init__(self, rows: Iterable[tuple[int, str | None]], shortest: int):
        kept = [(i, t) for i, t in ((i, tokens(t)) for i, t in rows) if len(t) >= shortest]
        self.ids, self.tokens = [i for i, _ in kept], [t for _, t in kept]
        seeds = [windows_hash(t, shortest) for t in self.tokens]
        self.seeds = np.concatenate([*seeds, np.empty(0, np.uint64)])
        self.owners = np.repeat(np.arange(len(kept)), [len(s) for s in seeds])
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.owners = self.seeds[order], self.owners[order]

    def sharing(self, doc: np.ndarray, shortest: int) -> np.ndarray:
        """Items that share a seed with the document."""
        if len(doc) < shortest or not len(self.seeds):
            return np.empty(0, np.int64)
        h = windows_hash(doc, shortest)
        at = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        hits = np.unique(h[self.seeds[at] == h])
        low, high = np.searchsorted(self.seeds, hits, "left"), np.searchsorted(self.seeds, hits, "right")
        return np.unique(np.concatenate([self.owners[x:y] for x, y in zip(low, high)])) if len(hits) else np.empty(0, np.int64)


KIND = "array<struct<item_id:bigint,n_words:bigint,n_covered:bigint,n_tiles:bigint>>"


def _leaks(spark, items: DataFrame, text: str, shortest: int, coverage: float):
    """The column of what ``text`` gives away of one block of items, and the block's broadcast."""
    shared = spark.sparkContext.broadcast(Items([tuple(r) for r in items.collect()], shortest))  # a block's worth

    @F.pandas_udf(KIND)
    def leaks(texts: pd.Series) -> pd.Series:
        known, out = shared.value, []
        for t in texts:
            seq, hits = tokens(t), []
            for k in known.sharing(seq, shortest):
                tiles = tile(known.tokens[k], seq, shortest)
                covered, n = sum(x[2] for x in tiles), len(known.tokens[k])
                if covered >= coverage * n:
                    hits.append({"item_id": known.ids[k], "n_words": n, "n_covered": covered, "n_tiles": len(tiles)})
            out.append(hits)
        return pd.Series(out, dtype=object)

    return leaks(F.col(text)), shared


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", into: str = "leaks", shortest: int = MIN_TILE, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with an array of the benchmark items that the text gives away: item_id, n_words, n_covered, n_tiles.

    One block of items is a column of the plan. More blocks run one after the other over numbered rows, each writing the
    few rows that it hits before the next block is read, so that one block at a time is in memory anywhere."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    if blocks == 1:
        return docs.withColumn(into, _leaks(spark, items, text, shortest, coverage)[0])
    rows, hits = cut(docs.withColumn("_dc_row", F.monotonically_increasing_id())), None
    for k in range(blocks):
        column, shared = _leaks(spark, items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k), text, shortest, coverage)
        found = cut(rows.select("_dc_row", column.alias("_dc_leaks")).where(F.size("_dc_leaks") > 0))
        hits = found if hits is None else hits.unionByName(found)
        shared.destroy()
    hits = hits.groupBy(F.col("_dc_row").alias("_dc_hit")).agg(F.flatten(F.collect_list("_dc_leaks")).alias("_dc_leaks"))
    out = rows.join(hits, F.col("_dc_row") == F.col("_dc_hit"), "left")
    return out.withColumn(into, F.coalesce("_dc_leaks", F.array().cast(KIND))).drop("_dc_row", "_dc_hit", "_dc_leaks")


def query(spark, sf_dir: str) -> DataFrame:
    """One row for each contaminated document and item that it gives away."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return flag(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go."""
    return flag(docs, read(spark, sf_dir, "benchmark"), into="_dc_found").where(F.size("_dc_found") == 0).select(docs.columns)
