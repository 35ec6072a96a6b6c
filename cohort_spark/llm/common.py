"""What the operators of this subpackage share: shared-folder tables, words, hashes, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a pattern for Spark's regular expressions.
BREAKS = r"[\x20\x09-\x0D]+"

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode and where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="cohort-shared-"))
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from the files, whoever is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``cut`` returned, once no later plan reads it; the tables made from it are files of their own."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def split_words(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z lower-cased; bytes.split breaks at the same six characters as BREAKS."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, or byte strings, of an Arrow array one after the other, and where each starts, with the end
    as one more; null is empty. Nothing is copied where no text is null."""
    large = texts.cast(pa.large_binary())
    if large.null_count:
        large = large.fill_null(b"")
    if not len(large):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = large.buffers()
    offsets = np.frombuffer(offsets, np.int64)[large.offset : large.offset + len(large) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


#: Bytes of a text that are split into terms at once.
SEGMENT = 1 << 20


def segments(data: np.ndarray, term: bytes) -> Iterator[list[bytes]]:
    """The terms, maximal matches of ``term``, of a text's bytes with A-Z lower-cased, for a bounded stretch of it at a time.
    Long texts are cut where no term can go on; only a single term may be longer than a stretch."""
    found = re.compile(term)
    at = 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data):  # the place of the first byte after it that is in no term
            more = data[end : end + SEGMENT].tobytes().lower()
            match = found.match(more)
            if not match:
                break
            end += match.end()
        yield found.findall(data[at:end].tobytes().lower())
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def hash_words(tokens: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=False) if tokens else np.empty(0, np.uint64)


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` words; the whole sequence as one window if it is shorter."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's word windows."""
    return np.unique(windows_hash(hash_words(split_words(text)), width))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches over ``links`` (a, b).

    Alternates the large-star and small-star steps, which need a number of rounds that grows with the
    logarithm of the number of nodes; each round is a few grouped joins and ends in a written table. The node that a whole
    component points to has all its edges under one key: its least neighbour is an aggregate that combines before its
    shuffle, joined back, which Spark may split where one key is too large. No window holds them.
    Null ends and self-links are ignored; nodes without links don't appear.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select("b", "a"))

    def least(e: DataFrame, keep) -> DataFrame:
        """Every neighbour v of u points to the least of u and its neighbours, for the (u, v) that ``keep`` takes."""
        lows = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        out = e.join(lows, "a")
        return out.where(keep(out)).select(F.col("b").alias("x"), F.col("m").alias("y"))

    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("x") != F.col("y")).select(
            F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()

    edges = cut(links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        large = tidy(least(both(edges), lambda e: F.col("b") > F.col("a")))
        own = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = tidy(own.select(F.col("b").alias("x"), F.col("m").alias("y")).union(
            own.select(F.col("a").alias("x"), F.col("m").alias("y"))))
        edges = cut(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b"), F.col("b")).distinct())
