"""Removal of repeated passages by prefix doubling over the bytes of all texts.

A byte goes if a string of ``threshold`` bytes that covers it also starts at another place of any text. Such places are
found as a suffix array finds them: Spark sorts pairs of (rank of a position's prefix so far, what follows at the next
offset), equal pairs get one new rank, positions whose pair is unique drop out, and prefix lengths grow until the
threshold: a quarter of it, a half, nine tenths, all of it.

Ranking every byte of a corpus at every length would shuffle many times the corpus, so a round at prefix length K ranks a
sample that loses nothing: each place p is judged at its anchor, the place with the least fingerprint of K bytes among the
threshold - K + 1 places from p on. Equal strings of ``threshold`` bytes have their anchors at the same offset, with the
same K bytes, so a place whose anchor's prefix is unique is unique itself. An anchor stands for a run of neighbouring
places; the run's context is all the bytes of their strings. Contexts that occur twice or more are settled as a whole. Of
contexts that share an anchor's prefix with different ones, one of each is cut out and goes on, with the anchor's rank
and its number of copies, to the next, longer prefix with its denser sample; at the last length every place left is its own
anchor. So copies, however many, are one context from the first round on.

Ranks stand for 64-bit fingerprints of a prefix; a context, and the whole string at the last length, is told by a second,
independent fingerprint within one rank, so equal strings are told by 128 bits at least.

Defined results: a null text is an empty one; a text of fewer bytes than the threshold keeps all; strings never cross
texts; every row is a document of its own, so rows that repeat lose what they share, whatever their ids, null ids
included; empty tables give empty tables; removed bytes may leave half a character, so what is kept is binary; columns
``spans`` and ``kept`` are replaced, all others kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, discard, mix, read, utf8

THRESHOLD = 200
#: Bytes that are fingerprinted at once; longer texts are taken in parts that overlap.
CHUNK = 1 << 18
_LOW = np.uint64(CHUNK - 1)
#: A run of places is one number: its first place times _RUN plus the number of further places.
_RUN = 1 << 16


def prefix_lengths(threshold: int) -> list[int]:
    """Ascending; the last is the threshold."""
    return sorted({max(1, threshold // 4), max(1, threshold // 2), threshold - threshold // 10, threshold})


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints of each byte, powers of an odd base and of its inverse modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    seeds = mix(np.arange(1, 513, dtype=np.uint64) * np.uint64(base))

    def powers(b: int) -> np.ndarray:
        out = np.full(CHUNK + 1, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return seeds[:256], seeds[256:], powers(base), powers(pow(base, -1, 1 << 64))


def _window_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by windows of doubling width."""
    n, m, w = len(v) - width + 1, v, 1
    while w * 2 <= width:
        m, w = np.minimum(m[:-w], m[w:]), w * 2
    return np.minimum(m[:n], m[width - w : width - w + n])


def anchored(data: np.ndarray, ends: np.ndarray, threshold: int, prefix: int):
    """(text, first place, further places, prefix fingerprint, context fingerprint) of the runs of the texts whose bytes
    ``data`` holds one after the other; ``ends`` are their ends. At most CHUNK bytes."""
    n = len(data)
    starts = np.r_[0, ends[:-1]]
    if n < threshold:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    one, two, powers, inverse = _tables()
    sums, more = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(one[data] * powers[:n], out=sums[1:])
    np.cumsum(two[data] * powers[:n], out=more[1:])
    prints = mix((sums[prefix:] - sums[:-prefix]) * inverse[: n - prefix + 1])
    places = np.arange(len(prints), dtype=np.uint64)
    at = (_window_least((prints & ~_LOW) | places, threshold - prefix + 1) & _LOW).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(at)]
    p = np.flatnonzero(np.arange(len(at)) + threshold <= ends[text])  # strings that don't cross a text's end
    if not len(p):
        return p, p, p, p, p
    turn = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(at[p]) != 0)])
    first, last = p[turn], p[np.r_[turn[1:] - 1, len(p) - 1]]
    whole = mix((more[last + threshold] - more[first]) * inverse[first] + (last - first).astype(np.uint64))
    text = text[first]
    return text, first - starts[text], last - first, prints[at[first]].view(np.int64), whole.view(np.int64)


def parts(offsets: np.ndarray, threshold: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, first byte, end byte) of chunks of whole rows, and of overlapping parts of longer rows."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        low, high = int(offsets[row]), int(offsets[end])
        if high - low <= CHUNK:
            yield row, end, low, high
        else:
            for at in range(low, high - threshold + 1, CHUNK - threshold + 1):
                yield row, end, at, min(at + CHUNK, high)
        row = end


def _sample(schema: pa.Schema, column: str, base: str | None, threshold: int, prefix: int) -> Callable:
    """Runs of the texts or byte strings in ``column``, with the other columns beside each. ``base`` names the place at
    which a byte string starts in its document."""

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(column))
            others = batch.drop_columns([column] if base is None else [column, base])
            bases = np.zeros(batch.num_rows, np.int64) if base is None else batch.column(base).to_numpy()
            for row, end, low, high in parts(offsets, threshold):
                ends = offsets[row + 1 : end + 1] - low if high == offsets[end] and low == offsets[row] else np.array([high - low])
                text, first, further, fp, ctx = anchored(data[low:high], ends, threshold, prefix)
                if len(text):
                    place = first + (low - offsets[row] if len(ends) == 1 else 0) + bases[row + text]
                    kept = others.take(pa.array(row + text))
                    yield pa.RecordBatch.from_arrays([*kept.columns, *map(pa.array, (place * _RUN + further, fp, ctx))], schema=schema)

    return runs


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _runs_of(items: DataFrame, column: str, base: str | None, threshold: int, prefix: int) -> DataFrame:
    """The columns of ``items`` but ``column`` and ``base``, and run, fp, ctx."""
    kept = [f for f in items.schema if f.name not in (column, base)]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in ("run", "fp", "ctx")]])
    return items.mapInArrow(_sample(_arrow(schema), column, base, threshold, prefix), schema)


def _rerank(rows: DataFrame) -> DataFrame:
    """The written ``rows`` (rank, fp, ctx, copies, ...), which go, whose pair (rank, fp) isn't unique, with the pair's place in Spark's sort order
    as new rank, and ``mixed``: whether its contexts differ."""
    pairs = rows.groupBy("rank", "fp").agg(F.sum("copies").alias("_n"), F.min("ctx").alias("_low"), F.max("ctx").alias("_high")).where("_n > 1")
    ranks = cut(pairs.orderBy("rank", "fp").select("rank", "fp", F.monotonically_increasing_id().alias("_rank"), (F.col("_low") != F.col("_high")).alias("mixed")))
    out = cut(rows.join(ranks, ["rank", "fp"]).drop("rank", "fp").withColumnRenamed("_rank", "rank"))
    discard(rows)
    discard(ranks)
    return out


def _contexts(rows: DataFrame, named: list[str]) -> DataFrame:
    """(rank, ctx, mixed, copies, one): the different contexts of each rank, the number of their copies, 2 for more, and
    the columns ``named`` of one of them."""
    found = rows.groupBy("rank", "ctx", "mixed").agg(F.sum("copies").alias("_n"), F.min(F.struct(*named)).alias("one"))
    return cut(found.select("rank", "ctx", "mixed", F.least("_n", F.lit(2).cast("long")).alias("copies"), "one"))


def _left(contexts: DataFrame) -> DataFrame:
    """Contexts that go on: those of ranks with different contexts, one of which occurs once."""
    mixed = contexts.where("mixed")
    return mixed.join(mixed.where("copies = 1").select("rank").distinct(), "rank", "left_semi")


def _pieces(docs: DataFrame, wanted: DataFrame, threshold: int) -> DataFrame:
    """(item, rank, copies, id, print, base, data): the bytes of the contexts ``wanted`` (rank, copies, one)."""
    runs = wanted.groupBy(F.col("one.id").alias("_id"), F.col("one.print").alias("_print")).agg(F.collect_list(F.struct("rank", "copies", "one.run")).alias("_runs"))
    here = docs.join(runs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")))
    schema = T.StructType([docs.schema["id"], T.StructField("print", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("rank", "copies", "base")], T.StructField("data", T.BinaryType())])
    arrow = _arrow(schema)

    def cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for row, runs in enumerate(batch.column("_runs")):
                found = runs.as_py()
                starts = [r["run"] // _RUN for r in found]
                ends = [s + r["run"] % _RUN + threshold for s, r in zip(starts, found)]
                low = int(offsets[row])
                bytes_ = [data[low + s : low + e].tobytes() for s, e in zip(starts, ends)]
                same = batch.select(["id", "print"]).take(pa.array([row] * len(found), pa.int64()))
                columns = [[r["rank"] for r in found], [r["copies"] for r in found], starts]
                yield pa.RecordBatch.from_arrays([*same.columns, *[pa.array(c, pa.int64()) for c in columns], pa.array(bytes_, pa.binary())], schema=arrow)

    return here.select("id", "print", "text", "_runs").mapInArrow(cut_out, schema)


def _numbered(items: DataFrame) -> DataFrame:
    return cut(items.withColumn("item", F.monotonically_increasing_id()))


def repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id, print, run): the runs of places of ``docs`` (id, print, text) whose strings occur elsewhere."""
    lengths = prefix_lengths(threshold)
    rows = cut(_runs_of(docs, "text", None, threshold, lengths[0]).withColumns({"rank": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")}))
    rows = _rerank(rows)
    contexts = _contexts(rows, ["id", "print", "run"])
    settled = contexts.where("copies > 1").select("rank", "ctx")
    hits = rows.join(settled, ["rank", "ctx"]).select("id", "print", "run")
    items = _numbered(_pieces(docs, _left(contexts), threshold))
    for length in lengths[1:]:
        rows = _rerank(cut(_runs_of(items, "data", "base", threshold, length)))
        contexts = _contexts(rows, ["item", "run"])
        settled = contexts.where("copies > 1").select("rank", "ctx")
        # What had copies before is a hit already.
        hits = hits.unionByName(rows.where("copies = 1").join(settled, ["rank", "ctx"]).select("id", "print", "run"))
        if length < threshold:
            wanted = _left(contexts).select(F.col("one.item").alias("item"), F.col("rank").alias("_rank"), F.col("copies").alias("_copies"), F.col("one.run").alias("_run"))
            place, further = F.floor(F.col("_run") / _RUN), F.col("_run") % _RUN
            # Sums of an offset in a byte string and a length; both are small.
            data = F.substring("data", (place - F.col("base") + 1).cast("int"), (further + threshold).cast("int"))
            cuts = items.drop("rank", "copies").join(wanted, "item").select("id", "print", F.col("_rank").alias("rank"), F.col("_copies").alias("copies"), place.alias("base"), data.alias("data"))
            longer, items = items, _numbered(cuts)
            discard(longer)
    discard(items)
    return hits


def spans_of(runs: np.ndarray, threshold: int, n: int) -> np.ndarray:
    """Maximal removed stretches (start, end), a row each, of a text of n bytes."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs // _RUN, 1)
    np.add.at(edges, runs // _RUN + runs % _RUN + threshold, -1)
    gone = np.r_[False, np.cumsum(edges)[:-1] > 0, False]
    return np.flatnonzero(np.diff(gone)).reshape(-1, 2)


SPANS = "array<struct<start:bigint,end:bigint>>"


def _keep(text: str, threshold: int) -> Column:
    @F.pandas_udf(f"spans {SPANS}, kept binary")
    def keep(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        out = []
        for text, runs in zip(texts, hits):
            data = text.encode("utf-8", "surrogatepass") if text else b""
            if runs is None or not len(runs):
                out.append(([], data))
                continue
            spans = spans_of(np.asarray(runs, np.int64), threshold, len(data)).tolist()
            kept = [data[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(data)])]
            out.append(([{"start": s, "end": e} for s, e in spans], b"".join(kept)))
        return pd.DataFrame(out, columns=["spans", "kept"])

    return keep(F.col(text), F.col("_sd_runs"))


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with spans (start and end of each maximal removed run of bytes) and kept (the bytes that stay)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hits = repeats(docs.select(F.col(id).alias("id"), F.xxhash64(whole).alias("print"), whole.alias("text")), threshold)
    hits = hits.groupBy(F.col("id").alias("_sd_id"), F.col("print").alias("_sd_print")).agg(F.collect_set("run").alias("_sd_runs"))
    named = docs.drop("spans", "kept").withColumn("_sd_of", F.xxhash64(whole))
    out = named.join(hits, F.col(id).eqNullSafe(F.col("_sd_id")) & (F.col("_sd_of") == F.col("_sd_print")), "left")
    return (out.withColumn("_sd", _keep(text, threshold)).withColumns({"spans": F.col("_sd.spans"), "kept": F.col("_sd.kept")})
            .drop("_sd", "_sd_of", "_sd_id", "_sd_print", "_sd_runs"))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string is hashed at every place; two hexadecimal digits stand for a byte.
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (SELECT doc_id, r, x, (length(x) // 2)::BIGINT AS n FROM d),
p AS (SELECT r, unnest(range(0, n - {THRESHOLD - 1})) AS p, x FROM n WHERE n >= {THRESHOLD}),
h AS (SELECT r, p, md5_number(substr(x, 2 * p + 1, {2 * THRESHOLD})) AS h FROM p),
t AS (SELECT r, p FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
e AS (SELECT r, p, p - lag(p) OVER (PARTITION BY r ORDER BY p) AS gap FROM t),
g AS (SELECT r, p, count(*) FILTER (gap IS NULL OR gap > {THRESHOLD}) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) AS g FROM e),
s AS (SELECT r, g, min(p) AS a, max(p) + {THRESHOLD} AS b FROM g GROUP BY r, g),
k AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY r),
j AS (SELECT n.r, n.x, n.n, k.n_spans, k.n_removed, list_concat([0], k.b) AS a, list_concat(k.a, [n.n]) AS b FROM n JOIN k USING (r)),
o AS (SELECT r, array_to_string(list_transform(range(1, len(a) + 1), lambda i: substr(x, 2 * a[i] + 1, 2 * (b[i] - a[i]))), '') AS kept FROM j)
SELECT n.doc_id, n.n AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(o.kept, n.x))) AS kept_sha256
FROM n LEFT JOIN k USING (r) LEFT JOIN o USING (r)
"""
