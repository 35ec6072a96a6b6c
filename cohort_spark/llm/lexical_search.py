"""Ranked lexical search: the best documents for each query, by range maxima over intervals of documents.

A pass over the texts writes, for every document, its length and the query terms it holds. From these Spark adds up the
collection's counts, and every task searches its own documents: a chunk of them is put in an order that brings documents
with the same rare terms together, each term's postings are an array of impacts, and a sparse table over that array gives
the largest impact, and where it is, of any interval of documents by two look-ups. An interval's bound is the sum of its
terms' largest impacts. Intervals are taken best first; each is split at the document of its largest impact, which is
scored exactly, and the two intervals left of and right of it get bounds of their own. Intervals whose bound is below the
tenth best score that the task knows are left out; those that tie with it are not, so ties are settled by id. Tasks hand on
their best documents alone, and Spark keeps the best of these.

Queries are dealt into blocks of bounded size by their text; equal texts are one query with several ids.

Defined results: null texts have no terms; documents without terms count nowhere; queries without terms find nothing; every
row is a document of its own, so repeated rows take ranks of their own; null ids come last among equal scores; an item id
with several texts has a ranking for each, repeated rows of queries count once; empty tables find nothing; other columns
don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, read, segments, utf8

TOP = 10
#: Characters of the queries of a block, on average; a block's terms and weights are broadcast.
BLOCK_CHARS = 4_000_000
#: Postings that are searched at once.
POSTINGS = 1 << 18
#: Intervals that are split at once.
AT_ONCE = 64
#: b = 0.75 and k1 = 1.2 of the scoring in whole numbers: percent, and 1000 * 1.2 / 1.5 for a hundredth of a length.
PERCENT, SATURATION = 75, 8

_TERM = rb"[0-9a-z\x80-\xff]+"


def terms_of(data: np.ndarray) -> Counter:
    """Occurrences of each term in a text's bytes."""
    found: Counter = Counter()
    for terms in segments(data, _TERM):
        found.update(terms)
    return found


def _postings(vocabulary, schema: pa.Schema, carried: str):
    """(id, n, terms, tfs) of each document with terms: its number of terms, and those of the vocabulary with their counts."""

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows, sizes, terms, counts = [], [], [], []
            for row in range(batch.num_rows):
                found = terms_of(data[offsets[row] : offsets[row + 1]])
                if found:
                    here = found.keys() & known.keys()
                    rows.append(row)
                    sizes.append(found.total())
                    terms.append([known[t] for t in here])
                    counts.append([found[t] for t in here])
            yield pa.RecordBatch.from_arrays([batch.column(carried).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], schema=schema)

    return hold


class Chunk:
    """Documents in an order of our own, the postings of each term, and the places of range maxima over these."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, lengths: np.ndarray, weights: np.ndarray):
        """``sizes`` are the documents' numbers of postings, ``lengths`` their m of the scoring formula."""
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)
        rarest = np.full(n, -1, np.int64)
        np.maximum.at(rarest, owner, weights[terms] * len(weights) + terms)  # the heaviest term, ties by number
        self.order = np.lexsort((lengths, rarest))
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.width = n + 1
        keys = terms * self.width + place[owner]
        by = np.argsort(keys)
        self.keys = keys[by]
        self.impacts = ((1_000_000_000 * tfs) // (1000 * tfs + SATURATION * lengths[owner]))[by]
        self.table = [np.arange(len(by), dtype=np.int32)]
        step = 1
        while step * 2 <= min(n, len(by)):
            left, right = self.table[-1][:-step], self.table[-1][step:]
            self.table.append(np.where(self.impacts[left] >= self.impacts[right], left, right))
            step *= 2
        self.table = np.array([np.pad(t, (0, len(by) - len(t))) for t in self.table]) if len(by) else np.zeros((1, 1), np.int32)

    def bounds(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of posting ranges [low, high), one a term: the sums of largest impacts, and the document to split at."""
        size = high - low
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        a = self.table[level, np.where(some, low, 0)]
        b = self.table[level, np.where(some, high - (1 << level), 0)]
        best = np.where(self.impacts[a] >= self.impacts[b], a, b)
        parts = np.where(some, self.impacts[best], 0) * weights
        greatest = np.argmax(parts, axis=1)
        return parts.sum(axis=1), self.keys[best[np.arange(len(best)), greatest]] % self.width

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold all of the chunk's ``top`` best with scores from ``least`` on, and ties."""
        base = terms * self.width
        low, high = [np.searchsorted(self.keys, x)[None, :] for x in (base, base + self.width - 1)]
        bound, split = self.bounds(low, high, weights)
        first, last = np.array([0]), np.array([self.width - 2])
        docs, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        best = np.empty(0, np.int64)
        while True:
            live = bound >= least
            if not live.all():
                first, last, low, high, bound, split = (x[live] for x in (first, last, low, high, bound, split))
            if not len(bound):
                break
            chosen = np.argpartition(-bound, AT_ONCE - 1)[:AT_ONCE] if len(bound) > AT_ONCE else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            m, lo, hi = split[chosen], low[chosen], high[chosen]
            at = np.searchsorted(self.keys, base + m[:, None])
            here = (at < hi) & (self.keys[np.minimum(at, len(self.keys) - 1)] == base + m[:, None])
            score = (np.where(here, self.impacts[np.minimum(at, len(self.keys) - 1)], 0) * weights).sum(axis=1)
            good = score >= least
            docs.append(self.order[m[good]])
            scores.append(score[good])
            best = np.sort(np.r_[best, score[good]])[-top:]
            if len(best) == top:
                least = max(least, int(best[0]))
            left, right = first[chosen] < m, m < last[chosen]
            new_low = np.r_[lo[left], (at + here)[right]]
            new_high = np.r_[at[left], hi[right]]
            new_bound, new_split = self.bounds(new_low, new_high, weights) if len(new_low) else (bound[:0], split[:0])
            first = np.r_[first[rest], first[chosen][left], m[right] + 1]
            last = np.r_[last[rest], m[left] - 1, last[chosen][right]]
            low, high = np.r_[low[rest], new_low], np.r_[high[rest], new_high]
            bound, split = np.r_[bound[rest], new_bound], np.r_[split[rest], new_split]
        return np.concatenate(docs), np.concatenate(scores)


def chunks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbouring documents with at most POSTINGS postings, or a single one with more."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        end = max(first + 1, int(np.searchsorted(ends, before + POSTINGS, "right")))
        yield first, end
        first = end


def _best(shared, schema: pa.Schema, carried: str, top: int):
    """(query, id, score): the best documents of the task for each query."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights, documents, total = shared.value
        found: dict[int, list] = {q: [] for q in queries}
        for batch in batches:
            n = batch.column("n").to_numpy()
            lengths = 100 - PERCENT + (PERCENT * n * documents) // total
            lists = batch.column("terms")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            terms, tfs = lists.values.to_numpy().astype(np.int64), batch.column("tfs").values.to_numpy()
            sizes = np.diff(offsets)
            for low, high in chunks(sizes):
                a, b = offsets[low], offsets[high]
                chunk = Chunk(sizes[low:high], terms[a:b], tfs[a:b], lengths[low:high], weights)
                for q, (mine, repeats) in queries.items():
                    known = found[q]
                    least = known[-1][0] if len(known) == top else 1
                    docs, scores = chunk.search(mine, repeats * weights[mine], least, top)
                    if len(docs):
                        if len(scores) > top:
                            keep = scores >= np.partition(scores, -top)[-top]
                            docs, scores = docs[keep], scores[keep]
                        ids = batch.column(carried).take(pa.array(docs + low)).to_pylist()
                        merged = known + list(zip(scores.tolist(), ids))
                        found[q] = sorted(merged, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:top]
        rows = [(q, i, s) for q, best in found.items() for s, i in best]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return search


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """(query, term, repeats) of (query, ``text``)."""
    schema = "query long, term string, repeats long"

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            found = [terms_of(data[a:b]) for a, b in zip(offsets, offsets[1:])]
            query = np.repeat(batch.column("query").to_numpy(), [len(f) for f in found])
            terms = [t.decode("utf-8", "replace") for f in found for t in f]
            counts = [c for f in found for c in f.values()]
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(terms, pa.string()), pa.array(counts, pa.int64())], names=["query", "term", "repeats"])

    return queries.select("query", text).mapInArrow(split, schema)


def search(docs: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(``item``, rank, ``id``, score) of the ``top`` documents with a score for each row of ``queries`` (``item``, text)."""
    spark = docs.sparkSession
    texts = F.coalesce(F.col("text"), F.lit(""))
    known = cut(queries.select(F.col(item).alias("item"), texts.alias("text")).distinct())
    numbered = cut(known.select("text").distinct().withColumn("query", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil((numbered.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    best = None
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for k in range(blocks):
        block = numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k)
        found = cut(_search_block(spark, rows, query_terms(block, "text").collect(), top))
        best = found if best is None else best.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ids = known.join(numbered, "text").select("item", "query")
    return ids.join(ranked, "query").select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")


def _search_block(spark, rows: DataFrame, wanted: list, top: int) -> DataFrame:
    """(query, id, score) of each task's best documents for the queries ``wanted`` (query, term, repeats)."""
    numbers = {t: k for k, t in enumerate(sorted({r.term for r in wanted}))}
    vocabulary = spark.sparkContext.broadcast({t.encode(): k for t, k in numbers.items()})
    held = T.StructType([rows.schema["id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])
    postings = cut(rows.mapInArrow(_postings(vocabulary, _arrow(held), "id"), held))
    documents, total = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # One row for each term of the block.
    df = {r.term: r.n for r in postings.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(numbers))], np.int64)
    queries: dict[int, tuple[list, list]] = {}
    for r in wanted:
        mine = queries.setdefault(r.query, ([], []))
        mine[0].append(numbers[r.term])
        mine[1].append(r.repeats)
    arrays = {q: (np.array(t, np.int64), np.array(n, np.int64)) for q, (t, n) in queries.items()}
    shared = spark.sparkContext.broadcast((arrays, weights, documents, max(total, 1)))
    schema = T.StructType([T.StructField("query", T.LongType()), rows.schema["id"], T.StructField("score", T.LongType())])
    return postings.mapInArrow(_best(shared, _arrow(schema), "id", top), schema)


def query(spark, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"unnest(regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'))"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
t AS (SELECT r, doc_id, {_SPLIT} AS term FROM d),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT r, count(*) AS n FROM t GROUP BY r),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
q AS (SELECT item_id, term, count(*) AS k FROM (SELECT item_id, {_SPLIT} AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * s.docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term, s.docs),
m AS (SELECT r, 100 - {PERCENT} + ({PERCENT} * n * s.docs) // s.total AS m FROM n, s),
x AS (SELECT q.item_id, f.r, f.doc_id, sum(q.k * w.w * ((1000000000 * f.tf) // (1000 * f.tf + {SATURATION} * m.m)))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY rank <= {TOP}
"""
