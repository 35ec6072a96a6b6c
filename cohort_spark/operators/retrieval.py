"""Retrieval stability: query texts, top-k search, overlap and ranking metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation_pvalue
from ..functions.text import label_anchor, normalize_feature_name
from . import ranks

#: Query vectors that one pass over the documents takes: a block is broadcast to the scan (64 MB at 1024 doubles).
QUERY_BLOCK = 8192
#: Documents that meet the queries at once, and pivots that bring similar documents of a batch together.
STRIP, PIVOTS = 512, 64


def build_queries(top: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(id, label, model, stream, query): anchor and the distinct readable names of the strongest features by rank; and the
    stream "combined", the first stream's query followed by the names of the other streams, as they are."""
    rows = top.withColumn("name", normalize_feature_name(F.col("feature")))
    keys = ["id", "label", "model"]
    most = F.coalesce(*[F.when(F.col("stream") == s, F.lit(n)) for s, n in limits.items()], F.lit(1 << 30))
    rows = rows.where((F.col("rank") <= most) & (F.col("name") != ""))
    ranked = F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda r: r["name"])  # limits bound a case's names
    by = rows.groupBy(*keys, "stream").agg(ranked.alias("names"))
    by = by.withColumn("query", F.concat_ws(" ", label_anchor(F.col("label")), F.concat_ws(" ", F.array_distinct("names"))))
    lead, *rest = limits
    parts = [F.max(F.when(F.col("stream") == lead, F.col("query")))] + [F.max(F.when(F.col("stream") == s, F.concat_ws(" ", "names"))) for s in rest]
    both = by.groupBy(*keys).agg(F.trim(F.concat_ws(" ", F.coalesce(parts[0], label_anchor(F.first("label"))), *parts[1:])).alias("query"))
    return by.select(*keys, "stream", "query").unionByName(both.select(*keys, F.lit("combined").alias("stream"), "query"))


def l2_normalize(vector: Column, floor: float = 1e-9) -> Column:
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(floor)))


def rank_hits(hits: DataFrame, k: int, query: list[str] = ("query_id",), doc: str = "doc_id") -> DataFrame:
    """The k most similar documents of each query with rank; the smaller id of equals first."""
    w = Window.partitionBy(*query).orderBy(F.desc("sim"), doc)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Hits:
    """The k best documents of each query so far, over all batches of a task.

    Documents of a batch are put in order by the pivot they are nearest to, pivots being documents of the batch; those of one
    pivot are a strip, or several. With c a strip's mean and r the largest distance from it, no document of the strip is more similar to a query q
    than q * c + |q| * r, so queries whose k-th best similarity is above that skip the strip. Skipping changes no result.
    """

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.sizes = np.linalg.norm(queries, axis=1)
        self.sims = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.met = self.skipped = 0  # pairs of a query and a strip

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        pivots = vectors[:: max(1, len(vectors) // PIVOTS)][:PIVOTS]
        distance = (pivots * pivots).sum(axis=1) / 2 - vectors @ pivots.T  # up to what all pivots have in common
        nearest = distance.argmin(axis=1)
        order = np.lexsort((distance[np.arange(len(vectors)), nearest], nearest))
        ids, vectors, nearest = ids[order], vectors[order], nearest[order]
        ends = [*np.flatnonzero(np.diff(nearest)) + 1, len(ids)]
        for first, end in zip([0, *ends], ends):
            for low in range(first, end, STRIP):
                self._strip(ids[low : min(low + STRIP, end)], vectors[low : min(low + STRIP, end)])

    def _strip(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        middle = vectors.mean(axis=0)
        radius = np.sqrt(((vectors - middle) ** 2).sum(axis=1).max())
        # A little more than rounding can lose, on both sides of the comparison.
        slack = 1e-9 * self.sizes * (np.linalg.norm(middle) + radius)
        here = np.flatnonzero(~(self.queries @ middle + self.sizes * radius + slack < self.sims[:, -1]))
        self.met += len(self.queries)
        self.skipped += len(self.queries) - len(here)
        sims = self.queries[here] @ vectors.T
        better = ~(sims.max(axis=1) < self.sims[here, -1]) if len(here) else np.empty(0, bool)
        here, sims = here[better], sims[better]
        if len(here):
            all_sims = np.concatenate([self.sims[here], sims], axis=1)
            all_ids = np.concatenate([self.ids[here], np.broadcast_to(ids, sims.shape)], axis=1)
            best = np.lexsort((all_ids, -all_sims), axis=-1)[:, : self.k]  # the smaller id of equals first
            self.sims[here], self.ids[here] = np.take_along_axis(all_sims, best, 1), np.take_along_axis(all_ids, best, 1)


def topk(queries: DataFrame, docs: DataFrame, k: int = 5, block: int = QUERY_BLOCK, pairs: tuple | None = None) -> DataFrame:
    """(query_id, doc_id, sim, rank) by dot product of ``vec`` columns, all queries against all documents.

    Queries are dealt into blocks of a bounded size. A block is broadcast; each task keeps its k best candidates for each
    query over all its documents, so only these shuffle, once for each task. ``pairs`` are two accumulators that take the
    numbers of pairs of a query and a strip of documents, and of those that a bound left out. Where there are several
    blocks, each one's hits are written before the next is read.
    """
    spark = docs.sparkSession
    parts = max(1, -(-queries.count() // block))
    there = docs.select("doc_id", "vec").where("vec is not null")
    out = None
    for p in range(parts):
        chunk = queries.where((F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) & F.col("vec").isNotNull()).select("query_id", "vec").toArrow()
        if not chunk.num_rows:
            continue
        vecs = chunk["vec"].combine_chunks()
        matrix = vecs.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(chunk.num_rows, -1)
        shared = spark.sparkContext.broadcast((chunk["query_id"].to_numpy(), matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            hits = Hits(q, k)
            for b in batches:
                if b.num_rows:
                    vectors = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                    hits.add(b.column("doc_id").to_numpy(zero_copy_only=False), vectors.reshape(b.num_rows, -1))
            if pairs:
                pairs[0].add(hits.met)
                pairs[1].add(hits.skipped)
            row, at = np.nonzero(np.isfinite(hits.sims) | (hits.ids != np.iinfo(np.int64).max))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(hits.ids[row, at]), pa.array(hits.sims[row, at])], ["query_id", "doc_id", "sim"])

        hits = there.mapInArrow(run, "query_id long, doc_id long, sim double")
        if parts > 1:  # one block at a time in memory anywhere
            path = f"{_shared_folder(spark)}/tables/{uuid.uuid4().hex}"
            rank_hits(hits, k).drop("rank").write.parquet(path)
            hits = spark.read.schema("query_id long, doc_id long, sim double").parquet(path)
            shared.destroy()
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], "query_id long, doc_id long, sim double")
    return rank_hits(out, k)


def _shared_folder(spark) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("more than one block of queries needs spark.checkpoint.dir, a folder that all executors share")
    return folder


def merge_streams(hits: list[DataFrame], k: int = 5, query: list[str] = ("query_id",)) -> DataFrame:
    """Hits of several streams as one list: each document once, with its largest similarity, ranked anew."""
    union = hits[0]
    for h in hits[1:]:
        union = union.unionByName(h)
    return rank_hits(union.groupBy(*query, "doc_id").agg(F.max("sim").alias("sim")), k, list(query))


def two_stream(queries: list[DataFrame], docs: list[DataFrame], k: int = 5) -> DataFrame:
    """Top k of each stream's queries against its document vectors, merged."""
    return merge_streams([topk(q, d, k) for q, d in zip(queries, docs)], k)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two id sets; 1 if both are empty."""
    a, b = F.coalesce(a, F.array()), F.coalesce(b, F.array())
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def hit_sets(hits: DataFrame, name: str, query: list[str] = ("query_id",)) -> DataFrame:
    return hits.groupBy(*query).agg(F.collect_set("doc_id").alias(name))


def doc_jaccard(a: DataFrame, b: DataFrame, query: list[str] = ("query_id",)) -> DataFrame:
    """(query, jaccard) of two hit lists."""
    return hit_sets(a, "_a", query).join(hit_sets(b, "_b", query), list(query), "full").select(*query, jaccard(F.col("_a"), F.col("_b")).alias("jaccard"))


def mid_rank(column: str, *keys: str) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / 2


def spearman(pairs: DataFrame, x: str, y: str, keys: list[str], least: int = 3) -> DataFrame:
    """(keys, n, rho); NaN for fewer than ``least`` rows or a constant side."""
    ranked = pairs.withColumns({"_x": mid_rank(x, *keys), "_y": mid_rank(y, *keys)})
    out = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r"), F.stddev_pop("_x").alias("sx"), F.stddev_pop("_y").alias("sy"))
    return out.select(*keys, "n", F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("r")).otherwise(float("nan")).alias("rho"))


def rank_correlation(a: DataFrame, b: DataFrame, query: list[str] = ("query_id",)) -> DataFrame:
    """Spearman correlation of similarities over the documents that both lists have."""
    q = list(query)
    both = a.select(*q, "doc_id", F.col("sim").alias("sa")).join(b.select(*q, "doc_id", F.col("sim").alias("sb")), [*q, "doc_id"])
    return spearman(both, "sa", "sb", q)


def pair_models(hits: DataFrame, x: str, y: str) -> DataFrame:
    """(id, label, hits of model x, hits of model y)."""
    a, b = (hits.where(F.col("model") == m).groupBy("id", "label").agg(F.collect_set("doc_id").alias(n)) for m, n in ((x, "hits_x"), (y, "hits_y")))
    return a.join(b, ["id", "label"])


def stability(source: dict[str, DataFrame], other: dict[str, DataFrame], query: list[str] = ("query_id",)) -> DataFrame:
    """(query, jacc_{stream}, rho_{stream}) between two models' hit lists, for each stream."""
    out = None
    for s in source:
        row = doc_jaccard(source[s], other[s], query).withColumnRenamed("jaccard", f"jacc_{s}").join(
            rank_correlation(source[s], other[s], query).select(*query, F.col("rho").alias(f"rho_{s}")), list(query), "left").fillna({f"rho_{s}": float("nan")})
        out = row if out is None else out.join(row, list(query), "full")
    return out


def summarize(cases: DataFrame, metrics: list[str], label: str = "label") -> DataFrame:
    """(label or "overall", n_{m}, mean_{m}, sd_{m}): NaN and null are skipped; all levels in one pass."""
    aggs = []
    for m in metrics:
        v = F.when(~F.isnan(m), F.col(m))
        aggs += [F.count(v).alias(f"n_{m}"), F.avg(v).alias(f"mean_{m}"), F.stddev_pop(v).alias(f"sd_{m}")]
    out = cases.rollup(label).agg(*aggs, F.grouping(label).alias("_g"))
    return out.withColumn(label, F.when(F.col("_g") == 1, "overall").otherwise(F.col(label))).drop("_g")


def spearman_all(pairs: DataFrame, x: str, y: str, least: int = 3) -> DataFrame:
    """(n, rho) over all rows: mid-ranks come from counts of distinct values in bands, so no task sorts all rows."""
    def mid(c: str) -> DataFrame:
        counts = pairs.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
        at = ranks.running(counts, ["g"], "v", ["n"])
        return at.select(F.col("v").alias(f"_v{c}"), (F.col("n_upto") - (F.col("n") - 1) / 2).alias(f"_r{c}"))

    known = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = known
    both = known.join(mid(x), F.col(x) == F.col(f"_v{x}")).join(mid(y), F.col(y) == F.col(f"_v{y}"))
    out = both.agg(F.count("*").alias("n"), F.corr(f"_r{x}", f"_r{y}").alias("r"), F.stddev_pop(f"_r{x}").alias("sx"), F.stddev_pop(f"_r{y}").alias("sy"))
    return out.select("n", F.when((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("r")).otherwise(float("nan")).alias("rho"))


def divergence_correlation(cases: DataFrame, delta: str, jacc: str, label: str = "label") -> DataFrame:
    """(label or "overall", n, rho, p): Spearman of attribution change against lost overlap. Labels are a handful; each is
    ranked in bands like the whole."""
    rows = cases.select(F.col(label).alias("label"), F.col(delta).alias("delta"), (1 - F.col(jacc)).alias("lost"))
    out = spearman_all(rows, "delta", "lost").withColumn("label", F.lit("overall"))
    for r in rows.select("label").distinct().where("label is not null").orderBy("label").collect():  # a handful of labels
        out = out.unionByName(spearman_all(rows.where(F.col("label") == r[0]), "delta", "lost").withColumn("label", F.lit(r[0])))
    p = F.udf(lambda r, n: correlation_pvalue(None if r is None or r != r else r, n), "double")  # a row for each label
    return out.select(F.col("label").alias(label), "n", "rho", p("rho", "n").alias("p"))


def relevance(terms: Column, relevant: Column) -> Column:
    return F.arrays_overlap(F.transform(terms, lambda t: F.lower(t)), F.transform(relevant, lambda t: F.lower(t)))


def precision_at_k(hits: DataFrame, k: int = 5, query: list[str] = ("query_id",), queries: DataFrame | None = None) -> DataFrame:
    """(query, precision): share of relevant hits among the k first that there are. Queries without hits have NaN, if
    ``queries`` names all of them, else no row."""
    out = hits.where(F.col("rank") <= k).groupBy(*query).agg(F.avg(F.col("rel").cast("double")).alias("precision"))
    if queries is None:
        return out
    return queries.select(*query).distinct().join(out, list(query), "left").withColumn("precision", F.coalesce("precision", F.lit(float("nan"))))


def ndcg_at_k(hits: DataFrame, k: int = 5, query: list[str] = ("query_id",)) -> DataFrame:
    """(query, ndcg) against the best order of the same hits; NaN if none is relevant."""
    best = Window.partitionBy(*query).orderBy(F.desc("rel"), "rank")
    rows = hits.where(F.col("rank") <= k).withColumn("rel", F.col("rel").cast("double")).withColumn("_best", F.row_number().over(best))
    out = rows.groupBy(*query).agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("d"), F.sum(F.col("rel") / F.log2(F.col("_best") + 1.0)).alias("i"))
    return out.select(*query, F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(float("nan")).alias("ndcg"))


def share_above(hits: DataFrame, least: float = 0.40, query: list[str] = ("query_id",)) -> DataFrame:
    return hits.groupBy(*query).agg(F.avg((F.col("sim") >= least).cast("double")).alias("share"))


def sim_lift(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, lift): mean similarity of the hits over the query's mean similarity to all documents, which is its product
    with the mean document."""
    mean = docs.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda r: r["m"]).alias("mean"))
    base = queries.crossJoin(F.broadcast(mean)).select("query_id", F.aggregate(F.zip_with("vec", "mean", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).alias("base"))  # one row
    return hits.groupBy("query_id").agg(F.avg("sim").alias("hit")).join(base, "query_id").select("query_id", (F.col("hit") / F.when(F.col("base") != 0, F.col("base"))).alias("lift"))


def oracle_terms(hits: DataFrame, terms: str = "mesh", label: str = "label", n: int = 20) -> DataFrame:
    """(label, term, count, rank): the n most frequent terms of the source model's hits."""
    counts = hits.select(label, F.explode(terms).alias("t")).groupBy(label, F.lower("t").alias("term")).agg(F.count("*").alias("count"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("count"), "term"))).where(F.col("rank") <= n)


def best_case(cases: DataFrame, jacc: str = "jaccard", prob: str = "prob", label: str = "label", id_col: str = "id") -> DataFrame:
    """(label, id, is_tp): the true positive of highest overlap and probability, else the most probable positive."""
    order = F.struct(F.col("is_tp"), F.when(F.col("is_tp"), F.col(jacc)), F.col(prob), -F.col(id_col))
    return cases.where("y = 1").groupBy(label).agg(F.max_by(F.struct(id_col, "is_tp"), order).alias("b")).select(label, "b.*")


def rater_sheet(hits: DataFrame) -> DataFrame:
    """Hits as rows for raters, with empty columns for the rating and notes."""
    cols = ["label", "stay_id", "model", "rank", "pmid", "year", "sim", "physio_query", "title"]
    return hits.select(*[c for c in cols if c in hits.columns], F.substring("abstract", 1, 150).alias("abstract_150"), F.concat_ws("; ", "mesh").alias("mesh_tags"), F.lit("").alias("relevant_0_1"), F.lit("").alias("rater_notes"))


def write_rater_sheet(hits: DataFrame, path: str) -> None:
    rater_sheet(hits).write.mode("overwrite").option("header", True).csv(path)


def read_ratings(spark, path: str) -> DataFrame:
    """A rater's file; a rating that can't be read is 0."""
    return spark.read.option("header", True).csv(path).withColumn("rating", F.coalesce(F.expr("try_cast(trim(relevant_0_1) as int)"), F.lit(0)))


def rated_metrics(hits: DataFrame, ratings: DataFrame, k: int = 5, keys: list[str] = ("label", "stay_id", "model"), doc: str = "pmid") -> DataFrame:
    """(keys, precision, ndcg) by raters; unrated hits count as 0."""
    keys = list(keys)
    rated = hits.join(ratings.select(*keys, doc, "rating"), [*keys, doc], "left").withColumn("rel", F.coalesce("rating", F.lit(0)))
    return precision_at_k(rated, k, keys).join(ndcg_at_k(rated, k, keys), keys)


def embed(docs: DataFrame, text: str, features: int = 4096, into: str = "vec", fitted=None):
    """(docs with unit vectors in ``into``, fitted pipeline): hashed term frequencies with inverse document frequencies. Any
    other encoder fits as a pandas UDF that gives arrays of doubles."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
    from pyspark.ml.functions import vector_to_array

    if fitted is None:
        fitted = Pipeline(stages=[Tokenizer(inputCol=text, outputCol="_t"), HashingTF(inputCol="_t", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_v")]).fit(docs)
    return fitted.transform(docs).withColumn(into, vector_to_array("_v")).drop("_t", "_tf", "_idf", "_v"), fitted
