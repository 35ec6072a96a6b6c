"""Exact token totals for every context limit from a histogram of encoded lengths.

Documents are aggregated by their number of tokens. With suffix sums over the histogram, each length says how
many documents and tokens lie at or above it, and how many tokens remain if every document is cut there;
quantiles are read off the same rows. The histogram has a row for each distinct length, so the sums run over
blocks of lengths: block totals first, then the rows of each block.

Defined results: null and empty texts have length 0 and count as documents; repeated rows count each; an empty
table has an empty histogram, totals of 0 and no quantiles; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import cut, read

BLOCK = 1024


def histogram(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs)."""
    return bpe.lengths(docs.select(text), text, "n_tokens", path).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """``hist`` with, for each length L: docs_longer and tokens_longer (documents of more than L tokens and their
    tokens), truncated_total (tokens left if every document is cut at L tokens) and docs_upto, first_rank (ranks,
    from 1, of the documents of this length in ascending order: first_rank to docs_upto)."""
    rows = hist.withColumns({"_t": F.col("n_tokens") * F.col("n_docs"), "_b": F.floor(F.col("n_tokens") / BLOCK)})
    sums = rows.groupBy("_b").agg(F.sum("n_docs").alias("d"), F.sum("_t").alias("t"))
    above, below = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_b", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_{k}") for k, w in (("above", above), ("below", below)) for c in ("d", "t")])
    here = Window.partitionBy("_b")
    more, less = here.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1), here.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, "_b").withColumns({
        "docs_longer": F.col("d_above") + F.coalesce(F.sum("n_docs").over(more), F.lit(0)),
        "tokens_longer": F.col("t_above") + F.coalesce(F.sum("_t").over(more), F.lit(0)),
        "docs_upto": F.col("d_below") + F.sum("n_docs").over(less),
        "tokens_upto": F.col("t_below") + F.sum("_t").over(less)})
    return out.select("n_tokens", "n_docs", "docs_longer", "tokens_longer",
                      (F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_total"),
                      (F.col("docs_upto") - F.col("n_docs") + 1).alias("first_rank"), "docs_upto")


def totals(sums: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens, longest."""
    return sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0)).alias("n_tokens"), F.max("n_tokens").alias("longest"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the length of the document of rank ceil(share * documents), 1 at least."""
    want = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    ranks = totals(sums).select("n_docs", want).select("share", F.greatest(F.ceil(F.col("share") * F.col("n_docs")), F.lit(1)).alias("rank"))
    return sums.join(F.broadcast(ranks), (F.col("rank") >= F.col("first_rank")) & (F.col("rank") <= F.col("docs_upto"))).select("share", "n_tokens")


def truncated(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, kept_tokens, cut_docs) for any limits, whether or not a document has that length."""
    want = sums.sparkSession.createDataFrame([(int(x),) for x in limits], "limit long")
    upto = F.col("n_tokens") <= F.col("limit")
    return (want.join(sums, F.lit(True), "left").groupBy("limit").agg(
        F.coalesce(F.sum(F.when(upto, F.col("n_tokens") * F.col("n_docs")).otherwise(F.col("limit") * F.col("n_docs"))), F.lit(0)).alias("kept_tokens"),
        F.coalesce(F.sum(F.when(~upto, F.col("n_docs"))), F.lit(0)).alias("cut_docs")))


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_sums(cut(histogram(read(spark, sf_dir, "documents"))))
