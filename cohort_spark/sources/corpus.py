"""Document corpora: cached JSON, article XML, windows of years, passages, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import read_checked

SCHEMA = "pmid string, title string, abstract string, year int, first_author string, journal string, mesh array<string>"

ARTICLE = """
MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string,
  Abstract: struct<AbstractText: array<string>>,
  AuthorList: struct<Author: array<struct<LastName: string>>>,
  Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: int>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: string>>>>
"""


def read_json(spark: SparkSession, path: str, years: tuple[int, int] | None = None) -> DataFrame:
    """A cached corpus, a JSON array or one object for each line, with the years in the window."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    return docs.where(F.col("year").between(*years)) if years else docs


def _articles(raw: DataFrame, default_year: int) -> DataFrame:
    a = F.col("MedlineCitation.Article")
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"), F.coalesce(a["ArticleTitle"], F.lit("")).alias("title"),
        F.concat_ws(" ", a["Abstract"]["AbstractText"]).alias("abstract"),
        F.coalesce(a["Journal"]["JournalIssue"]["PubDate"]["Year"], F.lit(default_year)).alias("year"),
        F.get(a["AuthorList"]["Author"], F.lit(0))["LastName"].alias("first_author"), a["Journal"]["Title"].alias("journal"),
        F.coalesce(F.transform("MedlineCitation.MeshHeadingList.MeshHeading", lambda m: m["DescriptorName"]), F.array().cast("array<string>")).alias("mesh"))


def read_article_xml(spark: SparkSession, path: str, row_tag: str = "PubmedArticle", shortest: int = 100, default_year: int = 2015) -> DataFrame:
    """Articles of XML dumps. Abstract parts are joined by a space; articles whose abstract is missing or shorter than
    ``shortest`` are left out; a missing year is ``default_year``."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(ARTICLE).load(path)
    return _articles(raw, default_year).where(F.length("abstract") >= shortest)


def read_article_xml_checked(spark: SparkSession, path: str, row_tag: str = "PubmedArticle", shortest: int = 100, default_year: int = 2015) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(articles, left out, rejected): as above, with (pmid, abstract_chars) of the articles that are too short, and the file
    and text of the records that don't parse or don't fit (a year that is no number, a tag that is never closed). Together
    they are all records."""
    good, rejected = read_checked(spark, path, ARTICLE, "xml", rowTag=row_tag)
    docs = _articles(good, default_year)
    long_enough = F.length("abstract") >= shortest
    return docs.where(long_enough), docs.where(~long_enough).select("pmid", F.length("abstract").alias("abstract_chars")), rejected


def window_from_tag(tag: Column, back: int = 10) -> Column:
    """Struct (first, last): the ``back`` years before the year before an era tag's first year."""
    first = F.array_min(F.transform(F.regexp_extract_all(tag, F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int")))
    return F.struct((first - 1 - back).alias("first"), (first - 1).alias("last"))


def passages(docs: DataFrame, longest: int = 2000) -> DataFrame:
    """``docs`` with passage: title and abstract, cut at ``longest`` characters."""
    return docs.withColumn("passage", F.substring(F.concat(F.col("title"), F.lit(". "), F.col("abstract")), 1, longest))


def dedup(docs: DataFrame, key: str = "pmid", order: tuple[str, ...] = ("query_no", "rank")) -> DataFrame:
    """One row for each key, the first in ``order``; rows without a key are left out."""
    rest = [c for c in docs.columns if c != key]
    return (docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_d"))
            .select(key, "_d.*"))
