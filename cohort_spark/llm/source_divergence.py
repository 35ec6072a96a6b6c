"""How far the sources of each language diverge in their words: exact, ranked by count cells.

Terms are counted by (language, source). All terms of a group with the same count there and the same count in the
language form a cell: what the audit says of a term depends on these two counts alone, so it is worked out once a cell.
The cells of a group are ranked by their value; cells of equal value are one, and the running sum of their numbers of terms
says which ranks a value takes. Only values that reach the first ``top`` ranks are expanded to terms, in UTF-8 order.

Sources are compared in pairs by the same idea. The terms that only one of two sources has are cells of that source's
counts. Terms that several sources have are grouped by their counts in all of them, and a group of terms with equal counts is
one row with a multiplicity before any pair is formed. So no step holds the terms of a group, or all its pairs, in one task.

Counts leave each worker already added up by group, and decimals carry what can exceed 64 bits.

Defined results: null texts, languages and sources are empty strings; every row is a document, repeated ids and rows
count each; a group without kept terms has pairs and no terms; a language with one source has no pairs; an empty table
gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, read, segments, utf8

#: Documents of a language that hold a term, at least.
LEAST_DOCS = 30
#: Added to every count.
PRIOR = 5
SCALE = 1_000_000_000
TOP = 50
#: Different (group, term) that a worker adds up before it hands them on.
ENTRIES = 200_000

_TERM = rb"[a-z\x80-\xff]+"


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of (lang, source, text), added up within the worker."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
    counts: dict[tuple[str, str], Counter] = {}
    holders: dict[tuple[str, str], Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            terms = list(found)
            held = holders[lang, source]
            columns = [[lang] * len(terms), [source] * len(terms), [t.decode("utf-8", "replace") for t in terms], list(found.values()), [held[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        counts.clear()
        holders.clear()

    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for row, group in enumerate(groups):
            once = set()
            total = counts.setdefault(group, Counter())
            for terms in segments(data[offsets[row] : offsets[row + 1]], _TERM):
                total.update(terms)
                once.update(terms)
            holders.setdefault(group, Counter()).update(once)
            if row % 64 == 0 and sum(map(len, counts.values())) > ENTRIES:
                yield from flushed()
    yield from flushed()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it, by group."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, total): the counts of the terms that enough documents of their language hold."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs)
    return counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total")


def share(count: str, size: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (size + PRIOR * kept)), exact; null where nothing is kept."""
    whole = f"(cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0)))"
    return F.expr(f"if({kept} = 0, null, 1 + {whole} div cast(cast({size} as decimal(20,0)) + {PRIOR} * cast({kept} as decimal(12,0)) as decimal(31,0)))")


def group_sizes(groups: DataFrame, held: DataFrame) -> DataFrame:
    """(lang, source, size, kept, lang_size, none): a row for every group; ``none`` is the share of a term it hasn't."""
    by_group = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = held.groupBy("lang", "term").agg(F.first("total").alias("total"))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    out = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").fillna(0, ["size", "kept", "lang_size"])
    return out.withColumn("none", share("0", "size", "kept"))


def top_terms(held: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of the terms with the greatest share above their language's."""
    cells = held.groupBy("lang", "source", "n", "total").agg(F.count("*").alias("terms")).join(sizes, ["lang", "source"])
    cells = cells.withColumn("value", share("n", "size", "kept") - share("total", "lang_size", "kept")).where("value > 0")
    cells = cut(cells.select("lang", "source", "n", "total", "value", "terms"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    # A value takes one rank at least, so values beyond the first ``top`` can't reach them.
    values = values.withColumn("_k", F.row_number().over(ranked)).where(F.col("_k") <= top)
    values = values.withColumn("before", F.sum("terms").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) - F.col("terms")).where(F.col("before") < top)
    chosen = cells.join(values.select("lang", "source", "value", "before"), ["lang", "source", "value"]).drop("terms")
    within = Window.partitionBy("lang", "source", "value").orderBy("item")
    terms = held.join(chosen, ["lang", "source", "n", "total"]).select("lang", "source", F.col("term").alias("item"), "value", "before")
    terms = terms.withColumn("_k", F.row_number().over(within)).where(F.col("_k") <= top)
    return terms.withColumn("rank", (F.col("before") + F.col("_k")).cast("int")).where(F.col("rank") <= top).select("lang", "source", "item", "value", "rank")


def source_pairs(held: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): the summed difference of shares to each other source of the language.

    With f0 the difference for a term that neither has, the sum is kept * f0, and for each term that the one has and for
    each that the other has the difference to the other's share of a missing term less f0, and for terms of both what
    that counted twice.
    """
    shares = cut(held.join(sizes, ["lang", "source"]).select("lang", "source", "term", share("n", "size", "kept").alias("p"), "none"))
    one, two = [sizes.select("lang", F.col("source").alias(s), F.col("none").alias(n), "kept") for s, n in (("a", "a0"), ("b", "b0"))]
    pairs = cut(one.join(two.drop("kept"), "lang").where("a < b").withColumn("f0", F.coalesce(F.abs(F.col("a0") - F.col("b0")), F.lit(0).cast("long"))))
    cells = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))

    def alone(side: str, other: str) -> DataFrame:
        met = pairs.join(cells.withColumnRenamed("source", side), ["lang", side])
        return met.groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col(other)) - F.col("f0"))).alias("d"))

    profiles = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "none"))).alias("held")).where(F.size("held") > 1)
    profiles = profiles.groupBy("lang", "held").agg(F.count("*").alias("terms"))
    firsts = profiles.select("lang", "terms", "held", F.posexplode("held").alias("k", "x"))
    both = firsts.select("lang", "terms", "x", F.explode(F.slice("held", F.col("k") + 2, F.size("held"))).alias("y"))
    parts = [("x.p", "y.p", 1), ("x.p", "y.none", -1), ("x.none", "y.p", -1), ("x.none", "y.none", 1)]
    twice = sum((F.lit(sign) * F.abs(F.col(p) - F.col(q)) for p, q, sign in parts), F.lit(0).cast("long"))
    shared = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(F.col("terms") * twice).alias("d"))
    sums = pairs.select("lang", "a", "b", (F.col("kept") * F.col("f0")).alias("d")).unionByName(alone("a", "b0")).unionByName(alone("b", "a0")).unionByName(shared)
    sums = cut(sums.groupBy("lang", "a", "b").agg(F.sum("d").alias("value")))
    ways = [sums.select("lang", F.col(s).alias("source"), F.col(i).alias("item"), "value") for s, i in (("a", "b"), ("b", "a"))]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return ways[0].unionByName(ways[1]).withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares with the other sources, ``term`` lists the terms that
    stand out most."""
    groups = cut(docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct())
    held = cut(kept_counts(cut(term_counts(docs, text, lang, source)), least_docs))
    sizes = cut(group_sizes(groups, held))
    named = [d.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
             for part, d in (("pair", source_pairs(held, sizes)), ("term", top_terms(held, sizes, top)))]
    return named[0].unionByName(named[1])


def query(spark, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT lang, source, sum(c) AS n FROM f GROUP BY lang, source),
p AS (SELECT f.*, 1 + ({SCALE}::HUGEINT * (c + {PRIOR})) // (s.n + {PRIOR} * v.v)::HUGEINT AS p, 1 + ({SCALE}::HUGEINT * (total + {PRIOR})) // (v.n + {PRIOR} * v.v)::HUGEINT AS q
      FROM f JOIN s USING (lang, source) JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
SELECT * FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
