"""Quality rules whose cutoffs carry a guarantee on falsely rejected documents (DataFrame functions only).

``measure`` counts words, symbols, repeated lines and repeated word windows of whole texts. ``fit_cutoffs``
looks at labelled documents, stratum by stratum: a rule "value > cutoff" may be used only if the exact
binomial (Clopper-Pearson) upper bound on the share of good documents that it rejects stays under the
rule's share of ``alpha``, at a confidence that a Bonferroni correction over all strata and rules makes
hold for all of them at once. A tighter cutoff rejects a superset, so within one rule the cutoffs are a
fixed test sequence and need no correction of their own. ``judge`` applies the cutoffs.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null stratum
is a stratum of its own; a stratum without enough labels gets no cutoff and keeps all that passes the base
rules; repeated ids are judged row by row; a document labelled more than once is good if any label says so;
columns of the input are kept by ``judge`` unless they carry one of the names that it sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, read, words

#: rule -> (numerator, candidate cutoffs in thousandths of the numerator per word)
RULES = {
    "symbols": ("n_symbols", [20, 50, 100, 200, 300, 400, 500, 700, 1000, 2000]),
    "marks": ("n_marks", [20, 50, 100, 200, 300, 400, 500, 700, 1000, 2000]),
    "capitals": ("n_capitals", [300, 600, 900, 1200, 1500, 2000, 3000, 4000]),
    "dup_lines": ("n_dup_lines", [2, 5, 10, 20, 50, 100, 200]),
    "repeats": ("n_repeat_words", [50, 100, 150, 200, 300, 400]),
    "word_length": ("word_chars", [7000, 8000, 9000, 10000, 12000, 15000, 20000]),
}
ALPHA, DELTA = 0.05, 0.1


def _covered(spans: Column, width: int) -> Column:
    """Words under windows of ``width`` words that start at the sorted positions ``spans``."""
    return F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("at")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(width), p - s["at"])).alias("n"), p.alias("at")),
        lambda s: s["n"])


def repeat_words(tokens: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that occurs twice or more in the text."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def repeated(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(order, lambda a: _covered(F.sort_array(F.transform(
            F.filter(a, lambda x, i: (x["h"] == F.get(a, i + 1)["h"]).eqNullSafe(True) | ((i > 0) & (x["h"] == F.get(a, F.greatest(i - 1, F.lit(0)))["h"]))),
            lambda x: x["i"])), width))

    return F.when(F.size(tokens) <= width, 0).otherwise(
        let(hashes(tokens), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules use (longs) and base_failed."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def lost(pattern: str) -> Column:
        return (F.length(whole) - F.length(F.regexp_replace(whole, pattern, ""))).cast("long")

    facts = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("word_chars"),
        repeat_words(w).cast("long").alias("n_repeat_words")))
    named = {
        "n_words": F.col("_facts.n_words"), "word_chars": F.col("_facts.word_chars"),
        "n_symbols": lost(r"[#*$%&|<>]"), "n_marks": lost("!"), "n_capitals": lost("[A-Z]"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_facts.n_repeat_words"),
    }
    out = docs.withColumn("_facts", facts).withColumns(named).drop("_facts")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _values() -> dict[str, Column]:
    return {r: (F.lit(1000) * F.col(c)) for r, (c, _) in RULES.items()}


def most_rejected(n: Column, alpha: float, delta: Column) -> Column:
    """Largest k such that k of n good documents rejected still shows a rate under alpha; -1 if none does.

    The exact upper bound is under alpha when P(Binomial(n, alpha) <= k) <= delta; the terms are summed
    in logarithms from 0 up to the mean, where the sum is near one half.
    """
    odds = F.log(F.lit(alpha / (1 - alpha)))
    start = F.struct((n * F.log(F.lit(1 - alpha))).alias("lp"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, i: Column) -> Column:
        cdf = s["cdf"] + F.exp(s["lp"])
        return F.struct((s["lp"] + F.log(F.greatest(n - i, F.lit(0.5)) / (i + 1)) + odds).alias("lp"), cdf.alias("cdf"),
                        F.when(cdf <= delta, i).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.least(n, F.ceil(n * alpha)).cast("long")), start, step, lambda s: s["k"])


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n_good, good_rejected, bad_rejected): the usable cutoff that gains most.

    ``labels`` is (doc_id, quality). Gain is labelled bad documents rejected less good ones rejected; of
    equal gains the loosest cutoff is taken, and none where no cutoff gains. All labelled documents that
    pass the base rules serve as the holdout: the cutoff grid is fixed beforehand, nothing is fitted on them.
    """
    truth = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    grids = {r: F.array(*[F.lit(c) for c in g]) for r, (_, g) in RULES.items()}
    # How many of a rule's cutoffs the value exceeds: value > cutoff * words, in whole numbers.

    def exceeded(grid: Column, value: Column) -> Column:
        return F.size(F.filter(grid, lambda c: value > c * F.col("n_words")))

    passed = F.array(*[F.struct(F.lit(r).alias("rule"), exceeded(grids[r], v).alias("b")) for r, v in _values().items()])
    seen = measured.where(~F.col("base_failed")).select("doc_id", F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), passed.alias("_p")).join(truth, "doc_id")
    counts = seen.select("stratum", F.explode("_p").alias("p"), "_good").groupBy("stratum", "p.rule", "p.b").agg(
        F.count_if(F.col("_good") > 0).alias("good"), F.count_if(F.col("_good") <= 0).alias("bad"))
    whole = Window.partitionBy("stratum", "rule")
    tail = whole.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"n_good": F.sum("good").over(whole), "good_rejected": F.sum("good").over(tail), "bad_rejected": F.sum("bad").over(tail)})
    # A bucket b > 0 stands for its tightest cutoff that all of it exceeds, the b-th of the ascending grid.
    strata = seen.agg(F.count_distinct("stratum").alias("n_strata"))
    cutoffs = F.element_at(F.element_at(F.create_map(*[x for r, g in grids.items() for x in (F.lit(r), g)]), F.col("rule")), F.col("b"))
    tests = F.lit(delta) / (F.col("n_strata") * len(RULES))
    return (ranked.where("b > 0").withColumn("cutoff", cutoffs).crossJoin(F.broadcast(strata))  # one row
            .withColumn("_most", most_rejected(F.col("n_good"), alpha / len(RULES), tests))
            .where("good_rejected <= _most and bad_rejected > good_rejected")
            .groupBy("stratum", "rule")
            .agg(F.max(F.struct((F.col("bad_rejected") - F.col("good_rejected")).alias("gain"), "cutoff", "n_good", "good_rejected", "bad_rejected")).alias("s"))
            .select("stratum", "rule", "s.cutoff", "s.n_good", "s.good_rejected", "s.bad_rejected"))


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with kept: false where a base rule or one of the stratum's cutoffs rejects.

    The cutoffs are folded to a row for each stratum and written, so Spark broadcasts them if, and only if,
    the file's size is under its threshold.
    """
    by = cut(cutoffs.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs")))
    rejects = [F.coalesce(v > F.element_at(F.col("_cutoffs"), F.lit(r)) * F.col("n_words"), F.lit(False)) for r, v in _values().items()]
    failed = F.col("base_failed")
    for x in rejects:
        failed = failed | x
    return (measured.join(by, F.coalesce(F.col(stratum), F.lit("")) == F.col("_stratum"), "left")
            .withColumn("kept", ~failed).drop("_stratum", "_cutoffs"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    facts = cut(measure(read(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text"))
    return judge(facts, fit_cutoffs(facts, read(spark, sf_dir, "labels"))).select(COLUMNS)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go. Whole rows never shuffle; only the counts of
    labelled documents do. Measures are written once with the rows: in one plan with the verdict, Catalyst would
    copy their expressions into every rule that filters by them."""
    # Rows travel in one column, so that counts don't replace columns of the same names.
    facts = cut(measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_qr_row"), "doc_id", "lang", "text")).drop("text"))
    return judge(facts, fit_cutoffs(facts, read(spark, sf_dir, "labels"))).where("kept").select("_qr_row.*")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) t(k) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
       (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
       (length(text) - length(regexp_replace(text, '!', '', 'g')))::BIGINT AS n_marks,
       (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
     FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
m AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f),
rules AS (SELECT * FROM (VALUES {', '.join(f"('{r}', {g}::BIGINT[])" for r, (_, g) in RULES.items())}) t(rule, grid)),
c AS (SELECT rule, unnest(grid) AS cutoff FROM rules),
v AS ({' UNION ALL '.join(f"SELECT doc_id, stratum, n_words, base_failed, '{r}' AS rule, 1000 * {c} AS v FROM m" for r, (c, _) in RULES.items())}),
t AS (SELECT doc_id, max(quality) AS good FROM labels GROUP BY doc_id),
s AS (SELECT v.stratum, v.rule, c.cutoff, count(*) FILTER (good > 0) AS n_good,
        count(*) FILTER (good > 0 AND v > cutoff * n_words) AS good_rejected, count(*) FILTER (good <= 0 AND v > cutoff * n_words) AS bad_rejected
      FROM v JOIN t USING (doc_id) JOIN c USING (rule) WHERE NOT base_failed GROUP BY ALL),
a AS (SELECT *, (SELECT count(DISTINCT stratum) FROM s) AS n_strata, {ALPHA / len(RULES)!r}::DOUBLE AS alpha FROM s),
b AS (SELECT *, (SELECT sum(exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln(alpha) + (n_good - k) * ln(1 - alpha)))
                 FROM unnest(range(0, good_rejected + 1)) u(k)) AS cdf FROM a WHERE n_good > 0 AND good_rejected <= n_good * alpha + 1),
z AS (SELECT stratum, rule, arg_max(cutoff, (bad_rejected - good_rejected, cutoff)) AS cutoff
      FROM b WHERE cdf <= {DELTA!r} / (n_strata * {len(RULES)}) AND bad_rejected > good_rejected GROUP BY ALL),
x AS (SELECT DISTINCT v.doc_id FROM v JOIN z USING (stratum, rule) WHERE v.v > z.cutoff * v.n_words)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM x) AS kept FROM m
"""
