"""URL filters: rules on host and path, then host segmentation and naive Bayes.

Host and path are cut out of the URL with string functions. A rule names a host with all its subdomains and a
path prefix; the longest that fits decides. For the rest, host names are split into words: the labels' runs of letters
and digits by the most likely split (Viterbi) under unigram counts of the corpus, with a length penalty for
unknown words. A multinomial naive Bayes over segmented host words and path tokens gives the verdict.

It learns from the URLs themselves, in rounds. A word of LEXICON in the host is no verdict but prior evidence: such a row
starts at SEEDED odds of being bad, any other at UNSEEDED. Each round counts tokens in the two classes, weighted by
the rows' odds, and gives every row new odds from its tokens and half of its prior evidence. So words that keep company with the
lexicon's block hosts that have none of its words, and a lexicon word in the company of good words is allowed. The rules'
verdicts are no labels: rules test top-level domains, and the model would take those for the reason.

Segmentation knows the corpus' counts alone. A host's run that it splits is a token beside its parts. The counts that
it needs are those of substrings of host names, so they are joined to the substrings of distinct host runs; the whole
vocabulary goes nowhere. Segmentation runs once for each distinct run.

Defined results: a null URL, or one without "://", has an empty host and path, fits no rule and is judged by its
(missing) tokens, that is by the class sizes; equal log-odds allow; repeated rows are judged each; without
rows nothing is learned and all is allowed; ``judge`` replaces columns named host, path, rule and verdict and keeps all
others; words of more than LONGEST characters are no pieces of host names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, read

#: Fixed: the rules to apply, host/path prefix and verdict.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Fixed: words of what URL filters commonly block, by category.
LEXICON = tuple("""
adult cams erotic escort escorts fetish hentai hookup milf nude nudes porn porno sex sexy webcam xxx
bet bets betting bingo blackjack casino casinos gamble gambling jackpot lottery poker roulette slots wager
cialis pharma pill pills steroids viagra
ads adserver adtech advert adverts banner banners doubleclick popup popups tracker trackers tracking
botnet crack cracked keygen malware phish phishing ransomware scam scams spam spyware torrent torrents warez
payday
""".split())
#: Fixed: what a label of a host name holds at most.
LONGEST = 63
#: Odds of being bad, as logarithms, that rows with and without a lexicon word start with, and learning rounds.
SEEDED, UNSEEDED, ROUNDS = math.log(9), math.log(0.02 / 0.98), 3
#: Pseudo-occurrences of every token, dealt to the classes by their sizes.
SMOOTHING = 5.0
#: Tokens whose weights are broadcast at most; rarer ones are joined by shuffle.
BROADCAST_TOKENS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fits(rule: str, host: Column, path: Column) -> Column:
    name, slash, prefix = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)


def apply_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (with host and path) with rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, said in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked last, so it wins
        fits = _fits(name, F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return urls.withColumns({"rule": rule, "_said": verdict})


def runs(text: Column) -> Column:
    """Runs of letters and digits, in lower case; those of digits alone become "0"."""
    parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(x))


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, c) over the words of a column of HTML, mark-up left out."""
    plain = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"<[^>]*>|&\w+;", " ")
    return texts.select(F.explode(runs(plain)).alias("word")).where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("c"))


def segment(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely split of ``run``; of equal ones that with the longer last word. A word that was never seen
    costs as much as a tenth of one occurrence, and ten times more for each of its characters."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(run) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            c = counts.get(run[start:end], 0)
            cost = math.log(total / c) if c else math.log(total) + (end - start + 1) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    out, end = [], len(run)
    while end:
        out.append(run[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def segments(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of the distinct runs of ``names`` (run)."""
    names = cut(names.distinct())
    at = names.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("a"))
    pieces = at.select("run", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("run") - F.col("a") + 1))).alias("n"))
    pieces = pieces.select("run", F.substring("run", F.col("a"), F.col("n")).alias("word")).distinct().join(counts, "word")
    total = F.broadcast(counts.agg(F.sum("c").alias("total")))  # one row
    known = pieces.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "c"))).alias("counts"))  # bounded by the run's substrings

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, counts: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([segment(r, dict(c) if c is not None else {}, int(t)) for r, c, t in zip(run, counts, total)], dtype=object)

    return names.join(known, "run", "left").crossJoin(total).select("run", split("run", "counts", F.coalesce("total", F.lit(1))).alias("words"))


def _weighed(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """(rid, s): sums of the tokens' weights. Weights of the most frequent tokens are broadcast, so that their rows aren't
    dealt by token."""
    sizes = weights.select(F.floor(F.log2(F.col("n") + 1) * 8).alias("step")).groupBy("step").agg(F.count("*").alias("rows")).orderBy(F.desc("step"))
    least, total = None, 0
    for r in sizes.toLocalIterator():  # a few hundred steps
        total += r["rows"]
        if total > BROADCAST_TOKENS:
            break
        least = r["step"]
    frequent = F.lit(False) if least is None else F.floor(F.log2(F.col("n") + 1) * 8) >= least
    top = F.broadcast(weights.where(frequent).select("token", "w"))
    met = tokens.join(top, "token").select("rid", "w")
    rest = weights.where(~frequent).select("token", "w")
    if total > BROADCAST_TOKENS:
        met = met.union(tokens.join(top, "token", "left_anti").join(rest, "token").select("rid", "w"))
    return met.groupBy("rid").agg(F.sum("w").alias("s"))


def learn(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(rid, odds) of rows (rid, tokens, seeded, n), where n is how often the row occurs.

    Naive Bayes over soft counts, smoothed in proportion to the classes' sizes: a row counts in the bad class by its probability so far."""
    tokens = cut(rows.select("rid", "n", F.explode("tokens").alias("token")))
    evidence = F.when(F.col("seeded"), SEEDED).otherwise(UNSEEDED)
    state = rows.select("rid", "n", "seeded", evidence.alias("odds"))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.col("odds")))
        state = cut(state.withColumn("p", p))
        b, g = F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p")))
        seen = cut(tokens.join(state.select("rid", "p"), "rid").groupBy("token").agg(b.alias("b"), g.alias("g"), F.sum("n").alias("n")))
        sums = seen.agg(F.coalesce(F.sum("b"), F.lit(0.0)).alias("tb"), F.coalesce(F.sum("g"), F.lit(0.0)).alias("tg"), F.count("*").alias("v"))
        total = F.col("tb") + F.col("tg")

        def log_share(c: str, t: str) -> Column:  # smoothed by the class' part of SMOOTHING, so that a rare token says nothing
            spare = SMOOTHING * F.greatest(F.col(t) / total, F.lit(1e-9))
            return F.log((F.col(c) + spare) / (F.col(t) + spare * F.col("v")))

        w = log_share("b", "tb") - log_share("g", "tg")
        weights = cut(seen.crossJoin(F.broadcast(sums)).select("token", "n", w.alias("w")))  # one row
        prior = F.broadcast(state.agg(F.coalesce(F.log((b + 1) / (g + 1)), F.lit(0.0)).alias("prior")))  # one row
        lean = evidence / 2  # what a row starts with goes on to count, half
        state = (state.select("rid", "n", "seeded").join(_weighed(tokens, weights), "rid", "left").crossJoin(prior)
                 .select("rid", "n", "seeded", (F.coalesce("s", F.lit(0.0)) + F.col("prior") + lean).alias("odds")))
    return state.select("rid", "odds")


def judge(urls: DataFrame, counts: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """``urls`` with host, path, rule and verdict. ``counts`` are (word, c) of the corpus."""
    names = ("host", "path", "rule", "verdict")
    kept = [c for c in urls.columns if c not in names]
    # Everything of the input travels in one column, so that no name of its own can clash.
    urls = urls.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_in"), F.col(f"`{url}`").alias("_url"))
    urls = apply_rules(urls.select("_in", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path")), rules)
    urls = urls.withColumn("_path", F.array_join(runs(F.col("path")), " "))
    rows = cut(urls.groupBy("host", F.col("_path").alias("tail")).agg(F.count("*").alias("n")).withColumn("rid", F.monotonically_increasing_id()))
    parts = cut(rows.select("host").distinct().select("host", F.posexplode(runs(F.col("host"))).alias("k", "run")))
    split = parts.join(segments(parts.select("run"), counts), "run")
    split = split.withColumn("words", F.when(F.size("words") > 1, F.array_append("words", F.col("run"))).otherwise(F.col("words")))
    hosts = cut(split.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "words"))), lambda x: x["words"])).alias("words")))
    lexicon = F.array(*[F.lit(x) for x in LEXICON])
    words = F.coalesce("words", F.array().cast("array<string>"))
    tails = F.filter(F.split("tail", " "), lambda x: x != "")
    rows = cut(rows.join(hosts, "host", "left").select("rid", "host", "tail", "n", F.concat(words, tails).alias("tokens"), F.arrays_overlap(words, lexicon).alias("seeded")))
    verdicts = cut(rows.join(learn(rows), "rid").select(F.col("host").alias("_h"), F.col("tail").alias("_t"), (F.col("odds") > 0).alias("_bad")))
    said = F.coalesce("_said", F.when(F.coalesce("_bad", F.lit(False)), "block").otherwise("allow"))
    out = urls.join(verdicts, (F.col("host") == F.col("_h")) & (F.col("_path") == F.col("_t")), "left")
    return out.select("_in.*", "host", "path", "rule", said.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), word_counts(pages, "html")).select("page_id", "host", "path", "rule", "verdict")
