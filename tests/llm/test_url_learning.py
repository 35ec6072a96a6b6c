"""Segmentation and naive Bayes of the URL filter against brute force, and verdicts that differ from the lexicon's."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohort_spark.llm import url_filter as uf


def test_segments_are_the_best_of_all_splits():
    r = random.Random(41)
    for _ in range(200):
        counts = {"".join(r.choice("ab") for _ in range(r.randrange(1, 5))): r.randrange(1, 50) for _ in range(8)}
        total, run = sum(counts.values()), "".join(r.choice("ab") for _ in range(r.randrange(1, 10)))

        def cost(words):
            return sum(math.log(total / counts[w]) if w in counts else math.log(total) + (len(w) + 1) * math.log(10) for w in words)

        splits = ([run[i:j] for i, j in zip((0, *cuts), (*cuts, len(run)))] for k in range(len(run)) for cuts in itertools.combinations(range(1, len(run)), k))
        got = uf.segment(run, counts, total)
        assert "".join(got) == run and cost(got) == pytest.approx(min(map(cost, splits)))


def brute(rows, rounds):
    odds = {i: uf.SEEDED if seeded else uf.UNSEEDED for i, _, seeded, _ in rows}
    for _ in range(rounds):
        p = {i: 1 / (1 + math.exp(-x)) for i, x in odds.items()}
        b, g = Counter(), Counter()
        for i, tokens, _, n in rows:
            for t in tokens:
                b[t] += n * p[i]
                g[t] += n * (1 - p[i])
        v, tb, tg = len(b), sum(b.values()), sum(g.values())
        x, y = (uf.SMOOTHING * t / (tb + tg) for t in (tb, tg))
        w = {t: math.log((b[t] + x) / (tb + x * v)) - math.log((g[t] + y) / (tg + y * v)) for t in b}
        prior = math.log((sum(n * p[i] for i, *_, n in rows) + 1) / (sum(n * (1 - p[i]) for i, *_, n in rows) + 1))
        odds = {i: sum(w[t] for t in tokens) + prior + (uf.SEEDED if seeded else uf.UNSEEDED) / 2 for i, tokens, seeded, n in rows}
    return odds


@pytest.mark.parametrize("few", [uf.BROADCAST_TOKENS, 5])
def test_bayes_is_that_of_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(uf, "BROADCAST_TOKENS", few)
    r = random.Random(42)
    rows = [(i, [r.choice("abcdefghijkl") for _ in range(r.randrange(6))], r.random() < 0.2, r.randrange(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "rid long, tokens array<string>, seeded boolean, n long")
    want = brute(rows, uf.ROUNDS)
    got = {x.rid: x.odds for x in uf.learn(df).collect()}
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want)


def test_verdicts_against_the_lexicon(spark):
    bad = [f"http://{x}-jackpot-bonus.xyz/win/{k}" for k, x in enumerate(["casino", "poker", "slots", "bets", "lottery", "roulette"] * 5)]
    good = [f"http://{x}-museum-abbey.org/visit/history/{k}" for k, x in enumerate(["city", "river", "old", "hill", "garden"] * 40)]
    urls = bad + good + ["http://mega-jackpot-bonus.xyz/win/1", "http://casino-museum-abbey.org/visit/history/9"]
    letters = [(w, 1000) for w in "casino poker slots bets lottery roulette jackpot bonus win city river old hill garden museum abbey visit history mega".split()]
    got = {x.url: x.verdict for x in uf.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(letters, "word string, c long")).collect()}
    assert all(got[u] == "block" for u in bad) and all(got[u] == "allow" for u in good)
    assert got[urls[-2]] == "block"  # no word of the lexicon
    assert got[urls[-1]] == "allow"  # one, in good company


def test_long_hosts_ties_and_clashing_columns(spark):
    long = "http://" + "ab" * 1000 + ".net/x"
    rows = [(1, long, 5), (1, long, 5), (2, None, 6), (3, "http://" + "a" * 24 + "b.xyz/", 7), (4, "http://" + "a" * 25 + "b.xyz/", 8)]
    names = ("tokens", "nb", "v", "n", "rid", "w", "host", "_h", "tail", "b.c")
    df = spark.createDataFrame(rows, "page_id long, url string, x int")
    for c in names:
        df = df.withColumn(c, F.col("x"))
    counts = spark.createDataFrame([("a" * 24, 9), ("a" * 25, 9), ("b", 5), ("ab", 3)], "word string, c long")
    got = uf.judge(df, counts).collect()
    assert len(got) == 5 and all(x["v"] == x["tokens"] == x["b.c"] == x["rid"] == x.x for x in got) and {x.verdict for x in got} == {"allow"}
    words = {x.run: x.words for x in uf.segments(spark.createDataFrame([("a" * 24 + "b",), ("a" * 25 + "b",)], "run string"), counts).collect()}
    assert words == {"a" * 24 + "b": ["a" * 24, "b"], "a" * 25 + "b": ["a" * 25, "b"]}
    assert uf.judge(df.limit(0), counts).count() == 0
