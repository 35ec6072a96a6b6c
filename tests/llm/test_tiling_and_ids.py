"""Greedy tiling against exhaustive search, long pieces of BPE, and ids that doubles can't hold."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from cohort_spark.llm import bpe, decontamination, ngram_join

from .test_operators import DOCS, brute_groups


def exhaustive(item, doc, least):
    a, b, tiles = set(), set(), []
    while True:
        best = None
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and p + n not in a and d + n not in b:
                    n += 1
                if n >= least and (best is None or (-n, p, d) < best):
                    best = (-n, p, d)
        if best is None:
            return tiles
        n, p, d = best
        a |= set(range(p, p - n))
        b |= set(range(d, d - n))
        tiles.append((p, d, -n))


def test_tiles_are_those_of_exhaustive_search():
    r = random.Random(31)
    for k in range(2000):
        letters = 2 + k % 4
        item, doc = ([r.randrange(1, letters + 1) for _ in range(r.randrange(1, n))] for n in (16, 24))
        assert decontamination.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3) == exhaustive(item, doc, 3)


def test_one_repeated_word_takes_no_product():
    began = time.perf_counter()
    tiles = decontamination.tile(np.full(800, 7, np.uint64), np.full(80_000, 7, np.uint64))
    assert tiles == [(0, 0, 800)] and time.perf_counter() - began < 2
    assert decontamination.tile(np.full(80_000, 7, np.uint64), np.full(800, 7, np.uint64)) == [(0, 0, 800)]


def test_blocks_one_after_the_other(spark):
    r = random.Random(32)
    items = [" ".join(f"w{r.randrange(500)}" for _ in range(30)) for _ in range(12)]
    docs = [(k, "intro " + items[k % 12] + " and " + items[(k + 3) % 12] if k % 3 else None) for k in range(40)] + [(None, items[0]), (1, items[1])]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_dc", F.lit(1))

    def found(**o):
        return sorted((str(x.doc_id), tuple(sorted((y.item_id, y.n_covered) for y in x.leaks))) for x in decontamination.flag(frame, bench, **o).collect())

    assert found(block_chars=300) == found() and decontamination.flag(frame, bench, block_chars=300).columns == ["doc_id", "text", "_dc", "leaks"]


def test_long_pieces_of_bpe():
    from tokenizers import Tokenizer

    ref, codec = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    r = random.Random(33)
    texts = ["a" * n for n in (255, 256, 257, 258, 1000, 5001)] + ["".join(r.choice("abeiotn") for _ in range(3000)) for _ in range(5)] + [" " * 3000, "=-" * 2000, "ß" * 999, "字" * 700]
    for t in texts:
        assert codec.encode(t) == ref.encode(t, add_special_tokens=False).ids
    began = time.perf_counter()
    assert codec.decode(codec.encode("z" * 1_000_000)) == "z" * 1_000_000
    assert time.perf_counter() - began < 30 and not any(len(p) > bpe.LONG for p in codec.pieces)


def test_large_and_missing_ids(spark):
    big = 2**53
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(big + 1, words, "en", "s", 1), (big + 3, words + " more", "en", "s", 1), (None, words, "en", "s", 1), (big + 5, "something else " * 9, "en", "s", 1)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute_groups([x for x in rows if x[0] is not None])
    kept = ngram_join.stage(spark, spark.createDataFrame(rows + [(big + 5, "quite another text of its own " * 3, "en", "s", 2), (None, "and one that has no id " * 5, "en", "s", 3), (None, "and one that has no id " * 5, "en", "s", 3)], DOCS), "")
    assert sorted((x.doc_id or 0, x.n_chars) for x in kept.collect()) == [(0, 3), (big + 1, 1), (big + 5, 1), (big + 5, 2)]


def test_all_links(spark):
    r = random.Random(34)
    words = [f"w{k}" for k in range(300)]
    base, rows = [[r.choice(words) for _ in range(r.randrange(20, 90))] for _ in range(4)], []
    for i in range(70):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w), "en", "s", 0))
    sets = {i: frozenset(tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)) for i, t, *_ in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(a, b) for s, a in first.items() for t, b in first.items() if a < b and 100 * len(s & t) >= 80 * len(s | t)}
    df = spark.createDataFrame(rows, DOCS)
    for hot in (16, 3):
        members, found = ngram_join.links(df, hot=hot)
        assert {tuple(x) for x in found.collect()} == want
        assert {x.doc_id: x.n_links for x in members.collect()} == {i: sum(first[sets[i]] in p for p in want) for i in sets}


def test_sets_of_one_frequent_passage_meet_in_units(spark, monkeypatch):
    """Sets that share a passage with all others and are alike in some pairs only, dealt into units of a few sets."""
    monkeypatch.setattr(ngram_join, "UNIT", 8)
    r = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    tails = [[f"t{n}_{k}" for k in range(24)] for n in range(6)]
    rows = []
    for i in range(60):
        own = list(r.choice(tails))
        for _ in range(r.choice([0, 1, 2])):
            own[r.randrange(len(own))] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(passage + own), "en", "s", 0))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t, *_ in rows}
    least = {i: i for i in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    got = {x.doc_id: x.component_id for x in ngram_join.groups(spark.createDataFrame(rows, DOCS), hot=2).collect()}
    assert len(set(least.values())) > 1
    assert got == least
