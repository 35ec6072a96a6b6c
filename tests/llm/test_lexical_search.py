"""Ranked search against the scoring formula of every document, with ties, nulls, blocks and small chunks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from cohort_spark.llm import lexical_search as ls

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    out = set()
    for item, text in set(items):
        found = []
        for k, (i, c) in enumerate(held):
            m, score = 25 + 75 * c.total() * n // total, 0
            for t in terms(text):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in x for _, x in held) + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:top])}
    return out


def made_up(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Été", "ÉTÉ", "a1", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 5, 30, 80])))) for k in range(n)]
    return [*docs, (None, "w3 w4 w5"), (None, "w3 w4 w5"), (2, docs[2][1]), (7, None), (8, "-- ++")], [" ".join(rng.choices(words, weights, k=rng.choice([1, 4, 12]))) for _ in range(12)]


@pytest.mark.parametrize("postings, at_once, block_chars", [(1 << 18, 64, 4_000_000), (60, 3, 4_000_000), (200, 1, 100)])
def test_against_every_document(spark, monkeypatch, postings, at_once, block_chars):
    docs, texts = made_up(3, 150)
    items = [*enumerate(texts), (3, texts[3]), (20, texts[3]), (21, None), (22, "zzz"), (23, "w3 w3 W3"), (None, "w5")]
    chunks, search = ls.chunks, ls.Chunk.search
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in docs], "doc_id long, text string, n int, score double").repartition(3)
    benchmark = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = {tuple(r) for r in ls.search(df, benchmark, block_chars=block_chars).select("item_id", "rank", "doc_id", "score").collect()}
    assert got == brute(docs, items)
    # The same by chunks of few postings and other numbers of intervals, in this process.
    monkeypatch.setattr(ls, "POSTINGS", postings)
    monkeypatch.setattr(ls, "AT_ONCE", at_once)
    assert (ls.chunks, ls.Chunk.search) == (chunks, search)
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    vocabulary = {t: k for k, t in enumerate(sorted({t for x in texts for t in terms(x)}))}
    n, total = len(held), sum(c.total() for _, c in held)
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in held) + 1))) for t in vocabulary])
    lists = [[(vocabulary[t], k) for t, k in c.items() if t in vocabulary] for _, c in held]
    sizes, lengths = np.array([len(x) for x in lists]), np.array([25 + 75 * c.total() * n // total for _, c in held])
    flat = np.array([x for one in lists for x in one])
    ends = np.r_[0, np.cumsum(sizes)]
    want = brute(docs, list(enumerate(texts)))
    for q, text in enumerate(texts):
        mine = Counter(terms(text))
        ids, repeats = np.array([vocabulary[t] for t in mine]), np.array(list(mine.values()))
        scores, visited = [], 0
        for a, b in ls.chunks(sizes):
            part = flat[ends[a] : ends[b]]
            found = ls.Chunk(sizes[a:b], part[:, 0], part[:, 1], lengths[a:b], weights).search(ids, repeats * weights[ids], 1, 10)
            scores += found[1].tolist()
            visited += len(found[0])
        assert sorted(scores, reverse=True)[:10] == sorted((s for i, _, _, s in want if i == q), reverse=True)
        assert len(list(ls.chunks(sizes))) > 1 or postings > 1000
    assert max(b - a for a, b in ls.chunks(sizes)) >= 1


def test_bounds_leave_out_documents():
    """Most documents of a large chunk are never scored: the intervals that hold them end below the best scores."""
    rng = np.random.default_rng(1)
    n, vocabulary = 20_000, 300
    sizes = np.full(n, 12)
    terms_ = np.concatenate([rng.choice(vocabulary, 12, replace=False) for _ in range(n)])
    tfs = rng.integers(1, 6, n * 12)
    df = np.bincount(terms_, minlength=vocabulary)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    chunk = ls.Chunk(sizes, terms_, tfs, rng.integers(50, 150, n), weights)
    query = np.arange(8)
    scored = 0
    bounds = chunk.bounds

    def counted(low, high, w):
        nonlocal scored
        scored += len(low)
        return bounds(low, high, w)

    chunk.bounds = counted
    docs, scores = chunk.search(query, weights[query], 1, 10)
    every = np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), 12)
    asked = np.isin(terms_, query)
    lengths = np.zeros(n, np.int64)
    lengths[chunk.order[chunk.keys % chunk.width]] = 0
    where = {int(k): int(v) for k, v in zip(chunk.keys, chunk.impacts)}
    place = np.empty(n, np.int64)
    place[chunk.order] = np.arange(n)
    for o, t in zip(owner[asked], terms_[asked]):
        every[o] += weights[t] * where[int(t) * chunk.width + int(place[o])]
    assert sorted(scores.tolist())[-10:] == np.sort(every)[-10:].tolist()
    assert (every[docs] == scores).all()
    assert scored < n / 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert ls.search(docs, items).collect() == []
    assert ls.search(spark.createDataFrame([(1, "one")], docs.schema), items.where("false")).collect() == []
    assert ls.search(spark.createDataFrame([(1, " - ")], docs.schema), items).collect() == []
