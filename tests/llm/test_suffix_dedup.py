"""Repeated passages against a count of all strings, on small alphabets, ties, nulls and texts of several parts."""

import random
from collections import Counter

import numpy as np
import pytest

from cohort_spark.llm import suffix_dedup as sd

from .test_operators import SF


def brute(texts, threshold):
    """([(start, end)], kept bytes) of each text."""
    all_bytes = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + threshold] for b in all_bytes for k in range(len(b) - threshold + 1))
    out = []
    for b in all_bytes:
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - threshold + 1):
            if seen[b[k : k + threshold]] > 1:
                gone[k + 1 : k + 1 + threshold] = True
        spans = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
        out.append(([tuple(s) for s in spans.tolist()], bytes(x for x, g in zip(b, gone[1:]) if not g)))
    return out


def texts_of(rng, alphabet, threshold):
    base = "".join(rng.choice("abcdefgh é") for _ in range(500))
    odd = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, threshold, 60, 200]))) for _ in range(30)]
    near = [base[:k] + "X" + base[k + 1 :] for k in (100, 130, 131, 400)]
    return [*odd, None, "", None, base, base, *near, base[250:], base[:threshold], base[3 : threshold + 2], "y" * 300, "y" * 90]


@pytest.mark.parametrize("threshold, alphabet", [(8, "abé"), (20, "ab"), (40, "a" * 30 + "b")])
def test_against_all_strings(spark, threshold, alphabet):
    texts = texts_of(random.Random(threshold), alphabet, threshold)
    ids = list(range(len(texts)))
    ids[3], ids[7], ids[5] = None, None, ids[6]  # null ids and one that repeats are documents of their own
    df = spark.createDataFrame(list(zip(ids, texts, range(len(texts)), [-1] * len(texts))), "doc_id long, text string, n int, spans int")
    out = sd.dedup(df, threshold=threshold)
    assert out.columns == ["doc_id", "text", "n", "spans", "kept"]
    got = {r.n: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in out.collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, threshold)
    assert [r.text for r in out.orderBy("n").collect()] == texts


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    texts = [long, "zz" + long[200_000:290_000], long[10:30] + "q" + long[262_100:262_190]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ([tuple(s) for s in r.spans], bytes(r.kept)) for r in sd.dedup(df, threshold=60).collect()}
    assert [got[k] for k in range(3)] == brute(texts, 60)


def test_empty_table_and_other_names(spark):
    empty = spark.createDataFrame([], "key string, body string, run long, fp int, item string")
    assert sd.dedup(empty, id="key", text="body").collect() == []
    rows = [("a", "one two three four", 5, 1, "x"), ("b", "one two three fear", 6, 2, "y")]
    out = sd.dedup(spark.createDataFrame(rows, empty.schema), id="key", text="body", threshold=10).orderBy("key").collect()
    assert [(r.run, r.fp, r.item, bytes(r.kept)) for r in out] == [(5, 1, "x", b"our"), (6, 2, "y", b"ear")]


def test_prefixes_grow_to_the_threshold():
    assert sd.prefix_lengths(200) == [50, 100, 180, 200]
    assert sd.prefix_lengths(3) == [1, 3] and sd.prefix_lengths(1) == [1]


def test_one_byte_threshold(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "cd")], "doc_id long, text string")
    assert [bytes(r.kept) for r in sd.dedup(df, threshold=1).orderBy("doc_id").collect()] == [b"ab", b"d"]


def test_query_columns(spark):
    assert sd.query(spark, SF).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
