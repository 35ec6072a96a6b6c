"""The maximum-entropy model against a plain evaluation of its definition, its sums to one, and its gain on held-out texts."""

import math

import numpy as np
import pytest

from cohort_spark.llm import lm_scoring as lm

from .test_operators import EDGE, DOCS, SF


@pytest.mark.parametrize("head,pairs", [(lm.HEAD, lm.HEAD_PAIRS), (10, 2000)])
def test_scores_are_those_of_the_definition(spark, head, pairs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(2**53 + 1, "a b c"), (None, "no id"), (2**53 + 3, None)], "doc_id long, text string")).cache()
    model = lm.fit(docs.where(~lm.held_out(docs.doc_id)), head=head, head_pairs=pairs)
    count = {r.word: r.c for r in model.counts.collect()}
    u = {(r.word, r.b): r.u for r in model.features.collect()}
    words, shares, lz = model.words, np.exp(model.words.log_shares()), model.log_z

    def log_p(w, one, two):
        k = int(words.class_of(np.array([w], np.uint64))[0])
        return k, model.classes[one * lm.BUCKETS + two, k] + math.log((count.get(w, 0) + 1) / shares[k]) - lz[one, k] + u.get((w, one), 0.0) if w != lm.END else model.classes[one * lm.BUCKETS + two, 0] + math.log((count.get(w, 0) + 1) / shares[0])

    got = {r.doc_id: r for r in lm.score_with(model, docs).collect()}
    assert {2**53 + 1, None, 2**53 + 3} <= set(got) and got[None].held_out is False
    for doc, text in docs.collect():
        w = lm.token_words(text)
        one, two = lm.history(w)
        want = sum(log_p(int(x), int(a), int(b))[1] for x, a, b in zip(w, one, two)) / math.log(10)
        assert got[doc].score == pytest.approx(want, rel=1e-4), doc

    for one, two in ((0, 0), (5, 9), (77, 3)):  # all words, an unknown one and the end sum to one
        total = sum(math.exp(log_p(w, one, two)[1]) for w in count if w != lm.END)
        rare = math.exp(model.classes[one * lm.BUCKETS + two, lm.CLASSES - 1] - lz[one, lm.CLASSES - 1]) / shares[lm.CLASSES - 1]
        empty = sum(math.exp(model.classes[one * lm.BUCKETS + two, k]) for k in range(lm.CLASSES - 1) if words.tokens[k] + words.distinct[k] == 0)
        end = math.exp(model.classes[one * lm.BUCKETS + two, 0]) if words.distinct[0] else 0
        assert total + rare + empty + end == pytest.approx(1, abs=2e-3)


def test_gain_on_held_out_texts(spark):
    out = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").toPandas()
    per_token = lambda c: out[c].sum() / out["n_tokens"].sum()
    print("held-out log10 a token", per_token("base_score"), per_token("score"))
    assert per_token("score") > per_token("base_score") + 0.02


def test_edges(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    assert lm.score(df).count() == len(EDGE) and lm.score(df.limit(0)).count() == 0
    none = lm.score(spark.createDataFrame([(4, "a b")], "doc_id long, text string").where("doc_id is null or doc_id > 0"))
    assert none.count() == 1


@pytest.mark.parametrize("most", [1, 7, 1 << 15])
def test_texts_of_a_run_are_numbered_as_each_alone(monkeypatch, most):
    monkeypatch.setattr(lm, "AT_ONCE", most)
    texts = [None, "", "a", "A b\tc", "  ", "d e f g h i j k l", None, "a b"]
    parts = list(lm.runs(texts))
    assert len(parts) == {1: 8, 7: 3, 1 << 15: 1}[most]
    words = [lm.token_words(t) for t in texts]
    assert np.concatenate([p.words for p in parts]).tolist() == np.concatenate(words).tolist()
    got, want = [lm.history(p.words, p.starts) for p in parts], [lm.history(w) for w in words]
    for k in range(2):
        assert np.concatenate([g[k] for g in got]).tolist() == np.concatenate([w[k] for w in want]).tolist()
