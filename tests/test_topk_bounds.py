"""Top-k by strips with bounds: equal to brute force, ties by id, strips left out where documents are clustered."""

import numpy as np
import pytest

from cohort_spark.operators import retrieval


def brute(q, ids, d, k):
    sims = q @ d.T
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=-1)[:, :k]
    return ids[order], np.take_along_axis(sims, order, 1)


def clustered(rng, n, dim=16, centres=40):
    c = rng.normal(size=(centres, dim)) * 3
    v = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * 0.2
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["random", "clustered", "whole numbers"])
def test_hits_equal_brute_force(monkeypatch, kind):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(retrieval, "STRIP", 50)
    d = {"random": lambda: rng.normal(size=(3000, 8)), "clustered": lambda: clustered(rng, 3000), "whole numbers": lambda: rng.integers(-1, 2, (3000, 4)).astype(float)}[kind]()
    q = d[::50] * (1 if kind == "clustered" else 2)
    ids = rng.permutation(3000).astype(np.int64)
    for k in (1, 5):
        hits = retrieval.Hits(q, k)
        for low in range(0, 3000, 700):
            hits.add(ids[low : low + 700], d[low : low + 700])
        want = brute(q, ids, d, k)
        assert hits.sims == pytest.approx(want[1])
        if kind != "random":  # equal similarities are exactly equal, and go to the smaller id
            assert kind != "whole numbers" or (hits.ids == want[0]).all()
        assert hits.met % len(q) == 0 and hits.met >= len(q) * 3000 // 50


def test_bounds_leave_out_most_strips_of_clustered_documents():
    rng = np.random.default_rng(3)
    d = clustered(rng, 40_000)
    hits = retrieval.Hits(d[::50], 5)
    for low in range(0, len(d), 10_000):
        hits.add(np.arange(low, low + 10_000), d[low : low + 10_000])
    assert hits.skipped > 0.6 * hits.met
    assert hits.sims == pytest.approx(brute(d[::50], np.arange(len(d)), d, 5)[1])


def test_fewer_documents_than_k_and_none():
    hits = retrieval.Hits(np.ones((2, 3)), 5)
    hits.add(np.array([4, 2]), np.eye(3)[:2])
    assert hits.ids[:, :2].tolist() == [[2, 4], [2, 4]] and np.isneginf(hits.sims[:, 2:]).all()


def test_pairs_are_counted(spark):
    rng = np.random.default_rng(4)
    d = clustered(rng, 2000)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(d)] + [(5000, None)], "doc_id long, vec array<double>").repartition(2)
    queries = docs.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    counts = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = {(r.query_id, r.rank): (r.doc_id, r.sim) for r in retrieval.topk(queries, docs, 3, pairs=counts).collect()}
    ids, sims = brute(d[::50], np.arange(2000), d, 3)
    assert {k: v[0] for k, v in got.items()} == {(50 * q, r + 1): int(ids[q, r]) for q in range(40) for r in range(3)}
    assert 0 < counts[1].value < counts[0].value and counts[0].value % 40 == 0
