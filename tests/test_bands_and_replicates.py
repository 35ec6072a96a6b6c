"""Bands of values, running sums, and bootstrap scans over bands, against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import evaluate, ranks, resample

ODD = [0.0, -0.0, 5e-324, -5e-324, 1e-301, 1e-299, 0.1, 0.1 + 2**-56, 0.5, math.nextafter(0.5, 0), math.nextafter(0.5, 1), 1.0, math.nextafter(1.0, 0), 2.0**40, 2.0**40 - 2**-13, 1e299, 1e301, float("inf")]


def test_position_never_falls(spark):
    r = random.Random(1)
    values = sorted({*ODD, *(-v for v in ODD), *(r.gauss(0, 1) * 10 ** r.randint(-20, 20) for _ in range(3000)), *(2.0**k for k in range(-60, 60)), *(math.nextafter(2.0**k, 0) for k in range(-60, 60))})
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double")
    got = [x.p for x in df.select("v", ranks.position(F.col("v")).alias("p")).orderBy("v").collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("bits", [0, 4, 12, 31])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, bits, descending):
    r = random.Random(bits)
    rows = [("k" + str(r.randrange(3)), v, r.randrange(5)) for v in {*(round(r.gauss(0, 3), 2) for _ in range(400)), *ODD[3:]}]
    counts = spark.createDataFrame(rows, "k string, v double, n int").groupBy("k", "v").agg(F.sum("n").alias("n"))
    want, total = {}, {}
    for k, v, n in sorted(rows, key=lambda x: -x[1] if descending else x[1]):
        total[k] = total.get(k, 0) + n
        want[k, v] = total[k]
    got = ranks.running(counts, ["k"], "v", ["n"], descending, bits).collect()
    assert {(x.k, x.v): (x.n_upto, x.n_all) for x in got} == {(k, v): (n, total[k]) for (k, v), n in want.items()}


def test_no_job_while_a_plan_is_built(spark):
    df = spark.createDataFrame([(1, "l", "m", 1, 0.5), (2, "l", "m", 0, 0.2)], "id long, label string, model string, y int, prob double")
    spark.sparkContext.setJobGroup("building", "")
    evaluate.auroc(df)
    evaluate.metrics(df.withColumn("split", F.lit("s")))
    resample.replicate_metric(df, 10, "ap")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("", "")


def test_more_input_makes_more_bands(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/a")
    few = ranks.band_bits(spark.read.parquet(f"{tmp_path}/a"))
    spark.range(4_000_000).select("id", F.rand(1).alias("v")).write.parquet(f"{tmp_path}/b")
    assert few == 0 < ranks.LEAST_BITS < ranks.band_bits(spark.read.parquet(f"{tmp_path}/b")) < ranks.MOST_BITS


def plain(ids, scores, y, replicates):
    """(auroc, ap) of each replicate, from weights laid out in full."""
    w = resample._weights(np.array(ids), np.arange(replicates)).astype(float)
    order = np.unique(scores)[::-1]
    tp = fp = np.zeros(replicates)
    area = ap = np.zeros(replicates)
    for s in order:
        p, n = w[(scores == s) & (y == 1)].sum(axis=0), w[(scores == s) & (y != 1)].sum(axis=0)
        tp, fp = tp + p, fp + n
        area = area + n * (tp - p / 2)
        ap = ap + np.where(p > 0, p * tp / np.maximum(tp + fp, 1), 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return area / (tp * fp), ap / tp


@pytest.fixture(scope="module")
def scored():
    r = np.random.default_rng(7)
    n = 600
    scores = np.where(r.random(n) < 0.3, 0.5, np.round(r.random(n), 3))  # one score that a third has, and many ties
    return np.arange(n), scores, (r.random(n) < 0.3 + 0.4 * scores).astype(int)


@pytest.mark.parametrize("metric", ["auroc", "ap"])
def test_replicates_over_many_bands(spark, monkeypatch, scored, metric):
    monkeypatch.setattr(resample, "BAND_ROWS", 50)
    ids, scores, y = scored
    rows = [(int(i), "l", m, int(c), float(s)) for m in ("a", "b") for i, c, s in zip(ids, y, scores if m == "a" else scores[::-1])]
    rows += [(9999, "l", "a", None, 0.5), (9998, "l", "a", 1, None), (1, "one class", "a", 1, 0.3), (2, "one class", "a", 1, 0.3)]
    df = spark.createDataFrame(rows, "id long, label string, model string, y int, prob double")
    assert resample._dealt(df).select("band").distinct().count() > 5
    got = {(x.model, x.label, x.b): x.value for x in resample.replicate_metric(df, 40, metric).collect()}
    for m, s in (("a", scores), ("b", scores[::-1])):
        want = plain(ids, s, y, 40)[metric == "ap"]
        assert [got[m, "l", b] for b in range(40)] == pytest.approx(want.tolist())
    if metric == "auroc":
        assert all(got["a", "one class", b] is None for b in range(40))


def test_a_scan_takes_scores_across_batches(scored):
    ids, scores, y = scored
    order = np.argsort(-scores, kind="stable")
    scan, whole = resample._Scan(("m", "l", 0), 30), resample._Scan(("m", "l", 0), 30)
    whole.add(ids[order], scores[order], y[order])
    for low in range(0, len(ids), 7):
        part = order[low : low + 7]
        scan.add(ids[part], scores[part], y[part])
    for a, b in zip(scan.row()[3:], whole.row()[3:]):
        assert a == pytest.approx(b)
    p, n, area, _ = whole.row()[3:]
    assert area / (p * n) == pytest.approx(plain(ids, scores, y, 30)[0])


def test_replicates_shuffle_rows_and_not_replicates(spark, scored):
    ids, scores, y = scored
    df = spark.createDataFrame([(int(i), "l", "m", int(c), float(s)) for i, c, s in zip(ids, y, scores)], "id long, label string, model string, y int, prob double")
    out = resample._scan_bands(resample._dealt(df), 1000)
    out.count()
    tracked = [x for x in out.collect()]
    assert sum(len(x.p) for x in tracked) == 1000 * len(tracked) and len(tracked) < 5  # a vector for each band, not for each row


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, label string, model string, y int, prob double")
    assert resample.replicate_metric(df, 5).collect() == [] == resample.replicate_metric(df, 5, "ap").collect()


@pytest.mark.parametrize("bits", [0, 7])
@pytest.mark.parametrize("kind", ["timestamp", "long", "double"])
def test_ranks_over_groups(spark, kind, bits):
    from cohort_spark.operators import splits

    r = random.Random(8)
    rows = [(k, "e" + str(r.randrange(3)), r.choice([None, 1_700_000_000 + r.randrange(2_000_000), 1_700_000_000, -5])) for k in range(500)]
    df = spark.createDataFrame(rows, "stay_id long, era string, t long").withColumn("t", F.timestamp_seconds("t") if kind == "timestamp" else F.col("t").cast(kind)).repartition(3)
    got = {x.stay_id: (x._rank, x._n) for x in splits._ranked(df, ["t", "stay_id"], "era", bits).collect()}
    want = sorted(rows, key=lambda x: (x[1], x[2] is not None, x[2] or 0, x[0]))
    assert got == {x[0]: (k + 1, 500) for k, x in enumerate(want)}


def attribution_rows(seed=5):
    r = random.Random(seed)
    rows = [(i, x, f"f{f}", m, r.gauss(0, 1)) for i in range(60) for x in (["k", None][i % 2], "l") for f in range(5) for m in ("source", "adapted") if r.random() < 0.9]
    return rows + [(None, "k", "f0", "adapted", 9.0), (7, "k", "f0", "adapted", None), (7, "alone", "f0", "adapted", 1.0), (7, "k", "f0", "other", 1.0)]


def test_attribution_intervals_against_loops(spark):
    rows, n = attribution_rows(), 30
    schema = "id long, label string, feature string, model string, value double"
    got = {(x.label, x.feature): (x.delta, x.low, x.high) for x in resample.bootstrap_mean_delta(spark.createDataFrame(rows, schema).repartition(3), "source", "adapted", n).collect()}
    want = {}
    for label, feature in {(x[1], x[2]) for x in rows if x[1] != "alone"}:
        phi = []
        for m in ("source", "adapted"):
            of = [(i, abs(v)) for i, lab, f, k, v in rows if (lab, f, k) == (label, feature, m) and v is not None]
            ids = [(i, v) for i, v in of if i is not None]
            w = resample._weights(np.array([i for i, _ in ids]), np.arange(n))
            phi.append([np.mean([v for _, v in of]), *(np.array([v for _, v in ids]) @ w / w.sum(axis=0))])
        d = np.array(phi[1]) - phi[0]
        want[label, feature] = (d[0], *np.percentile(d[1:], [2.5, 97.5]))
    assert len(want) == 15 and got.keys() == want.keys()  # a null label is a group of its own
    assert all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("limits", [(1 << 17, 2048, 4096, 1024), (100, 3, 4, 2)])
def test_a_task_sends_each_group_once_and_weighs_an_id_once(monkeypatch, limits):
    import pyarrow as pa

    for name, x in zip(("ROWS_AT_ONCE", "GROUPS_AT_ONCE", "GROUPS", "AT_ONCE"), limits):
        monkeypatch.setattr(resample, name, x)
    rows = [r for r in attribution_rows() if r[4] is not None]
    weighed, plain_weights = [], resample._weights
    monkeypatch.setattr(resample, "_weights", lambda ids, numbers: weighed.extend(ids) or plain_weights(ids, numbers))
    task, sent = resample._Sums(8), []
    for at in range(0, len(rows), limits[0]):
        sent += task.add(pa.table(dict(zip(("id", "label", "feature", "model", "value"), zip(*rows[at : at + limits[0]])))))
    kept = [x for b in [*sent, *task.take()] for x in b.to_pylist()]
    groups = {r[1:4] for r in rows}
    if limits[2] > len(groups):
        assert len(kept) == len(groups) and len(weighed) <= 2 * 60 + 3  # each id is in two labels
    total = {}
    for x in kept:
        k = x["label"], x["feature"], x["model"]
        total[k] = total.get(k, 0) + np.array([x["s"], x["w"]])
    for k in groups:
        of = [(i, v) for i, *key, v in rows if tuple(key) == k]
        w = np.array([np.r_[1, plain_weights(np.array([i or 0]), np.arange(8))[0] * (i is not None)] for i, _ in of])
        assert total[k] == pytest.approx(np.array([[v for _, v in of] @ w, w.sum(axis=0)]))
