"""Bucketed interval joins against all pairs, and era sketches against exact comparisons."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import drift, intervals, labels, timegrid

T0 = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def made_up(seed, n):
    r = random.Random(seed)
    spans = [(k, r.randrange(3), s := r.choice([r.uniform(-50, 50), float(r.randrange(-50, 50))]), s + r.choice([0, 1, 6, 24, 100, 0.5])) for k in range(n)]
    return [*spans, (n, 0, None, 3.0), (n + 1, 0, 3.0, None), (n + 2, 0, 9.0, 4.0), (n + 3, None, 0.0, 5.0)]


@pytest.mark.parametrize("hours", [0.5, 6, 1000])
@pytest.mark.parametrize("closed", ["both", "left"])
def test_points_in_intervals(spark, hours, closed):
    stays, points = made_up(1, 80), [(k, p[1], p[2]) for k, p in enumerate(made_up(2, 150))]
    s = spark.createDataFrame([(i, k, at(a), at(b)) for i, k, a, b in stays], "stay_id long, hadm_id int, intime timestamp, outtime timestamp")
    e = spark.createDataFrame([(i, k, at(t)) for i, k, t in points], "event_id long, hadm_id int, t timestamp")
    got = timegrid.attach_events(e, s, "t", key="hadm_id", closed=closed, bucket_seconds=hours * 3600)
    assert "_bucket" not in got.columns
    inside = {(p, i) for p, pk, t in points for i, k, a, b in stays if None not in (pk, t, a, b) and pk == k and a <= t and (t <= b if closed == "both" else t < b)}
    rows = [(x.event_id, x.stay_id) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == inside
    plain = timegrid.attach_events(e, s, "t", key="hadm_id", closed=closed)
    assert {(x.event_id, x.stay_id) for x in plain.collect()} == inside


@pytest.mark.parametrize("hours", [0.5, 6, 1000])
def test_overlapping_intervals_meet_once(spark, hours):
    a, b = made_up(3, 60), made_up(4, 60)
    left = spark.createDataFrame([(i, k, at(x), at(y)) for i, k, x, y in a], "a_id long, key int, a1 timestamp, a2 timestamp")
    right = spark.createDataFrame([(i, k, at(x), at(y)) for i, k, x, y in b], "b_id long, key int, b1 timestamp, b2 timestamp")
    rows = [(x.a_id, x.b_id) for x in intervals.overlapping(left, right, (F.col("a1"), F.col("a2")), (F.col("b1"), F.col("b2")), "key", hours * 3600).collect()]
    want = {(i, j) for i, k, x, y in a for j, m, u, v in b if None not in (k, m, x, y, u, v) and k == m and x <= y and u <= v and x < v and u < y}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_busy_key_meets_its_neighbours_alone(spark):
    """10,000 stays of one subject, one after the other: pairs that are compared are hardly more than matches."""
    stays = spark.range(10_000).select(F.col("id").alias("stay_id"), F.lit(1).alias("subject_id"), F.timestamp_seconds(F.col("id") * 90_000).alias("intime"), F.timestamp_seconds(F.col("id") * 90_000 + 86_400).alias("outtime"))
    events = spark.range(50_000).select(F.col("id").alias("event_id"), F.lit(1).alias("subject_id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(900_000_000))).alias("t"))
    matches = timegrid.attach_events(events, stays, "t", key="subject_id", bucket_seconds=8640).count()
    compared = intervals.dealt(stays, F.col("intime"), F.col("outtime"), 8640).join(events.withColumn("_bucket", intervals._bucket(F.col("t"), 8640)), ["subject_id", "_bucket"]).count()
    assert 40_000 < matches and compared < 1.2 * matches


def test_labels_by_a_coarser_key(spark):
    ent = spark.createDataFrame([(k, k // 2, at(100 * (k % 2))) for k in range(6)], "stay_id long, hadm_id long, intime timestamp")
    iv = spark.createDataFrame([(0, at(1), at(8)), (0, at(109), None), (1, at(14), at(20)), (1, at(7), at(9)), (2, at(9), None), (2, None, at(9))], "hadm_id long, starttime timestamp, endtime timestamp")
    window = [F.col("intime") + F.make_dt_interval(F.lit(0), F.lit(h)) for h in (8, 14)]
    got = {x.stay_id: x.label for x in labels.interval_overlap(ent, iv, *window, on="hadm_id", bucket_seconds=3600).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True, 5: False}


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(3)
    rows = [(e, "x", r.gauss(k * 0.2, 1)) for k, e in enumerate("abcd") for _ in range(6000)]
    rows += [(e, "steps", float(min(9, int(r.expovariate(0.5 + 0.1 * k))))) for k, e in enumerate("abcd") for _ in range(3000)]
    rows += [(e, "flat", 1.0) for e in "abcd" for _ in range(10)]
    return spark.createDataFrame(rows, "grp string, feature string, value double").repartition(5).cache()


def test_sketched_psi_and_ks_are_near(spark, long):
    sketches = drift.era_sketches(long, 1024).cache()
    error = drift.rank_error(1024)
    for a, b in (("a", "b"), ("a", "d")):
        ref, cur = [sketches.where(f"grp = '{g}'").select("feature", F.col("sketch").alias(n)) for g, n in ((a, "_r"), (b, "_c"))]
        got = {x.feature: (x.psi, x.ks) for x in drift.compare_sketches(ref.join(cur, "feature")).collect()}
        psi = {x.feature: x.psi for x in drift.psi_quantile(long, a, b).collect()}
        ks = {x.feature: x.ks for x in drift.ks_two_sample(long, a, b).collect()}
        for f in ("x", "steps"):
            assert got[f][1] == pytest.approx(ks[f], abs=2 * error + 4 / drift.POINTS)
            # Ten shares near a tenth, each off by 2 * error at most: the derivative of a term is about log(q/p) + 1 at most.
            assert got[f][0] == pytest.approx(psi[f], abs=10 * 2 * error * 0.6)
        assert got["flat"] == (0.0, 0.0)


def test_sketched_scan_and_merged_eras(spark, long):
    sketches = drift.era_sketches(long.where("feature <> 'flat'"), 2048).cache()
    exact = {(x.era, x.next_era): x for x in drift.scan_eras(long.where("feature <> 'flat'")).collect()}
    got = {(x.era, x.next_era): x for x in drift.scan_sketches(sketches).collect()}
    assert got.keys() == exact.keys() == {("a", "b"), ("b", "c"), ("c", "d")}
    for k in got:
        assert got[k].distance == pytest.approx(exact[k].distance, abs=0.02)
    two = drift.merged_eras(sketches, {"old": ["a", "b"], "new": ["c", "d"]})
    assert {(x.feature, x.grp): x.n for x in two.collect()} == {(f, g): n for f, n in (("x", 12000), ("steps", 6000)) for g in ("old", "new")}
    union = long.where("feature <> 'flat'").withColumn("grp", F.when(F.col("grp").isin("a", "b"), "1").otherwise("2"))
    want = drift.scan_eras(union).first().distance
    renamed = two.withColumn("grp", F.when(F.col("grp") == "old", "1").otherwise("2"))
    assert drift.scan_sketches(renamed).first().distance == pytest.approx(want, abs=0.02)


def test_a_sketch_reads_the_rows_once(spark, long):
    plan = drift.era_sketches(long)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
