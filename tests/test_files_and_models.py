"""Files, intervals against brute force, embeddings and adapted models."""

import json
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import evaluate, ranks, resample, retrieval, splits, train
from cohort_spark.sources import corpus, io


def test_split_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, "train", "M", "WHITE"), (2, 11, "val", None, None)], "stay_id long, subject_id long, split string, gender string, ethnicity string")
    splits.write_assignment(df, str(tmp_path / "a"))
    back = io.read_table(spark, str(tmp_path / "a"))
    assert back.columns == ["stay_id", "subject_id", "split"] and [r.stay_id for r in splits.take(df, back, "val").collect()] == [2]
    rows = {r.stay_id: (r.gender_M, r.eth_WHITE, r.eth_ASIAN, r.hr) for r in io.load_split(df, ["hr"], []).collect()}
    assert rows == {1: (1.0, 1.0, 0.0, 0.0), 2: (0.0, 0.0, 0.0, 0.0)}


def test_predictions_file(spark, tmp_path):
    wide = spark.createDataFrame([(1, "l", 1, 0.5, 0.25)], "id long, label string, y int, a double, b double")
    io.write_table(evaluate.to_long_predictions(wide, ["id", "label", "y"], ["a", "b"]), str(tmp_path / "p"), ["model"])
    assert {(r.model, r.prob) for r in io.read_table(spark, str(tmp_path / "p")).collect()} == {("a", 0.5), ("b", 0.25)}


def test_json_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"pmid": str(y), "title": "T", "abstract": "A", "year": y, "mesh": ["X"]} for y in (2001, 2005, 2009)]))
    assert [r.pmid for r in corpus.read_json(spark, str(tmp_path / "c.json"), (2002, 2006)).collect()] == ["2005"]
    assert corpus.read_json(spark, str(tmp_path / "c.json")).count() == 3


def test_rater_files(spark, tmp_path):
    hits = spark.createDataFrame([("l", 1, "m", k, str(k), "abstract", ["A", "B"]) for k in (1, 2, 3)], "label string, stay_id long, model string, rank int, pmid string, abstract string, mesh array<string>")
    retrieval.write_rater_sheet(hits, str(tmp_path / "out"))
    sheet = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert set(sheet.columns) >= {"abstract_150", "mesh_tags", "relevant_0_1", "rater_notes"} and sheet.count() == 3
    (tmp_path / "in.csv").write_text("label,stay_id,model,pmid,relevant_0_1\nl,1,m,1,1\nl,1,m,2,maybe\n")
    ratings = retrieval.read_ratings(spark, str(tmp_path / "in.csv")).withColumn("stay_id", F.col("stay_id").cast("long"))
    assert {r.pmid: r.rating for r in ratings.collect()} == {"1": 1, "2": 0}
    got = retrieval.rated_metrics(hits, ratings).first()
    assert got.precision == pytest.approx(1 / 3) and got.ndcg == 1.0


def test_exact_quantiles(spark):
    r = random.Random(1)
    rows = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 997)) for v in ([r.choice([0.0, 0.0, r.gauss(0, 1), 1e9 * r.random()]) for _ in range(n)])]
    shares = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = {x.k: x.q for x in ranks.exact_quantiles(spark.createDataFrame(rows + [("a", None)], "k string, v double"), ["k"], "v", shares).collect()}
    for k in "abc":
        assert got[k] == pytest.approx(np.quantile([v for j, v in rows if j == k], shares))


def brute_auc(pos, neg):
    return (pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2


def test_bca_against_brute_force(spark):
    r = random.Random(4)
    ids = list(range(60))
    y = np.array([int(r.random() < 0.4) for _ in ids])
    a = np.array([round(min(1, max(0, r.gauss(0.4 + 0.1 * k, 0.2))), 2) for k in y])
    b = np.array([round(min(1, max(0, r.gauss(0.3 + 0.3 * k, 0.2))), 2) for k in y])
    rows = [(i, "l", m, int(y[i]), float(p[i])) for i in ids for m, p in (("a", a), ("b", b))]
    df = spark.createDataFrame(rows, "id long, label string, model string, y int, prob double")

    def gap(at):
        return brute_auc(b[at][y[at] == 1], b[at][y[at] == 0]) - brute_auc(a[at][y[at] == 1], a[at][y[at] == 0])

    point, reps = gap(np.array(ids)), []
    for k in range(200):
        reps.append(gap(np.repeat(ids, resample._weights(np.array(ids), np.array([k]))[:, 0])))
    reps = np.array(reps)
    left_out = np.array([gap(np.array([j for j in ids if j != i])) for i in ids])
    d = left_out.mean() - left_out
    normal, acc = NormalDist(), (d**3).sum() / (6 * (d**2).sum() ** 1.5)
    z0 = normal.inv_cdf((reps < point).mean())
    ends = [100 * normal.cdf(z0 + (z0 + z) / (1 - acc * (z0 + z))) for z in (normal.inv_cdf(0.025), normal.inv_cdf(0.975))]
    got = resample.bca(df, "a", "b", 200).first()
    assert got.point == pytest.approx(point)
    assert (got.low, got.high) == (pytest.approx(np.percentile(reps, ends[0])), pytest.approx(np.percentile(reps, ends[1])))
    simple = resample.paired_bootstrap(df, "a", "b", 200).first()
    assert simple.value_b - simple.value_a == pytest.approx(simple.point) and simple.low == pytest.approx(np.percentile(reps, 2.5))


def test_hashed_embeddings(spark):
    from pyspark.ml.feature import HashingTF

    texts = ["red fish blue fish", "one red apple", "blue apple pie and apple tart", ""]
    docs, _ = retrieval.embed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string"), "t", 512)
    place = HashingTF(numFeatures=512).indexOf
    words = [t.split() for t in texts]
    for r in docs.collect():
        v = np.zeros(512)
        for w in words[r.doc_id] or [""]:
            v[place(w)] += math.log((len(texts) + 1) / (sum(w in (x or [""]) for x in words) + 1))
        assert r.vec == pytest.approx(list(v / max(np.linalg.norm(v), 1e-300)), abs=1e-9)


def test_adapted_model_learns_the_new_era(spark):
    r = random.Random(5)

    def era(start, n, flip):
        return [(start + k, x, z, int((x < 0.5) if flip else (x > 0.5))) for k in range(n) for x, z in [(r.random(), r.random())]]

    schema = "stay_id long, x double, z double, y int"
    buffer, new, val, test = (spark.createDataFrame(rows, schema) for rows in (era(0, 60, False), era(1000, 400, True), era(2000, 120, True), era(3000, 200, True)))
    model = train.fit_adapted(buffer, new, val, ["x", "z"], "y", trees=10, depth=2)
    scored = train.score(model, test, ["x", "z"], "y", "adapted")
    assert scored.columns == ["id", "label", "model", "y", "prob"] and evaluate.auroc(scored).first().auroc > 0.95
    losses = train.stage_losses(model, test, ["x", "z"], "y")
    assert len(losses) == model.getNumTrees <= 10 and losses[-1] < losses[0]


def test_boosting_at_its_defaults_ends_early(spark):
    r = random.Random(6)
    rows = [(k, x, int((x > 0.5) != (r.random() < 0.2))) for k in range(900) for x in [r.random()]]
    df = spark.createDataFrame(rows, "stay_id long, x double, y int")
    learned = train.bounded(df.where("stay_id < 600"), 400, "stay_id")
    assert learned.count() == 400 and learned.exceptAll(train.bounded(df.where("stay_id < 600"), 400, "stay_id")).count() == 0
    model = train.fit_gbt(learned, df.where("stay_id >= 600 and stay_id < 750"), ["x"], "y")
    assert 1 <= model.getNumTrees < 300
    assert spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    assert evaluate.auroc(train.score(model, df.where("stay_id >= 750"), ["x"], "y", "m")).first().auroc > 0.7
