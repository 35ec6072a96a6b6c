"""Edge rules on hand-made frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohort_spark.functions import stats, text
from cohort_spark.operators import attribution, channels, cohort, drift, evaluate, features, labels, resample, retrieval, sequences, splits, timegrid, train
from cohort_spark.sources import corpus, io
from cohort_spark.streaming import jobs


def one(df):
    return df.first().asDict()


def test_hours_and_windows(spark):
    t = "timestamp '2024-01-01 {}'"
    df = spark.sql("select * from values " + ", ".join(f"({t.format(x)})" for x in ("00:00:00", "06:00:00", "05:59:59", "14:00:00")) + ", (timestamp '2023-12-31 23:30:00') as v(t)").withColumn("t0", F.lit("2024-01-01").cast("timestamp"))
    got = [tuple(r) for r in df.select(timegrid.hours_since(F.col("t"), F.col("t0")), timegrid.in_window(F.col("t"), F.col("t0"), 0, 6 * 3600), timegrid.in_window(F.col("t"), F.col("t0"), 8 * 3600, 14 * 3600, "both")).collect()]
    assert got == [(0, True, False), (6, False, False), (5, True, False), (14, False, True), (0, False, False)]


def test_interval_bounds_and_point_events(spark):
    ent = spark.createDataFrame([(k,) for k in range(4)], "stay_id long")
    iv = spark.createDataFrame([(0, 1, 8), (1, 14, 20), (2, 9, None), (3, 7, 9)], "stay_id long, starttime int, endtime int")
    got = {r.stay_id: r.label for r in labels.interval_overlap(ent, iv, F.lit(8), F.lit(14)).collect()}
    assert got == {0: False, 1: False, 2: True, 3: True}


def test_null_status_is_dropped(spark):
    df = spark.createDataFrame([("Given",), ("Not Given",), (None,)], "s string")
    assert [r.s for r in channels.exclude_status(df, "s", ["Not Given"]).collect()] == ["Given"]


def test_lab_lands_in_the_right_stay(spark):
    stays = spark.createDataFrame([(1, 10, "2024-01-01", "2024-01-02"), (2, 10, "2024-01-03", "2024-01-04")], "stay_id long, hadm_id long, a string, b string").select("stay_id", "hadm_id", F.col("a").cast("timestamp").alias("intime"), F.col("b").cast("timestamp").alias("outtime"))
    lab = spark.createDataFrame([(10, "2024-01-03 05:00:00", 1.0)], "hadm_id long, t string, v double").select("hadm_id", F.col("t").cast("timestamp").alias("charttime"), "v")
    assert [r.stay_id for r in timegrid.attach_events(lab, stays, "charttime", key="hadm_id").collect()] == [2]


def test_flat_signals(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, None), (2, 0, 3.0), (2, 1, 3.0), (3, 0, None), (4, 0, 1.0), (4, 1, 2.0)], "stay_id long, hr int, x double")
    assert {r.stay_id for r in cohort.drop_flat(df, ["x"]).collect()} == {3, 4}


def test_psi_properties(spark):
    rng = random.Random(1)
    rows = [(g, f, float(v)) for g in "ab" for f, n in (("same", 200), ("const", 200), ("zeros", 200)) for k in range(n) for v in [k if f == "same" else 7 if f == "const" else max(0, k - 150)]]
    rows += [(g, "few", rng.random()) for g in "ab" for _ in range(4)]
    long = spark.createDataFrame(rows, "grp string, feature string, value double")
    q = {r.feature: r.psi for r in drift.psi_quantile(long, "a", "b").collect()}
    w = {r.feature: r.psi for r in drift.psi_equal_width(long, "a", "b").collect()}
    k = {r.feature: r.ks for r in drift.ks_two_sample(long, "a", "b").collect()}
    assert q["same"] == 0 and q["const"] == 0 and abs(q["zeros"]) < 1e-12
    assert w["few"] == 0 and abs(w["same"]) < 1e-12
    assert k["few"] == 0 and k["same"] == 0


def test_group_without_rows(spark):
    long = spark.createDataFrame([("a", "x", float(v)) for v in range(20)], "grp string, feature string, value double")
    assert [r.psi for r in drift.psi_quantile(long, "a", "b").collect()] == [0.0]
    assert [r.ks for r in drift.ks_two_sample(long, "a", "b").collect()] == [0.0]
    assert [r.d for r in drift.cohen_d(long.limit(1), "a", "b").collect()] == [0.0]
    one_class = spark.createDataFrame([(i, "l", "m", 1, 0.5) for i in range(3)], "id long, label string, model string, y int, prob double")
    assert all(r.loo is None for r in resample.jackknife(one_class).collect())


def test_auroc_corner_cases(spark):
    rows = [(i, "l", "one", 1, i / 10) for i in range(5)] + [(i, "l", "tied", i % 2, 0.5) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, label string, model string, y int, prob double")
    a = {r.model: r.auroc for r in evaluate.auroc(df).collect()}
    p = {r.model: r.ap for r in evaluate.average_precision(df).collect()}
    assert a["one"] is None and a["tied"] == 0.5 and p["tied"] == pytest.approx(0.5)
    r = random.Random(2)
    df = spark.createDataFrame([(i, "l", m, int(r.random() < 0.3), p) for i in range(80) for p in [round(r.random(), 1)] for m in ("x",)], "id long, label string, model string, y int, prob double")
    both = evaluate.auroc(df.unionByName(df.withColumns({"prob": 1 - F.col("prob"), "model": F.lit("neg")}))).collect()
    assert sum(x.auroc for x in both) == pytest.approx(1)


def test_closed_form_jackknife(spark):
    r = random.Random(3)
    rows = [(i, "l", "m", int(r.random() < 0.4), round(r.random(), 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, label string, model string, y int, prob double")

    def brute(rs):
        pos, neg = [x[4] for x in rs if x[3]], [x[4] for x in rs if not x[3]]
        return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)

    for x in resample.jackknife(df).collect():
        assert x.loo == pytest.approx(brute([t for t in rows if t[0] != x.id]))


def test_disagreement_asymmetry(spark):
    rows = [(1, "l", "a", 1, 0.9), (1, "l", "b", 1, 0.01), (2, "l", "a", 0, 0.9), (2, "l", "b", 0, 0.2)]
    df = spark.createDataFrame(rows, "id long, label string, model string, y int, prob double")
    assert one(evaluate.disagreement(df, [("a", "b")]))["asymmetry"] == math.inf
    assert one(evaluate.check_alignment(df, "a", "b")) == {"only_x": 0, "only_y": 0, "label_differs": 0}


def test_overlap_and_ranking(spark):
    hits = "query_id long, doc_id long, sim double, rank int, rel int"
    a = spark.createDataFrame([(1, 1, 0.9, 1, 0), (1, 2, 0.8, 2, 0)], hits)
    b = spark.createDataFrame([(1, 1, 0.7, 1, 0), (1, 2, 0.6, 2, 1)], hits)
    assert math.isnan(one(retrieval.rank_correlation(a, b))["rho"])
    assert math.isnan(one(retrieval.ndcg_at_k(a))["ndcg"]) and one(retrieval.ndcg_at_k(b))["ndcg"] == pytest.approx(1 / math.log2(3))
    none = spark.range(1).select(retrieval.jaccard(F.array().cast("array<long>"), F.lit(None).cast("array<long>")).alias("j"))
    assert one(none)["j"] == 1.0


def test_sequences_pad_and_cut(spark):
    df = spark.createDataFrame([(s, h, 1.0 + h) for s, n in ((1, 4), (2, 8)) for h in range(n)], "stay_id long, hr int, x double")
    got = {r.stay_id: [v[0] for v in r.seq] for r in sequences.assemble(df, ["x"]).collect()}
    assert got == {1: [1, 2, 3, 4, 0, 0], 2: [1, 2, 3, 4, 5, 6]}
    flat = {r.stay_id: (r.last_x, r.min_x, r.max_x) for r in sequences.flatten(df, ["x"]).collect()}
    assert flat == {1: (0.0, 0.0, 4.0), 2: (6.0, 1.0, 6.0)}


def test_ratio_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (500.0, 10.0), (-3.0, 1.0), (None, 2.0), (2.0, None)], "x double, x_baseline double")
    assert [r.x_ratio for r in features.delta_ratio(df, ["x"]).collect()] == [1.0, 10.0, -3.0, None, None]


def test_splits_are_disjoint(spark):
    df = spark.createDataFrame([(i, i % 7, "train" if i < 10 else "val") for i in range(20)], "stay_id long, subject_id long, split string")
    out = splits.purge_subjects(df)
    assert {r.split for r in out.collect()} == {"train"}
    splits.assert_disjoint(out)
    with pytest.raises(ValueError):
        splits.assert_disjoint(df.unionByName(df.withColumn("split", F.lit("test"))))


def test_names_and_tokens(spark):
    df = spark.createDataFrame([("physio:last_map",), ("has_total_crystalloid_ml",), ("mean_roll_3_hr",)], "f string")
    assert [r[0] for r in df.select(text.normalize_feature_name(F.col("f"))).collect()] == ["MAP", "total crystalloid", "roll 3 hr"]
    assert one(spark.range(1).select(text.token_jaccard(F.lit("a b"), F.lit("B c")).alias("j")))["j"] == pytest.approx(1 / 3)


def test_p_values():
    assert stats.chi2_pvalue(3.841459) == pytest.approx(0.05, abs=1e-6)
    assert stats.ks_pvalue(0.0, 10, 10) == 1.0 and stats.ks_pvalue(0.9, 100, 100) < 1e-6
    low, high = stats.bca_percentiles(0.5, 0.0)
    assert (low, high) == (pytest.approx(2.5), pytest.approx(97.5))


def test_weight_delta_and_linear_attribution(spark):
    w = spark.createDataFrame([("a", 0, 1.0, 1.0), ("a", 1, 0.0, 1.0)], "layer string, i int, before double, after double")
    assert one(attribution.weight_delta(w))["l2"] == 1.0
    x = spark.createDataFrame([(1, 3.0)], "id long, x double")
    assert one(attribution.linear_attribution(x, {"x": 2.0}, {"x": 1.0}))["value"] == 4.0


def test_external_scorer(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert one(train.score_with(df, lambda pdf: pdf["x"] * 2, ["x"]))["prob"] == 4.0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2.5\n")
    assert one(io.read_tables(spark, str(tmp_path), {"a": "id long, v double"})["a"]) == {"id": 1, "v": 2.5}
    df = spark.createDataFrame([(1, float("nan"), float("inf")), (2, 0.1234567, 1.0)], "id long, x double, y double")
    io.write_report(df, str(tmp_path / "r"))
    got = {r.id: r.asDict() for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert got[1].get("x") is None and got[1]["y_inf"] == "inf" and got[2]["x"] == 0.123457
    io.write_table(df, str(tmp_path / "t"), ["id"], ["x"])
    assert io.read_table(spark, str(tmp_path / "t")).count() == 2
    (tmp_path / "x.xml").write_text("<r><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>" + "a" * 60 + "</AbstractText><AbstractText>" + "b" * 60 + "</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName></Author></AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName>Sepsis</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></r>")
    doc = one(corpus.read_article_xml(spark, str(tmp_path / "x.xml")))
    assert (doc["pmid"], doc["year"], doc["mesh"], doc["first_author"], len(doc["abstract"])) == ("7", 2015, ["Sepsis"], "L", 121)
    window = one(spark.range(1).select(corpus.window_from_tag(F.lit("2020 - 2022")).alias("w")))["w"]
    assert (window["first"], window["last"]) == (2009, 2019)


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", 7, 5.0), (1, "2024-01-01 00:50:00", 7, 9.0), (1, "2024-01-01 01:10:00", 7, 1.0)]
    src, schema = str(tmp_path / "in"), "stay_id long, charttime timestamp, itemid int, valuenum double"
    spark.createDataFrame(rows, "stay_id long, c string, itemid int, valuenum double").select("stay_id", F.col("c").cast("timestamp").alias("charttime"), "itemid", "valuenum").write.parquet(src)
    out = jobs.hourly_channels(spark.readStream.schema(schema).parquet(src), [channels.Channel("hr", (7,), 0, 100)])
    q = out.writeStream.format("memory").queryName("buckets").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.hr for r in spark.table("buckets").collect()) == [1.0, 9.0]

    vals = str(tmp_path / "vals")
    spark.createDataFrame([("x", float(v)) for v in range(10)], "feature string, value double").write.parquet(vals)
    breaks = spark.createDataFrame([("x", [5.0])], "feature string, breaks array<double>")
    ref = spark.createDataFrame([("x", 0, 5), ("x", 1, 5)], "feature string, bin int, n long")
    seen = []
    q = jobs.drift_monitor(spark.readStream.schema("feature string, value double").parquet(vals), breaks, ref, lambda df, n: seen.extend(df.collect()), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert seen and abs(seen[-1].psi) < 1e-12


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    from cohort_spark.plans.registry import rounded

    r = random.Random(3)
    values = [0.5026875, -0.5026875, 0.0, 1e300, 1e308, -1e308, float("inf"), float("-inf"), 4503599627.370497, *(r.randrange(10**7) / 10**7 for _ in range(500)), *(r.randrange(-(10**9), 10**9) / 10**7 for _ in range(500))]
    values += [(r.randrange(10**6) + 0.5) / 10**6 for _ in range(2000)]
    got = [x.v for x in rounded(spark.createDataFrame([(k, v) for k, v in enumerate([*values, None, float("nan")])], "k int, v double")).orderBy("k").collect()]
    assert got[-2] is None and math.isnan(got[-1])
    assert got[:-2] == [x for (x,) in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
