"""Late rows over batches and a restart, replayed drift batches, bucketed tables, broken input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import channels, drift
from cohort_spark.sources import io
from cohort_spark.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "stay_id long, charttime timestamp, itemid int, valuenum double"
HR = [channels.Channel("hr", (7,), 0, 100)]


def test_late_rows_over_a_restart(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        spark.createDataFrame([(k, T0 + timedelta(minutes=m), 7, float(v)) for k, m, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(src)

    def feed():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)

    def run():
        for q in jobs.start_channels(feed, HR, folder):
            q.awaitTermination()

    put((1, 10, 5), (1, 50, 9), (2, 30, 2))
    run()
    put((1, 200, 1))  # the watermark comes to 1:20, bucket 0 closes
    run()  # each run starts anew from the checkpoints
    put((1, 70, 3), (1, 55, 50), (2, 20, 60), (2, 21, 61))  # 1:10 is just inside, its bucket being open; bucket 0 is closed
    run()
    put((1, 600, 4))
    run()
    put((1, 601, 4))
    run()
    got = {(r.stay_id, r.start): (r.hr, r.n_rows) for r in spark.read.parquet(f"{folder}/buckets").collect()}
    assert got == {(1, T0): (9.0, 2), (2, T0): (2.0, 1), (1, T0 + timedelta(hours=1)): (3.0, 1), (1, T0 + timedelta(hours=3)): (1.0, 1)}
    late = {(r.stay_id, r.start): r.n_late for r in jobs.late_rows(spark, folder).collect()}
    assert late == {(1, T0): 1, (2, T0): 2}
    # The batch query over the rows that weren't late gives the same buckets.
    rows = spark.read.schema(SCHEMA).parquet(src).where("valuenum < 50 and charttime < timestamp '2024-01-01 10:00:00'")
    batch = rows.groupBy("stay_id", F.window("charttime", "1 hour").alias("w")).agg(F.max("valuenum").alias("hr"), F.count("*").alias("n"))
    assert {(r.stay_id, r.w.start): (r.hr, r.n) for r in batch.collect()} == got


def test_drift_monitor_in_update_mode_and_replayed(spark, tmp_path):
    src, checkpoint = str(tmp_path / "vals"), str(tmp_path / "c")
    ref = [("x", float(v % 20)) for v in range(100)] + [("y", float(v % 7)) for v in range(70)]
    long = spark.createDataFrame([("ref", f, v) for f, v in ref], "grp string, feature string, value double")
    inner = {"x": [4.0, 9.0, 14.0], "y": [2.0, 5.0]}
    breaks = spark.createDataFrame(list(inner.items()), "feature string, breaks array<double>")
    reference = jobs.bin_counts(long.select("feature", "value"), breaks)
    feeds = [[("x", 1.0), ("x", 17.0), ("y", 3.0)], [("x", 5.0)] * 4, [("y", 6.0), ("x", 12.0)], [("y", 0.0)] * 3]
    seen, changed = [], []

    def run():
        stream = spark.readStream.schema("feature string, value double").option("maxFilesPerTrigger", 1).parquet(src)
        q = jobs.drift_monitor(stream, breaks, reference, lambda df, n: seen.append((n, {r.feature: r.psi for r in df.collect()})), checkpoint, trigger={"availableNow": True})
        q.awaitTermination()

    for feed in feeds:
        spark.createDataFrame(feed, "feature string, value double").coalesce(1).write.mode("append").parquet(src)
        run()
    assert [n for n, _ in seen] == [0, 1, 2, 3]
    all_rows = [r for feed in feeds for r in feed]
    want = {r.feature: r.psi for r in jobs.psi_of_counts(jobs.bin_counts(spark.createDataFrame(all_rows, "feature string, value double"), breaks), reference).collect()}
    assert seen[-1][1] == pytest.approx(want)
    versions = jobs._versions(spark, f"{checkpoint}_counts")
    assert versions == [1, 2, 3]  # older ones are gone
    # The last batch once more, and a late replay of an earlier one's rows, change nothing.
    again = spark.createDataFrame([("y", 0, 3), ("y", 1, 1), ("y", 2, 1)], "feature string, bin int, n long").where("bin = 0")
    changed = {(r.feature, r.bin): r.n for r in jobs.merge_counts(again, 3, f"{checkpoint}_counts").collect()}
    assert changed == {(r.feature, r.bin): r.n for r in jobs.bin_counts(spark.createDataFrame(all_rows, "feature string, value double"), breaks).collect()}


def test_monitor_equals_the_quantile_psi_of_the_union(spark, tmp_path):
    ref, cur = [float(v % 50) for v in range(500)], [float((v * v) % 61) for v in range(400)]
    long = spark.createDataFrame([("r", "x", v) for v in ref] + [("c", "x", v) for v in cur], "grp string, feature string, value double")
    want = drift.psi_quantile(long, "r", "c").first().psi
    import numpy as np

    breaks = spark.createDataFrame([("x", np.unique(np.percentile(ref, range(0, 101, 10)))[1:-1].tolist())], "feature string, breaks array<double>")
    counts = [jobs.bin_counts(long.where(f"grp = '{g}'").select("feature", "value"), breaks) for g in "rc"]
    half = counts[1].withColumn("n", F.floor(F.col("n") / 2))
    folder = str(tmp_path / "t")
    jobs.merge_counts(half, 0, folder)
    assert jobs.psi_of_counts(jobs.merge_counts(counts[1], 1, folder), counts[0]).first().psi == pytest.approx(want)


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    names = [f"bucketed_{k}" for k in range(3)]
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for k, name in enumerate(names):
            rows = spark.range(3000).select((F.col("id") % 500).alias("stay_id"), (F.col("id") % 6).cast("int").alias("hr"), F.col("id").alias(f"v{k}")).dropDuplicates(["stay_id", "hr"])
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            rows.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            io.write_bucketed(spark.read.parquet(f"{tmp_path}/{name}"), name, ["stay_id"], 4, ["stay_id", "hr"])

        def joined(read):
            out = read(names[0])
            for name in names[1:]:
                out = out.join(read(name), ["stay_id", "hr"], "left")
            return out.groupBy("stay_id").agg(F.sum("v1").alias("s"))

        assert all(len(spark.table(n).inputFiles()) == 4 for n in names)
        plain = joined(lambda n: spark.read.parquet(f"{tmp_path}/{n}"))
        assert exchanges(joined(spark.table)) == 0 < exchanges(plain)
        assert sorted(map(tuple, joined(spark.table).collect())) == sorted(map(tuple, plain.collect()))
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_partitioned_tables_have_few_files(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select((F.col("id") % 3).alias("era"), F.col("id"))
    io.write_table(rows, f"{tmp_path}/t", ["era"], ["id"])
    back = spark.read.parquet(f"{tmp_path}/t")
    assert len(back.inputFiles()) == 3 and back.count() == 4000
    first = [r.id for r in back.where("era = 1").coalesce(1).collect()]
    assert first == sorted(first)


def test_broken_rows_are_set_aside(spark, tmp_path):
    (tmp_path / "a.csv").write_text("stay_id,v,name\n1,2.5,x\n2,oops,y\n3,1.0\n4,,z\n5,7,w,more\n")
    good, bad = io.read_checked(spark, str(tmp_path / "a.csv"), "stay_id long, v double, name string")
    assert sorted(tuple(r) for r in good.collect()) == [(1, 2.5, "x"), (4, None, "z")]
    assert sorted(r.record for r in bad.collect()) == ["2,oops,y", "3,1.0", "5,7,w,more"]
    assert all(r.file.endswith("a.csv") for r in bad.collect())
    (tmp_path / "a.xml").write_text("<set><item><id>1</id><t>one</t></item><item><id>two</id><t>x</t></item><item><id>3</id></item></set>")
    good, bad = io.read_checked(spark, str(tmp_path / "a.xml"), "id long, t string", "xml", rowTag="item")
    assert sorted(r.id for r in good.collect()) == [1, 3]
    assert ["two" in r.record for r in bad.collect()] == [True]
    (tmp_path / "a.json").write_text('{"id": 1}\n{"id": \n{"id": 2}\n')
    good, bad = io.read_checked(spark, str(tmp_path / "a.json"), "id long", "json")
    assert good.count() == 2 and bad.count() == 1


def test_articles_short_and_broken_ones_add_up(spark, tmp_path):
    from cohort_spark.sources import corpus

    def article(pmid, year, abstract, end="</PubmedArticle>"):
        date = f"<Journal><Title>J</Title><JournalIssue><PubDate><Year>{year}</Year></PubDate></JournalIssue></Journal>" if year else ""
        return f"<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>{abstract}</AbstractText></Abstract>{date}</Article></MedlineCitation>{end}"

    long = "word " * 30
    whole = [article(1, 2019, long), article(2, None, long), article(3, 2018, "short"), article(4, "MMXX", long), article(5, 2017, long + "<b>")]
    (tmp_path / "a.xml").write_text("<Set>" + "".join(whole) + "</Set>")
    good, short, bad = corpus.read_article_xml_checked(spark, str(tmp_path / "a.xml"))
    assert {(r.pmid, r.year) for r in good.collect()} == {("1", 2019), ("2", 2015)}
    assert [(r.pmid, r.abstract_chars) for r in short.collect()] == [("3", 5)]
    records = [r.record for r in bad.collect()]
    assert len(records) == 2 and any("MMXX" in r for r in records) and any("<PMID>5<" in r for r in records)
    assert good.count() + short.count() + bad.count() == len(whole)
