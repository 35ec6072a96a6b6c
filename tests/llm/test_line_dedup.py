"""Line dedup where one line is everywhere, keys are hot and ids or columns clash."""

import random

from cohort_spark.llm import line_dedup

from .test_advice_r01 import gone_lines


def test_one_line_in_every_document_and_hot_thirds(spark):
    r = random.Random(21)
    third = "2024-01-01 12:00:00 server one says "
    logs = [third + "".join(r.choice("abcdefghij ") for _ in range(60)) for _ in range(40)]
    docs = [(i, "\n".join(["the line that all documents have in common", r.choice(logs), r.choice(logs) + "x"])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (64, 4):
        assert {(x.doc_id, x.pos) for x in line_dedup.late_lines(df, min_chars=1, hot=hot).collect()} == gone_lines(docs)


def test_spread_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SPREAD", 3)
    docs = [(i, f"numbered line {i:04d} of a long file with one text") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(x.doc_id, x.pos) for x in line_dedup.late_lines(df, hot=8).collect()} == gone_lines(docs)


def test_ids_and_columns_that_clash(spark):
    a, b, c = ("a line that is long enough %d" % k * 2 for k in (1, 222, 33333))
    rows = [(1, f"{a}\n{b}", 7, "x"), (2, f"{c}\n{a}", 8, "y"), (2, f"{c}\n{b} and more of it", 9, "z"), (None, a, 1, "n"), (3, None, 1, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed long, n_lines string").selectExpr("*", "1 as _id", "2 as h1", "3 as key")
    got = {(x.doc_id, x.text, tuple(x.removed), x._id) for x in line_dedup.dedup(df).collect()}
    assert got == {(1, f"{a}\n{b}", (), 1), (2, c, (1,), 1), (2, f"{c}\n{b} and more of it", (), 1), (None, a, (), 1), (3, None, (), 1)}
    frame = df.withColumn("n_chars", df.h1.cast("long"))
    out = line_dedup.stage(spark, frame, "")
    assert out.columns == frame.columns and sorted(x.removed for x in out.collect()) == [1, 1, 7, 8, 9]
