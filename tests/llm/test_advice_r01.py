"""What the first round's advice found missing."""

import random

import pytest

from cohort_spark.llm import html_extraction, line_dedup, url_filter

from .test_operators import edits
from .test_pipeline import SF, duck


def gone_lines(docs, threshold=2):
    """(doc_id, pos) of all lines with a word that equal an earlier line or are near a different one, by brute force."""
    lines = sorted((i, p, x) for i, t in docs for p, x in enumerate(t.split("\n")) if x.strip(" \t\n\r\x0b\x0c"))
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))
    late = {x for x in first if any(first[y] < first[x] and abs(len(x) - len(y)) <= threshold and edits(x, y) <= threshold for y in first)}
    return {(i, p) for i, p, x in lines if x in late or first[x] != (i, p)}


def test_line_dedup_short_lines(spark, monkeypatch):
    r = random.Random(11)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé ") for _ in range(n)) for n in (0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6, 7, 8, 9, 12, 15, 18, 19, 20, 23)]
    docs = [(i, "\n".join(x[: len(x) // 2] + r.choice(["", "", "x"]) + x[len(x) // 2 + r.randrange(2) :] for x in (r.choice(words) for _ in range(5)))) for i in range(40)]
    docs += [(40 + i, "".join(chr(0x4E00 + 10 * i + k) for k in range(3))) for i in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot, limit in ((64, 10**6), (2, 10**6), (64, 0)):
        monkeypatch.setattr(line_dedup, "BROADCAST_LINES", limit)
        monkeypatch.setattr(line_dedup, "MANY", 3)
        assert {(x.doc_id, x.pos) for x in line_dedup.late_lines(df, min_chars=1, hot=hot).collect()} == gone_lines(docs)


def test_line_dedup_query_takes_short_copies(spark):
    docs = duck(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    lines = sorted((i, p, x) for i, t in docs for p, x in enumerate((t or "").split("\n")) if 0 < len(x.strip()) < 20)
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))
    copies = {(i, p) for i, p, x in lines if first[x] != (i, p)}
    removed = {(x.doc_id, p) for x in line_dedup.query(spark, SF).collect() for p in x.removed}
    assert copies and copies <= removed


@pytest.mark.parametrize("html", [
    "<html><head><title>t</title><meta charset=x><body><p>some text</p></body></html>",
    "<head><title>t</title>\n<p>some text</p>",
    "<head><title>t</title>\nsome text",
    "<head><noscript><link href=x><body>some text",
    "<head><title>t</title></head><body><svg/><p>some text</p>",
    "<body><svg><title/></svg><p>some text</p><svg><g><title>a</svg>",
    "<head><script>var a = '<p>no</p>';</script><style>p {}</style></head><p>some text</p>",
])
def test_html_heads_and_drawings_end(html):
    assert "".join(t for _, _, t in html_extraction.Tree(html).parts).strip() == "some text"


def test_html_features_have_no_limits():
    html = "<body><div>" + "<p>a</p><b>b</b>" * 150 + "</div><p>" + "7" * 250 + "</p><a><b><i><b><i><b>deep</b></i></b></i></b></a>"
    tree = html_extraction.Tree(html)
    x = dict(zip(html_extraction.PLAIN, html_extraction.features(tree).T))
    at = {"".join(n.text): k for k, n in enumerate(tree.nodes)}
    assert x["same_tag"][at["a"]] == x["same_tag"][at["b"]] == 0.5
    assert x["digits"][at["7" * 250]] == 250
    assert x["link_chars"][at["deep"]] == 4


def test_url_filter_knows_corpus_counts_and_a_lexicon(spark):
    names = spark.createDataFrame([("freeshop",), ("example",)], "run string")
    counts = [("freeshop", 5), ("ex", 500), ("ample", 500), ("free", 1), ("shop", 1)]
    got = {x.run: x.words for x in url_filter.segments(names, spark.createDataFrame(counts, "word string, c long")).collect()}
    assert got == {"freeshop": ["freeshop"], "example": ["ex", "ample"]}
    urls = [(1, "http://best-poker.xyz/"), (2, "http://garden.xyz/"), (3, "http://tea.xyz/"), (4, "http://casino.xyz/")]
    letters = spark.createDataFrame([(c, 1000) for c in "abcdefghijklmnopqrstuvwxyz"], "word string, c long")
    df = spark.createDataFrame(urls, "page_id long, url string")
    assert {x.page_id: x.verdict for x in url_filter.judge(df, letters.union(spark.createDataFrame([("best", 10**6), ("xyz", 10**6)], letters.schema))).collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block"}
    assert url_filter.judge(df, letters.limit(0)).count() == 4
