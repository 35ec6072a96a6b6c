"""Trees, decoding and extraction of main text against brute force and the pages' article elements."""

import itertools
import random

import numpy as np
import pytest

from cohort_spark.llm import html_extraction as hx

from .test_operators import SF


def test_decoding_is_the_best_assignment():
    r = random.Random(51)
    for _ in range(60):
        html, depth = "<body>", 0
        for _ in range(r.randrange(1, 6)):
            html += f"<div>{'x' * r.randrange(9)}" if r.random() < 0.6 else "</div>"
        tree = hx.Tree(html)
        odds = np.array([r.uniform(-3, 3) for _ in tree.nodes])
        weight = np.array([0.01 + len("".join(x.text).strip()) for x in tree.nodes])

        def total(states):
            return sum((o if s == 1 else -o) * w for s, o, w in zip(states, odds, weight))

        allowed = [s for s in itertools.product(range(3), repeat=len(odds)) if all(x.parent is None or s[k] >= s[x.parent.index] for k, x in enumerate(tree.nodes))]
        main = hx.decode(tree, odds)
        best = max(map(total, allowed))
        # The states that explain the decoded answer best reach the best total.
        assert max(total(s) for s in allowed if [x == 1 for x in s] == list(main)) == pytest.approx(best)


def test_trees_learn_an_interaction():
    r = np.random.default_rng(52)
    x = r.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = hx.Trees().fit(x[:2000], y[:2000])
    assert ((model.odds(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97


def article_text(html):
    tree = hx.Tree(html)
    inside = np.zeros(len(tree.nodes), bool)
    for k, x in enumerate(tree.nodes):
        inside[k] = x.tag == "article" or x.parent is not None and inside[x.parent.index]
    return hx.text_of(tree, inside)


@pytest.fixture(scope="module")
def model(spark):
    return hx.train(spark.read.parquet(f"{SF}/pages.parquet"))


def test_articles_of_the_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = hx.extract(pages, model, into="main").collect()
    same = [x.main == article_text(x.html) for x in got]
    assert np.mean(same) > 0.98

    def renamed(h):  # pages without the element, under names that the labels never saw
        return h.replace("<article>", '<div class="k7 wrapper">').replace("</article>", "</div>")

    other = spark.createDataFrame([(x.page_id, renamed(x.html), article_text(x.html)) for x in got], "page_id long, html string, want string")
    hits = [len(set(x.text.split()) & set(x.want.split())) >= 0.95 * len(set(x.want.split())) for x in hx.extract(other, model).collect() if x.want]
    assert np.mean(hits) > 0.9


def test_blocks_inside_articles_and_open_elements(spark, model):
    body = "<p>" + "The road went on and on, and nobody knew what would come next. " * 5 + "</p>"
    plain = body[3:-4].strip()
    kinds = {w: f'<article>{body}<div class="{w}"><p>Nice, thanks for all this.</p></div></article>' for w in ("comments", "newsletter", "share", "advertisement")}
    opened = {"iframe": f"<article><iframe src=x>{body}</article>", "textarea": f"<article><textarea>{body}</article>", "noscript": f"<article><noscript>{body}</article>", "svg": f"<article><svg/>{body}</article>",
              "script": f"<article>{body}<script>var x = 1;</article>"}
    rows = [(k, f"<html><body><nav><a href=x>Home</a></nav>{h}<footer>f</footer></body></html>") for k, h in (kinds | opened).items()]
    got = {x.name: x.text for x in hx.extract(spark.createDataFrame(rows, "name string, html string"), model).collect()}
    assert got == {k: plain for k in got}


def test_bounds_and_pages_without_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert len(hx.train(pages, most=500).trees) == hx.TREES
    none = hx.train(spark.createDataFrame([("<p>a</p>",), (None,)], "html string"))
    assert none.trees == [] and hx.extract(pages.limit(1), none).count() == 1
