"""Each operator against a brute-force version and on edge rows."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohort_spark.llm import bpe, chat_format, decontamination, html_extraction, line_dedup, lm_scoring, ngram_join, quality_rules, token_counts, url_filter
from cohort_spark.llm.common import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
EDGE = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, LONG * 400, "en", "s", 1), (5, LONG * 400, None, "s", 1), (5, LONG * 400, None, "s", 1), (6, "one two", "xx", None, 7), (6, "one two", "xx", None, 7)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def brute_groups(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_ngram_join(spark, edge, empty):
    r = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    base = [[r.choice(words) for _ in range(r.randrange(3, 120))] for _ in range(6)]
    rows = []
    for i in range(90):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w), "en", "s", 0))
    df = spark.createDataFrame(rows, DOCS)
    expected = brute_groups(rows)
    for hot in (16, 3):  # 3: most keys are hot
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.groups(df, hot=hot).collect()} == expected
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.groups(edge).collect()} == brute_groups(EDGE)
    assert ngram_join.groups(empty).count() == 0
    assert sorted(x.doc_id for x in ngram_join.stage(spark, edge, SF).collect()) == [1, 2, 3, 4, 6]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, edge, empty):
    r = random.Random(3)

    def change(t, n):
        t = list(t)
        for _ in range(n):
            p = r.randrange(len(t))
            t[p : p + r.randrange(2)] = r.choice(["", "x", "é"])
        return "".join(t)

    base = ["".join(r.choice("abcdefg ") for _ in range(r.randrange(16, 40))) for _ in range(25)]
    docs = [(i, "\n".join(change(r.choice(base), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(6)))) for i in range(60)]
    lines = sorted((i, p, x) for i, t in docs for p, x in enumerate(t.split("\n")) if len(x.strip(" \t\n\r\x0b\x0c")) >= 20)
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))
    late = {x for x in first if any(first[y] < first[x] and edits(x, y) <= 2 for y in first)}
    expected = {(i, p) for i, p, x in lines if x in late or first[x] != (i, p)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for hot in (64, 2):
        assert {(x.doc_id, x.pos) for x in line_dedup.late_lines(df, hot=hot).collect()} == expected
    out = line_dedup.dedup(edge.withColumn("removed_by", F.lit(1)))
    assert out.count() == len(EDGE) and "removed_by" in out.columns
    assert line_dedup.dedup(empty).count() == 0
    texts = {x.doc_id: x.text for x in line_dedup.dedup(df).collect()}
    for i, t in docs:
        assert texts[i] == "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in expected)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(spark, threshold):
    r = random.Random(4)
    pairs = []
    for _ in range(300):
        a = "".join(r.choice("abé") for _ in range(r.randrange(25)))
        b = "".join(r.choice(["", c, c, c, c + "a"]) for c in a)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.near(F.col("a"), F.col("b"), threshold).alias("n"))
    assert all(x.n == (edits(x.a, x.b) <= threshold) for x in df.collect())


def test_tiling_matches_exhaustive_search():
    import numpy as np

    def exhaustive(item, doc, least):
        a, b, tiles = set(), set(), []
        while True:
            best = None
            for p in range(len(item)):
                for d in range(len(doc)):
                    n = 0
                    while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and p + n not in a and d + n not in b:
                        n += 1
                    if n >= least and (best is None or (-n, p, d) < best):
                        best = (-n, p, d)
            if best is None:
                return sorted(tiles)
            n, p, d = best
            a |= set(range(p, p - n))
            b |= set(range(d, d - n))
            tiles.append(-n)

    r = random.Random(5)
    for _ in range(60):
        item, doc = ([r.randrange(5) for _ in range(r.randrange(1, n))] for n in (20, 30))
        assert sorted(t[2] for t in decontamination.tile(np.array(item, np.uint64), np.array(doc, np.uint64), 3)) == exhaustive(item, doc, 3)


def test_decontamination(spark, edge, empty):
    item = "what is the capital city of the large country in the north"
    half = item.split()
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "the of"), (4, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"intro {item} outro"), (2, " ".join(half[6:] + ["x"] + half[:6])), (3, "nothing of the kind here at all"), (4, None)], "doc_id long, text string")
    got = {(x.doc_id, l.item_id) for x in decontamination.flag(docs, bench).collect() for l in x.leaks}
    assert got == {(1, 1), (2, 1), (1, 4), (2, 4)}
    assert decontamination.flag(edge, bench).count() == len(EDGE)
    assert decontamination.flag(empty, bench).count() == 0 and decontamination.flag(docs, bench.limit(0)).count() == 4


def test_bpe_equals_library(spark, edge, empty):
    from tokenizers import Tokenizer

    ref, codec = Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())
    r = random.Random(6)
    texts = ["", "  ", "a  b\n\n c", "<|endoftext|>x<|endoftext|>", "don't 1234 ünïcödé 中文 🎉"] + ["".join(chr(r.choice([32, 10, 39, 97, 98, 65, 49, 0xE9, 0x4E2D, 0x1F600, 0x85, 0x3000])) for _ in range(40)) for _ in range(300)]
    for t in texts:
        ids = codec.encode(t)
        assert ids == ref.encode(t, add_special_tokens=False).ids and codec.decode(ids) == t
    out = bpe.decode(bpe.encode(edge), into="back").collect()
    assert all(x.back == (x.text or "") for x in out) and bpe.encode(empty).count() == 0
    one = bpe.digests(edge).where("doc_id = 1").first()
    assert (one.n_tokens, one.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_token_counts(spark, edge, empty):
    codec = bpe.Codec(bpe.default_path())
    n = sorted(len(codec.encode(t)) for _, t, *_ in EDGE)
    sums = token_counts.suffix_sums(token_counts.histogram(edge))
    assert {x.n_tokens: (x.n_docs, x.docs_longer, x.truncated_total) for x in sums.collect()} == {k: (n.count(k), sum(x > k for x in n), sum(min(x, k) for x in n)) for k in set(n)}
    assert {x.limit: x.kept_tokens for x in token_counts.truncated(sums, [0, 3, 10**6]).collect()} == {k: sum(min(x, k) for x in n) for k in (0, 3, 10**6)}
    assert token_counts.quantiles(sums, [0.5]).first().n_tokens == n[-(-len(n) // 2) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(empty)).count() == 0


def test_quality_rules(spark, sample, edge, empty):
    out = quality_rules.judge(quality_rules.measure(edge), quality_rules.fit_cutoffs(quality_rules.measure(sample), spark.read.parquet(f"{SF}/labels.parquet")))
    got = {x.doc_id: (x.n_words, x.base_failed, x.kept) for x in out.collect()}
    assert got[1] == got[2] == got[3] == (0, True, False) and got[4][:2] == (4000, True)
    measured = quality_rules.measure(empty)
    assert quality_rules.judge(measured, quality_rules.fit_cutoffs(measured, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_repeat_words(spark):
    r = random.Random(7)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(30))) for _ in range(80)]

    def brute(t):
        w = t.split()
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        return len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)})

    got = quality_rules.measure(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_repeat_words for x in got} == {i: brute(t) for i, t in enumerate(texts)}


def test_false_rejection_is_bounded(spark):
    from math import comb

    def cdf(k, n, p):
        return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    for n, a, d in ((50, 0.05, 0.05), (500, 0.02, 0.01), (1200, 0.01, 0.1)):
        k = spark.range(1).select(quality_rules.most_rejected(F.lit(n).cast("long"), a, F.lit(d)).alias("k")).first().k
        assert (k < 0 or cdf(k, n, a) <= d) and cdf(k + 1, n, a) > d


def test_chat_round_trip(spark):
    r = random.Random(8)
    bits = [*chat_format.CONTROL, "\\", "<", "[", "s>", "a", "\n", ""]
    for _ in range(2000):
        turns = [(r.choice(["user", "assistant", "system", "tool", "", "[ROLE]"]), "".join(r.choice(bits) for _ in range(r.randrange(6)))) for _ in range(r.randrange(5))]
        text, mask = chat_format.render(turns)
        assert chat_format.parse(text) == turns
        assert [chat_format.unescape(text[a : a + n]) for a, n in mask] == [t for x, t in turns if x == "assistant"]
    raw = [('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', "messages"), ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"extra":1}', "conversations"),
           ('{"instruction":"q","output":"a"}', "instruction"), ('{"prompt":"q","completion":"a"}', "completion"), ('{"data":{"question":"q","answer":"a"}}', "nested_question"), ('{"foo":1}', None), ("[1]", None), ("not json", None), (None, None)]
    got = chat_format.format_records(spark.createDataFrame(raw, "record string, want string")).collect()
    for x in got:
        assert x.layout == x.want
        assert chat_format.parse(x.formatted) == ([("user", "q"), ("assistant", "a")] if x.want else [])
    turns = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", None), (2, None, "user", "x")], "conv_id long, turn long, role string, text string")
    assert {x.conv_id: x.n_turns for x in chat_format.digest(chat_format.format_records(chat_format.records_of(turns))).collect()} == {1: 2, 2: 1}


def test_html_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extraction.train(pages)
    body = "It was a long day, and nobody knew what would come next. The road went on and on. " * 4
    html = [(1, f"<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>{body}<p>x\n y {body}</article><footer>f</footer></body></html>"), (2, None), (3, ""), (4, "plain &lt; text"),
            (5, f'<body><div class="menu"><a href=x>Home</a></div><div id="content"><p>{body}</p><div class="comments"><p>Nice.</p></div></div><script>var a="<p>no</p>";</script>')]
    got = {x.page_id: x.text for x in html_extraction.extract(spark.createDataFrame(html, "page_id long, html string"), model).collect()}
    assert got[1] == f"A & B\n\n{body.strip()}\n\nx y {body.strip()}" and got[2] == got[3] == "" and got[4] == "plain < text"
    assert got[5] == body.strip()
    assert html_extraction.extract(pages.limit(0), model).count() == 0


def test_url_filter(spark):
    urls = [(1, "HTTP://WWW.Example.com/en/x?q#f"), (2, "http://a.example.com/en/"), (3, "https://b.net/es/1"), (4, "http://c.net/de/"), (5, None), (6, "nothing"), (7, "x://cheappills.org/en/1"), (8, "http://xcom/"), (9, "http://c.net/de/")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    counts = spark.createDataFrame([("cheap", 50), ("pills", 40), ("net", 10)], "word string, c long")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge(df, counts).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("net/es/", "block")
    assert got[4][2] is None and got[5][:3] == ("", "", None) and got[6][:3] == ("", "", None) and got[7][3] == "block" and got[8][2] is None
    assert url_filter.judge(df.limit(0), counts).count() == 0
    assert url_filter.segment("cheappills", {"cheap": 5, "pills": 5}, 100) == ["cheap", "pills"]


def test_lm_scores(spark, sample, edge, empty):
    import math
    import zlib

    rows = sample.select("doc_id", "text").collect()
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for head in (500_000, 10):
        for x in lm_scoring.score(sample, head=head).collect():
            ws = tokens[x.doc_id]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
            assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
            assert x.score < 0
    assert lm_scoring.score(edge).count() == len(EDGE) and lm_scoring.score(empty).count() == 0
