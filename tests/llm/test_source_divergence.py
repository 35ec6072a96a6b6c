"""The audit against plain counting with whole numbers; edge rows; texts of several segments."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from cohort_spark.llm import common
from cohort_spark.llm import source_divergence as sd

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def brute(docs, least, top):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        count[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(counts):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (size + 5 * len(kept)) for t in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        by = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(by[s][t] - by[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(by[s][t] - whole[t], t) for t in kept if count[lang, s][t] > 0 and by[s][t] > whole[t]]
            for part, rows, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out |= {(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)}
    return out


def rows_of(spark, docs):
    return spark.createDataFrame([(t, g, s, 1, "x", 2) for t, g, s in docs], "text string, lang string, source string, value int, item string, rank int")


def made_up(seed):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzéß"] + ["Ä", "ä", "ZZ", "zz", "日本", "\U0001d518", "｡x"]
    docs = [(" 1".join(rng.choices(words, k=rng.choice([0, 2, 20]))), rng.choice(["en", "de", "xx"]), rng.choice(["s1", "s2", "s3", "é"])) for _ in range(200)]
    return [*docs, (None, None, None), (None, "en", "quiet"), ("alone alone", "one", "only"), ("ax", "de", None), docs[0], docs[0], ("ax " * 3000, "en", "s1")]


def test_against_plain_counting(spark):
    docs = made_up(1)
    for least, top in ((1, 5), (4, 50), (10_000, 3)):
        got = sd.audit(rows_of(spark, docs).repartition(3), least_docs=least, top=top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert {tuple(r) for r in got.collect()} == brute(docs, least, top)


def test_ties_fill_the_last_rank_in_byte_order(spark):
    docs = [(" ".join(chr(c) for c in range(0x4E00, 0x4E00 + 90)), "en", "a"), ("｡ \U0001d518 b", "en", "a"), ("other", "en", "b")]
    got = {tuple(r) for r in sd.audit(rows_of(spark, docs), least_docs=1).collect()}
    assert got == brute(docs, 1, 50)


def test_empty_table(spark):
    assert sd.audit(rows_of(spark, []).where("false")).collect() == []


def test_handing_on_often_changes_nothing(monkeypatch):
    import pyarrow as pa

    docs = [((t or ""), g or "", s or "") for t, g, s in made_up(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*docs)], names=["text", "lang", "source"])

    def counted():
        out = Counter(), Counter()
        for b in sd._count(iter([batch, batch])):
            for lang, source, term, n, held in zip(*[c.to_pylist() for c in b.columns]):
                out[0][lang, source, term] += n
                out[1][lang, source, term] += held
        return out

    whole = counted()
    monkeypatch.setattr(sd, "ENTRIES", 3)
    assert counted() == whole


def test_segments_never_cut_a_term(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice("aB é1-  ") for _ in range(rng.randrange(60))).encode()
        whole = re.findall(rb"[a-z\x80-\xff]+", text.lower())
        monkeypatch.setattr(common, "SEGMENT", rng.choice([1, 3, 7, 100]))
        assert [t for part in common.segments(np.frombuffer(text, np.uint8), rb"[a-z\x80-\xff]+") for t in part] == whole
