"""The pipeline's stages against brute-force versions of each, one after the other."""

import corpus_pipeline
import duckdb
from tokenizers import Tokenizer

from cohort_spark.llm import bpe, decontamination, quality_rules
from tests.llm.test_operators import SF, brute_groups
from tests.oracle import duck


def near(a, b, most=2):
    """Whether the edit distance is at most ``most``, over the band that matters."""
    if abs(len(a) - len(b)) > most:
        return False
    row = {j: j for j in range(most + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, 99) + 1
            if j:
                best = min(best, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (x != b[j - 1]))
            new[j] = best
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), 99) <= most


def test_stages(spark):
    tables = duck(SF)
    docs = {i: t for i, t in tables.execute("SELECT doc_id, text FROM documents").fetchall()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "bpe"]

    def run(name):
        out = corpus_pipeline.cut(stages[name](spark, frame, SF))
        assert name == "bpe" or out.columns == columns
        return out

    frame = run("quality_rules")
    kept = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM ({quality_rules.SQL}) WHERE kept", connection=tables).fetchall()}
    docs = {i: t for i, t in docs.items() if i in kept}
    assert {r.doc_id: r.text for r in frame.collect()} == docs

    frame = run("line_dedup")
    lines = sorted((i, p, x) for i, t in docs.items() for p, x in enumerate(t.split("\n")) if len(x.strip(" \t\n\r\x0b\x0c")) >= 20)
    first = {}
    for i, p, x in lines:
        first.setdefault(x, (i, p))
    by_length = {}
    for x in first:
        by_length.setdefault(len(x), []).append(x)
    late = {x for x in first if any(first[y] < first[x] and near(x, y) for n in range(len(x) - 2, len(x) + 3) for y in by_length.get(n, ()))}
    gone = {(i, p) for i, p, x in lines if x in late or first[x] != (i, p)}
    docs = {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in frame.collect()}
    assert gone and got == {i: (t, len(t)) for i, t in docs.items()}

    frame = run("ngram_jaccard")
    docs = {i: docs[i] for i, (_, c) in brute_groups(list(docs.items())).items() if c == i}
    assert {r.doc_id for r in frame.collect()} == set(docs)

    frame = run("decontamination")
    items = [x for x in (decontamination.tokens(t) for _, t in tables.execute("SELECT item_id, text FROM benchmark").fetchall()) if len(x) >= 5]
    words = {i: decontamination.tokens(t) for i, t in docs.items()}
    clean = {i for i, w in words.items() if not any(2 * sum(t[2] for t in decontamination.tile(x, w)) >= len(x) for x in items)}
    docs = {i: docs[i] for i in clean}
    assert {r.doc_id for r in frame.collect()} == set(docs)

    frame = run("bpe")
    ref = Tokenizer.from_file(bpe.default_path())
    assert {r.doc_id: list(r.ids) for r in frame.collect()} == {i: ref.encode(t, add_special_tokens=False).ids for i, t in docs.items()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids"]
