"""What workers hold is bounded, and the bounds change no result."""

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from cohort_spark.llm import bpe, ngram_join


def test_forgotten_pieces_are_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    path = bpe.default_path()
    codec, ref = bpe.Codec(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    words = ["the", " the", "naïve", "—dash—", "x1y2", "\n\n", " a\tb", "日本語", "unbelievably", "##"]
    for _ in range(200):
        text = "".join(rng.choice(words, rng.integers(0, 12)))
        assert codec.encode(text) == ref.encode(text, add_special_tokens=False).ids
        assert len(codec.pieces) <= 3 and len(codec.older) <= 3  # inside one text, too


def test_sketch_batches_are_bounded_and_whole(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in (0, 3, 30, 200, 200, 1000, 5)] * 2
    batch = pd.DataFrame({"doc_id": range(len(texts)), "text": [*texts[:-1], None]})

    def rows():
        return list(ngram_join._sketches(80, 5, "text")(iter([batch])))

    whole = rows()
    monkeypatch.setattr(ngram_join, "YIELD", 50)
    split = rows()
    assert len(whole) == 1 and len(split) > 3
    order = ["key", "ref", "info"]
    assert (pd.concat(split).sort_values(order).to_numpy() == whole[0].sort_values(order).to_numpy()).all()


def test_no_documents_give_no_rows():
    empty = pd.DataFrame({"doc_id": pd.Series([], dtype="int64"), "text": pd.Series([], dtype=object)})
    assert not sum(map(len, ngram_join._sketches(80, 5, "text")(iter([empty]))))
