"""Byte-level BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so a text may be
cut there before any merge is tried: the fragments are encoded on their own and their ids concatenated. Inside
the pieces that the vocabulary's splitting pattern makes, a table of 65,536 flags marks those pairs. Equal
pieces and fragments repeat constantly, so each worker keeps a bounded table of what it has encoded. Very long
fragments (a megabyte of one letter, say) are merged by a heap, in time that grows with n log n.

Texts are taken from a batch one at a time and their ids go straight into the batch's result, so a worker holds the batch,
its ids and the bounded table.

Special tokens written in a text become their own id, as the tokenizers library does by default.
Null texts count as empty; empty texts have no ids. Rows are handled one by one: repeated rows give repeated
results, an empty table an empty one, and all columns of the input are kept (``encode`` and ``decode`` replace
a column of the name they are given for their result).
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read

#: Fixed: the splitting pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, and fragments of cut pieces, that a worker remembers, and as many older ones (some 50 MB in all); beyond it the
#: older ones that didn't occur again are forgotten, which costs time, not results.
REMEMBERED = 100_000
#: Bytes of a fragment, and characters of a piece, beyond which they are merged by a heap and not remembered.
LONG = 256
NONE = 1 << 40


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the vocabulary file: itself where it is visible."""
    visible = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Codec:
    """A vocabulary: encodes a text to a list of ids and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.first = [vocab[s] for s in symbols]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        steps = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(steps)}.get
        self.merged = [c for _, _, c in steps]
        inside = np.zeros((256, 256), bool)
        for t in vocab:
            b = np.frombuffer(self.bytes_of[vocab[t]], np.uint8)
            inside[b[:-1], b[1:]] = True
        self.inside = [row.tobytes() for row in inside]
        self.split = regex.compile(PATTERN).finditer
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def fragment(self, data: bytes) -> tuple[int, ...]:
        """Ids of a fragment: the merge of lowest rank first, the leftmost of equals."""
        if len(data) > LONG:
            return self.long_fragment(data)
        ids, rank = [self.first[b] for b in data], self.rank
        ranks = [rank(pair, NONE) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            ids[at : at + 2] = [self.merged[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), NONE)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), NONE)
        return tuple(ids)

    def long_fragment(self, data: bytes) -> tuple[int, ...]:
        """The same by a heap of (rank, place) over linked places, so that time grows with n log n."""
        n, rank = len(data), self.rank
        ids = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank((ids[k], ids[k + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right == n or rank((ids[k], ids[right]), NONE) != r:
                continue  # a merge has changed this pair since
            ids[k], ids[right] = self.merged[r], -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if (r := rank((ids[k], ids[after[k]]), NONE)) != NONE:
                    heapq.heappush(heap, (r, k))
            if before[k] >= 0 and (r := rank((ids[before[k]], ids[k]), NONE)) != NONE:
                heapq.heappush(heap, (r, before[k]))
        return tuple(i for i in ids if i >= 0)

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of a piece of the splitting pattern: of its fragments between forced boundaries."""
        data, inside, start, ids = text.encode("utf-8", "surrogatepass"), self.inside, 0, []
        for at in range(1, len(data) + 1):
            if at == len(data) or not inside[data[at - 1]][data[at]]:
                if at - start == len(data):
                    return self.fragment(data)  # uncut: remembered as a piece
                part = data[start:at]
                if (known := self.fragments.get(part)) is None:
                    known = self.fragment(part)
                    if len(part) <= LONG:
                        if len(self.fragments) >= REMEMBERED:
                            self.fragments.clear()
                        self.fragments[part] = known
                ids += known
                start = at
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for k, plain in enumerate(self.split_special(text or "")):
            if k % 2:
                ids.append(self.special[plain])
                continue
            pieces, older = self.pieces, self.older
            for match in self.split(plain):
                p = match.group()
                known = pieces.get(p)
                if known is None:
                    known = older.get(p) or self.piece(p)
                    if len(p) <= LONG:
                        if len(pieces) >= REMEMBERED:
                            pieces, older = self.pieces, self.older = {}, pieces
                        pieces[p] = known
                ids += known
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def listed(self, ids) -> str:
        return ",".join(map(self.text_of.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each worker process and path."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` as an array of ints."""
    path = path or default_path()

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c, values, ends = codec(path), array("i"), [0]
        for t in texts:
            values.extend(c.encode(t.as_py()))
            ends.append(len(values))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32)))

    return docs.withColumn(into, ids(F.col(text)))


def decode(rows: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with the text of ``ids``; null ids give an empty text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode(x) if x is not None else "" for x in column], dtype=object)

    return rows.withColumn(into, text(F.col(ids)))


def lengths(docs: DataFrame, text: str = "text", into: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``docs`` with the number of ids of ``text``."""
    path = path or default_path()

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([len(c.encode(t.as_py())) for t in texts], pa.int64())

    return docs.withColumn(into, count(F.col(text)))


def digests(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256: the ids are made, decoded again and hashed in
    one pass, so that neither ids nor texts leave the worker."""
    path = path or default_path()

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(texts: pa.Array) -> pa.Array:
        c, out = codec(path), ([], [], [])
        for t in texts:
            ids = c.encode(t.as_py())
            out[0].append(len(ids))
            out[1].append(hashlib.sha256(c.listed(ids).encode()).hexdigest())
            out[2].append(hashlib.sha256(c.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
        kinds = zip(out, (pa.int64(), pa.string(), pa.string()))
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in kinds], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.withColumn("_bpe", both(F.col(text))).withColumns({c: F.col(f"_bpe.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_bpe")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every document as ids."""
    return encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
