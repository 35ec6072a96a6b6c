"""Exact n-gram Jaccard join by parity sketches, and the groups that its links form.

A document is its set of distinct 5-word shingles. Sets of sizes a and b reach similarity s only if they differ
in at most D = (1 - s) / (1 + s) * (a + b) shingles. Per band of sizes, shingles are dealt by hash into K > D
segments and each segment's shingles are XOR-hashed into one 64-bit parity word: words of a segment differ only
if the sets differ there, so the number of differing words bounds the difference from below, and two sets that
may be similar agree on K - D segments at least (pigeonhole). Joining on (band, segment, word) therefore
finds every pair; pairs are then verified on the whole sets.

The Hamming bound is also the filter: a pair that agrees on fewer than K - D segments is dropped unverified.

Hot keys. Many sets may share a segment (a passage that a third of all documents quote, a group of near copies,
segments without shingles). A set can do without as many of its matching segments as K exceeds D + 1, so
empty segments give no key, and the keys of hot groups are given up wherever that allowance covers them; the
bound then asks for as many matches less. The sets whose allowance is used up ("saturated") meet on their rarest
shingles instead: a similar pair shares one of the first n - ceil(s * n) + 1 of each, in ascending order of
frequency. Only a set four fifths made of what many others hold has frequent ones among these; for groups of
such sets each is compared with the group's smallest, and then members of different components with each other.
Nothing is capped: every pair that could be similar is verified, or its two ends are already connected.

Cost. Sets are found by one pass over the texts; what is shuffled is about half a key for each shingle. Equal
sets are one class from the start: each task emits the keys of a class once. Verification reads texts again,
of candidate classes only, first for one partner of each class, then for pairs not yet connected.

Defined results: null and empty texts, and texts of white space, have an empty set and link with nothing (a
component of their own); texts of fewer than five words are one shingle; repeated rows and ties fall into the
same class; rows with a null id are left out of ``groups`` and ``links`` (``stage`` keeps them); a class is told by a 64-bit hash of its set together with its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, mix, read, shingle_set

WIDTH = 5
#: Similarity in hundredths.
PERCENT = 80
#: Distinct sets of one key from which on it is hot.
HOT = 16
#: Ids of candidates that are broadcast at most (8 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Sets of a unit of the last pass, on average at most.
UNIT = 256
#: Rows of a batch of sketch keys, from which on it is handed over: a batch of texts gives some hundred keys a text.
YIELD = 1 << 17
_BAND_STEP = 1.6
_PACK = 1 << 32


def bands(percent: int, up_to: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, largest difference D and number of segments K of each band of sizes."""
    least = [1]
    while least[-1] < up_to:
        least.append(max(least[-1] + 4, int(least[-1] * _BAND_STEP)))
    first = np.array(least, np.int64)
    diff = (100 - percent) * 2 * (first[1:] - 1) // (100 + percent)
    return first, diff, diff + 2 + diff // 5


def class_hash(shingles: np.ndarray) -> int:
    return int(mix(np.bitwise_xor.reduce(mix(shingles), keepdims=True) + np.uint64(len(shingles))).view(np.int64)[0])


def sketch_keys(shingles: np.ndarray, band: int, segments: int) -> np.ndarray:
    """One key for each segment with shingles. ``shingles`` is sorted, and so are their segments."""
    at = ((shingles >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    parity = np.bitwise_xor.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return mix(parity ^ mix(at[starts] * np.uint64(64) + np.uint64(band)))


def empty_keys(shingles: np.ndarray, band: int, segments: int) -> np.ndarray:
    at = np.unique(((shingles >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32))
    return mix(mix(np.setdiff1d(np.arange(segments, dtype=np.uint64), at) * np.uint64(64) + np.uint64(band)))


def _sketches(percent: int, width: int, text: str):
    first, diff, count = bands(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(key, ref, info): of documents (doc_id, class hash, -1 - set size), and of sketch keys
        (key, class hash, size + allowance * 2**32 + band * 2**56)."""
        seen: set[int] = set()

        def frame() -> pd.DataFrame:
            parts = [tuple(np.array(c, np.int64) for c in own), *out]
            return pd.DataFrame({c: np.concatenate([p[k] for p in parts]) for k, c in enumerate(("key", "ref", "info"))})

        for batch in batches:
            out, own, rows = [], ([], [], []), 0
            for doc, content in zip(batch["doc_id"], batch[text]):
                shingles = shingle_set(content, width)
                n = len(shingles)
                ref = class_hash(shingles) if n else 0
                if rows >= YIELD:
                    yield frame()
                    out, own, rows = [], ([], [], []), 0
                for column, value in zip(own, (doc, ref, -1 - n)):
                    column.append(value)
                rows += 1
                if not n or ref in seen:
                    continue
                if len(seen) > 1_000_000:  # forgetting costs repeated keys, nothing else
                    seen.clear()
                seen.add(ref)
                home = int(np.searchsorted(first, n, "right")) - 1
                # Also in the next band if a set of its smallest size could be a partner.
                for b in (home, home + 1) if 100 * n >= percent * int(first[home + 1]) else (home,):
                    if diff[b] == 0:
                        continue  # only equal sets link there
                    keys = sketch_keys(shingles, b, int(count[b]))
                    spare = int(count[b] - diff[b]) - 1 - (int(count[b]) - len(keys))
                    if spare < 0:  # the matching segments may all be empty: these count as keys too
                        keys = np.concatenate([keys, empty_keys(shingles, b, int(count[b]))])
                        spare = int(count[b] - diff[b]) - 1
                    out.append((keys.view(np.int64), np.full(len(keys), ref), np.full(len(keys), n + min(spare, 1 << 20) * _PACK + (b << 56))))
                    rows += len(keys)
            yield frame()

    return run


FOUND = "kind string, a long, b long, c long, band int, sa int, sb int"


def _pairs(percent: int, hot: int):
    def frame(kind: str, a, b, c, ia, ib) -> pd.DataFrame:
        return pd.DataFrame({"kind": kind, "a": a, "b": b, "c": c, "band": (ia >> 56).astype(np.int32),
                             "sa": ((ia >> 32) & 0xFFFFFF).astype(np.int32), "sb": ((ib >> 32) & 0xFFFFFF).astype(np.int32)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Over rows sorted by key and class: documents as they are ('d': id, class, size), pairs that a key of
        few classes gives ('p': class, class) and the members of hot keys ('h': key, class, size); band, sa and
        sb are the key's band and the allowances of the two classes."""
        tail = np.empty((3, 0), np.int64)  # the last key's rows so far, fewer than ``hot``
        hot_key = None

        def told(rows: np.ndarray, last: bool) -> Iterator[pd.DataFrame]:
            nonlocal tail, hot_key
            k, r, i = rows
            new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]  # a class comes once for each task that saw it
            k, r, i = rows[:, new]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            is_hot = (sizes >= hot) | ((k[starts] == hot_key) if hot_key is not None else False)
            done = np.ones(len(starts), bool)
            if not last:
                done[-1] = is_hot[-1]  # more of it may come
                hot_key = k[-1] if is_hot[-1] else None
                tail = np.empty((3, 0), np.int64) if is_hot[-1] else np.stack([k, r, i])[:, starts[-1] :]
            many = np.repeat(is_hot, sizes)
            if many.any():
                yield frame("h", k[many], r[many], i[many] & (_PACK - 1), i[many], i[many])
            xs, ys = [], []
            for n in np.unique(sizes[done & ~is_hot]):
                if n > 1:
                    x, y = np.triu_indices(n, 1)
                    first = starts[done & ~is_hot & (sizes == n)][:, None]
                    xs.append((first + x).ravel())
                    ys.append((first + y).ravel())
            if xs:
                x, y = np.concatenate(xs), np.concatenate(ys)
                nx, ny = i[x] & (_PACK - 1), i[y] & (_PACK - 1)
                fit = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
                x, y = x[fit], y[fit]
                yield frame("p", r[x], r[y], np.ones(len(x), np.int64), i[x], i[y])

        for batch in batches:
            rows = np.stack([batch[c].to_numpy(np.int64) for c in ("key", "ref", "info")])
            docs = rows[2] < 0
            if docs.any():
                k, r, i = rows[:, docs]
                yield frame("d", k, r, -1 - i, np.zeros_like(k), np.zeros_like(k))
                rows = rows[:, ~docs]
            if rows.shape[1]:
                yield from told(np.concatenate([tail, rows], axis=1), False)
        if tail.shape[1]:
            yield from told(tail, True)

    return run


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, s): shingle sets of the documents that ``ids`` (doc_id) names."""
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["s"] = [shingle_set(t, width).view(np.int64) for t in batch["text"]]
            yield batch[["doc_id", "s"]]

    return wanted.mapInPandas(run, "doc_id long, s array<long>").dropDuplicates(["doc_id"])


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(key, ref, info): of each set (doc_id, s) the rarest shingles, of which similar sets share one, as rows for
    ``_pairs``; shingles of one set only are left out."""
    rows = sets.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("key"))
    rows = rows.join(rows.groupBy("key").agg(F.count("*").alias("df")), "key")
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "key")))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    return rows.where((F.col("at") <= first) & (F.col("df") > 1)).select("key", F.col("doc_id").alias("ref"), F.col("n").cast("long").alias("info"))


def _verify(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents that are similar enough, on their whole sets."""
    ends = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = cut(_sets(docs, ends, width))
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(batch["sa"], batch["sb"])], np.int64)
            total = batch["sa"].map(len).to_numpy(np.int64) + batch["sb"].map(len).to_numpy(np.int64) - common
            yield batch.loc[100 * common >= percent * total, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _joined(pairs: DataFrame, reached: DataFrame) -> DataFrame:
    """``pairs`` with the components ca and cb of their ends."""
    return (pairs.join(reached.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(reached.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}))


def _apart(frequent: DataFrame, reached: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) between members of one frequent key (key, doc) that lie in different components.

    Members are dealt into units of about UNIT: by their least frequent key, large components apart from the rest.
    Two units that share a key, unless both are of one component, meet as a block, and a block's common shingles are
    counted by products of incidence matrices. So what is shipped is sets by unit, not pairs of sets.
    """
    rows = cut(frequent.join(reached, frequent["doc"] == reached["node"], "left").select("key", "doc", F.coalesce("component", "doc").alias("c")))
    open_keys = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    rows = cut(rows.join(open_keys, "key", "left_semi"))
    docs = cut(rows.groupBy("doc", "c").agg(F.min("key").alias("home")))
    # Counted by aggregates that combine before their shuffles: a home may be the key of a third of all documents.
    sizes = cut(docs.groupBy("home", "c").agg(F.count("*").alias("n")).withColumn("uc", F.when(F.col("n") >= UNIT // 4, F.col("c"))))
    others = sizes.where("uc is null").groupBy("home").agg(F.sum("n").alias("others"))
    sizes = sizes.join(others, "home", "left").withColumn("chunks", F.ceil(F.when(F.col("uc").isNull(), F.col("others")).otherwise(F.col("n")) / UNIT))
    docs = docs.join(sizes, ["home", "c"])
    unit = F.xxhash64("home", F.coalesce("uc", F.lit(-1)), F.pmod(F.xxhash64("doc"), F.col("chunks")))
    docs = cut(docs.select("doc", "c", "uc", unit.alias("unit")))

    keys = rows.select("key", "doc").join(docs, "doc").select("key", "unit", "uc").distinct()
    x, y = keys.select("key", F.col("unit").alias("u"), F.col("uc").alias("x")), keys.select("key", F.col("unit").alias("v"), F.col("uc").alias("y"))
    blocks = cut(x.join(y, "key").where((F.col("u") <= F.col("v")) & ~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).select("u", "v").distinct())
    sides = (blocks.join(docs, blocks["u"] == docs["unit"]).select("u", "v", "doc", "c", F.lit(0).alias("side"))
             .union(blocks.where("u < v").join(docs, F.col("v") == docs["unit"]).select("u", "v", "doc", "c", F.lit(1).alias("side"))))

    def meet(block: pd.DataFrame) -> pd.DataFrame:
        n, own = len(block), block["side"].to_numpy()
        size = block["s"].map(len).to_numpy()
        _, column = np.unique(np.concatenate([np.asarray(s) for s in block["s"]]), return_inverse=True)
        doc = np.repeat(np.arange(n), size)
        common, width = np.zeros((n, n)), 4096
        order = np.argsort(column, kind="stable")
        column, doc = column[order], doc[order]
        for at in range(0, int(column[-1]) + 1, width):
            low, high = np.searchsorted(column, (at, at + width))
            there = np.zeros((n, width), np.float32)
            there[doc[low:high], column[low:high] - at] = 1
            common += there @ there.T
        close = np.triu(100 * common >= percent * (size[:, None] + size[None, :] - common), 1)
        if own.any():
            close &= own[:, None] != own[None, :]
        a, b = np.nonzero(close)
        ids, c = block["doc"].to_numpy(), block["c"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b], "x": np.minimum(c[a], c[b]), "y": np.maximum(c[a], c[b])}).query("x < y").drop_duplicates(["x", "y"])[["a", "b"]]

    return sides.join(sets.select(F.col("doc_id").alias("doc"), "s"), "doc").groupBy("u", "v").applyInPandas(meet, "a long, b long")


def classes_and_links(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class_id) of every document, and verified links (a, b) between classes.

    A class is the smallest id of the documents with that set. The links connect exactly what similarity
    connects; links between classes that others already connect may be absent, unless ``every`` asks for all.
    """
    # Rows without an id go before ids pass through Python, where a null would turn a batch's ids into doubles.
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = docs.mapInPandas(_sketches(percent, width, "text"), "key long, ref long, info long")
    found = cut(keys.repartition("key").sortWithinPartitions("key", "ref").mapInPandas(_pairs(percent, hot), FOUND))

    rows = found.where("kind = 'd'").select(F.col("a").alias("doc_id"), F.col("b").alias("ref"), F.col("c").alias("n_shingles"))
    least = cut(rows.where("n_shingles > 0").groupBy("ref", "n_shingles").agg(F.min("doc_id").alias("class_id")))
    members = rows.join(least, ["ref", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    of = least.select("ref", F.col("class_id").alias("id"), F.col("n_shingles").alias("n"))

    hots = found.where("kind = 'h'").select(F.col("a").alias("key"), F.col("b").alias("ref"), "band", F.col("sa").alias("spare"))
    used = cut(hots.groupBy("ref", "band").agg(F.count("*").alias("used"), F.max("spare").alias("spare")))

    # Matches by band; the pair's own band is among them. What hot keys took counts as matched.
    matched = found.where("kind = 'p'").groupBy("a", "b", "band").agg(F.sum("c").alias("c"), F.max("sa").alias("sa"), F.max("sb").alias("sb"))
    for x in ("a", "b"):
        took = used.select(F.col("ref").alias(x), "band", F.col("used").alias(f"u{x}"))
        matched = matched.where("c > 0").join(took, [x, "band"], "left")
    enough = [F.col("c") + F.coalesce(f"u{x}", F.lit(0)) > F.col(f"s{x}") for x in ("a", "b")]
    close = matched.where(enough[0] & enough[1]).select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()

    # Saturated sets meet on their rarest shingles.
    tired = cut(hots.join(used.where("used > spare").select("ref", "band"), ["ref", "band"], "left_semi").join(of, "ref").select(F.col("id").alias("doc_id"), "n").distinct())
    whole = cut(_sets(docs, tired.select("doc_id"), width))
    second = cut(_rarest(whole, percent).repartition("key").sortWithinPartitions("key", "ref").mapInPandas(_pairs(percent, hot), FOUND))
    frequent = cut(second.where("kind = 'h'").select(F.col("a").alias("key"), F.col("b").alias("doc")))
    star = frequent.join(frequent.groupBy("key").agg(F.min("doc").alias("low")), "key").where("low < doc").select(F.col("low").alias("a"), F.col("doc").alias("b"))

    pairs = close.join(of.select(F.col("ref").alias("x"), F.col("id").alias("i")), "x").join(of.select(F.col("ref").alias("y"), F.col("id").alias("j")), "y").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    pairs = pairs.union(second.where("kind = 'p'").select("a", "b"))
    if every:
        none = cut(components(docs.sparkSession.createDataFrame([], "a long, b long")))
        found = _verify(docs, cut(pairs.distinct()), width, percent).union(_apart(frequent, none, whole, percent))
        return members, found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = cut(pairs.union(star).distinct())

    # One partner of each class first: in a group of near copies that connects nearly all.
    tree = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = cut(_verify(docs, tree, width, percent))
    reached = cut(components(links))
    rest = cut(_joined(pairs.join(tree, ["a", "b"], "left_anti"), reached).where("ca <> cb").select("a", "b"))
    links = cut(links.union(_verify(docs, rest, width, percent)))
    return members, links.union(cut(_apart(frequent, cut(components(links)), whole, percent)))


def links(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class_id, n_links) of every document and all links (a, b) between classes.

    A class is one set; n_links counts the other classes that it links with. Every candidate pair is verified, so the
    result grows with the number of links: groups of m different similar texts have up to m * m / 2.
    """
    members, found = classes_and_links(docs, text, width, percent, hot, every=True)
    found = cut(found)
    counts = found.select(F.col("a").alias("_c")).union(found.select("b")).groupBy("_c").agg(F.count("*").alias("n_links"))
    out = members.join(counts, members["class_id"] == counts["_c"], "left").drop("_c")
    return out.withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long"))), found


def groups(docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) of every document."""
    members, links = classes_and_links(docs, text, width, percent, hot)
    reached = cut(components(links))
    return (members.join(reached, members["class_id"] == reached["node"], "left")
            .select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the first by (doc_id, hash of the text, position in the
    input).

    Rows are told by numbers of their own, so rows without an id and rows of one id with different
    texts are documents like any other; rows without an id come last."""
    rows = cut(docs.withColumn("_ng_row", F.monotonically_increasing_id()))
    found = cut(groups(rows.select(F.col("_ng_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_ng_id"), "component_id"))
    # Groups of one need no election; the others are an aggregate that combines before its shuffle.
    several = found.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    voters = cut(found.join(several, "component_id", "left_semi"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.xxhash64("text").alias("h"), F.col("_ng_row"))
    ranked = voters.join(rows.select(F.col("_ng_row").alias("_ng_id"), key.alias("k")), "_ng_id")
    lost = cut(ranked.select("_ng_id", "component_id", "k").join(ranked.groupBy("component_id").agg(F.min("k").alias("best")), "component_id").where("k <> best").select(F.col("_ng_id").alias("_ng_row")))
    return rows.join(lost, "_ng_row", "left_anti").select(docs.columns)


SQL = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - {WIDTH - 2}, 2)), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS g
      FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)
"""
SQL = SQL.replace("WITH w AS", "WITH RECURSIVE w AS", 1) + """,
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT doc_id, md5(array_to_string(list_sort(list(g)), chr(10))) AS h FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS class_id FROM k)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.class_id, d.doc_id) AS class_id, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
"""
