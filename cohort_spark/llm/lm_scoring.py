"""Language-model scores: a unigram base and a hashed maximum-entropy model with a class-factored softmax.

The model gives a word w after history h as P(class of w | h) * P(w | class, h). Classes are cut by frequency: words are
ordered by their count, and the counts are cut so that classes hold about the same number of tokens; the end of a text is
a class of its own, and all words that are too rare for the broadcast table, unknown ones too, are the last class.

Both factors are log-linear in hashed features of the history. The class factor has the previous word (n-gram), the word
before it (skip) and both together. The word factor starts from the class' add-one shares and has a feature for each
word and hashed previous word that occurred together LEAST times or more; its normalizer, one number for each hashed previous
word and class, is 1 plus what the features add, so it is exact.

What training gathers: the count of every (word, hashed previous word), a table that grows with the corpus and gives the
words' counts and the word features; and how often each class followed each hashed history, a table of bounded size. Both
come from all training texts. The class weights climb the exact log-likelihood: in every round tasks turn their share of
the history table into gradients and curvatures (observed minus expected class counts, by feature), Spark sums them,
and the driver moves a matrix of fixed size. The word weights are updated in rounds over the feature table: given the
normalizers of the round before, each weight is moved to where its own gradient (observed minus expected minus prior) is 0,
and tasks add up the new normalizers. Both stop at a stated tolerance.

Scoring adds up, for the texts of a run at a time, what the broadcast tables know: class parts, counts of the HEAD most frequent
words, weights of the HEAD_PAIRS most frequent features. A bitmap of fixed size says which other features can exist. Rarer
words, and words with other features, go to the tables by a join on the word's hash. Nothing is dropped or estimated: the
split only decides which way a number travels.

Defined results: null and empty texts are one end token; rows with a null id are never held out and keep their null;
repeated rows are scored each, and counted each in training; an empty table or one without training rows gives the
uniform model, an empty one no rows; words are told by 57 bits of a hash; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_words, mix, read, split_words

#: Classes (0 is the end of a text, the last one the rare words) and buckets of a history word (0 is before the text).
CLASSES, BUCKETS = 32, 128
#: Rows of the class weights: a bias, previous word, word before it, and hashed pairs.
PAIRS = 4096
#: Gradient rounds at most, the relative gain in log-likelihood that ends them, how many occurrences' worth of evidence
#: pulls each class weight towards 0, and its largest step.
ROUNDS, TOLERANCE, PRIOR, STEP = 20, 1e-4, 4.0, 0.5
#: Occurrences that a word feature needs, its prior, rounds at most, and the change of log normalizers that ends them.
LEAST, WORD_PRIOR, WORD_ROUNDS, WORD_TOLERANCE = 2, 2.0, 6, 1e-2
#: Words whose counts, and features whose weights, are broadcast at most (8 and 12 MB); bits of the map of features (8 MB).
HEAD, HEAD_PAIRS, MAP_BITS = 500_000, 1_000_000, 26
#: Tokens, of whole texts, that a worker numbers and scores at once.
AT_ONCE = 1 << 15
#: The number of the word that ends a text.
END = 0x1E5D

_CONTEXTS, _RARE, _LOG10 = BUCKETS * BUCKETS, CLASSES - 1, float(np.log(10))
_SHIFT = 7  # bits of a bucket, below the 57 bits of a word


def token_words(text: str | None) -> np.ndarray:
    """Numbers of a text's words and its end."""
    return np.append(hash_words(split_words(text)) >> np.uint64(_SHIFT), np.uint64(END))


@dataclass
class Run:
    """The tokens of a few texts one after the other: their words' numbers, and where each text starts."""

    words: np.ndarray
    starts: np.ndarray


def runs(texts: Iterable[str | None]) -> Iterator[Run]:
    """All of ``texts`` as ``token_words`` has them, AT_ONCE tokens or one more text at a time."""
    held, ends = [], []
    for t in texts:
        held += split_words(t)
        ends.append(len(held))
        held.append(b"")  # no word is empty
        if len(held) >= AT_ONCE:
            yield _run(held, ends)
            held, ends = [], []
    if held:
        yield _run(held, ends)


def _run(held: list[bytes], ends: list[int]) -> Run:
    words = hash_words(held) >> np.uint64(_SHIFT)
    words[ends] = END
    return Run(words, np.r_[0, np.array(ends[:-1], np.int64) + 1])


def history(words: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word before each token and of the one before that; ``starts`` are the first tokens of texts that follow
    each other, by default the first of all."""
    bucket = 1 + (mix(words) % np.uint64(BUCKETS - 1)).astype(np.int64)
    starts = 0 if starts is None else starts
    one = np.r_[0, bucket[:-1]]
    one[starts] = 0
    two = np.r_[0, one[:-1]]
    two[starts] = 0
    return one, two


def pair_keys(words: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (words << np.uint64(_SHIFT)) | bucket.astype(np.uint64)


def feature_rows(context: np.ndarray) -> np.ndarray:
    """Rows of the class weights that are on for each context: four columns."""
    one, two = context // BUCKETS, context % BUCKETS
    pair = (mix(context.astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
    return np.stack([np.zeros_like(one), 1 + one, 1 + BUCKETS + two, 1 + 2 * BUCKETS + pair], axis=1)


def log_softmax(weights: np.ndarray, context: np.ndarray) -> np.ndarray:
    logits = weights[feature_rows(context)].sum(axis=1)
    top = logits.max(axis=1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pair_counts(train: DataFrame, text: str) -> DataFrame:
    """(key, n): how often each word (END too) followed each bucket; a task sends a key once for a few thousand texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for part in runs(batch[text]):
                held.append(pair_keys(part.words, history(part.words, part.starts)[0]))
                n += len(part.words)
                if n > 2_000_000:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pd.DataFrame({"key": keys.view(np.int64), "n": n})

    return train.select(text).mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _word(key: str = "key") -> Column:
    return F.shiftrightunsigned(key, _SHIFT)


def _bucket(key: str = "key") -> Column:
    return F.col(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _at_least(table: DataFrame, column: str, most: int) -> int | None:
    """The least value of ``column`` such that at most ``most`` rows have it or more; None if there is none."""
    least, total = None, 0
    for r in table.groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc(column)).toLocalIterator():
        total += r["rows"]
        if total > most:
            break
        least = r[column]
    return least


@dataclass
class Words:
    """The most frequent words in order of their numbers, their counts and classes; tokens and distinct words by class."""

    numbers: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: np.ndarray
    distinct: np.ndarray

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words, and whether they are there."""
        if not len(self.numbers):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.numbers, words), len(self.numbers) - 1)
        return at, self.numbers[at] == words

    def class_of(self, words: np.ndarray) -> np.ndarray:
        at, there = self.find(words)
        known = self.classes[at] if len(self.numbers) else np.zeros(len(words), np.int64)
        return np.where(words == END, 0, np.where(there, known, _RARE)).astype(np.int64)

    def log_shares(self) -> np.ndarray:
        """Logarithm of each class' add-one denominator; only the last class has room for an unknown word."""
        spare = np.zeros(CLASSES)
        spare[_RARE] = 1
        return np.log(np.maximum(self.tokens + self.distinct + spare, 1))


def frequent_words(counts: DataFrame, head: int) -> Words:
    """``counts`` is (word, c) of all training tokens."""
    totals = counts.where(F.col("word") != END).agg(F.sum("c"), F.count("*")).first()
    ends = counts.where(F.col("word") == END).agg(F.sum("c")).first()[0] or 0
    words = counts.where(F.col("word") != END)
    least = _at_least(words, "c", head)
    few = words.where(F.col("c") >= least).toArrow() if least is not None else None
    numbers = few["word"].to_numpy().view(np.uint64) if few else np.empty(0, np.uint64)
    c = few["c"].to_numpy() if few else np.empty(0, np.int64)
    order = np.argsort(numbers)
    numbers, c = numbers[order], c[order]
    # Words of one count are of one class: a class ends at the count where its share of the tokens is reached.
    values, at = np.unique(-c, return_inverse=True)
    mass = np.cumsum(np.bincount(at, c)) if len(c) else np.empty(0)
    starts = np.r_[0, mass[:-1]] if len(c) else mass
    by_value = 1 + np.minimum((starts * (CLASSES - 2) / max(mass[-1], 1)).astype(np.int64), CLASSES - 3) if len(c) else np.empty(0, np.int64)
    classes = by_value[at].astype(np.int64) if len(c) else np.empty(0, np.int64)
    tokens, distinct = np.bincount(classes, c, CLASSES), np.bincount(classes, minlength=CLASSES).astype(float)
    tokens[0], distinct[0] = ends, 1 if ends else 0
    tokens[_RARE], distinct[_RARE] = (totals[0] or 0) - c.sum(), totals[1] - len(c)
    return Words(numbers, c, classes, tokens, distinct)


def history_counts(train: DataFrame, text: str, words) -> DataFrame:
    """(context, n0, n1, ...): how often each class followed each context; at most BUCKETS ** 2 rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = words.value
        table = np.zeros(_CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            cells = []
            for part in runs(batch[text]):
                distinct, place = np.unique(part.words, return_inverse=True)
                one, two = history(part.words, part.starts)
                cells.append((one * BUCKETS + two) * CLASSES + known.class_of(distinct)[place])
            if cells:
                table += np.bincount(np.concatenate(cells), minlength=len(table))
        table = table.reshape(_CONTEXTS, CLASSES)
        some = np.flatnonzero(table.any(axis=1))
        yield pd.DataFrame(table[some], columns=names).assign(context=some)

    names = [f"n{k}" for k in range(CLASSES)]
    return (train.select(text).mapInPandas(run, ", ".join(f"{c} long" for c in names) + ", context long")
            .groupBy("context").agg(*[F.sum(c).alias(c) for c in names]))


def fit_classes(table: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, tolerance: float = TOLERANCE) -> np.ndarray:
    """Class weights (features x classes) by rounds over the history table.

    The bias starts at the classes' shares. Each round adds up, over all tasks, the gradient and the curvature of
    the log-likelihood for each weight; a weight moves by their quotient, over the number of features that share a
    history, and by STEP at most. Rounds end when the log-likelihood gains less than ``tolerance`` of itself."""
    spark, names = table.sparkSession, [f"n{k}" for k in range(CLASSES)]
    rows = 1 + 2 * BUCKETS + PAIRS
    weights = np.zeros((rows, CLASSES))
    seen = table.agg(*[F.sum(c) for c in names]).first()
    weights[0] = np.log(np.array([float(n or 0) + 1 for n in seen]))
    sums, last = [f"{x}{k}" for x in "gh" for k in range(CLASSES)], None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            both, total = np.zeros((rows + 1, 2 * CLASSES)), 0.0
            for batch in batches:
                context, n_class = batch["context"].to_numpy(), batch[names].to_numpy(float)
                logs = log_softmax(shared.value, context)
                share, n = np.exp(logs), n_class.sum(axis=1, keepdims=True)
                total += float((n_class * logs).sum())
                change = np.concatenate([n_class - n * share, n * share * (1 - share)], axis=1)
                for column in feature_rows(context).T:
                    np.add.at(both, column, change)
            both[rows, 0] = total  # the last row carries the log-likelihood
            some = np.flatnonzero(both.any(axis=1))
            yield pd.DataFrame(both[some], columns=sums).assign(feature=some)

        parts = table.mapInPandas(gradient, ", ".join(f"{c} double" for c in sums) + ", feature long")
        both = np.zeros((rows + 1, 2 * CLASSES))
        for r in parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in sums]).collect():  # rows + 1 at most
            both[r[0]] = r[1:]
        shared.unpersist()
        pull = prior * weights
        pull[0] = 0  # the bias is not pulled
        fit = both[rows, 0] - 0.5 * float((pull * weights).sum())
        if last is not None and fit - last < tolerance * abs(last):
            break
        last = fit
        weights = weights + np.clip((both[:rows, :CLASSES] - pull) / (4 * both[:rows, CLASSES:] + prior), -STEP, STEP)
    return weights


def word_weights(n: np.ndarray, share: np.ndarray, expected: np.ndarray, prior: float = WORD_PRIOR) -> np.ndarray:
    """The weight of each feature at which n - expected * share * exp(weight) - prior * weight is 0, by Newton steps;
    ``expected`` is how often the class followed the bucket, over the normalizer."""
    a = np.maximum(share * expected, 1e-300)
    u = np.clip(np.log(n / a), -n / prior, n / prior)
    for _ in range(12):
        e = a * np.exp(np.minimum(u, 50))
        u = u + (n - e - prior * u) / (e + prior)
    return u


def fit_words(features: DataFrame, words: Words, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalizers that the weights are fitted with, normalizers of these weights), both buckets x classes.

    ``features`` is (word, b, n, c); ``follow`` says how often each class followed each bucket. A round maps the features
    with the last normalizers to weights and sums what these add to 1."""
    spark, logs = features.sparkSession, words.log_shares()
    given = np.ones((BUCKETS, CLASSES))
    for _ in range(WORD_ROUNDS):
        shared = spark.sparkContext.broadcast((words, follow, given))

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known, follow, given = shared.value
            total = np.zeros(BUCKETS * CLASSES)
            for batch in batches:
                k, b = known.class_of(batch["word"].to_numpy(np.int64).view(np.uint64)), batch["b"].to_numpy(np.int64)
                share = (batch["c"].to_numpy(float) + 1) / np.exp(logs[k])
                u = word_weights(batch["n"].to_numpy(float), share, follow[b, k] / given[b, k])
                total += np.bincount(b * CLASSES + k, share * np.expm1(u), BUCKETS * CLASSES)
            some = np.flatnonzero(total)
            yield pd.DataFrame({"cell": some, "more": total[some]})

        new = np.ones(BUCKETS * CLASSES)
        for r in features.mapInPandas(add, "cell long, more double").groupBy("cell").agg(F.sum("more")).collect():  # one for each cell at most
            new[r[0]] += r[1]
        new = np.maximum(new.reshape(BUCKETS, CLASSES), 1e-9)
        shared.unpersist()
        if np.abs(np.log(new) - np.log(given)).max() < WORD_TOLERANCE:
            break
        given, last = new, given
    else:
        given = last  # the last weights were fitted with the normalizers before
    return given, new


@dataclass
class Model:
    """What scoring needs: tables of bounded size, and the feature and count tables, which grow with the corpus."""

    words: Words
    classes: np.ndarray  # log P(class | context)
    log_z: np.ndarray  # log normalizers of the word factor, buckets x classes
    keys: np.ndarray  # features that are broadcast, and their weights
    weights: np.ndarray
    bits: np.ndarray  # which features there are, by hash
    counts: DataFrame
    features: DataFrame  # (word, b, n, c, u)


def _bit(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP_BITS)


def fit(train: DataFrame, text: str = "text", head: int = HEAD, head_pairs: int = HEAD_PAIRS) -> Model:
    spark = train.sparkSession
    pairs = cut(pair_counts(train, text))
    counts = cut(pairs.groupBy(_word().alias("word")).agg(F.sum("n").alias("c")))
    words = frequent_words(counts, head)
    shared = spark.sparkContext.broadcast(words)
    table = cut(history_counts(train, text, shared))
    classes = log_softmax(fit_classes(table), np.arange(_CONTEXTS))
    follow = np.zeros((BUCKETS, CLASSES))
    for r in table.groupBy(F.floor(F.col("context") / BUCKETS).cast("int").alias("b")).agg(*[F.sum(f"n{k}") for k in range(CLASSES)]).collect():  # BUCKETS rows
        follow[r[0]] = r[1:]

    often = pairs.where(F.col("n") >= LEAST).select(_word().alias("word"), _bucket().alias("b"), "n").where(F.col("word") != END)
    features = cut(often.join(counts, "word"))
    given, z = fit_words(features, words, follow)
    inner = spark.sparkContext.broadcast((follow / given, words.log_shares()))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expected, logs = inner.value
        for batch in batches:
            k, b = shared.value.class_of(batch["word"].to_numpy(np.int64).view(np.uint64)), batch["b"].to_numpy(np.int64)
            batch["u"] = word_weights(batch["n"].to_numpy(float), (batch["c"].to_numpy(float) + 1) / np.exp(logs[k]), expected[b, k])
            yield batch

    features = cut(features.mapInPandas(weigh, "word long, b int, n long, c long, u double"))
    key = F.shiftleft("word", _SHIFT).bitwiseOR(F.col("b").cast("long"))
    least = _at_least(features, "n", head_pairs)
    few = features.where(F.col("n") >= least).select(key.alias("key"), "u").toArrow() if least is not None else None
    keys = few["key"].to_numpy().view(np.uint64) if few else np.empty(0, np.uint64)
    order = np.argsort(keys)
    weights = few["u"].to_numpy().astype(np.float32)[order] if few else np.empty(0, np.float32)

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bit = np.unique(_bit(batch["key"].to_numpy(np.int64).view(np.uint64))).astype(np.int64)
            yield pd.DataFrame({"place": bit >> 6, "bits": (np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64)})

    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    found = features.select(key.alias("key")).mapInPandas(mark, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()  # 2 ** (MAP_BITS - 6) rows at most
    bits[found["place"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Model(words, classes, np.log(z), keys[order], weights, bits, counts, features)


def score(docs: DataFrame, text: str = "text", head: int = HEAD, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return score_with(fit(docs.where(~held_out(F.col("doc_id"))), "text", head, head_pairs), docs)


def score_with(model: Model, docs: DataFrame) -> DataFrame:
    """``score`` of (doc_id, text) rows by a fitted model."""
    spark, words = docs.sparkSession, model.words
    tokens, distinct = int(words.tokens.sum()), int(words.distinct.sum())
    floor = float(np.log10(tokens + distinct + 1))
    shared = spark.sparkContext.broadcast((words, (model.classes / _LOG10).astype(np.float32), (model.log_z + words.log_shares()) / _LOG10, model.keys, model.weights / np.float32(_LOG10), model.bits, float(words.tokens[0])))
    columns = ["row", "doc_id", "no_id", "key", "rare", "tf", "known", "s", "m"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each text (rare 0): its tokens, the known ones of them that are settled here, s = sum of log10(c + 1),
        m = the model's settled part. And a row for each of its (word, bucket) that goes to the tables: rare 2 if the
        word's count is missing here, 1 if only the feature is."""
        known, classes, base, keys, weights, bits, ends = shared.value
        logs = np.log10(known.counts + 1.0)
        for batch in batches:
            first = 0
            for part in runs(batch["text"]):
                starts, many = part.starts, len(part.starts)
                some = batch.iloc[first : first + many]
                first += many
                one, two = history(part.words, starts)
                key, place = np.unique(pair_keys(part.words, one), return_inverse=True)
                word = key >> np.uint64(_SHIFT)  # ascending, as the keys are
                at, there = known.find(word)
                end = word == END
                c = np.where(there, logs[at], 0.0) if len(logs) else np.zeros(len(key))
                c[end] = np.log10(ends + 1)
                k = known.class_of(word)
                weight, fits = np.zeros(len(key)), np.zeros(len(key), bool)
                if len(keys):
                    near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    fits = (keys[near] == key) & there  # a rarer word takes its weights from the tables
                    weight[fits] = weights[near[fits]]
                bit = _bit(key)
                maybe = (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                kind = np.where(there, np.where(fits | ~maybe, 0, 1), 2)
                kind[end] = 0
                # The end's share is its class' alone: its denominator is already in ``base``.
                weight += c - base[(key & np.uint64(BUCKETS - 1)).astype(np.int64), k]
                m = classes[one * BUCKETS + two, k[place]] + weight[place]
                settled = np.add.reduceat((there | end)[place].astype(np.int64), starts) - (ends == 0)
                rows, n = some["row"].to_numpy(), np.diff(np.r_[starts, len(place)])
                yield pd.DataFrame({"row": rows, "doc_id": some["doc_id"].to_numpy(), "no_id": some["no_id"].to_numpy(), "key": 0, "rare": 0, "tf": n, "known": settled,
                                    "s": np.add.reduceat(c[place], starts), "m": np.add.reduceat(m, starts)})[columns]
                far = np.flatnonzero(kind[place])
                cell, tf = np.unique(np.repeat(np.arange(many), n)[far] * len(key) + place[far], return_counts=True)
                text, which = cell // len(key), cell % len(key)
                yield pd.DataFrame({"row": rows[text], "key": key[which].view(np.int64), "rare": kind[which], "tf": tf}).assign(known=0, s=0.0, m=0.0, doc_id=0, no_id=False)[columns]

    # A null id travels as a mark: in a batch of doubles, large ids would change.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    kind = "row long, doc_id long, no_id boolean, key long, rare int, tf long, known long, s double, m double"
    parts = cut(numbered.mapInPandas(run, kind))

    weights = model.features.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("b", "u"))).alias("us"))  # BUCKETS entries at most
    table = model.counts.where(F.col("word") != END).join(weights, "word", "left")
    far = parts.where("rare > 0").select("row", _word().alias("word"), _bucket().alias("b"), "rare", "tf").join(table, "word")
    count = F.when(F.col("rare") == 2, F.log10(F.col("c") + 1.0)).otherwise(0.0)
    u = F.coalesce(F.try_element_at("us", F.col("b")), F.lit(0.0)) / _LOG10
    tail = far.groupBy("row").agg(F.sum(F.when(F.col("rare") == 2, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * count).alias("rest"), F.sum(F.col("tf") * (count + u)).alias("parts"))
    n, known = F.col("tf"), F.col("known") + F.coalesce("more", F.lit(0))
    s, m = F.col("s") + F.coalesce("rest", F.lit(0.0)), F.col("m") + F.coalesce("parts", F.lit(0.0))
    doc_id = F.when(~F.col("no_id"), F.col("doc_id"))
    return (parts.where("rare = 0").join(tail, "row", "left")
            .select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), n.alias("n_tokens"), known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
                    (s - n * F.lit(floor)).alias("base_score"), m.alias("score")))


def query(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
