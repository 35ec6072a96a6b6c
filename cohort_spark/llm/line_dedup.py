"""Line deduplication within a small edit distance (DataFrame functions only).

Equal lines are found by a 128-bit hash. For near ones, a line of more than THRESHOLD characters is cut into
THRESHOLD + 1 segments of even length; two lines within the threshold share at least one segment unchanged,
shifted by no more characters than the threshold leaves room for. So each line gives keys (length, segment number,
segment) of its own, and keys of its substrings for partners that are up to THRESHOLD characters shorter;
for a partner's segment i only starts that leave i edits before it and THRESHOLD - i after it are probed. Lines of at
most THRESHOLD characters are all near each other and have one key in common; a longer line that is near one of them
has a character in common with it, which is their key. Keys
with at least two different lines, one of which has the segment as its own, lead to candidate pairs. An edit
changes four of a line's character pairs at most, so lines whose 64-bit parity sketches of character pairs differ in more than 4 * THRESHOLD bits drop out inside the
join. The rest are verified on their whole texts by an edit distance over a band of 2 * THRESHOLD + 1 diagonals
whose cells are bits of one number (Hyyro's banded form of Myers' algorithm).

A line goes if an equal line came before, by (doc_id, number), or if a different line whose first occurrence
comes before is within the threshold, whether or not that line stays. Keys of very many lines (numbered
lines, lines with a third in common) are hot: their lines meet the key's first line alone, and of those that still stay
only the ones that share one of 4 * THRESHOLD + 1 sketch blocks meet, by the same bound on changed character pairs.

Only hashes, keys and numbers shuffle; texts of candidate lines are fetched in a second pass. Keys are written once and
counted by an aggregate that combines before its shuffle; no window holds the lines of a key together.

The registered query judges every line that has a word. The functions and the pipeline's stage leave lines of fewer than
``min_chars`` characters (after trimming white space at both ends) alone, MIN_CHARS of them unless told otherwise.

Defined results: null and empty texts have no lines that count; blank lines never go; rows of one id are one document,
whose equal lines of equal number are the same line, while each row loses only lines that it has itself; rows with a null
id are kept untouched; empty tables give empty tables; other columns are kept by ``dedup``, which replaces n_lines and
removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, let, read

THRESHOLD = 2
MIN_CHARS = 20
#: Lines under one key from which on it is hot.
HOT = 64
#: Lines of a hot key that meet its first line in one task.
SPREAD = 1024
#: Line hashes and keys that are broadcast at most (16 MB); more are joined by shuffle.
BROADCAST_LINES = 1_000_000
#: Copies of a line from which on its hash is broadcast, so that they stay in their tasks.
MANY = 10_000

_BLANKS = " \t\n\r\x0b\x0c"


def lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(doc_id, pos, line, h1, h2, n) of the lines that count."""
    one = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    return (one.where(F.length(F.btrim("line", F.lit(_BLANKS))) >= min_chars)
            .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "n": F.length("line")}))


def _cuts(n: Column, threshold: int) -> list[tuple[Column, Column]]:
    """(start, length), from 0, of each segment of a line of n characters: even, the longer ones last."""
    parts = threshold + 1
    rest = n % parts
    short = ((n - rest) / parts).cast("int")
    out = []
    for k in range(parts):
        longer = F.greatest(F.lit(0), rest - (parts - k))  # longer segments before this one
        out.append((short * k + longer, short + F.when(F.lit(k) >= parts - rest, 1).otherwise(0)))
    return out


def _probes(threshold: int, tiny: bool) -> Column:
    """An array with a struct for each key of a line.

    ``part`` is the segment's number, ``less`` by how many characters the partner is shorter, ``shift`` how far the
    partner's segment starts from where it would start there; ``own`` marks the line's own segments. At most ``part`` edits
    lie before the segment and threshold - part after it. With ``tiny``, lines of at most ``threshold`` characters (part -1)
    and their longer partners' characters (part -2, at ``shift``) have keys too.
    """
    rows = [(k, 0, 0, 1) for k in range(threshold + 1)]
    for less in range(threshold + 1):
        for k in range(threshold + 1):
            low, high = max(-k, less - (threshold - k)), min(k, less + (threshold - k))
            rows += [(k, less, d, 0) for d in range(low, high + 1) if (less, d) != (0, 0)]
    if tiny:
        rows += [(-1, 0, 0, 1)] + [(-2, 0, at, 0) for at in range(2 * threshold)]
    names = ("part", "less", "shift", "own")
    return F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, r)]) for r in rows])


def line_keys(rows: DataFrame, threshold: int, tiny: bool, keep: tuple[str, ...] = ("h1",)) -> DataFrame:
    """(key, own, *keep) of ``rows`` (line, n, *keep): a row for each segment or probe that fits.

    The probes are rows of a short table rather than columns, so one small expression makes every key and the JVM compiles
    it; as columns of one projection they exceed the method size that the JVM compiles.
    """
    parts = threshold + 1
    one = rows.select("line", "n", *keep, F.explode(_probes(threshold, tiny)).alias("p")).select("line", "n", *keep, "p.*")
    m = F.col("n") - F.col("less")  # the partner's length
    short, rest = F.floor(m / parts).cast("int"), m % parts
    start = short * F.col("part") + F.greatest(F.lit(0), rest - (parts - F.col("part")))  # the longer segments come last
    one = one.withColumns({"m": m, "at": start + F.col("shift"), "size": short + (F.col("part") >= parts - rest).cast("int")})
    segment = (F.col("part") >= 0) & (F.col("m") > threshold) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n"))
    key = F.xxhash64("m", "part", F.substring("line", F.col("at") + 1, F.col("size")))
    if tiny:
        small = F.col("n") <= threshold
        one = one.withColumn("own", F.when(F.col("part") == -2, small.cast("int")).otherwise(F.col("own")))
        segment = segment | ((F.col("part") == -1) & small) | ((F.col("part") == -2) & (F.col("n") <= 2 * threshold) & (F.col("shift") < F.col("n")))
        key = (F.when(F.col("part") >= 0, key).when(F.col("part") == -1, F.xxhash64(F.lit("tiny")))
               .otherwise(F.xxhash64(F.lit("tiny"), F.substring("line", F.col("shift") + 1, F.lit(1)))))
    return one.where(segment).select(key.alias("key"), F.col("own").cast("byte").alias("own"), *keep)


def near(a: Column, b: Column, threshold: int) -> Column:
    """Whether two lines' edit distance is at most ``threshold``.

    Bit k of the vertical differences of column j stands for row j - threshold + k, so that one column's band
    passes to the next by a shift. Rows outside the line's characters match nothing.
    """
    width, full = 2 * threshold + 1, (1 << (2 * threshold + 1)) - 1
    top = 1 << (width - 1)

    def verdict(p: Column) -> Column:  # p = (x, y), arrays of characters; x is not longer
        x, y = p["x"], p["y"]
        m, n = F.size(x), F.size(y)

        def step(s: Column, j: Column) -> Column:  # j from 0: column j + 1
            eq = sum((F.when(F.get(x, j - threshold + k) == F.get(y, j), 1 << k).otherwise(0) for k in range(width)), F.lit(0))

            def column(e: Column) -> Column:
                diag = (((e.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(e).bitwiseOR(s["vn"])).bitwiseAND(F.lit(full))

                def cells(d: Column) -> Column:
                    hp = s["vn"].bitwiseOR(F.bitwise_not(d.bitwiseOR(s["vp"]))).bitwiseAND(F.lit(full))
                    hn = d.bitwiseAND(s["vp"])
                    # The cell followed: down the band's lowest diagonal, then along the last row.
                    down = j + threshold < m
                    last = F.element_at(F.array(*[F.lit(1 << k) for k in range(width)]), F.greatest(F.least(m - 1 - j + threshold, F.lit(width - 1)), F.lit(0)) + 1)
                    along = F.when(hp.bitwiseAND(last) != 0, 1).when(hn.bitwiseAND(last) != 0, -1).otherwise(0)
                    dist = s["dist"] + F.when(down, F.when(d.bitwiseAND(F.lit(top)) != 0, 0).otherwise(1)).otherwise(along)
                    d1 = F.shiftright(d, 1)
                    return F.struct(hn.bitwiseOR(F.bitwise_not(d1.bitwiseOR(hp))).bitwiseAND(F.lit(full)).alias("vp"), d1.bitwiseAND(hp).alias("vn"), dist.alias("dist"))

                return let(diag, cells)

            return let(eq, column)

        start = F.struct(F.lit(full - ((1 << threshold) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("dist"))
        return (n - m <= threshold) & (F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["dist"]) <= threshold)

    short = F.length(a) <= F.length(b)
    chars = F.struct(F.split(F.when(short, a).otherwise(b), "").alias("x"), F.split(F.when(short, b).otherwise(a), "").alias("y"))
    return F.when(F.least(F.length(a), F.length(b)) <= threshold, F.levenshtein(a, b) <= threshold).otherwise(let(chars, verdict))


def pair_sketch(line: Column) -> Column:
    """64 bits, each the parity of how many of the line's neighbouring character pairs hash to it."""
    def parity(c: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0).cast("long"), lambda s, i: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(F.get(c, i), F.get(c, i + 1)), F.lit(64)))))

    return F.when(F.length(line) < 2, F.lit(0).cast("long")).otherwise(let(F.split(line, ""), parity))


def sketch_blocks(line: Column, threshold: int) -> Column:
    """4 * threshold + 1 numbers, parities of the hashed character pairs that fall to each: lines within the threshold
    agree on one at least, since an edit changes four pairs at most."""
    count = 4 * threshold + 1

    def pairs(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda i: F.pmod(F.xxhash64(F.get(c, i), F.get(c, i + 1)), F.lit(count * 60)))

    def block(h: Column, j: Column) -> Column:
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(x / count).cast("int"))
        return F.aggregate(F.filter(h, lambda x: x % count == j), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x)))

    none = F.array_repeat(F.lit(0).cast("long"), count)
    blocks = let(F.split(line, ""), lambda c: let(pairs(c), lambda h: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: block(h, j))))
    return F.when(F.length(line) < 2, none).otherwise(blocks)


def _texts(docs: DataFrame, wanted: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, line, n, sketch) of the lines whose h1 is in ``wanted``, once each."""
    few = wanted.count() <= BROADCAST_LINES
    found = lines(docs, text, min_chars).select("h1", "h2", "line")
    once = found.join(F.broadcast(wanted) if few else wanted, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    return once.withColumns({"n": F.length("line"), "sketch": pair_sketch(F.col("line"))})


_SIDE = ("h1", "h2", "n", "sketch", "first", "own", "parts")


def _meet(x: DataFrame, y: DataFrame, threshold: int, on: tuple[str, ...] = ("key",)) -> DataFrame:
    """(a1, a2, b1, b2, salt): different lines of one key, a before b, that may be near. The conditions hold inside the
    join. ``salt`` deals the partners of a over its ``parts``."""
    x = x.select(*on, *[F.col(c).alias(f"x_{c}") for c in _SIDE])
    y = y.select(*[F.col(c).alias(f"_{c}") for c in on], *[F.col(c).alias(f"y_{c}") for c in _SIDE])
    fits = (F.col("x_first") < F.col("y_first")) & (F.greatest("x_own", "y_own") == 1) & (F.abs(F.col("x_n") - F.col("y_n")) <= threshold)
    fits = fits & (F.bit_count(F.col("x_sketch").bitwiseXOR(F.col("y_sketch"))) <= 4 * threshold)
    for c in on:
        fits = fits & (F.col(c) == F.col(f"_{c}"))
    ends = [F.col(f"{side}_{h}").alias(name) for name, side, h in (("a1", "x", "h1"), ("a2", "x", "h2"), ("b1", "y", "h1"), ("b2", "y", "h2"))]
    return x.join(y, fits).select(*ends, F.pmod("y_h2", "x_parts").alias("salt")).distinct()


def _judged(pairs: DataFrame, texts: DataFrame, threshold: int, dealt: DataFrame | None = None) -> DataFrame:
    """(h1, h2) of the later lines of the pairs that are near. ``dealt`` (h1, h2, parts) are earlier lines that so many
    later ones meet that their texts are copied to several tasks."""
    a = texts.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("line").alias("la"))
    b = texts.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("line").alias("lb"))
    if dealt is None:
        a = a.withColumn("salt", F.lit(0).cast("long"))
    else:
        copies = dealt.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"))
        a = a.join(copies, ["a1", "a2"])
    near_ones = pairs.join(b, ["b1", "b2"]).join(a, ["a1", "a2", "salt"]).where(near(F.col("la"), F.col("lb"), threshold))
    return near_ones.select(F.col("b1").alias("h1"), F.col("b2").alias("h2")).distinct()


def _meet_hot(warm: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(h1, h2) of the later lines that are near an earlier one of the same hot key.

    First every line meets its key's first line, which is copied to as many tasks as the key has thousands of lines. What
    is left meets all earlier lines of the key that share a block of its wide sketch, too.
    """
    warm = warm.withColumn("parts", F.ceil(F.col("size") / SPREAD))
    lead = warm.groupBy("key").agg(F.min_by(F.struct(*[c for c in _SIDE if c != "parts"], "size"), "first").alias("l")).select("key", "l.*")
    lead = lead.withColumn("_parts", F.ceil(F.col("size") / SPREAD))
    widest = cut(lead.groupBy("h1", "h2").agg(F.max("_parts").alias("parts")))
    lead = lead.join(widest, ["h1", "h2"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    first = _meet(lead, warm.withColumn("salt", F.pmod("h2", "parts")), threshold, ("key", "salt"))
    gone = cut(_judged(first, texts, threshold, widest))

    wide = cut(texts.join(warm.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", sketch_blocks(F.col("line"), threshold).alias("b")))
    split = warm.withColumn("parts", F.lit(1).cast("long")).join(wide, ["h1", "h2"]).select("*", F.posexplode("b").alias("j", "block")).drop("b")
    left = split.join(gone, ["h1", "h2"], "left_anti")
    return gone.union(_judged(_meet(split, left, threshold, ("key", "j", "block")), texts, threshold))


def late_lines(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """(doc_id, pos, h1) of the lines that go, numbered from 0, with their hashes."""
    here = cut(lines(docs, text, min_chars).select("doc_id", "pos", "h1", "h2"))
    firsts = cut(here.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies")))

    # A key counts if two different lines have it, one as its own segment. Aggregates combine before the shuffle, so a line
    # in every document is one row for each task.
    keys = cut(line_keys(lines(docs, text, min_chars), threshold, min_chars <= 2 * threshold))
    spans = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("own").alias("owned"))
    met = cut(spans.where("lo < hi and owned = 1").select("key"))
    few = met.count() <= BROADCAST_LINES
    shared = cut(keys.join(F.broadcast(met) if few else met, "key", "left_semi").groupBy("key", "h1").agg(F.max("own").alias("own")))
    discard(keys)  # by far the largest table here
    texts = cut(_texts(docs, cut(shared.select("h1").distinct()), text, min_chars))
    sizes = cut(shared.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > hot))
    shared = cut(shared.join(texts.join(firsts, ["h1", "h2"]).select("h1", "h2", "n", "sketch", "first"), "h1").join(sizes, "key", "left"))

    cold = shared.where("size is null").withColumn("parts", F.lit(1).cast("long"))
    gone = _judged(_meet(cold, cold, threshold), texts, threshold)
    gone = cut(gone.union(_meet_hot(shared.where("size is not null"), texts, threshold)).distinct())

    # Of lines that occur once and are not near an earlier one, none go. The most frequent ones are not dealt by their hash.
    judged = cut(firsts.join(gone.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where(F.col("near") | (F.col("copies") > 1)))
    if judged.count() <= BROADCAST_LINES:
        met = here.join(F.broadcast(judged), ["h1", "h2"])
    else:
        top = F.broadcast(judged.where(F.col("copies") > MANY))  # fewer than all lines / MANY
        met = here.join(top, ["h1", "h2"]).unionByName(here.join(top, ["h1", "h2"], "left_anti").join(judged.where(F.col("copies") <= MANY), ["h1", "h2"]))
    return met.where(F.col("near") | (F.struct("doc_id", "pos") != F.col("first"))).select("doc_id", "pos", "h1").distinct()


def _without_late(docs: DataFrame, text: str, threshold: int, min_chars: int, hot: int) -> DataFrame:
    """``docs`` without the lines that go, and _ld_removed, the numbers of those."""
    late = cut(late_lines(docs.select("doc_id", text), text, threshold, min_chars, hot))
    few = late.count() <= BROADCAST_LINES
    gone = cut(late.groupBy(F.col("doc_id").alias("_ld_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "h1"))).alias("_ld_gone")))
    parts = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    # Of rows with one id and different texts, each loses the lines that it has.
    here = F.transform(F.filter("_ld_gone", lambda g: F.xxhash64(F.get(parts, g["pos"])) == g["h1"]), lambda g: g["pos"])
    kept = let(F.col("_ld_removed"), lambda r: F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(r, i)), "\n"))
    return (docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_ld_id"), "left")
            .withColumn("_ld_removed", F.coalesce(here, F.array().cast("array<int>")))
            .withColumn(text, F.when(F.size("_ld_removed") == 0, F.col(text)).otherwise(kept)).drop("_ld_id", "_ld_gone"))


def dedup(docs: DataFrame, text: str = "text", threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, hot: int = HOT) -> DataFrame:
    """``docs`` without the lines that go, and n_lines (before) and removed (their numbers, ascending); columns of these
    two names are replaced, all others kept."""
    n = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return _without_late(docs.withColumn("n_lines", n), text, threshold, min_chars, hot).drop("removed").withColumnRenamed("_ld_removed", "removed")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, min_chars=1).select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts lose the lines that came before; n_chars follows. All documents stay."""
    out = _without_late(docs, "text", THRESHOLD, MIN_CHARS, HOT)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
