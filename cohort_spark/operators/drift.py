"""Distribution drift between two groups of rows: PSI, KS, chi-square, Cohen's d, rate shifts, audits.

Features come in long form (feature, grp, value), unpivoted once; ``ref`` and ``cur`` name the two groups. Statistics are
grouped aggregates; only breaks and counts, a few rows for each feature, are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import chi2_pvalue, ks_pvalue
from . import ranks

CLIP = 1e-6


def to_long(df: DataFrame, features: list[str], group: str = "grp") -> DataFrame:
    """(grp, feature, value) of the first row of each entity, say; null and NaN values go."""
    typed = df.select(F.col(group).alias("grp"), *[F.col(c).cast("double").alias(c) for c in features])
    return typed.unpivot(["grp"], features, "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def _psi(p: Column, q: Column) -> Column:
    return (q - p) * F.log(q / p)


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(CLIP)), F.lit(1 - CLIP))


def _pair(long: DataFrame, ref: str, cur: str) -> DataFrame:
    return long.where(F.col("grp").isin(ref, cur)).withColumn("is_cur", F.col("grp") == cur)


def equal_width_bins(long: DataFrame, ref: str, cur: str, bins: int = 10, pad: float = 1e-6) -> DataFrame:
    """(feature, bin, n_ref, n_cur) over ``bins`` equal bins of the joint range; empty bins have rows too."""
    rows = _pair(long, ref, cur)
    # A row for each feature, that is, for each column of the table the rows were unpivoted from.
    span = rows.groupBy("feature").agg((F.min("value") - pad).alias("lo"), (F.max("value") + pad).alias("hi"))
    at = F.least(F.floor((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    counts = rows.join(F.broadcast(span), "feature").groupBy("feature", at.alias("bin")).agg(F.count_if(~F.col("is_cur")).alias("n_ref"), F.count_if("is_cur").alias("n_cur"))
    grid = span.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").fillna(0, ["n_ref", "n_cur"])


def psi_equal_width(long: DataFrame, ref: str, cur: str, bins: int = 10, least: int = 10) -> DataFrame:
    """(feature, psi) with add-one shares; 0 where the current group has fewer than ``least`` rows."""
    counts = equal_width_bins(long, ref, cur, bins)
    total = Window.partitionBy("feature")
    rows = counts.withColumns({"p": (F.col("n_ref") + 1) / (F.sum("n_ref").over(total) + bins), "q": (F.col("n_cur") + 1) / (F.sum("n_cur").over(total) + bins), "m": F.sum("n_cur").over(total)})
    return rows.groupBy("feature").agg(F.when(F.max("m") < least, 0.0).otherwise(F.sum(_psi(F.col("p"), F.col("q")))).alias("psi"))


def histogram(long: DataFrame, ref: str, cur: str, bins: int = 20) -> DataFrame:
    """(feature, bin, left, right, density_ref, density_cur) over equal bins, for display."""
    counts = equal_width_bins(long, ref, cur, bins)
    total = Window.partitionBy("feature")
    width = (F.col("hi") - F.col("lo")) / bins
    return counts.select("feature", "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
                         *[(F.col(f"n_{g}") / (F.greatest(F.sum(f"n_{g}").over(total), F.lit(1)) * width)).alias(f"density_{g}") for g in ("ref", "cur")])


def value_counts(long: DataFrame, ref: str, cur: str) -> DataFrame:
    """(feature, value, r, c) by distinct value, with r_upto, r_all, c_upto, c_all: what breaks and KS are read from."""
    rows = _pair(long, ref, cur)
    counts = rows.groupBy("feature", "value").agg(F.count_if(~F.col("is_cur")).alias("r"), F.count_if("is_cur").alias("c"))
    return ranks.running(counts, ["feature"], "value", ["r", "c"])


def _bin(breaks: Column, value: Column, bins: int) -> Column:
    """The bin of ``value`` between at most bins + 1 distinct ascending breaks, the outer ones open."""
    inside = [((F.size(breaks) - 1 > k) & (F.get(breaks, F.lit(k)) <= value)) for k in range(1, bins)]
    return sum((F.when(x, 1).otherwise(0) for x in inside), F.lit(0))


def _psi_of_bins(binned: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, psi, more) of (keys, bin, ok, r, c); shares clipped; 0 where not ok or where a side is empty."""
    total = Window.partitionBy(*keys)
    shares = binned.withColumns({"tr": F.sum("r").over(total), "tc": F.sum("c").over(total)})
    psi = F.sum(_psi(_clip(F.col("r") / F.greatest("tr", F.lit(1))), _clip(F.col("c") / F.greatest("tc", F.lit(1)))))
    return shares.groupBy(*keys).agg(F.when(F.bool_and("ok") & (F.min("tr") > 0) & (F.min("tc") > 0), psi).otherwise(0.0).alias("psi"), *more)


def _psi_and_ks(ranked: DataFrame, bins: int, least: int = 5) -> DataFrame:
    """(feature, psi, n_ref, n_cur, ks) of ``value_counts`` rows, which are read twice: for the breaks, and for the rest."""
    tenths = ranks.quantiles(ranked.where("r > 0"), ["feature"], "value", "r", [k / bins for k in range(bins + 1)])
    breaks = tenths.select("feature", F.array_distinct("q").alias("b"))
    # A row for each feature, that is, for each column of the table the rows were unpivoted from.
    rows = ranked.join(F.broadcast(breaks), "feature", "left").withColumn("b", F.coalesce("b", F.array().cast("array<double>")))
    binned = rows.groupBy("feature", _bin(F.col("b"), F.col("value"), bins).alias("bin"), (F.size("b") > 1).alias("ok")).agg(
        F.sum("r").alias("r"), F.sum("c").alias("c"), F.max(_gap()).alias("gap"), F.max("r_all").alias("n_ref"), F.max("c_all").alias("n_cur"))
    out = _psi_of_bins(binned, ["feature"], F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max("gap").alias("gap"))
    return out.withColumn("ks", F.when(F.least("n_ref", "n_cur") < least, 0.0).otherwise(F.col("gap"))).drop("gap")


def psi_quantile(long: DataFrame, ref: str, cur: str, bins: int = 10) -> DataFrame:
    """(feature, psi) over the reference's distinct quantile breaks, the outer ones open; shares clipped; 0 for fewer than
    two breaks or an empty group."""
    return _psi_and_ks(value_counts(long, ref, cur), bins).select("feature", "psi")


def moments(long: DataFrame, ref: str, cur: str) -> DataFrame:
    """(feature, n, mean, population sd and sample variance of each group), in one pass."""
    out = []
    for g, k in ((ref, "ref"), (cur, "cur")):
        v = F.when(F.col("grp") == g, F.col("value"))
        out += [F.count(v).alias(f"n_{k}"), F.avg(v).alias(f"mean_{k}"), F.stddev_pop(v).alias(f"sd_{k}"), F.var_samp(v).alias(f"var_{k}"), F.count_if(v == 1).alias(f"ones_{k}")]
    return long.where(F.col("grp").isin(ref, cur)).groupBy("feature").agg(*out)


def _binary_psi() -> Column:
    p, q = F.coalesce("mean_ref", F.lit(0.0)), F.coalesce("mean_cur", F.lit(0.0))
    both = _psi(_clip(p), _clip(q)) + _psi(_clip(1 - p), _clip(1 - q))
    return F.when((F.col("n_ref") > 0) & (F.col("n_cur") > 0), both).otherwise(0.0)


def psi_binary(long: DataFrame, ref: str, cur: str) -> DataFrame:
    """(feature, psi) of 0/1 features from the two shares."""
    return moments(long, ref, cur).select("feature", _binary_psi().alias("psi"))


def rate_shift(long: DataFrame, ref: str, cur: str) -> DataFrame:
    """(feature, rate_ref, rate_cur, shift, abs_shift, rel_shift)."""
    d = F.col("mean_cur") - F.col("mean_ref")
    return moments(long, ref, cur).select("feature", F.col("mean_ref").alias("rate_ref"), F.col("mean_cur").alias("rate_cur"), d.alias("shift"), F.abs(d).alias("abs_shift"), (F.abs(d) / (F.col("mean_ref") + 1e-6)).alias("rel_shift"))


def _gap() -> Column:
    return F.abs(F.col("r_upto") / F.greatest("r_all", F.lit(1)) - F.col("c_upto") / F.greatest("c_all", F.lit(1)))


def ks_two_sample(long: DataFrame, ref: str, cur: str, least: int = 5) -> DataFrame:
    """(feature, n_ref, n_cur, ks): largest distance of the two distribution functions. 0 where a group has fewer than
    ``least`` rows."""
    out = value_counts(long, ref, cur).groupBy("feature", F.col("r_all").alias("n_ref"), F.col("c_all").alias("n_cur")).agg(F.max(_gap()).alias("gap"))
    return out.select("feature", "n_ref", "n_cur", F.when(F.least("n_ref", "n_cur") < least, 0.0).otherwise(F.col("gap")).alias("ks"))


def ks_pvalues(ks: DataFrame, least: int = 5) -> DataFrame:
    """``ks`` with the asymptotic p-value; a row for each feature, so a plain scalar function will do."""
    f = F.udf(lambda d, n, m: 1.0 if min(n, m) < least else ks_pvalue(d, n, m), "double")
    return ks.withColumn("ks_p", f("ks", "n_ref", "n_cur"))


def _chi2() -> Column:
    a, b = F.col("ones_ref").cast("double"), (F.col("n_ref") - F.col("ones_ref")).cast("double")
    c, d = F.col("ones_cur").cast("double"), (F.col("n_cur") - F.col("ones_cur")).cast("double")
    n, margins = a + b + c + d, (a + b) * (c + d) * (a + c) * (b + d)
    gap = F.greatest(F.abs(a * d - b * c) - F.least(n / 2, F.abs(a * d - b * c)), F.lit(0.0))
    return F.when(margins > 0, n * gap * gap / margins)


def chi2_2x2(long: DataFrame, ref: str, cur: str) -> DataFrame:
    """(feature, chi2) of the 2 x 2 table of group and value, with Yates' correction; null for an empty margin."""
    return moments(long, ref, cur).select("feature", _chi2().alias("chi2"))


def chi2_pvalues(chi2: DataFrame) -> DataFrame:
    return chi2.withColumn("chi2_p", F.udf(chi2_pvalue, "double")("chi2"))


def _cohen_d() -> Column:
    squares = (F.col("n_ref") - 1) * F.col("var_ref") + (F.col("n_cur") - 1) * F.col("var_cur")
    pooled = F.sqrt(squares / F.greatest(F.col("n_ref") + F.col("n_cur") - 2, F.lit(1)))
    enough = (F.col("n_ref") >= 2) & (F.col("n_cur") >= 2) & (pooled >= 1e-9)
    return F.coalesce(F.when(enough, (F.col("mean_ref") - F.col("mean_cur")) / pooled), F.lit(0.0))


def cohen_d(long: DataFrame, ref: str, cur: str) -> DataFrame:
    """(feature, d): reference mean less current mean over the pooled sample deviation; 0 where that is under 1e-9 or a
    group has fewer than two rows."""
    return moments(long, ref, cur).select("feature", _cohen_d().alias("d"))


def severity(psi: Column) -> Column:
    return F.when(psi < 0.10, "stable").when(psi < 0.20, "minor").when(psi < 0.35, "moderate").otherwise("severe")


def severity_binary(abs_shift: Column, rel_shift: Column) -> Column:
    return F.when((abs_shift > 0.10) | (rel_shift > 0.40), "severe").when((abs_shift > 0.05) | (rel_shift > 0.20), "moderate").when(abs_shift > 0.02, "minor").otherwise("stable")


def audit(long: DataFrame, ref: str, cur: str, binary: list[str] = (), alpha: float = 0.05, least: int = 5) -> DataFrame:
    """One row for each feature with ``least`` rows or more in both groups: PSI (by kind), KS or chi-square, Cohen's d,
    means, shifts, severity, drifted and, with Bonferroni's correction, significant.

    Two aggregates read the rows: one takes all moments, the other counts distinct values, from which breaks, PSI and KS
    follow."""
    is_binary = F.col("feature").isin(list(binary)) if binary else F.lit(False)
    m = moments(long, ref, cur).where((F.col("n_ref") >= least) & (F.col("n_cur") >= least))
    both = ks_pvalues(_psi_and_ks(value_counts(long.where(~is_binary), ref, cur), 10, least)).select("feature", "psi", "ks", "ks_p")
    gap = F.abs(F.col("mean_cur") - F.col("mean_ref"))
    out = m.join(both.withColumnRenamed("psi", "_psi"), "feature", "left").withColumns({
        "psi": F.when(is_binary, _binary_psi()).otherwise(F.col("_psi")), "d": _cohen_d(), "chi2": F.when(is_binary, _chi2()),
        "kind": F.when(is_binary, "binary").otherwise("continuous"), "abs_shift": gap, "rel_shift": gap / (F.abs(F.col("mean_ref")) + 1e-6)})
    out = chi2_pvalues(out).withColumns({
        "severity": F.when(is_binary, severity_binary(F.col("abs_shift"), F.col("rel_shift"))).otherwise(severity(F.col("psi"))),
        "drifted": F.when(is_binary, (F.col("abs_shift") > 0.05) | (F.col("rel_shift") > 0.20)).otherwise(F.col("psi") > 0.20)})
    p = F.coalesce("ks_p", "chi2_p")
    tests = F.count(p).over(Window.partitionBy(F.lit(1)))  # a row for each feature
    out = out.withColumns({"significant": F.coalesce(p < alpha / tests, F.lit(False)), "drift_score": F.when(is_binary, F.col("abs_shift")).otherwise(F.col("psi"))})
    return out.select("feature", "n_ref", "n_cur", "mean_ref", "mean_cur", "sd_ref", "sd_cur", "psi", "d", "ks", "ks_p", "chi2", "chi2_p",
                      "kind", "abs_shift", "rel_shift", "severity", "drifted", "significant", "drift_score")


def audit_table(long: DataFrame, train: str, pre: str, post: str, binary: list[str] = ()) -> DataFrame:
    """The audit of train against post, with psi_train_pre, psi_pre_post and mean_pre of the same features; null where
    ``pre`` lacks rows."""
    def psi(a: str, b: str, name: str, *more: str) -> DataFrame:
        return audit(long, a, b, binary).select("feature", F.col("psi").alias(name), *[F.col(c).alias(f"{c[:-4]}_pre") for c in more])

    out = audit(long, train, post, binary).withColumnRenamed("psi", "psi_train_post")
    return out.join(psi(train, pre, "psi_train_pre", "mean_cur"), "feature", "left").join(psi(pre, post, "psi_pre_post"), "feature", "left")


def summary(audited: DataFrame) -> DataFrame:
    """One row: features, drifted ones, mean PSI and the overall severity."""
    out = audited.agg(F.count("*").alias("n_features"), F.count_if("drifted").alias("n_drifted"), F.count_if("significant").alias("n_significant"), F.avg("psi").alias("mean_psi"), F.max("psi").alias("max_psi"))
    return out.withColumn("level", severity(F.col("mean_psi")))


def top_features(audited: DataFrame, k: int = 15) -> DataFrame:
    return audited.orderBy(F.desc("drift_score"), "feature").limit(k)


def decide(audited: DataFrame, n_stays: int, least: int = 50) -> DataFrame:
    """One row: whether anything drifted, given enough stays."""
    return audited.agg(F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("any_drift")).select((F.col("any_drift") & F.lit(n_stays > least)).alias("drift"))


def combine_importance(audited: DataFrame, importance: DataFrame, k: int = 15) -> DataFrame:
    """The features with the largest importance * drift score."""
    out = audited.join(importance, "feature").withColumn("combined", F.col("importance") * F.col("drift_score"))
    return out.orderBy(F.desc("combined"), "feature").limit(k)


def consecutive_pairs(df: DataFrame, era: str = "era") -> DataFrame:
    """(era, next_era) of eras in order; a row for each era."""
    return df.select(era).distinct().select(F.col(era).alias("era"), F.lead(era).over(Window.orderBy(era)).alias("next_era")).where("next_era is not null")


def scan_eras(long: DataFrame, k: float = 2.0, train: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(era, next_era, distance, threshold, drift) over consecutive eras, ``grp`` being the era: mean PSI over features, held
    against ``k`` times the largest distance within the training eras (the first pair if none are named).

    One aggregate counts distinct values by feature and era; each era's breaks bin its own counts and the next era's."""
    counts = long.groupBy("feature", "grp", "value").agg(F.count("*").alias("n"))
    ranked = ranks.running(counts, ["feature", "grp"], "value", ["n"])
    tenths = ranks.quantiles(ranked, ["feature", "grp"], "value", "n", [j / bins for j in range(bins + 1)])
    pairs = consecutive_pairs(long, "grp").select(F.col("era").alias("e"), F.col("next_era").alias("f"))  # a handful of eras
    breaks = tenths.join(F.broadcast(pairs), F.col("grp") == F.col("e")).select(F.col("feature").alias("g"), "e", "f", F.array_distinct("q").alias("b"))
    hits = (F.col("feature") == F.col("g")) & ((F.col("grp") == F.col("e")) | (F.col("grp") == F.col("f")))
    rows = counts.join(F.broadcast(breaks), hits)  # a row of breaks for each feature and era
    own = F.col("grp") == F.col("e")
    binned = rows.groupBy("feature", "e", "f", _bin(F.col("b"), F.col("value"), bins).alias("bin"), (F.size("b") > 1).alias("ok")).agg(
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("r"), F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("c"))
    out = _psi_of_bins(binned, ["feature", "e", "f"]).groupBy(F.col("e").alias("era"), F.col("f").alias("next_era")).agg(F.avg("psi").alias("distance"))
    return _with_threshold(out, k, train)


def _with_threshold(out: DataFrame, k: float, train: list[str] | None) -> DataFrame:
    """``out`` (era, next_era, distance) with the threshold and whether the distance is beyond it."""
    if train is None:
        limit = out.agg((F.lit(k) * F.min_by("distance", "era")).alias("threshold"))
    else:
        limit = out.where(F.col("era").isin(train) & F.col("next_era").isin(train)).agg((F.lit(k) * F.max("distance")).alias("threshold"))
    return out.crossJoin(F.broadcast(limit)).withColumn("drift", F.col("distance") > F.col("threshold"))  # one row


def onset(scanned: DataFrame) -> DataFrame:
    """The first era that drifted from the one before, one row at most."""
    return scanned.where("drift").orderBy("next_era").limit(1).select(F.col("next_era").alias("onset"))


def performance_gate(aurocs: DataFrame, train_era: str, drop: float = 0.02) -> DataFrame:
    """(era, gated): eras where at least one label's AUROC fell by more than ``drop`` from the training era's."""
    base = aurocs.where(F.col("era") == train_era).select("label", F.col("auroc").alias("base"))
    return aurocs.join(base, "label").groupBy("era").agg(F.bool_or(F.col("base") - F.col("auroc") > drop).alias("gated"))


def narrative(audited: DataFrame, ref: str, cur: str, k: int = 5) -> DataFrame:
    """(rank, line): what changed most, in words."""
    top = top_features(audited.where("drifted"), k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("drift_score"), "feature")))  # k rows
    up = F.when(F.col("mean_cur") >= F.col("mean_ref"), "increased").otherwise("decreased")
    rate = F.format_string("%s: usage %s by %.1f%% between " + f"{ref} and {cur}", "feature", up, 100 * F.col("abs_shift"))
    level = F.format_string("%s: mean %s from %.2f to %.2f between " + f"{ref} and {cur} (PSI %.2f, %s)", "feature", up, "mean_ref", "mean_cur", "psi", "severity")
    return top.select("rank", F.when(F.col("kind") == "binary", rate).otherwise(level).alias("line"))


#: Parameter of the sketches that eras are kept as (larger is more exact and takes more room), and the number of evenly
#: spaced quantiles that stand for an era when two are compared.
SKETCH, POINTS = 4096, 2048


def rank_error(size: int = SKETCH, points: int = POINTS) -> float:
    """How far a compared share of values is off, at most, in 99 of 100 cases: the published fit for this kind of sketch, and
    half the distance of two quantiles."""
    return 2.296 / size**0.9021 + 0.5 / points


def era_sketches(long: DataFrame, size: int = SKETCH) -> DataFrame:
    """(feature, grp, n, sketch): a mergeable quantile sketch for each feature and era, from one pass over the rows. Kept as a
    table, it answers every later comparison of eras without the rows; the sketch of a new era is a row more."""
    values = F.col("value").cast("double")
    return long.groupBy("feature", "grp").agg(F.count("value").alias("n"), F.kll_sketch_agg_double(values, F.lit(size)).alias("sketch"))


def merged_eras(sketches: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """``sketches`` of groups of eras: each group's sketches become one, under the group's name."""
    name = F.create_map(*[F.lit(x) for g, eras in groups.items() for e in eras for x in (e, g)])[F.col("grp")]
    known = sketches.withColumn("grp", name).where("grp is not null")
    return known.groupBy("feature", "grp").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def compare_sketches(pairs: DataFrame, bins: int = 10, points: int = POINTS) -> DataFrame:
    """``pairs`` (ref and cur sketches in columns ``_r`` and ``_c``) with psi over the reference's distinct quantile breaks and
    ks at a quarter of the quantiles of either side; shares within rank_error of the exact ones."""
    def quantiles(sketch: str, shares: list[float]) -> Column:
        return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(s) for s in shares]))

    middles = [(k + 0.5) / points for k in range(points)]
    out = pairs.withColumns({"_b": F.array_distinct(quantiles("_r", [k / bins for k in range(bins + 1)])), "_r": quantiles("_r", middles), "_c": quantiles("_c", middles)})

    def below(grid: str, at: Column, reached: bool = False) -> Column:
        return F.size(F.filter(grid, lambda x: x <= at if reached else x < at)) / F.lit(float(points))

    def shares(grid: str) -> Column:
        edges = F.transform(F.slice("_b", 2, F.greatest(F.size("_b") - 2, F.lit(0))), lambda b: below(grid, b))
        return F.zip_with(F.concat(edges, F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), edges), lambda high, low: high - low)

    psi = F.aggregate(F.zip_with(shares("_r"), shares("_c"), lambda p, q: _psi(_clip(p), _clip(q))), F.lit(0.0), lambda s, x: s + x)
    some = F.array_union(*[F.filter(g, lambda x, k: k % 4 == 0) for g in ("_r", "_c")])
    gaps = F.transform(some, lambda g: F.abs(below("_r", g, True) - below("_c", g, True)))
    out = out.withColumns({"psi": F.when(F.size("_b") > 1, psi).otherwise(0.0), "ks": F.array_max(gaps)})
    return out.drop("_r", "_c", "_b")


def scan_sketches(sketches: DataFrame, k: float = 2.0, train: list[str] | None = None, bins: int = 10) -> DataFrame:
    """(era, next_era, distance, threshold, drift) as ``scan_eras`` has it, from the sketches of each era alone."""
    pairs = consecutive_pairs(sketches, "grp").select(F.col("era").alias("e"), F.col("next_era").alias("f"))
    ref = sketches.select(F.col("grp").alias("e"), "feature", F.col("sketch").alias("_r"))
    cur = sketches.select(F.col("grp").alias("f"), "feature", F.col("sketch").alias("_c"))
    out = compare_sketches(ref.join(pairs, "e").join(cur, ["f", "feature"]), bins)
    out = out.groupBy(F.col("e").alias("era"), F.col("f").alias("next_era")).agg(F.avg("psi").alias("distance"))
    return _with_threshold(out, k, train)
