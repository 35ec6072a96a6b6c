"""Attribution tables (id, label, model, feature, value): shifts between models, by feature and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name
from . import ranks


def tag_stream(feature: Column, treatment: list[str]) -> Column:
    """"treat" for the features of the treatment stream, by base name, else "physio"."""
    return F.when(base_name(feature).isin(list(treatment)), "treat").otherwise("physio")


def population_mean(attr: DataFrame) -> DataFrame:
    """(model, label, feature, phi): mean absolute attribution."""
    return attr.groupBy("model", "label", "feature").agg(F.avg(F.abs("value")).alias("phi"))


def delta(attr: DataFrame, source: str, adapted: str, stream: Column | None = None) -> DataFrame:
    """(label, feature, phi_source, phi_adapted, delta, stream), without a join."""
    def phi(m: str) -> Column:
        return F.avg(F.when(F.col("model") == m, F.abs("value")))

    out = attr.where(F.col("model").isin(source, adapted)).groupBy("label", "feature").agg(phi(source).alias("phi_source"), phi(adapted).alias("phi_adapted"))
    return out.withColumns({"delta": F.col("phi_adapted") - F.col("phi_source"), "stream": stream if stream is not None else F.lit("physio")})


def top_shifts(deltas: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("label", "stream").orderBy(F.desc(F.abs("delta")), "feature")
    return deltas.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stream_summary(deltas: DataFrame) -> DataFrame:
    """(label, stream, n, up, down, mean absolute delta); with interval columns low and high, up and down count the features
    whose interval lies above or below 0."""
    up, down = (F.col("low") > 0, F.col("high") < 0) if "low" in deltas.columns else (F.col("delta") > 0, F.col("delta") < 0)
    return deltas.groupBy("label", "stream").agg(F.count("*").alias("n"), F.count_if(up).alias("up"), F.count_if(down).alias("down"), F.avg(F.abs("delta")).alias("mean_abs_delta"))


def normalized_delta(attr: DataFrame, source: str, adapted: str) -> DataFrame:
    """(id, label, feature, shift): each row's change over the 95th percentile of absolute source attributions of its label,
    1e-6 at least."""
    pairs = attr.groupBy("id", "label", "feature").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(c) for m, c in ((source, "s"), (adapted, "a"))])
    sizes = attr.where(F.col("model") == source).select("label", F.abs("value").alias("size"))
    scale = ranks.exact_quantiles(sizes, ["label"], "size", [0.95]).select("label", F.greatest(F.col("q")[0], F.lit(1e-6)).alias("scale"))
    return pairs.join(F.broadcast(scale), "label").select("id", "label", "feature", ((F.col("a") - F.col("s")) / F.col("scale")).alias("shift"))  # one row for each label


def largest_shift(shifts: DataFrame) -> DataFrame:
    """(id, label, feature, shift): where each case changed most."""
    return shifts.groupBy("id", "label").agg(F.max_by(F.struct("feature", "shift"), F.struct(F.abs("shift"), "feature")).alias("b")).select("id", "label", "b.*")


def collapse_base(deltas: DataFrame) -> DataFrame:
    """(label, feature, delta): statistics of one base feature become one, the largest."""
    return deltas.groupBy("label", base_name(F.col("feature")).alias("feature")).agg(F.max("delta").alias("delta"))


def case_mass(attr: DataFrame, stream: Column) -> DataFrame:
    """(id, label, model, stream, mass): mean absolute attribution of each case."""
    return attr.withColumn("stream", stream).groupBy("id", "label", "model", "stream").agg(F.avg(F.abs("value")).alias("mass"))


def mass_delta(masses: DataFrame, source: str) -> DataFrame:
    """``masses`` of the other models with the absolute difference to the source's."""
    s = masses.where(F.col("model") == source).select("id", "label", "stream", F.col("mass").alias("_s"))
    return masses.where(F.col("model") != source).join(s, ["id", "label", "stream"]).withColumn("mass_delta", F.abs(F.col("mass") - F.col("_s"))).drop("_s")


def top_features(attr: DataFrame, stream: Column, k: dict[str, int], positive_only: bool = False) -> DataFrame:
    """(id, label, model, stream, feature, value, rank): each case's strongest features by stream."""
    w = Window.partitionBy("id", "label", "model", "stream").orderBy(F.desc(F.abs("value")), "feature")
    rows = attr.withColumn("stream", stream)
    rows = rows.where("value > 0") if positive_only else rows
    most = F.coalesce(*[F.when(F.col("stream") == s, n) for s, n in k.items()], F.lit(0))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def ablation_importance(df: DataFrame, features: list[str], score, id_col: str = "id") -> DataFrame:
    """(feature, importance): mean absolute change of the score when one feature is replaced by its mean, over the largest.

    ``score`` maps a DataFrame with the feature columns to the same with a column ``score``. All ablations are scored in one
    pass over exploded rows.
    """
    means = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in features])
    wide = df.select(id_col, *features).crossJoin(F.broadcast(means))  # one row
    which = wide.withColumn("ablated", F.explode(F.array(F.lit(""), *[F.lit(c) for c in features])))
    rows = which.select(id_col, "ablated", *[F.when(F.col("ablated") == c, F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) for c in features])
    scored = score(rows).select(id_col, "ablated", "score")
    base = scored.where("ablated = ''").select(id_col, F.col("score").alias("_s"))
    out = scored.where("ablated <> ''").join(base, id_col).groupBy(F.col("ablated").alias("feature")).agg(F.avg(F.abs(F.col("score") - F.col("_s"))).alias("raw"))
    top = F.max("raw").over(Window.partitionBy(F.lit(1)))  # a row for each feature
    return out.select("feature", "raw", (F.col("raw") / F.greatest(top, F.lit(1e-12))).alias("importance"))


def weight_delta(weights: DataFrame) -> DataFrame:
    """(layer, l2, relative, cosine) from (layer, i, before, after)."""
    b, a = F.col("before"), F.col("after")
    out = weights.groupBy("layer").agg(F.sqrt(F.sum((a - b) ** 2)).alias("l2"), F.sqrt(F.sum(b * b)).alias("nb"), F.sqrt(F.sum(a * a)).alias("na"), F.sum(a * b).alias("ab"))
    return out.select("layer", "l2", (F.col("l2") / F.greatest("nb", F.lit(1e-12))).alias("relative"), (F.col("ab") / F.greatest(F.col("na") * F.col("nb"), F.lit(1e-12))).alias("cosine"))


def weight_groups(deltas: DataFrame, group: Column) -> DataFrame:
    return deltas.groupBy(group.alias("grp")).agg(F.avg("relative").alias("mean_relative"), F.max("relative").alias("max_relative"))


def linear_attribution(df: DataFrame, coefficients: dict[str, float], baseline: dict[str, float] | None = None, id_col: str = "id") -> DataFrame:
    """(id, feature, value): coefficient * (x - baseline), which integrated gradients are for a linear model."""
    base = baseline or {}
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - F.lit(float(base.get(c, 0.0))))).alias("value")) for c, w in coefficients.items()])).alias("r")
    return df.select(id_col, rows).select(id_col, "r.*")
