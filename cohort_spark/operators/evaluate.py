"""Model evaluation over long predictions (id, split, label, model, y, prob), all groups in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

KEYS = ["model", "label"]


def to_long_predictions(wide: DataFrame, ids: list[str], models: list[str]) -> DataFrame:
    """One row for each model, from a column for each."""
    return wide.unpivot(ids, models, "model", "prob")


def _cumulative(df: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Per distinct score, descending: positives and negatives at it (p, n), up to it (tp, fp) and in all (np, nn)."""
    w = F.col(weight) if weight else F.lit(1)
    known = df.where("prob is not null and y is not null")
    counts = known.groupBy(*keys, "prob").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0).otherwise(w)).alias("n"))
    out = ranks.running(counts, list(keys), "prob", ["p", "n"], descending=True)
    return out.withColumnsRenamed({"p_upto": "tp", "n_upto": "fp", "p_all": "np", "n_all": "nn"})


def auroc(df: DataFrame, keys: list[str] = KEYS, weight: str | None = None) -> DataFrame:
    """(keys, auroc) with ties counted half; null where one class is missing."""
    c = _cumulative(df, keys, weight)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return c.groupBy(*keys).agg(F.when((F.max("np") > 0) & (F.max("nn") > 0), area / (F.max("np") * F.max("nn"))).alias("auroc"))


def average_precision(df: DataFrame, keys: list[str] = KEYS, weight: str | None = None) -> DataFrame:
    """(keys, ap): the step sum of precision over recall gains, ties as one step; null without positives."""
    c = _cumulative(df, keys, weight)
    return c.groupBy(*keys).agg(F.when(F.max("np") > 0, F.sum(F.when(F.col("p") > 0, F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)) / F.max("np")).alias("ap"))


def brier(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col("prob") - F.col("y")) ** 2).alias("brier"))


def metrics(df: DataFrame, keys: list[str] = ("split", "model", "label")) -> DataFrame:
    """(keys, n, n_pos, auroc, ap, brier)."""
    keys = list(keys)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"), F.avg((F.col("prob") - F.col("y")) ** 2).alias("brier"))
    return out.join(auroc(df, keys), keys).join(average_precision(df, keys), keys)


def _rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    one = F.lit(1)
    sens, prec = tp / F.greatest(tp + fn, one), tp / F.greatest(tp + fp, one)
    return {"sensitivity": sens, "specificity": tn / F.greatest(tn + fp, one), "precision": prec, "f1": 2 * prec * sens / F.greatest(prec + sens, F.lit(1e-9))}


def confusion(df: DataFrame, threshold: float = 0.5, keys: list[str] = KEYS) -> DataFrame:
    return threshold_sweep(df, [threshold], keys)


def threshold_sweep(df: DataFrame, thresholds=(0.3, 0.4, 0.5, 0.6, 0.7), keys: list[str] = KEYS) -> DataFrame:
    """(keys, tau, tp, fp, tn, fn and rates) at each threshold, in one pass: conditional counts, then a short unpivot."""
    hit, pos = {k: F.col("prob") >= t for k, t in enumerate(thresholds)}, F.col("y") == 1
    counts = [x for k in hit for x in (F.count_if(hit[k] & pos).alias(f"tp{k}"), F.count_if(hit[k] & ~pos).alias(f"fp{k}"), F.count_if(~hit[k] & ~pos).alias(f"tn{k}"), F.count_if(~hit[k] & pos).alias(f"fn{k}"))]
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), *[F.col(f"{c}{k}").alias(c) for c in ("tp", "fp", "tn", "fn")]) for k, t in enumerate(thresholds)])).alias("r")
    out = df.groupBy(*keys).agg(*counts).select(*keys, rows).select(*keys, "r.*")
    return out.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def summary_table(table: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """A row for each model and a column for each label."""
    return table.groupBy("model").pivot("label", labels).agg(F.first(value))


def wide_models(df: DataFrame, models: list[str]) -> DataFrame:
    """(id, label, y, a column for each model): one shuffle for all pairs of models."""
    return df.groupBy("id", "label").agg(F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("prob"))).alias(m) for m in models])


def _pairs(df: DataFrame, pairs: list[tuple[str, str]], thresholds: list[tuple[float, float]], rows: str) -> DataFrame:
    models = sorted({m for p in pairs for m in p})
    cases = F.array(*[F.struct(F.lit(x).alias("model_x"), F.lit(y).alias("model_y"), F.lit(float(hi)).alias("hi"), F.lit(float(lo)).alias("lo"), F.col(x).alias("px"), F.col(y).alias("py")) for x, y in pairs for hi, lo in thresholds])
    return wide_models(df, models).where(rows).select("label", F.explode(cases).alias("c")).select("label", "c.*")


def disagreement(df: DataFrame, pairs: list[tuple[str, str]], thresholds: list[tuple[float, float]] = ((0.5, 0.1),)) -> DataFrame:
    """On positives, for each pair of models and (hi, lo): x catches what y misses, the reverse, both at or above hi, both
    below it; asymmetry is infinite if the reverse is 0, NaN without positives."""
    x, y, hi, lo = F.col("px"), F.col("py"), F.col("hi"), F.col("lo")
    out = _pairs(df, pairs, thresholds, "y = 1").groupBy("label", "model_x", "model_y", "hi", "lo").agg(
        F.count("*").alias("n"), F.count_if((x >= hi) & (y < lo)).alias("x_catch"), F.count_if((y >= hi) & (x < lo)).alias("y_catch"),
        F.count_if((x >= hi) & (y >= hi)).alias("both_high"), F.count_if((x < hi) & (y < hi)).alias("both_low"))
    asym = F.when(F.col("n") == 0, float("nan")).when(F.col("y_catch") == 0, float("inf")).otherwise(F.col("x_catch") / F.when(F.col("y_catch") > 0, F.col("y_catch")))
    return out.withColumn("asymmetry", asym)


def false_alarms(df: DataFrame, pairs: list[tuple[str, str]], thresholds: list[tuple[float, float]] = ((0.5, 0.1),)) -> DataFrame:
    """The same on negatives: who alarms alone, both, neither."""
    x, y, hi, lo = F.col("px"), F.col("py"), F.col("hi"), F.col("lo")
    return _pairs(df, pairs, thresholds, "y = 0").groupBy("label", "model_x", "model_y", "hi", "lo").agg(
        F.count("*").alias("n"), F.count_if((x >= hi) & (y < lo)).alias("x_alarm"), F.count_if((y >= hi) & (x < lo)).alias("y_alarm"),
        F.count_if((x >= hi) & (y >= hi)).alias("both_alarm"), F.count_if((x < hi) & (y < hi)).alias("neither"))


def check_alignment(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: ids of one model only, and ids on which the two models' labels differ; zeros if aligned."""
    a = df.where(F.col("model") == x).select("id", "label", F.col("y").alias("ya"))
    b = df.where(F.col("model") == y).select("id", "label", F.col("y").alias("yb"))
    return a.join(b, ["id", "label"], "full").agg(F.count_if(F.col("yb").isNull()).alias("only_x"), F.count_if(F.col("ya").isNull()).alias("only_y"), F.count_if(F.col("ya") != F.col("yb")).alias("label_differs"))


def worked_examples(df: DataFrame, x: str, y: str, hi: float = 0.5, lo: float = 0.1) -> DataFrame:
    """(label, kind, id, px, py) of positives: "largest_gap", where x exceeds y most; "both_catch", both at ``hi`` or above
    with the largest sum; "only_x", x at ``hi`` or above and y under ``lo``, with the largest gap. The smaller id of equals;
    a kind without a case has no row."""
    rows = wide_models(df, [x, y]).where("y = 1").select("label", "id", F.col(x).alias("px"), F.col(y).alias("py")).where("px is not null and py is not null")
    px, py = F.col("px"), F.col("py")
    kinds = {"largest_gap": (F.lit(True), px - py), "both_catch": ((px >= hi) & (py >= hi), px + py), "only_x": ((px >= hi) & (py < lo), px - py)}
    best = [F.max_by(F.struct(F.lit(k).alias("kind"), "id", "px", "py"), F.when(ok, F.struct(by.alias("s"), (-F.col("id")).alias("i")))).alias(k) for k, (ok, by) in kinds.items()]
    return rows.groupBy("label").agg(*best).select("label", F.explode(F.array(*kinds)).alias("b")).where("b is not null").select("label", "b.*")


def wording(delta: Column) -> Column:
    return F.when(delta.isNull(), "n/a").when(F.abs(delta) < 0.005, "negligible").when(F.abs(delta) < 0.015, "small").when(F.abs(delta) < 0.03, "moderate").otherwise("large")


def gains(table: DataFrame, base: str, metric: str = "auroc", keys: list[str] = ("label",)) -> DataFrame:
    """(keys, model, delta, size in words, improved): metric differences to the base model."""
    keys = list(keys)
    b = table.where(F.col("model") == base).select(*keys, F.col(metric).alias("_b"))
    d = F.col(metric) - F.col("_b")
    return table.where(F.col("model") != base).join(b, keys).select(*keys, "model", d.alias("delta"), wording(d).alias("size"), (d > 0).alias("improved"))


def macro_gains(gained: DataFrame) -> DataFrame:
    return gained.groupBy("model").agg(F.avg("delta").alias("mean_delta"), F.max("delta").alias("max_delta"), F.count_if("improved").alias("n_improved"))


def winners(table: DataFrame, metric: str = "auroc", order: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """(label, winner): the best model; of equal ones the first in ``order``."""
    rank = F.coalesce(*[F.when(F.col("model") == m, -k) for k, m in enumerate(order)])
    return table.where(F.col("model").isin(list(order))).groupBy("label").agg(F.max_by("model", F.struct(F.col(metric), rank)).alias("winner"))


def seed_summary(runs: DataFrame, metric: str = "auroc", keys: list[str] = KEYS) -> DataFrame:
    """(keys, mean, sd, median_seed) over the seeds of a run; the median is the lower middle one."""
    w = Window.partitionBy(*keys)
    ranked = runs.withColumns({"_r": F.row_number().over(w.orderBy(metric, "seed")), "_n": F.count("*").over(w)})
    return ranked.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.max(F.when(F.col("_r") == F.floor((F.col("_n") + 1) / 2), F.col("seed"))).alias("median_seed"))
