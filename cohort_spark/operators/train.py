"""Spark ML jobs: class weights, boosted trees, scoring, external models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pos_weights(df: DataFrame, labels: list[str], cap: float = 20.0) -> DataFrame:
    """(label, n_pos, n_neg, weight): negatives over positives, within [1, cap]."""
    sums = df.agg(*[x for c in labels for x in (F.sum((F.col(c) == 1).cast("long")).alias(f"p_{c}"), F.sum((F.col(c) == 0).cast("long")).alias(f"n_{c}"))])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"p_{c}").alias("n_pos"), F.col(f"n_{c}").alias("n_neg")) for c in labels])).alias("r")).select("r.*")
    return rows.withColumn("weight", F.least(F.greatest(F.col("n_neg") / (F.col("n_pos") + 1e-6), F.lit(1.0)), F.lit(float(cap))))


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    clean = df.withColumns({c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(0.0)) for c in features})
    return VectorAssembler(inputCols=features, outputCol="_features").transform(clean)


#: Rounds of boosting after which the running errors are written to the checkpoint folder, so that a lost executor costs
#: these rounds and the lineage doesn't grow with the number of trees.
CHECKPOINT_ROUNDS = 10


def _checkpoints(spark) -> None:
    """Name the session's shared folder to Spark's reliable checkpoints, unless they have one."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(f"{folder}/boosting")


def bounded(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those of the least hash of their keys: the same in every run, whatever the size of the table. A
    model may learn from such a sample; it is scored on all rows."""
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(most)


def fit_gbt(train: DataFrame, val: DataFrame, features: list[str], label: str, cap: float = 20.0, trees: int = 300, depth: int = 6, seed: int = 42, tol: float = 0.0):
    """Boosted trees with a capped weight for positives. Boosting ends once the loss on the validation rows no longer falls, or
    by less than ``tol`` of itself, at ``trees`` at the latest: ``model.getNumTrees`` says where."""
    from pyspark.ml.classification import GBTClassifier

    _checkpoints(train.sparkSession)
    weight = pos_weights(train, [label], cap).first()["weight"]
    rows = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)), allowMissingColumns=True)
    rows = _vectors(rows, features).withColumns({"_w": F.when(F.col(label) == 1, float(weight)).otherwise(1.0), "_y": F.col(label).cast("double")})
    return GBTClassifier(featuresCol="_features", labelCol="_y", weightCol="_w", validationIndicatorCol="_val", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed,
                         validationTol=tol, checkpointInterval=CHECKPOINT_ROUNDS).fit(rows)


def stage_losses(model, df: DataFrame, features: list[str], label: str) -> list[float]:
    """Mean loss on ``df`` of the first tree, the first two, and so on, all stages in one pass: where more trees stop helping
    on rows that weren't learned from."""
    rows = _vectors(df, features).withColumns({"_y": F.col(label).cast("double"), "_w": F.lit(1.0)})
    return [float(x) for x in model.evaluateEachIteration(rows)]


def fit_adapted(buffer: DataFrame, new_train: DataFrame, val: DataFrame, features: list[str], label: str, cap: float = 15.0, **options):
    """The same over the replay buffer and the new era's rows."""
    return fit_gbt(buffer.unionByName(new_train, allowMissingColumns=True), val, features, label, cap, **options)


def score(model, df: DataFrame, features: list[str], label: str, name: str, id_col: str = "stay_id") -> DataFrame:
    """Long predictions (id, label, model, y, prob)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_vectors(df, features))
    return out.select(F.col(id_col).alias("id"), F.lit(label).alias("label"), F.lit(name).alias("model"), F.col(label).cast("int").alias("y"), vector_to_array("probability")[1].alias("prob"))


def score_with(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], columns: list[str], into: str = "prob") -> DataFrame:
    """``df`` with the result of an external model that maps batches of ``columns`` to numbers."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(predict(pd.concat(series, axis=1, keys=columns)), dtype="float64")

    return df.withColumn(into, run(*[F.col(c) for c in columns]))
