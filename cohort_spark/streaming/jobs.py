"""Structured Streaming: bucketed channels with late data, and a drift monitor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.channels import Channel, channel_expr


def hourly_channels(stream: DataFrame, channels: list[Channel], key: str = "stay_id", time: str = "charttime", item: str = "itemid", value: str = "valuenum", bucket: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, start, a column for each channel, n_rows) by tumbling buckets; rows later than the watermark are left out.
    n_rows counts the rows that made it."""
    kinds = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}
    rows = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = rows.groupBy(key, F.window("_t", bucket)).agg(*[kinds[c.agg](channel_expr([c], F.col(item), F.col(value))).alias(c.name) for c in channels], F.count("*").alias("n_rows"))
    return out.select(key, F.col("window.start").alias("start"), *[c.name for c in channels], "n_rows")


def start_channels(stream: Callable[[], DataFrame], channels: list[Channel], folder: str, key: str = "stay_id", time: str = "charttime", bucket: str = "1 hour", late: str = "2 hours", trigger: dict | None = None, **names):
    """Start two queries over the feed that ``stream`` opens: finished buckets are appended to ``folder``/buckets, and the
    numbers of rows that came for each bucket to ``folder``/arrivals, one part for each batch that a replay overwrites. Both
    go on from their checkpoints in ``folder`` when they are started again."""
    how = trigger or {"availableNow": True}
    done = hourly_channels(stream(), channels, key, time, bucket=bucket, late=late, **names)
    buckets = done.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/buckets").option("checkpointLocation", f"{folder}/checkpoints/buckets").trigger(**how).start()

    def count(rows: DataFrame, batch: int) -> None:
        found = rows.groupBy(key, F.window(F.col(time).cast("timestamp"), bucket).alias("w")).agg(F.count("*").alias("n"))
        found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n").write.mode("overwrite").parquet(f"{folder}/arrivals/batch={batch}")

    arrivals = stream().writeStream.foreachBatch(count).option("checkpointLocation", f"{folder}/checkpoints/arrivals").trigger(**how).start()
    return buckets, arrivals


def late_rows(spark: SparkSession, folder: str, key: str = "stay_id") -> DataFrame:
    """(key, start, n_late): rows that came after their bucket was closed, from what arrived and what finished buckets hold.
    Buckets up to the end of the last finished one are closed; later ones may still be open and aren't listed."""
    came = spark.read.parquet(f"{folder}/arrivals").groupBy(key, "start", "end").agg(F.sum("n").alias("n"))
    done = spark.read.parquet(f"{folder}/buckets").select(key, "start", "n_rows")
    last = came.join(done, [key, "start"], "left_semi").agg(F.max("end").alias("_last"))
    out = came.join(F.broadcast(last), F.col("end") <= F.col("_last")).join(done, [key, "start"], "left")  # one row
    return out.select(key, "start", (F.col("n") - F.coalesce("n_rows", F.lit(0))).alias("n_late")).where("n_late > 0")


def bin_counts(stream: DataFrame, breaks: DataFrame) -> DataFrame:
    """(feature, bin, n): running counts of a stream (feature, value) in fixed bins, (feature, breaks array). The state is
    bounded by features times bins."""
    at = F.size(F.filter("breaks", lambda b: b <= F.col("value")))
    return stream.join(breaks, "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("n"))


def psi_of_counts(counts: DataFrame, reference: DataFrame, clip: float = 1e-6) -> DataFrame:
    """(feature, psi) of running counts against reference counts (feature, bin, n)."""
    both = reference.select("feature", "bin", F.col("n").alias("r")).join(counts.select("feature", "bin", F.col("n").alias("c")), ["feature", "bin"], "full").fillna(0, ["r", "c"])
    w = Window.partitionBy("feature")

    def share(c: str):
        return F.least(F.greatest(F.col(c) / F.greatest(F.sum(c).over(w), F.lit(1)), F.lit(clip)), F.lit(1 - clip))

    rows = both.withColumns({"p": share("r"), "q": share("c")})
    return rows.groupBy("feature").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


#: Versions of the counts that are kept.
KEPT = 3


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions in ``folder``, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(path):
        return []
    names = [f.getPath().getName() for f in files.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def merge_counts(changed: DataFrame, batch: int, folder: str) -> DataFrame:
    """All counts (feature, bin, n) after ``batch``: the last version before it with the changed rows in place of theirs,
    written as that batch's version. A batch that comes again starts from the same version and writes the same rows."""
    spark = changed.sparkSession
    versions = _versions(spark, folder)
    before = [v for v in versions if v < batch]
    rows = changed.select("feature", F.col("bin").cast("int").alias("bin"), F.col("n").cast("long").alias("n"))
    if before:
        old = spark.read.schema(rows.schema).parquet(f"{folder}/v={before[-1]:012d}")
        rows = old.join(rows, ["feature", "bin"], "left_anti").unionByName(rows)
    path = f"{folder}/v={batch:012d}"
    rows.write.mode("overwrite").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for v in before[: -KEPT + 1]:
        hadoop(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop(f"{folder}/v={v:012d}"), True)
    return spark.read.schema("feature string, bin int, n long").parquet(path)


def drift_monitor(stream: DataFrame, breaks: DataFrame, reference: DataFrame, on_psi: Callable[[DataFrame, int], None], checkpoint: str, counts: str | None = None, trigger: dict | None = None):
    """Start a query that hands the current PSI of each feature to ``on_psi`` after every batch. Only the counts that a batch
    changes leave the state; they are merged into the table of counts, ``counts`` or beside the checkpoint."""
    table = counts or f"{checkpoint}_counts"

    def batch(changed: DataFrame, n: int) -> None:
        on_psi(psi_of_counts(merge_counts(changed, n, table), reference), n)

    writer = bin_counts(stream, breaks).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (writer.trigger(**trigger) if trigger else writer).start()
