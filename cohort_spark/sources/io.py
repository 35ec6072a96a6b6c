"""Tables in and out: typed CSV and Parquet readers, partitioned writers, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tables(spark: SparkSession, root: str, schemas: dict[str, T.StructType | str], fmt: str = "csv", register: bool = True) -> dict[str, DataFrame]:
    """Every table of ``schemas`` from ``root/<name>.<fmt>``, with its schema given rather than inferred;
    registered as a view of its name."""
    out = {}
    for name, schema in schemas.items():
        reader = spark.read.schema(schema)
        out[name] = reader.option("header", True).csv(f"{root}/{name}.csv") if fmt == "csv" else reader.format(fmt).load(f"{root}/{name}.{fmt}")
        if register:
            out[name].createOrReplaceTempView(name)
    return out


CORRUPT = "_corrupt_record"


def read_checked(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv", **options) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): the rows of ``path`` that fit ``schema``, and for those that don't the file and the record as it
    stands there. Together they are all records of the input; nothing is dropped or nulled without a word."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = T.StructType([*kind.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(whole).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, **({"header": True, "enforceSchema": False} if fmt == "csv" else {}), **options)
    rows = reader.format(fmt).load(path).withColumn("_file", F.input_file_name())
    # Always true; Spark parses no record, and finds none broken, where a query needs no column of the schema.
    parsed = F.xxhash64(*[F.col(f"`{f.name}`") for f in kind.fields]) >= F.lit(-(2**63))
    good = rows.where(parsed & F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")
    return good, rows.where(parsed & F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet; rows are sorted inside each file, never globally. Rows are brought together by ``partition_by`` before they are
    written, so that a partition has a few files of a good size and not one from every task; a partition with very many
    rows is split."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort:
        df = df.sortWithinPartitions(*(partition_by or []), *sort)
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, sort: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table of ``buckets`` files, one for each hash of ``keys``, sorted inside: tables of the same keys and number of
    buckets join and group by these keys without a shuffle. With ``spark.sql.requireAllClusterKeysForCoPartition`` off, joins
    on more columns than the keys don't shuffle either."""
    dealt = df.repartition(buckets, *keys)  # by the hash that the buckets have, so each task writes one file
    dealt.write.mode(mode).bucketBy(buckets, *keys).sortBy(*(sort or keys)).saveAsTable(name)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_split(df: DataFrame, seq_cols: list[str], static_cols: list[str], groups=("WHITE", "BLACK", "HISPANIC", "ASIAN")) -> DataFrame:
    """A split with the columns that models ask for: gender_M, an eth_* dummy for each group, and 0.0 for what is
    missing."""
    made = {}
    if "gender" in df.columns:
        made["gender_M"] = F.coalesce(F.col("gender") == "M", F.lit(False)).cast("double")
    if "ethnicity" in df.columns:
        made |= {f"eth_{g}": F.coalesce(F.col("ethnicity") == g, F.lit(False)).cast("double") for g in groups}
    df = df.withColumns(made) if made else df
    missing = {c: F.lit(0.0) for c in [*seq_cols, *static_cols] if c not in df.columns}
    return df.withColumns(missing) if missing else df


def report_ready(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, NaN as null and infinities as the strings "inf" and "-inf" in columns that hold any kind."""
    out = {}
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            out[name] = F.when(F.isnan(c), None).when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.round(c, digits).cast("string"))
    return df.withColumns(out) if out else df


def write_report(df: DataFrame, path: str, digits: int = 6) -> None:
    """One JSON object for each row. NaN becomes null; infinities become strings; other numbers stay numbers."""
    numbers = [n for n, k in df.dtypes if k in ("double", "float")]
    ready = df.withColumns({n: F.when(F.isnan(n) | (F.abs(F.col(n)) == float("inf")), None).otherwise(F.round(n, digits)) for n in numbers}) if numbers else df
    marks = {f"{n}_inf": F.when(F.col(n) == float("inf"), "inf").when(F.col(n) == float("-inf"), "-inf") for n in numbers}
    if marks:
        ready = df.withColumns(marks).withColumns({n: F.when(F.isnan(n) | (F.abs(F.col(n)) == float("inf")), None).otherwise(F.round(n, digits)) for n in numbers})
    ready.write.mode("overwrite").json(path)
