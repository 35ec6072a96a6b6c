"""The driver's tables read as a cohort: stays, hours, channels, eras, predictions, attributions; in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timegrid
from ..operators.channels import Channel

ORIGIN = "2024-01-01 00:00:00"
BLOCK, HOUR = 259200, 43200
BUCKETS = 6

CHANNELS = [Channel("click", ("click",), 5, 450), Channel("views", ("view",), 10, 490), Channel("purchase", ("purchase",), 0, 300), Channel("error", ("error",), 50, 490, "min"), Channel("signup", ("signup",), 0, 480)]
NAMES = [c.name for c in CHANNELS]


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def origin():
    return F.lit(ORIGIN).cast("timestamp")


def events(spark, d: str) -> DataFrame:
    """Events with stay_id, subject_id, blk, hr and era."""
    secs = (timegrid.micros(F.col("ts")) - timegrid.micros(origin())) / 1e6
    e = table(spark, d, "events").withColumn("blk", F.floor(secs / BLOCK).cast("long"))
    start = F.timestamp_micros(timegrid.micros(origin()) + F.col("blk") * (BLOCK * 1_000_000))
    e = e.withColumns({"stay_id": F.col("user_id") * 100 + F.col("blk"), "subject_id": F.col("user_id"), "intime": start})
    return e.withColumns({"hr": timegrid.hours_since(F.col("ts"), F.col("intime"), HOUR), "era": F.when(F.col("blk") < 4, "e1").when(F.col("blk") < 7, "e2").otherwise("e3")})


EVENTS = f"""e AS (SELECT *, user_id * 100 + blk AS stay_id, user_id AS subject_id, CASE WHEN blk < 4 THEN 'e1' WHEN blk < 7 THEN 'e2' ELSE 'e3' END AS era,
  CAST(greatest(0, floor((epoch(ts) - epoch(TIMESTAMP '{ORIGIN}') - blk * {BLOCK}) / {HOUR})) AS INTEGER) AS hr
  FROM (SELECT *, CAST(floor((epoch(ts) - epoch(TIMESTAMP '{ORIGIN}')) / {BLOCK}) AS BIGINT) AS blk FROM events))"""


def stays(spark, d: str) -> DataFrame:
    return events(spark, d).groupBy("stay_id").agg(F.first("subject_id").alias("subject_id"), F.first("blk").alias("blk"), F.first("intime").alias("intime"), F.first("era").alias("era"))


STAYS = f"{EVENTS}, s AS (SELECT DISTINCT stay_id, subject_id, blk, era FROM e)"


def hourly(spark, d: str) -> DataFrame:
    from ..operators.channels import hourly_pivot

    return hourly_pivot(events(spark, d), CHANNELS, item="event_type", value="value")


def _case(c: Channel) -> str:
    return f"{c.agg}(CASE WHEN event_type = '{c.items[0]}' AND value BETWEEN {c.low} AND {c.high} THEN value END) AS {c.name}"


HOURLY = f"{STAYS}, h AS (SELECT stay_id, hr, {', '.join(map(_case, CHANNELS))} FROM e GROUP BY ALL)"


def grid(spark, d: str) -> DataFrame:
    return timegrid.fill_grid(hourly(spark, d), stays(spark, d), BUCKETS)


GRID = f"{HOURLY}, g AS (SELECT s.stay_id, b.hr, {', '.join('h.' + n for n in NAMES)} FROM s CROSS JOIN (SELECT unnest(range({BUCKETS}))::INTEGER AS hr) b LEFT JOIN h ON h.stay_id = s.stay_id AND h.hr = b.hr)"


def predictions(spark, d: str) -> DataFrame:
    """(id, split, label, model, y, prob) from labels and document lengths."""
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels")
    a, b = F.col("n_chars") / (F.col("n_chars") + 2000), (F.col("doc_id") * 7919 % 1000) / 1000
    wide = labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), "quality", "toxic", a.alias("a"), b.alias("b"), ((a + b) / 2).alias("c"))
    long = wide.unpivot(["id", "a", "b", "c"], ["quality", "toxic"], "label", "y").unpivot(["id", "label", "y"], ["a", "b", "c"], "model", "prob")
    return long.withColumn("split", F.when(F.col("id") % 2 == 0, "pre").otherwise("post"))


PREDICTIONS = """w AS (SELECT l.doc_id AS id, quality, toxic, n_chars / (n_chars + 2000) AS a, (l.doc_id * 7919 % 1000) / 1000 AS b FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
y AS (SELECT id, a, b, 'quality' AS label, quality AS y FROM w UNION ALL SELECT id, a, b, 'toxic', toxic FROM w),
p AS (SELECT id, label, y, 'a' AS model, a AS prob, CASE WHEN id % 2 = 0 THEN 'pre' ELSE 'post' END AS split FROM y UNION ALL SELECT id, label, y, 'b', b, CASE WHEN id % 2 = 0 THEN 'pre' ELSE 'post' END FROM y
      UNION ALL SELECT id, label, y, 'c', (a + b) / 2, CASE WHEN id % 2 = 0 THEN 'pre' ELSE 'post' END FROM y)"""

DRIFT = ["l_quantity", "l_extendedprice", "l_discount"]


def drift_long(spark, d: str) -> DataFrame:
    from ..operators.drift import to_long

    li = table(spark, d, "lineitem").withColumns({"grp": F.year("l_shipdate").cast("string"), "returned": (F.col("l_returnflag") == "R").cast("int")})
    return to_long(li, [*DRIFT, "returned"])


LONG = f"""li AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS grp, *, (l_returnflag = 'R')::INTEGER AS returned FROM lineitem),
l AS ({' UNION ALL '.join(f"SELECT grp, '{c}' AS feature, {c}::DOUBLE AS value FROM li" for c in [*DRIFT, 'returned'])}),
lp AS (SELECT * FROM l WHERE grp IN ('1996', '1999'))"""


def attributions(spark, d: str, tasks: int | None = None) -> DataFrame:
    """(id, label, model, feature, value): an embedding's entries as source, its entries shifted by one as adapted values.
    ``tasks`` deals the embeddings out before they become rows, however few parts their file has."""
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    e = e if tasks is None else e.repartition(tasks, "vec_id")
    e = e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.explode(F.transform(F.col("v"), lambda x, i: F.struct(i.alias("i"), x.alias("source"), F.get(F.col("v"), (i + 1) % F.size("v")).alias("adapted")))).alias("r"))
    return rows.select("id", "label", F.format_string("mean_f%d", "r.i").alias("feature"), "r.source", "r.adapted").unpivot(["id", "label", "feature"], ["source", "adapted"], "model", "value")


ATTR = """ev AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
att AS (SELECT id, label, 'mean_f' || i AS feature, i, 'source' AS model, v[i + 1] AS value FROM ev UNION ALL SELECT id, label, 'mean_f' || i, i, 'adapted', v[(i + 1) % len(v) + 1] FROM ev)"""


def vectors(spark, d: str, part: slice | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries (every row whose id is divisible by 50) and documents (all rows), as unit vectors of all or a part of the
    dimensions."""
    from ..operators.retrieval import l2_normalize

    v = F.col("embedding") if part is None else F.slice("embedding", part.start + 1, part.stop - part.start)
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("lab"), l2_normalize(v).alias("vec"))
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "lab", "vec"), e.select(F.col("vec_id").alias("doc_id"), "lab", "vec")


def hits_sql(name: str, low: int, high: int, k: int = 5) -> str:
    return f"""{name}v AS (SELECT vec_id, label, list_transform(x, lambda z: z / greatest(sqrt(list_dot_product(x, x)), 1e-9)) AS x FROM (SELECT vec_id, label, CAST(embedding[{low + 1}:{high}] AS DOUBLE[]) AS x FROM embeddings)),
{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label = d.label AS rel, list_dot_product(q.x, d.x) AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, d.x) DESC, d.vec_id) AS rank
  FROM {name}v q JOIN {name}v d ON q.vec_id % 50 = 0) WHERE rank <= {k})"""
