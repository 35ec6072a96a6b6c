"""Queries of the cohort and feature build."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import channels, cohort, features, impute, labels, normalize, report, sequences, splits, timegrid, train
from ..operators.features import Spec
from . import standin as st
from .registry import query, rounded

N = st.NAMES


def cols(fmt: str, names=N) -> str:
    return ", ".join(fmt.format(c=c) for c in names)


@query(f"WITH {st.HOURLY} SELECT * FROM h")
def hourly_pivot(spark, d):
    return st.hourly(spark, d)


SPECS = [Spec("clicks", "count", where="event_type = 'click'"), Spec("spent", "sum", "value", "event_type = 'purchase'", 0.0), Spec("has_error", "flag", where="event_type = 'error'", default=0),
         Spec("first_signup", "min", "hr", "event_type = 'signup'", 6), Spec("mean_view", "avg", "value", "event_type = 'view'", 0.0)]


@query(f"""WITH {st.STAYS}, f AS (SELECT * FROM e WHERE hr < 3), a AS (SELECT stay_id, count(*) FILTER (event_type = 'click') AS clicks, sum(value) FILTER (event_type = 'purchase') AS spent,
  max((event_type = 'error')::INTEGER) AS has_error, min(hr) FILTER (event_type = 'signup') AS first_signup, avg(value) FILTER (event_type = 'view') AS mean_view FROM f GROUP BY 1)
SELECT s.stay_id, a.clicks, round(coalesce(spent, 0), 6) AS spent, coalesce(has_error, 0) AS has_error, coalesce(first_signup, 6) AS first_signup, round(coalesce(mean_view, 0), 6) AS mean_view FROM s LEFT JOIN a USING (stay_id)""")
def interval_join_agg(spark, d):
    e = st.table(spark, d, "events").withColumn("subject_id", F.col("user_id"))
    s = st.stays(spark, d)
    facts = timegrid.attach_events(e, s.select("stay_id", "subject_id", "intime"), "ts", end=None, key="subject_id").where(timegrid.in_window(F.col("ts"), F.col("intime"), 0, 3 * st.HOUR))
    facts = facts.withColumn("hr", timegrid.hours_since(F.col("ts"), F.col("intime"), st.HOUR))
    return rounded(features.window_agg(facts, SPECS, entities=s))


@query(f"WITH {st.GRID} SELECT * FROM g")
def dense_grid_fill(spark, d):
    return st.grid(spark, d)


@query(f"WITH {st.EVENTS} SELECT stay_id, hr, max((event_type = 'purchase')::INTEGER) AS bought, max((event_type = 'error')::INTEGER) AS failed FROM e WHERE event_type IN ('purchase', 'error') GROUP BY ALL")
def hourly_flags(spark, d):
    e = st.events(spark, d)
    return timegrid.hourly_flags({"bought": e.where("event_type = 'purchase'"), "failed": e.where("event_type = 'error'")})


@query(f"""WITH {st.EVENTS} SELECT stay_id, hr, round(greatest(sum(CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN -value WHEN event_type IN ('click', 'purchase') THEN value END), 0), 6) AS total
FROM e GROUP BY ALL HAVING greatest(sum(CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN -value WHEN event_type IN ('click', 'purchase') THEN value END), 0) <= 500""")
def signed_hourly_sum(spark, d):
    v = channels.signed_value(F.col("event_type"), F.col("value"), ["click", "purchase"], ["error"], ["signup"])
    return rounded(channels.hourly_sum(st.events(spark, d), v, most=500.0))


@query("""SELECT l_orderkey, max((contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue'))::INTEGER) AS colour, count(*) FILTER (contains(lower(p_name), 'green')) AS greens
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def keyword_flags(spark, d):
    rows = st.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(st.table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    rows = rows.withColumns({"hit": text.any_keyword(F.col("p_name"), ["RED", "blue"]), "green": text.any_keyword(F.col("p_name"), ["green"])})
    return features.window_agg(rows, [Spec("colour", "max", "hit"), Spec("greens", "count", where="green = 1")], key="l_orderkey")


@query("""SELECT l_orderkey, max((p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#3%')::INTEGER) AS first_brands, max((substr(p_brand, 7, 1) BETWEEN '4' AND '5')::INTEGER) AS last_brands
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def code_prefix_flags(spark, d):
    rows = st.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(st.table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey").withColumn("version", F.lit(9))
    rules = [cohort.CodeRule("first_brands", {9: ("Brand#1", "Brand#3")}), cohort.CodeRule("last_brands", {9: ()}, {9: (("Brand#4", "Brand#5"),)})]
    return cohort.code_flags(rows, rules, "l_orderkey", "p_brand", "version")


@query(f"WITH {st.STAYS}, a AS (SELECT stay_id, count(DISTINCT props) FILTER (event_type IN ('click', 'view')) AS kinds FROM e WHERE hr < 4 GROUP BY 1) SELECT s.stay_id, coalesce(kinds, 0) AS kinds FROM s LEFT JOIN a USING (stay_id)")
def nunique_in_window(spark, d):
    return features.window_agg(st.events(spark, d).where("hr < 4"), [Spec("kinds", "nunique", "props", "event_type IN ('click', 'view')", 0)], entities=st.stays(spark, d))


LOW, HIGH = "1997-01-01", "1997-07-20"
_OVER = f"coalesce(bool_or(CAST(l_shipdate AS TIMESTAMP) < TIMESTAMP '{HIGH}' AND CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_quantity AS INTEGER)) > TIMESTAMP '{LOW}'), false)"


def _ship(spark, d):
    li = st.table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("timestamp").alias("starttime"), "l_quantity", "l_returnflag")
    return li.withColumn("endtime", F.col("starttime") + F.make_dt_interval(F.col("l_quantity").cast("int"))), st.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")


@query(f"""WITH a AS (SELECT o_orderkey, {_OVER} AS o FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
b AS (SELECT l_orderkey, bool_or(l_returnflag = 'R' AND l_quantity >= 49) AS r FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS l_orderkey, coalesce(o, false) OR coalesce(r, false) AS label FROM a FULL JOIN b ON l_orderkey = o_orderkey""")
def labels_overlap(spark, d):
    li, orders = _ship(spark, d)
    a = labels.interval_overlap(orders, li, F.lit(LOW).cast("timestamp"), F.lit(HIGH).cast("timestamp"), key="l_orderkey")
    b = li.groupBy("l_orderkey").agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49)).alias("r"))
    return labels.any_of([(a, "label"), (b, "r")], "l_orderkey")


@query(f"""WITH a AS (SELECT o_orderkey, {_OVER} AS o FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
b AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS r, bool_or(l_quantity > 40) AS q FROM lineitem GROUP BY 1)
SELECT coalesce(o_orderkey, l_orderkey) AS l_orderkey, coalesce(o, false) AND coalesce(r, false) AND coalesce(q, false) AS label FROM a FULL JOIN b ON l_orderkey = o_orderkey""")
def labels_composite(spark, d):
    li, orders = _ship(spark, d)
    a = labels.interval_overlap(orders, li, F.lit(LOW).cast("timestamp"), F.lit(HIGH).cast("timestamp"), key="l_orderkey")
    b = li.groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("r"), F.bool_or(F.col("l_quantity") > 40).alias("q"))
    return labels.all_of([(a, "label"), (b, "r"), (b, "q")], "l_orderkey")


_FF = "last_value({c} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY hr ROWS UNBOUNDED PRECEDING)"
_BF = "first_value({c} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY hr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
FILLED = f"{st.GRID}, f AS (SELECT stay_id, hr, {cols(_FF + ' AS {c}')} FROM g)"


@query(f"WITH {FILLED} SELECT * FROM f")
def forward_fill(spark, d):
    return impute.forward_fill(st.grid(spark, d), N)


@query(f"WITH {st.GRID} SELECT stay_id, hr, {cols('coalesce(' + _FF + ', ' + _BF + ') AS {c}')} FROM g")
def fill_both(spark, d):
    return impute.fill_both(st.grid(spark, d), N)


@query(f"WITH {st.HOURLY} SELECT *, {cols('hr - coalesce(last_value(CASE WHEN {c} IS NOT NULL THEN hr END IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY hr ROWS UNBOUNDED PRECEDING), 0) AS {c}_time_delta')} FROM h")
def time_since_last(spark, d):
    return features.time_since_last(st.hourly(spark, d), N)


@query(f"""WITH {FILLED} SELECT stay_id, hr, round(avg(views) OVER (PARTITION BY stay_id ORDER BY hr ROWS 2 PRECEDING), 6) AS roll_mean_3, round(avg(click) OVER (PARTITION BY stay_id ORDER BY hr ROWS 5 PRECEDING), 6) AS roll_mean_6,
round(coalesce(stddev_samp(views) OVER (PARTITION BY stay_id ORDER BY hr ROWS 2 PRECEDING), 0), 6) AS roll_std_3, round(coalesce(stddev_samp(click) OVER (PARTITION BY stay_id ORDER BY hr ROWS 3 PRECEDING), 0), 6) AS roll_std_4 FROM f""")
def rolling(spark, d):
    f = impute.forward_fill(st.grid(spark, d), N)
    out = features.rolling(f, {"roll_mean_3": ("views", "mean", 3), "roll_mean_6": ("click", "mean", 6), "roll_std_3": ("views", "std", 3), "roll_std_4": ("click", "std", 4)})
    return rounded(out.drop(*N))


@query(f"""WITH {FILLED}, m AS (SELECT {cols('quantile_cont({c}, 0.5) AS {c}_m')} FROM f JOIN s USING (stay_id) WHERE era = 'e1')
SELECT f.stay_id, f.hr, {cols('round(coalesce(f.{c}, {c}_m), 6) AS {c}')}, {cols('(g.{c} IS NOT NULL)::TINYINT AS {c}_mask')} FROM f JOIN g USING (stay_id, hr) CROSS JOIN m""")
def train_median_impute(spark, d):
    g = impute.forward_fill(impute.add_masks(st.grid(spark, d), N), N)
    m = impute.train_medians(g.join(st.stays(spark, d).where("era = 'e1'").select("stay_id"), "stay_id", "left_semi"), N)
    return rounded(impute.fill_medians(g, m, N))


_RATIO = "CASE WHEN {c}_baseline = 0 THEN 1 WHEN {c} / {c}_baseline > 10 THEN 10 ELSE {c} / {c}_baseline END"


@query(f"""WITH {st.HOURLY}, b AS (SELECT stay_id, min_by(views, hr) FILTER (views IS NOT NULL) AS views_baseline, min_by(click, hr) FILTER (click IS NOT NULL) AS click_baseline FROM h GROUP BY 1)
SELECT h.stay_id, h.hr, views_baseline, click_baseline, {', '.join(f'round({c} - {c}_baseline, 6) AS {c}_delta, round({_RATIO.format(c=c)}, 6) AS {c}_ratio' for c in ('views', 'click'))} FROM h JOIN b USING (stay_id)""")
def baseline_delta_ratio(spark, d):
    h = st.hourly(spark, d)
    out = features.delta_ratio(h.join(features.first_observed(h, ["views", "click"]), "stay_id"), ["views", "click"])
    return rounded(out.drop(*N))


@query(f"""WITH {st.HOURLY}, z AS (SELECT stay_id, count(purchase) AS np, stddev_samp(purchase) AS sp, count(error) AS ne, stddev_samp(error) AS se FROM h GROUP BY 1)
SELECT h.* FROM h JOIN z USING (stay_id) WHERE NOT ((np = 0 OR sp IS NULL OR sp = 0) AND (ne = 0 OR se IS NULL OR se = 0) AND (np > 0 OR ne > 0))""")
def drop_flat(spark, d):
    return cohort.drop_flat(st.hourly(spark, d), ["purchase", "error"])


@query(f"""WITH {st.STAYS} SELECT s.stay_id, 40 + s.subject_id % 50 + 2024 - 2020 AS age, (c_mktsegment = 'BUILDING')::INTEGER AS seg_building,
CASE WHEN regexp_matches(upper(c_mktsegment), 'AUTO') THEN 'VEHICLE' WHEN regexp_matches(upper(c_mktsegment), 'HOUSE|FURNITURE') THEN 'HOME' ELSE 'OTHER' END AS bucket, n_name
FROM s JOIN customer ON c_custkey = s.subject_id JOIN nation ON n_nationkey = c_nationkey""")
def demographics(spark, d):
    patients = st.table(spark, d, "customer").select(F.col("c_custkey").alias("subject_id"), "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"), (40 + F.col("c_custkey") % 50).alias("anchor_age"), F.lit(2020).alias("anchor_year"))
    out = cohort.demographics(st.stays(spark, d), patients).join(st.table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    out = features.one_hot(out, "c_mktsegment", {"seg_building": "BUILDING"}).withColumn("bucket", features.regex_bucket(F.col("c_mktsegment"), [("VEHICLE", "AUTO"), ("HOME", "HOUSE|FURNITURE")]))
    return features.select_present(out, ["stay_id", "age", "seg_building", "bucket", "n_name", "absent"])


CHRONO = f"{st.STAYS}, c AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY era, blk, stay_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM s)"


@query(f"WITH {CHRONO} SELECT stay_id, era, split FROM c")
def chrono_split(spark, d):
    return splits.chronological(st.stays(spark, d)).select("stay_id", "era", "split")


@query(f"""WITH {st.STAYS}, n AS (SELECT *, row_number() OVER (ORDER BY blk, stay_id) AS r, count(*) OVER () AS n FROM s WHERE era = 'e3')
SELECT stay_id, CASE WHEN r <= floor(0.3 * n) THEN 'adapt_train' WHEN r <= floor(0.3 * n) + floor(0.1 * n) THEN 'adapt_val' ELSE 'eval_post' END AS split FROM n
UNION ALL SELECT * FROM (SELECT stay_id, 'buffer' FROM s WHERE era = 'e2' ORDER BY stay_id DESC LIMIT 100)""")
def adapt_split(spark, d):
    s = st.stays(spark, d)
    new = splits.adaptation(s.where("era = 'e3'"))
    return splits.with_buffer(splits.replay_buffer(s.where("era = 'e2'"), 100), new).select("stay_id", "split")


@query(f"""WITH {st.STAYS}, x AS (SELECT stay_id, stay_id % 997 AS subject, CASE era WHEN 'e1' THEN 'train' WHEN 'e2' THEN 'val' ELSE 'test' END AS split, CASE era WHEN 'e1' THEN 0 WHEN 'e2' THEN 1 ELSE 2 END AS k FROM s)
SELECT stay_id, split FROM (SELECT *, min(k) OVER (PARTITION BY subject) AS f FROM x) WHERE k = f""")
def purge_subjects(spark, d):
    s = st.stays(spark, d).withColumns({"subject_id": F.col("stay_id") % 997, "split": F.when(F.col("era") == "e1", "train").when(F.col("era") == "e2", "val").otherwise("test")})
    return splits.purge_subjects(s).select("stay_id", "split")


@query(f"""WITH {st.HOURLY}, y AS (SELECT s.era, h.stay_id, count(*) AS n, max((h.purchase > 150)::INTEGER) AS bought, max((h.error IS NOT NULL)::INTEGER) AS failed FROM h JOIN s USING (stay_id) GROUP BY ALL)
SELECT era, sum(n)::BIGINT AS n_rows, count(*) AS n_stays, round(100 * avg(coalesce(bought, NULL)), 6) AS pct_bought, round(100 * avg(failed), 6) AS pct_failed FROM y GROUP BY 1""")
def cohort_summary(spark, d):
    h = st.hourly(spark, d).join(st.stays(spark, d).select("stay_id", "era"), "stay_id").withColumns({"bought": F.col("purchase") > 150, "failed": F.col("error").isNotNull()})
    return rounded(report.cohort_summary(h, ["bought", "failed"]))


@query(f"""WITH {FILLED}, m AS (SELECT {cols('avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s')} FROM f JOIN s USING (stay_id) WHERE era = 'e1')
SELECT stay_id, hr, {cols('round(({c} - coalesce({c}_m, 0)) / CASE WHEN {c}_s IS NULL OR {c}_s = 0 THEN 1 ELSE {c}_s END, 6) AS {c}')} FROM f CROSS JOIN m""")
def zscore(spark, d):
    f = impute.forward_fill(st.grid(spark, d), N)
    stats = normalize.fit(f.join(st.stays(spark, d).where("era = 'e1'").select("stay_id"), "stay_id", "left_semi"), N)
    return rounded(normalize.apply(f, stats, N))


@query(f"""WITH {st.HOURLY}, z AS (SELECT s.stay_id, b.hr, coalesce(views, 0) AS views, coalesce(click, 0) AS click FROM s CROSS JOIN (SELECT unnest(range({st.BUCKETS}))::INTEGER AS hr) b LEFT JOIN h ON h.stay_id = s.stay_id AND h.hr = b.hr WHERE s.stay_id IN (SELECT stay_id FROM h))
SELECT stay_id, {', '.join(f'max_by({c}, hr) AS last_{c}, round(avg({c}), 6) AS mean_{c}, round(stddev_pop({c}), 6) AS std_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}' for c in ('views', 'click'))} FROM z GROUP BY 1""")
def flatten(spark, d):
    return rounded(sequences.flatten(st.hourly(spark, d).select("stay_id", "hr", "views", "click"), ["views", "click"]))


@query(f"""WITH {st.HOURLY}, q AS (SELECT stay_id, list([coalesce(views, 0), coalesce(click, 0)] ORDER BY hr)[1:4] AS x FROM h GROUP BY 1)
SELECT stay_id, array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN i <= len(x) THEN CAST(round(x[i][1] * 100)::BIGINT AS VARCHAR) || ':' || CAST(round(x[i][2] * 100)::BIGINT AS VARCHAR) ELSE '0:0' END || ':' || CAST(stay_id % 7 AS VARCHAR)), ',') AS seq FROM q""")
def sequence(spark, d):
    h = st.hourly(spark, d).withColumn("static", F.col("stay_id") % 7)
    out = sequences.tile_static(sequences.assemble(h, ["views", "click"], ["static"], length=4))
    step = F.transform("seq", lambda x: F.concat_ws(":", F.round(x[0] * 100).cast("long").cast("string"), F.round(x[1] * 100).cast("long").cast("string"), x[2].cast("long").cast("string")))
    return out.select("stay_id", F.array_join(step, ",").alias("seq"))


@query("""SELECT 'quality' AS label, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality = 0) AS n_neg, round(least(greatest(count(*) FILTER (quality = 0) / (count(*) FILTER (quality = 1) + 1e-6), 1), 20), 6) AS weight FROM labels
UNION ALL SELECT 'toxic', count(*) FILTER (toxic = 1), count(*) FILTER (toxic = 0), round(least(greatest(count(*) FILTER (toxic = 0) / (count(*) FILTER (toxic = 1) + 1e-6), 1), 20), 6) FROM labels""")
def pos_weights(spark, d):
    return rounded(train.pos_weights(st.table(spark, d, "labels"), ["quality", "toxic"]))
