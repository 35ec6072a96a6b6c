"""Queries of eligibility, assembly, splits, repeated runs and retrieval studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import attribution, channels, cohort, drift, evaluate, features, impute, labels, resample, retrieval, splits, timegrid
from ..operators.channels import Channel
from ..sources import corpus, io
from . import standin as st
from .model_queries import _ERFC, AUDIT, CUM, PSI_QUANTILE, REPLICATES, A, B, replicates_sql, scan_sql, weights_sql
from .registry import nearest, query, rounded

HOUR = 3_600_000_000


# Cohort build


@query(f"""WITH {st.EVENTS}, s AS (SELECT stay_id, user_id AS subject_id, blk, era, max(ts) AS outtime FROM e GROUP BY ALL),
t AS (SELECT *, TIMESTAMP '{st.ORIGIN}' + to_seconds(blk * {st.BLOCK}) AS intime FROM s),
u AS (SELECT *, CASE WHEN subject_id % 11 = 0 THEN intime + to_hours((subject_id % 40)::BIGINT) END AS deathtime, CASE WHEN subject_id % 13 > 0 THEN 1 END AS label, (epoch(outtime) - epoch(intime)) / 3600 AS los_hours FROM t)
SELECT stay_id, era, label FROM u WHERE stay_id > 0 AND (deathtime IS NULL OR deathtime > intime + INTERVAL 14 HOUR) AND outtime > intime + INTERVAL 14 HOUR AND los_hours >= 14
AND era IN ('e1', 'e3') AND label IS NOT NULL""")
def eligible_stays(spark, d):
    s = st.events(spark, d).groupBy("stay_id", "subject_id", "era", "intime").agg(F.max(F.col("ts").cast("timestamp")).alias("outtime"))
    start = timegrid.micros(F.col("intime"))
    s = s.withColumns({"deathtime": F.when(F.col("subject_id") % 11 == 0, F.timestamp_micros(start + (F.col("subject_id") % 40) * HOUR)),
                       "label": F.when(F.col("subject_id") % 13 > 0, 1), "los_hours": (timegrid.micros(F.col("outtime")) - start) / HOUR})
    return cohort.eligible(s, 14, ["e1", "e3"], labels=["label"]).select("stay_id", "era", "label")


_PART = "SELECT stay_id, hr, {agg} FROM e WHERE event_type IN ({kinds}) GROUP BY ALL"


@query(f"""WITH {st.EVENTS}, a AS ({_PART.format(agg='max(value) AS clicked', kinds="'click'")}), b AS ({_PART.format(agg='min(value) AS seen', kinds="'view'")}), c AS ({_PART.format(agg='sum(value) AS paid', kinds="'purchase', 'error'")})
SELECT a.*, seen, round(paid, 6) AS paid FROM a LEFT JOIN b USING (stay_id, hr) LEFT JOIN c USING (stay_id, hr)""")
def hourly_assembly(spark, d):
    e = st.events(spark, d)

    def part(agg, *kinds):
        return e.where(F.col("event_type").isin(*kinds)).groupBy("stay_id", "hr").agg(agg)

    return rounded(timegrid.assemble_hourly(part(F.max("value").alias("clicked"), "click"), part(F.min("value").alias("seen"), "view"), part(F.sum("value").alias("paid"), "purchase", "error")))


@query(f"""WITH {st.STAYS}, a AS (SELECT stay_id, count(*) AS n FROM e WHERE event_type = 'click' GROUP BY 1), b AS (SELECT stay_id, max(props) AS last_props FROM e WHERE event_type = 'error' GROUP BY 1)
SELECT s.stay_id, s.era, coalesce(n, 0) AS n, coalesce(last_props, 'none') AS last_props FROM s LEFT JOIN a USING (stay_id) LEFT JOIN b USING (stay_id)""")
def entity_assembly(spark, d):
    e = st.events(spark, d)
    a = e.where("event_type = 'click'").groupBy("stay_id").agg(F.count("*").alias("n"))
    b = e.where("event_type = 'error'").groupBy("stay_id").agg(F.max("props").alias("last_props"))
    return features.assemble(st.stays(spark, d).select("stay_id", "era"), a, b, fill={"n": 0, "last_props": "none"})


@query(f"""WITH {st.STAYS} SELECT s.stay_id, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN s ON s.subject_id = user_id
WHERE ts >= TIMESTAMP '{st.ORIGIN}' + to_seconds(s.blk * {st.BLOCK}) AND ts <= TIMESTAMP '{st.ORIGIN}' + to_seconds(s.blk * {st.BLOCK}) + INTERVAL 40 HOUR GROUP BY 1""")
def coarse_key_events(spark, d):
    """Events of a user land in that one of the user's stays whose hours hold them."""
    s = st.stays(spark, d).withColumn("outtime", F.timestamp_micros(timegrid.micros(F.col("intime")) + 40 * HOUR)).select("stay_id", "subject_id", "intime", "outtime")
    e = st.table(spark, d, "events").select(F.col("user_id").alias("subject_id"), "ts", "value")
    return timegrid.attach_events(e, s, "ts", key="subject_id", bucket_seconds=4 * 3600).groupBy("stay_id").agg(F.count("*").alias("n"), nearest(F.sum("value"), 4).alias("total"))


@query(f"""WITH {st.STAYS}, w AS (SELECT stay_id, subject_id, TIMESTAMP '{st.ORIGIN}' + to_seconds(blk * {st.BLOCK}) AS t0 FROM s),
x AS (SELECT user_id, ts AS a, ts + to_seconds(CAST(value AS BIGINT) * 60) AS b FROM events WHERE event_type = 'error')
SELECT stay_id, coalesce(bool_or(a < t0 + INTERVAL 14 HOUR AND b > t0 + INTERVAL 8 HOUR), false) AS label FROM w LEFT JOIN x ON user_id = subject_id GROUP BY 1""")
def labels_coarse_overlap(spark, d):
    """Whether an interval of the user, told by the user alone, meets the stay's prediction window."""
    hour = lambda n: F.timestamp_micros(timegrid.micros(F.col("intime")) + n * HOUR)
    e = st.table(spark, d, "events").where("event_type = 'error'")
    x = e.select(F.col("user_id").alias("subject_id"), F.col("ts").alias("starttime"), F.timestamp_micros(timegrid.micros(F.col("ts")) + F.floor(F.rint("value")) * 60_000_000).alias("endtime"))
    return labels.interval_overlap(st.stays(spark, d), x, hour(8), hour(14), on="subject_id", bucket_seconds=2 * 3600)


@query("SELECT event_id, event_type FROM events WHERE value BETWEEN -1e9 AND 1e9 AND nullif(event_type, 'view') NOT IN ('error', 'signup')")
def status_filter(spark, d):
    e = st.table(spark, d, "events").where(F.col("value").between(-1e9, 1e9)).withColumn("status", F.nullif("event_type", F.lit("view")))
    return channels.exclude_status(e, "status", ["error", "signup"]).select("event_id", "event_type")


@query("SELECT event_id, value FROM events WHERE event_type IN ('click', 'purchase') AND value > 50 AND value < 300")
def item_range(spark, d):
    rules = [Channel("a", ("click",)), Channel("b", ("purchase",))]
    return channels.filter_items(st.table(spark, d, "events"), rules, "event_type", "value", 50, 300).select("event_id", "value")


@query(f"""WITH {st.EVENTS} SELECT stay_id, hr, round(max(CASE WHEN event_type = 'click' AND value BETWEEN 30 AND 45 THEN value WHEN event_type = 'view' AND value BETWEEN 86 AND 113 THEN (value - 32) * 5 / 9 END), 6) AS temperature FROM e GROUP BY ALL""")
def unit_merge(spark, d):
    rules = [Channel("temperature", ("click",), 30, 45), Channel("temperature", ("view",), 86, 113, transform=channels.fahrenheit)]
    return rounded(channels.hourly_pivot(st.events(spark, d), rules, item="event_type", value="value"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS p, CASE WHEN l_quantity > 25 THEN l_quantity::DOUBLE END AS w, l_discount::DOUBLE AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, round(p / coalesce(w, 70), 6) AS dose, CASE WHEN w > 40 THEN 7 ELSE coalesce(w, -1) END AS timing, round(CASE WHEN k = 0 THEN 0 ELSE p / k END, 4) AS odds, round(1 / (1 + exp(-(k * 20 - 1))), 6) AS prob, coalesce(w::VARCHAR, 'none') AS seen FROM x""")
def derived_columns(spark, d):
    x = st.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("p"), F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("double")).alias("w"), F.col("l_discount").cast("double").alias("k"))
    ratio = F.when(F.col("k") == 0, F.lit(float("inf"))).otherwise(F.col("p") / F.when(F.col("k") != 0, F.col("k")))
    x = x.withColumns({"dose": features.per_weight(F.col("p"), F.col("w")), "timing": stats.sentinel_clip(F.col("w"), 40.0, 7.0), "odds": nearest(stats.finite(ratio), 4),
                       "prob": stats.sigmoid(F.col("k") * 20 - 1), "seen": F.col("w").cast("string")})
    return rounded(impute.fill_constants(x, {"timing": -1.0, "seen": "none"}).select("l_orderkey", "l_linenumber", "dose", "timing", "odds", "prob", "seen"))


_SEGMENTS = ["BUILDING", "MACHINERY", "FURNITURE", "HOUSEHOLD"]


@query(f"""SELECT c_custkey, (c_nationkey % 2 = 0)::DOUBLE AS "gender_M", {', '.join(f'(c_mktsegment = {s!r})::DOUBLE AS "eth_{s}"' for s in _SEGMENTS)}, round(c_acctbal::DOUBLE, 2) AS balance, 0.0::DOUBLE AS absent FROM customer""")
def split_columns(spark, d):
    c = st.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "M").otherwise("F").alias("gender"), F.col("c_mktsegment").alias("ethnicity"), nearest(F.col("c_acctbal").cast("double"), 2).alias("balance"))
    return io.load_split(c, ["balance", "absent"], [], tuple(_SEGMENTS)).drop("gender", "ethnicity")


@query(f"WITH {st.HOURLY} SELECT h.stay_id, hr, click FROM h WHERE stay_id IN (SELECT stay_id FROM s WHERE era = 'e2')")
def membership_filter(spark, d):
    assignment = st.stays(spark, d).select("stay_id", F.when(F.col("era") == "e2", "val").otherwise("train").alias("split"))
    return splits.take(st.hourly(spark, d), assignment, "val").select("stay_id", "hr", "click")


@query(f"""WITH {st.STAYS}, a AS (SELECT stay_id, 'train' AS split FROM s WHERE blk < 6 UNION ALL SELECT stay_id, 'val' FROM s WHERE blk > 4)
SELECT stay_id, count(DISTINCT split) AS n_splits FROM a GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def split_overlap(spark, d):
    s = st.stays(spark, d)
    both = s.where("blk < 6").select("stay_id", F.lit("train").alias("split")).unionByName(s.where("blk > 4").select("stay_id", F.lit("val").alias("split")))
    return splits.overlap(both)


@query("""SELECT o_orderkey, year(o_orderdate) || ' - ' || (year(o_orderdate) + 2) AS tag, (year(o_orderdate) - 11)::INTEGER AS first_year, (year(o_orderdate) - 1)::INTEGER AS last_year FROM orders""")
def corpus_window(spark, d):
    y = F.year("o_orderdate")
    o = st.table(spark, d, "orders").select("o_orderkey", F.concat(y.cast("string"), F.lit(" - "), (y + 2).cast("string")).alias("tag"))
    w = corpus.window_from_tag(F.col("tag"))
    return o.select("o_orderkey", "tag", w["first"].alias("first_year"), w["last"].alias("last_year"))


# Drift


@query(f"WITH {st.EVENTS}, x AS (SELECT DISTINCT era FROM e) SELECT * FROM (SELECT era, lead(era) OVER (ORDER BY era) AS next_era FROM x) WHERE next_era IS NOT NULL")
def consecutive_eras(spark, d):
    return drift.consecutive_pairs(st.events(spark, d))


def _audited(spark, d):
    return drift.audit(st.drift_long(spark, d), A, B, ["returned"])


@query(f"WITH {st.LONG}, {AUDIT} SELECT feature, round(drift_score, 6) AS drift_score FROM av ORDER BY av.drift_score DESC, feature LIMIT 5")
def drift_top(spark, d):
    return rounded(drift.top_features(_audited(spark, d), 5).select("feature", "drift_score"))


@query(f"WITH {st.LONG}, {AUDIT} SELECT bool_or(drifted) AND (SELECT count(*) FROM orders) > 50 AS drift FROM av")
def drift_decision(spark, d):
    return drift.decide(_audited(spark, d), st.table(spark, d, "orders").count())


@query(f"""WITH {st.LONG}, {AUDIT}, t AS (SELECT *, row_number() OVER (ORDER BY drift_score DESC, feature) AS rank, CASE WHEN mean_cur >= mean_ref THEN 'increased' ELSE 'decreased' END AS way FROM av WHERE drift_score >= 0)
SELECT rank, CASE WHEN bin THEN printf('%s: usage %s by %.1f%% between 1996 and 1999', feature, way, 100 * abs_shift)
ELSE printf('%s: mean %s from %.2f to %.2f between 1996 and 1999 (PSI %.2f, %s)', feature, way, mean_ref, mean_cur, psi, severity) END AS line FROM t WHERE rank <= 5""")
def drift_lines(spark, d):
    """All features count as drifted here, so that there are lines to compare."""
    return drift.narrative(_audited(spark, d).withColumn("drifted", F.lit(True)), A, B)


def _pair_psi(name: str, a: str, b: str) -> str:
    body = PSI_QUANTILE.replace("lp", "l").replace("'1996'", f"'{a}'").replace("'1999'", f"'{b}'")
    body = body.replace("FROM l JOIN bk USING (feature) GROUP BY", f"FROM l JOIN bk USING (feature) WHERE grp IN ('{a}', '{b}') GROUP BY")
    for part in ("bk", "qb", "qs", "pq"):
        body = body.replace(f"{part} AS (", f"{part}{name} AS (").replace(f"FROM {part} ", f"FROM {part}{name} ").replace(f"JOIN {part} ", f"JOIN {part}{name} ")
    return body


def _binary_psi(a: str, b: str) -> str:
    """PSI of the binary feature between the years ``a`` and ``b``, from the clipped shares of 0 and 1."""
    share = "least(greatest(avg(value) FILTER (feature = 'returned' AND grp = '{}'), 1e-6), 1 - 1e-6)"
    p, q = share.format(a), share.format(b)
    return f"({q} - {p}) * ln({q} / {p}) + ((1 - {q}) - (1 - {p})) * ln((1 - {q}) / (1 - {p}))"


#: Training, pre and post era of the audit table, and the pairs that it compares.
ERAS = ("1995", "1996", "1999")
_PAIRS = {"train_pre": ERAS[:2], "train_post": (ERAS[0], ERAS[2]), "pre_post": ERAS[1:]}
_AUDITED = ["n_ref", "n_cur", "mean_ref", "mean_pre", "mean_cur", "sd_ref", "sd_cur", "psi_train_pre", "psi_train_post", "psi_pre_post", "kind", "drifted", "severity"]


@query(f"""WITH {st.LONG}, {', '.join(_pair_psi(k, *p) for k, p in _PAIRS.items())},
mn AS (SELECT feature, {', '.join(f"avg(value) FILTER (grp = '{g}') AS mean_{c}, stddev_pop(value) FILTER (grp = '{g}') AS sd_{c}, count(*) FILTER (grp = '{g}') AS n_{c}" for g, c in zip(ERAS, ("ref", "pre", "cur")))} FROM l GROUP BY 1),
bp AS (SELECT {', '.join(f"{_binary_psi(*p)} AS {k}" for k, p in _PAIRS.items())} FROM l),
t AS (SELECT mn.*, feature = 'returned' AS bin, {', '.join(f"CASE WHEN feature = 'returned' THEN bp.{k} ELSE pq{k}.psi END AS psi_{k}" for k in _PAIRS)}, abs(mean_cur - mean_ref) AS gap,
  abs(mean_cur - mean_ref) / (abs(mean_ref) + 1e-6) AS rel FROM mn CROSS JOIN bp {' '.join(f"LEFT JOIN pq{k} USING (feature)" for k in _PAIRS)})
SELECT feature, n_ref, n_cur, {', '.join(f"round({c}, 6) AS {c}" for c in _AUDITED[2:10])}, CASE WHEN bin THEN 'binary' ELSE 'continuous' END AS kind,
  CASE WHEN bin THEN gap > 0.05 OR rel > 0.2 ELSE psi_train_post > 0.2 END AS drifted,
  CASE WHEN bin THEN CASE WHEN gap > 0.1 OR rel > 0.4 THEN 'severe' WHEN gap > 0.05 OR rel > 0.2 THEN 'moderate' WHEN gap > 0.02 THEN 'minor' ELSE 'stable' END
       WHEN psi_train_post < 0.1 THEN 'stable' WHEN psi_train_post < 0.2 THEN 'minor' WHEN psi_train_post < 0.35 THEN 'moderate' ELSE 'severe' END AS severity FROM t""")
def drift_audit_table(spark, d):
    """Three eras that all have rows; three continuous features and a binary one."""
    return rounded(drift.audit_table(st.drift_long(spark, d), *ERAS, ["returned"]).select("feature", *_AUDITED))


#: Larger than the number of rows of an era at the scales that SQL is run on, where a sketch is exact; its breaks are
#: values that occur, the first whose share of values up to it is large enough.
_KEPT = 32768
_SKETCHED = f"""WITH {st.LONG}, y AS (SELECT * FROM l WHERE feature <> 'returned' AND grp BETWEEN '1995' AND '2001'),
o AS (SELECT feature, grp, list(value ORDER BY value) AS v FROM y GROUP BY ALL),
k AS (SELECT feature, grp, list_sort(list_distinct(list_transform(range(0, 11), lambda i: v[greatest(ceil(i / 10.0 * len(v)), 1)::BIGINT]))) AS k FROM o),
pr AS (SELECT grp AS era, lead(grp) OVER (ORDER BY grp) AS next_era FROM (SELECT DISTINCT grp FROM y)),
g AS (SELECT feature, grp, unnest(list_transform(range({drift.POINTS}), lambda i: v[ceil((i + 0.5) / {drift.POINTS} * len(v))::BIGINT])) AS value FROM o),
bn AS (SELECT era, next_era, g.feature, len(k.k) > 1 AS ok, len(list_filter(k.k[2:len(k.k) - 1], lambda z: z <= value)) AS bin, count(*) FILTER (g.grp = era) AS r, count(*) FILTER (g.grp = next_era) AS c
  FROM pr JOIN k ON k.grp = era JOIN g ON g.feature = k.feature AND g.grp IN (era, next_era) WHERE next_era IS NOT NULL GROUP BY ALL),
sh AS (SELECT era, next_era, feature, ok, least(greatest(r / sum(r) OVER w, 1e-6), 1 - 1e-6) AS p, least(greatest(c / sum(c) OVER w, 1e-6), 1 - 1e-6) AS q FROM bn WINDOW w AS (PARTITION BY era, next_era, feature)),
sc AS (SELECT era, next_era, avg(psi) AS distance FROM (SELECT era, next_era, feature, CASE WHEN bool_and(ok) THEN sum((q - p) * ln(q / p)) ELSE 0 END AS psi FROM sh GROUP BY ALL) GROUP BY ALL)
SELECT era, next_era, round(distance, 6) AS distance, round(2 * min_by(distance, era) OVER (), 6) AS threshold, distance > 2 * min_by(distance, era) OVER () AS drift FROM sc"""


@query(_SKETCHED)
def era_scan_sketched(spark, d):
    """The scan from a table of sketches, a row for each feature and year."""
    long = st.drift_long(spark, d).where("feature <> 'returned' and grp between '1995' and '2001'")
    return rounded(drift.scan_sketches(drift.era_sketches(long, _KEPT)))


_ONSET = f"""li AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS grp, dayofyear(l_shipdate)::DOUBLE AS ship_day, l_quantity::DOUBLE AS l_quantity FROM lineitem),
l AS (SELECT grp, 'ship_day' AS feature, ship_day AS value FROM li UNION ALL SELECT grp, 'l_quantity', l_quantity FROM li)"""


@query(f"{scan_sql(_ONSET, 3)} QUALIFY drift AND row_number() OVER (ORDER BY NOT drift, next_era) = 1".replace("SELECT era, next_era, round", "SELECT next_era AS onset, round"))
def drift_onset(spark, d):
    """The first year that the scan finds drifted: in the last one, only the first months have shipments."""
    li = st.table(spark, d, "lineitem").withColumns({"grp": F.year("l_shipdate").cast("string"), "ship_day": F.dayofyear("l_shipdate")})
    scanned = drift.scan_eras(drift.to_long(li, ["ship_day", "l_quantity"]).where("grp between '1995' and '2001'"), k=3.0)
    found = drift.onset(scanned).join(scanned, F.col("onset") == F.col("next_era"))
    return rounded(found.select("onset", "distance", "threshold", "drift"))


_BY_SPLIT = CUM.replace("model, label", "split, model, label")


@query(f"""WITH {st.PREDICTIONS}, {_BY_SPLIT}, b AS (SELECT label, auroc AS base FROM ar WHERE split = 'pre' AND model = 'a')
SELECT split AS era, bool_or(base - auroc > 0.02) AS gated FROM ar JOIN b USING (label) WHERE model = 'a' GROUP BY 1""")
def auroc_gate(spark, d):
    table = evaluate.auroc(st.predictions(spark, d).where("model = 'a'"), ["split", "label"]).withColumnRenamed("split", "era")
    return drift.performance_gate(table, "pre")


# Evaluation


@query(f"""WITH {st.PREDICTIONS}, {_BY_SPLIT}, m AS (SELECT split, model, label, count(*) AS n, sum(y)::BIGINT AS n_pos, avg(pow(prob - y, 2)) AS brier FROM p GROUP BY ALL), x AS (SELECT split, model, label, sum(p * tp / (tp + fp)) / max(np) AS ap FROM cu GROUP BY ALL)
SELECT split, model, label, n, n_pos, round(brier, 6) AS brier, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM m JOIN ar USING (split, model, label) JOIN x USING (split, model, label)""")
def all_metrics(spark, d):
    return rounded(evaluate.metrics(st.predictions(spark, d)))


@query(f"""WITH {st.PREDICTIONS}, {CUM.replace('model, label', 'seed, model, label').replace('FROM p GROUP', 'FROM (SELECT *, id % 5 AS seed FROM p) GROUP')},
r AS (SELECT *, row_number() OVER (PARTITION BY model, label ORDER BY auroc, seed) AS k, count(*) OVER (PARTITION BY model, label) AS n FROM ar WHERE auroc IS NOT NULL AND NOT isnan(auroc))
SELECT model, label, round(avg(auroc), 6) AS mean, round(stddev_samp(auroc), 6) AS sd, max(seed) FILTER (k = (n + 1) // 2) AS median_seed FROM r GROUP BY ALL""")
def seed_summary(spark, d):
    """Five runs, each of a fifth of the rows."""
    runs = evaluate.auroc(st.predictions(spark, d).withColumn("seed", F.col("id") % 5), ["seed", "model", "label"])
    return rounded(evaluate.seed_summary(runs.where("auroc is not null")))


@query(f"""WITH {st.PREDICTIONS}, {CUM}, g AS (SELECT x.model, x.auroc - b.auroc AS d FROM ar x JOIN ar b ON b.label = x.label AND b.model = 'a' WHERE x.model <> 'a')
SELECT model, round(avg(d), 6) AS mean_delta, round(max(d), 6) AS max_delta, count(*) FILTER (d > 0) AS n_improved FROM g GROUP BY 1""")
def macro_gains(spark, d):
    return rounded(evaluate.macro_gains(evaluate.gains(evaluate.auroc(st.predictions(spark, d)), "a")))


@query(f"WITH {st.PREDICTIONS}, {CUM} SELECT label, arg_max(model, (auroc, CASE model WHEN 'a' THEN 3 WHEN 'b' THEN 2 ELSE 1 END)) AS winner FROM ar GROUP BY 1")
def winners(spark, d):
    return evaluate.winners(evaluate.auroc(st.predictions(spark, d)), order=("a", "b", "c"))


@query(f"""WITH {st.PREDICTIONS}, x AS (SELECT id, label, y FROM p WHERE model = 'a' AND id % 3 > 0), z AS (SELECT id, label, CASE WHEN id % 5 = 0 THEN 1 - y ELSE y END AS y FROM p WHERE model = 'b' AND id % 4 > 0)
SELECT count(*) FILTER (z.id IS NULL) AS only_x, count(*) FILTER (x.id IS NULL) AS only_y, count(*) FILTER (x.y <> z.y) AS label_differs FROM x FULL JOIN z ON x.id = z.id AND x.label = z.label""")
def align_models(spark, d):
    p = st.predictions(spark, d).where("model = 'a' and id % 3 > 0 or model = 'b' and id % 4 > 0")
    return evaluate.check_alignment(p.withColumn("y", F.when((F.col("model") == "b") & (F.col("id") % 5 == 0), 1 - F.col("y")).otherwise(F.col("y"))), "a", "b")


# Attribution and retrieval


@query(f"WITH {st.ATTR} SELECT model, label, feature, round(avg(abs(value)), 6) AS phi FROM att GROUP BY ALL")
def population_mean(spark, d):
    return rounded(attribution.population_mean(st.attributions(spark, d)))


_TREAT = [f"f{i}" for i in range(8)]
_STREAM = f"CASE WHEN feature IN ({', '.join(repr('mean_' + f) for f in _TREAT)}) THEN 'treat' ELSE 'physio' END"


def _stream():
    return attribution.tag_stream(F.col("feature"), _TREAT)


@query(f"""WITH {st.ATTR}, m AS (SELECT id, label, model, {_STREAM} AS stream, avg(abs(value)) AS mass FROM att GROUP BY ALL)
SELECT a.id, a.label, a.model, a.stream, round(a.mass, 6) AS mass, round(abs(a.mass - s.mass), 6) AS mass_delta FROM m a JOIN m s ON s.id = a.id AND s.label = a.label AND s.stream = a.stream AND s.model = 'source' WHERE a.model <> 'source'""")
def case_mass(spark, d):
    return rounded(attribution.mass_delta(attribution.case_mass(st.attributions(spark, d), _stream()), "source"))


_LIMITS = {"physio": 5, "treat": 4}
_TOP = f"""tp AS (SELECT *, row_number() OVER (PARTITION BY id, label, model, stream ORDER BY abs(value) DESC, feature) AS rank FROM (SELECT *, {_STREAM} AS stream FROM att)),
tk AS (SELECT *, substr(feature, 6) AS name FROM tp WHERE rank <= CASE stream WHEN 'physio' THEN 5 ELSE 4 END),
bq AS (SELECT id, label, model, stream, string_agg(name, ' ' ORDER BY rank) AS names FROM tk GROUP BY ALL)"""


@query(f"""WITH {st.ATTR}, {_TOP} SELECT id, label, model, stream, label || ' ICU ' || names AS query FROM bq
UNION ALL SELECT p.id, p.label, p.model, 'combined', p.label || ' ICU ' || p.names || ' ' || t.names FROM bq p JOIN bq t ON t.id = p.id AND t.label = p.label AND t.model = p.model AND t.stream = 'treat' WHERE p.stream = 'physio'""")
def build_queries(spark, d):
    top = attribution.top_features(st.attributions(spark, d), _stream(), _LIMITS)
    return retrieval.build_queries(top, _LIMITS)


def _hits(spark, d, low, high, k=20):
    return retrieval.topk(*st.vectors(spark, d, slice(low, high)), k=k)


_PHYSIO = f"{st.hits_sql('h', 0, 32, 20)}, {st.hits_sql('k', 32, 64, 20)}"
_TREATS = f"{st.hits_sql('m', 0, 64, 20)}, {st.hits_sql('n', 0, 32, 20)}"


def _stable(a: str, b: str, name: str) -> str:
    rank = "rank() OVER (PARTITION BY query_id ORDER BY {c}) + (count(*) OVER (PARTITION BY query_id, {c}) - 1) / 2 AS r{c}"
    return f"""{name}s AS (SELECT query_id, list(doc_id) AS a FROM {a} GROUP BY 1), {name}t AS (SELECT query_id, list(doc_id) AS b FROM {b} GROUP BY 1),
{name}j AS (SELECT query_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jacc_{name} FROM {name}s JOIN {name}t USING (query_id)),
{name}c AS (SELECT query_id, {rank.format(c='x')}, {rank.format(c='y')} FROM (SELECT query_id, x.sim AS x, y.sim AS y FROM {a} x JOIN {b} y USING (query_id, doc_id))),
{name}r AS (SELECT query_id, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END AS rho_{name} FROM {name}c GROUP BY 1)"""


@query(f"""WITH {_PHYSIO}, {_TREATS}, {_stable('h', 'k', 'physio')}, {_stable('m', 'n', 'treat')}
SELECT query_id, jacc_physio, rho_physio, jacc_treat, rho_treat FROM physioj LEFT JOIN physior USING (query_id) JOIN treatj USING (query_id) LEFT JOIN treatr USING (query_id)""")
def stability_table(spark, d):
    out = retrieval.stability({"physio": _hits(spark, d, 0, 32), "treat": _hits(spark, d, 0, 64)}, {"physio": _hits(spark, d, 32, 64), "treat": _hits(spark, d, 0, 32)})
    return rounded(out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("rho_physio", "rho_treat")}))


@query(f"""WITH {_PHYSIO}, u AS (SELECT query_id AS id, doc_id % 3 AS label, 'x' AS model, doc_id FROM h UNION ALL SELECT query_id, doc_id % 3, 'y', doc_id FROM k),
a AS (SELECT id, label, list_sort(list(DISTINCT doc_id)) AS x FROM u WHERE model = 'x' GROUP BY ALL), b AS (SELECT id, label, list_sort(list(DISTINCT doc_id)) AS y FROM u WHERE model = 'y' GROUP BY ALL)
SELECT id, label::VARCHAR AS label, array_to_string(x, ',') AS hits_x, array_to_string(y, ',') AS hits_y FROM a JOIN b USING (id, label)""")
def paired_hits(spark, d):
    u = None
    for model, (low, high) in {"x": (0, 32), "y": (32, 64)}.items():
        h = _hits(spark, d, low, high).select(F.col("query_id").alias("id"), (F.col("doc_id") % 3).cast("string").alias("label"), F.lit(model).alias("model"), "doc_id")
        u = h if u is None else u.unionByName(h)
    out = retrieval.pair_models(u, "x", "y")
    return out.select("id", "label", *[F.array_join(F.transform(F.sort_array(c), lambda x: x.cast("string")), ",").alias(c) for c in ("hits_x", "hits_y")])


_RHO = """r{s} AS (SELECT label, rank() OVER ({w} ORDER BY delta) + (count(*) OVER (PARTITION BY {k} delta) - 1) / 2 AS rx, rank() OVER ({w} ORDER BY lost) + (count(*) OVER (PARTITION BY {k} lost) - 1) / 2 AS ry FROM cs)"""


@query(f"""WITH {st.PREDICTIONS}, cs AS (SELECT label, abs(max(prob) FILTER (model = 'a') - max(prob) FILTER (model = 'b')) AS delta, 1 - max(prob) FILTER (model = 'c') AS lost FROM p GROUP BY id, label),
{_RHO.format(s=1, w='PARTITION BY label', k='label, ')}, {_RHO.format(s=2, w='', k='')},
u AS (SELECT label, count(*) AS n, corr(rx, ry) AS rho FROM r1 GROUP BY 1 UNION ALL SELECT 'overall', count(*), corr(rx, ry) FROM r2), z AS (SELECT *, abs(atanh(rho)) * sqrt(n - 3) / sqrt(2) AS z FROM u)
SELECT label, n, round(rho, 6) AS rho, round({_ERFC.format(x='z')}, 6) AS p FROM z""")
def divergence_correlation(spark, d):
    wide = evaluate.wide_models(st.predictions(spark, d), ["a", "b", "c"])
    cases = wide.select("label", F.abs(F.col("a") - F.col("b")).alias("delta"), F.col("c").alias("jacc"))
    return rounded(retrieval.divergence_correlation(cases, "delta", "jacc"))


@query("SELECT doc_id, lower(source) IN ('src1', 'web', 'en') OR lower(lang) IN ('src1', 'web', 'en') AS relevant FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def term_relevance(spark, d):
    docs = st.table(spark, d, "documents").where("source is not null and lang is not null")
    return docs.select("doc_id", retrieval.relevance(F.array(F.upper("source"), "lang"), F.array(F.lit("SRC1"), F.lit("Web"), F.lit("EN"))).alias("relevant"))


@query(f"""WITH {st.hits_sql('h', 0, 64, 20)} SELECT query_id, round(avg((sim >= 0.4)::INTEGER), 6) AS share FROM h GROUP BY 1""")
def share_above(spark, d):
    return rounded(retrieval.share_above(_hits(spark, d, 0, 64)))


@query(f"""WITH {st.hits_sql('h', 0, 64, 20)}, b AS (SELECT q.vec_id AS query_id, avg(list_dot_product(q.x, v.x)) AS base FROM hv q JOIN hv v ON q.vec_id % 50 = 0 GROUP BY 1)
SELECT query_id, round(avg(sim) / nullif(max(base), 0), 4) AS lift FROM h JOIN b USING (query_id) GROUP BY 1""")
def retrieval_lift(spark, d):
    q, docs = st.vectors(spark, d)
    return rounded(retrieval.sim_lift(retrieval.topk(q, docs, 20), q, docs), 4)


@query(f"""WITH {st.hits_sql('h', 0, 64)}, s AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 50 = 0), g AS (SELECT * FROM h WHERE query_id % 100 = 0)
SELECT s.query_id, round(avg(rel::INTEGER), 6) AS precision FROM s LEFT JOIN g USING (query_id) GROUP BY 1""")
def precision_of_all(spark, d):
    """Queries without hits are there too: half of the hits are left out."""
    q, docs = st.vectors(spark, d)
    hits = retrieval.topk(q, docs).where("query_id % 100 = 0")
    hits = hits.join(q.select("query_id", F.col("lab").alias("a")), "query_id").join(docs.select("doc_id", F.col("lab").alias("b")), "doc_id").withColumn("rel", (F.col("a") == F.col("b")).cast("int"))
    out = retrieval.precision_at_k(hits, queries=q)
    return rounded(out.withColumn("precision", F.when(~F.isnan("precision"), F.col("precision"))))


@query(f"""WITH {st.hits_sql('h', 0, 64)}, r AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 2 END AS rating FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rating DESC, rank) AS best FROM r)
SELECT query_id, round(avg(rating), 6) AS precision, CASE WHEN max(rating) > 0 THEN round(sum(rating / log2(rank + 1)) / sum(rating / log2(best + 1)), 6) END AS ndcg FROM b GROUP BY 1""")
def rated_metrics(spark, d):
    """Documents whose id is divisible by 4 have no rating."""
    hits = retrieval.topk(*st.vectors(spark, d))
    ratings = hits.where("doc_id % 4 <> 0").select("query_id", "doc_id", (F.col("doc_id") % 2).cast("int").alias("rating"))
    out = retrieval.rated_metrics(hits, ratings, keys=["query_id"], doc="doc_id")
    return rounded(out.withColumn("ndcg", F.when(~F.isnan("ndcg"), F.col("ndcg"))))


@query(f"""WITH {st.PREDICTIONS}, c AS (SELECT id, label, y, prob, (id % 7) / 7 AS jaccard, prob >= 0.5 AS tp FROM p WHERE model = 'a' AND y = 1)
SELECT label, arg_max(id, (tp, CASE WHEN tp THEN jaccard ELSE -1 END, prob, -id)) AS id, bool_or(tp) AS is_tp FROM c GROUP BY 1""")
def best_cases(spark, d):
    cases = st.predictions(spark, d).where("model = 'a'").withColumns({"jaccard": (F.col("id") % 7) / 7, "is_tp": F.col("prob") >= 0.5})
    return retrieval.best_case(cases)


@query("""SELECT doc_id, CASE WHEN contains(lower(coalesce(text, '')), 'the ') THEN 1 ELSE 0 END AS hit FROM documents""")
def keyword_documents(spark, d):
    return st.table(spark, d, "documents").select("doc_id", text.any_keyword(F.col("text"), ["THE "]).alias("hit"))


# Helpers over attributions, weights and items


@query(f"""WITH {st.ATTR}, v AS (SELECT id, label, feature, max(value) FILTER (model = 'adapted') - max(value) FILTER (model = 'source') AS d FROM att GROUP BY ALL),
q AS (SELECT label, greatest(quantile_cont(abs(value), 0.95), 1e-6) AS scale FROM att WHERE model = 'source' GROUP BY 1),
s AS (SELECT id, label, feature, d / scale AS shift FROM v JOIN q USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY abs(shift) DESC, feature DESC) AS k FROM s)
SELECT id, label, feature, round(shift, 6) AS shift FROM r WHERE k = 1""")
def largest_shifts(spark, d):
    return rounded(attribution.largest_shift(attribution.normalized_delta(st.attributions(spark, d), "source", "adapted")))


_WEIGHTS = "wb AS (SELECT 'layer' || (vec_id % 40) AS layer, vec_id, unnest(range(len(embedding))) AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), ww AS (SELECT layer, v[i + 1] AS b, v[(i + 1) % len(v) + 1] AS a FROM wb)"
_LAYERS = f"""{_WEIGHTS}, wl AS (SELECT layer, sqrt(sum((a - b) * (a - b))) AS l2, sqrt(sum(b * b)) AS nb, sqrt(sum(a * a)) AS na, sum(a * b) AS ab FROM ww GROUP BY 1),
wd AS (SELECT layer, l2, l2 / greatest(nb, 1e-12) AS relative, ab / greatest(na * nb, 1e-12) AS cosine FROM wl)"""


def _weights(spark, d):
    e = st.table(spark, d, "embeddings").select(F.concat(F.lit("layer"), F.col("vec_id") % 40).alias("layer"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    after = F.get("v", (F.col("i") + 1) % F.size("v"))
    return e.select("layer", "v", F.posexplode("v").alias("i", "before")).select("layer", "i", "before", after.alias("after"))


@query(f"WITH {_LAYERS} SELECT layer, round(l2, 6) AS l2, round(relative, 6) AS relative, round(cosine, 6) AS cosine FROM wd")
def layer_changes(spark, d):
    """Vectors as a layer's weights before, shifted by one place as those after."""
    return rounded(attribution.weight_delta(_weights(spark, d)))


@query(f"WITH {_LAYERS} SELECT CASE WHEN layer LIKE 'layer1%' THEN 'low' ELSE 'other' END AS grp, round(avg(relative), 6) AS mean_relative, round(max(relative), 6) AS max_relative FROM wd GROUP BY 1")
def layer_groups(spark, d):
    group = F.when(F.col("layer").startswith("layer1"), "low").otherwise("other")
    return rounded(attribution.weight_groups(attribution.weight_delta(_weights(spark, d)), group))


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, u.feature, round(CASE u.feature WHEN 'l_quantity' THEN 0.5 * (l_quantity - 25) WHEN 'l_discount' THEN 3.0 * l_discount ELSE 0.001 * (l_extendedprice - 1000) END, 6) AS value
FROM lineitem, (SELECT unnest(['l_quantity', 'l_discount', 'l_extendedprice']) AS feature) u""")
def linear_attribution(spark, d):
    li = st.table(spark, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(attribution.linear_attribution(li, {"l_quantity": 0.5, "l_discount": 3.0, "l_extendedprice": 0.001}, {"l_quantity": 25.0, "l_extendedprice": 1000.0}))


@query(f"""WITH {st.PREDICTIONS}, {CUM}, {weights_sql('p')}, {replicates_sql('auroc')}
SELECT label, round(p, 6) AS p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM ki""")
def significance_stars(spark, d):
    out = resample.paired_bootstrap(st.predictions(spark, d), "a", "c", REPLICATES)
    return rounded(out.select("label", "p", resample.stars(F.col("p")).alias("stars")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_name AS label, CASE WHEN lower(p_name) LIKE '%small%' THEN -l_quantity WHEN lower(p_name) LIKE '%widget%' OR lower(p_name) LIKE '%bolt%' THEN l_quantity END AS signed
FROM lineitem JOIN part ON p_partkey = l_partkey""")
def item_labels(spark, d):
    """Rows with the label of their item, and the sign that its words give their value."""
    items = st.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("label"))
    rows = channels.with_item_label(st.table(spark, d, "lineitem"), items, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "label", channels.signed_value(F.col("label"), F.col("l_quantity"), ["widget", "bolt"], ["small"]).alias("signed"))
