"""Queries of drift audits, model evaluation, attribution and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import attribution, drift, evaluate, resample, retrieval, splits, train
from ..sources import corpus
from . import standin as st
from .registry import nearest, query, rounded

A, B = "1996", "1999"

EQUAL_WIDTH = """sp AS (SELECT feature, min(value) - 1e-6 AS lo, max(value) + 1e-6 AS hi FROM lp GROUP BY 1),
eb AS (SELECT lp.feature, CAST(least(floor((value - lo) / ((hi - lo) / {n})), {n} - 1) AS INTEGER) AS bin, count(*) FILTER (grp = '1996') AS r, count(*) FILTER (grp = '1999') AS c FROM lp JOIN sp USING (feature) GROUP BY ALL),
eg AS (SELECT g.feature, g.bin, lo, hi, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM (SELECT feature, lo, hi, unnest(range({n}))::INTEGER AS bin FROM sp) g LEFT JOIN eb USING (feature, bin))"""


@query(f"""WITH {st.LONG}, {EQUAL_WIDTH.format(n=10)}, x AS (SELECT feature, (r + 1) / (sum(r) OVER w + 10) AS p, (c + 1) / (sum(c) OVER w + 10) AS q FROM eg WINDOW w AS (PARTITION BY feature))
SELECT feature, round(sum((q - p) * ln(q / p)), 6) AS psi FROM x GROUP BY 1""")
def psi_equal_width(spark, d):
    return rounded(drift.psi_equal_width(st.drift_long(spark, d), A, B))


PSI_QUANTILE = """bk AS (SELECT feature, list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS b FROM lp WHERE grp = '1996' GROUP BY 1),
qb AS (SELECT lp.feature, len(list_filter(list_sort(b)[2:len(b) - 1], lambda z: z <= value)) AS bin, len(b) > 1 AS ok, count(*) FILTER (grp = '1996') AS r, count(*) FILTER (grp = '1999') AS c FROM lp JOIN bk USING (feature) GROUP BY ALL),
qs AS (SELECT feature, ok, least(greatest(r / sum(r) OVER w, 1e-6), 1 - 1e-6) AS p, least(greatest(c / sum(c) OVER w, 1e-6), 1 - 1e-6) AS q FROM qb WINDOW w AS (PARTITION BY feature)),
pq AS (SELECT feature, CASE WHEN bool_and(ok) THEN sum((q - p) * ln(q / p)) ELSE 0 END AS psi FROM qs GROUP BY 1)"""


@query(f"WITH {st.LONG}, {PSI_QUANTILE} SELECT feature, round(psi, 6) AS psi FROM pq WHERE feature <> 'returned'")
def psi_quantile(spark, d):
    return rounded(drift.psi_quantile(st.drift_long(spark, d).where("feature <> 'returned'"), A, B))


@query(f"""WITH {st.LONG}, m AS (SELECT feature, avg(value) FILTER (grp = '1996') AS a, avg(value) FILTER (grp = '1999') AS b FROM lp WHERE feature = 'returned' GROUP BY 1)
SELECT feature, round((b - a) * ln(b / a) + ((1 - b) - (1 - a)) * ln((1 - b) / (1 - a)), 6) AS psi, round(a, 6) AS rate_ref, round(b, 6) AS rate_cur, round(b - a, 6) AS shift, round(abs(b - a), 6) AS abs_shift, round(abs(b - a) / (a + 1e-6), 6) AS rel_shift FROM m""")
def psi_binary(spark, d):
    long = st.drift_long(spark, d).where("feature = 'returned'")
    return rounded(drift.psi_binary(long, A, B).join(drift.rate_shift(long, A, B), "feature"))


KS = """kc AS (SELECT feature, value, count(*) FILTER (grp = '1996') AS r, count(*) FILTER (grp = '1999') AS c FROM lp GROUP BY ALL),
kw AS (SELECT feature, sum(r) OVER u / sum(r) OVER t AS f, sum(c) OVER u / sum(c) OVER t AS g, sum(r) OVER t AS n_ref, sum(c) OVER t AS n_cur FROM kc WINDOW u AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY feature)),
ks AS (SELECT feature, n_ref::BIGINT AS n_ref, n_cur::BIGINT AS n_cur, max(abs(f - g)) AS ks FROM kw GROUP BY ALL)"""


@query(f"WITH {st.LONG}, {KS} SELECT feature, n_ref, n_cur, round(ks, 6) AS ks FROM ks")
def ks(spark, d):
    return rounded(drift.ks_two_sample(st.drift_long(spark, d), A, B))


CHI = """ct AS (SELECT feature, count(*) FILTER (grp = '1996' AND value = 1)::DOUBLE AS a, count(*) FILTER (grp = '1996' AND value <> 1)::DOUBLE AS b, count(*) FILTER (grp = '1999' AND value = 1)::DOUBLE AS c, count(*) FILTER (grp = '1999' AND value <> 1)::DOUBLE AS d FROM lp WHERE feature = 'returned' GROUP BY 1),
ch AS (SELECT feature, (a + b + c + d) * pow(greatest(abs(a * d - b * c) - least((a + b + c + d) / 2, abs(a * d - b * c)), 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM ct)"""


@query(f"WITH {st.LONG}, {CHI} SELECT feature, round(chi2, 6) AS chi2 FROM ch")
def chi2(spark, d):
    return rounded(drift.chi2_2x2(st.drift_long(spark, d).where("feature = 'returned'"), A, B))


MOMENTS = """mo AS (SELECT feature, count(*) FILTER (grp = '1996') AS n_ref, count(*) FILTER (grp = '1999') AS n_cur, avg(value) FILTER (grp = '1996') AS mean_ref, avg(value) FILTER (grp = '1999') AS mean_cur,
  stddev_pop(value) FILTER (grp = '1996') AS sd_ref, stddev_pop(value) FILTER (grp = '1999') AS sd_cur, var_samp(value) FILTER (grp = '1996') AS vr, var_samp(value) FILTER (grp = '1999') AS vc FROM lp GROUP BY 1),
co AS (SELECT feature, (mean_ref - mean_cur) / sqrt(((n_ref - 1) * vr + (n_cur - 1) * vc) / (n_ref + n_cur - 2)) AS d FROM mo)"""


@query(f"WITH {st.LONG}, {MOMENTS} SELECT feature, round(d, 6) AS d FROM co")
def cohen_d(spark, d):
    return rounded(drift.cohen_d(st.drift_long(spark, d), A, B))


AUDIT = f"""{PSI_QUANTILE}, {KS}, {CHI}, {MOMENTS},
pb AS (SELECT feature, (mean_cur - mean_ref) * ln(mean_cur / mean_ref) + (mean_ref - mean_cur) * ln((1 - mean_cur) / (1 - mean_ref)) AS psi FROM mo WHERE feature = 'returned'),
au AS (SELECT mo.feature, mo.n_ref, mo.n_cur, mean_ref, mean_cur, sd_ref, sd_cur, CASE WHEN mo.feature = 'returned' THEN pb.psi ELSE pq.psi END AS psi, co.d, CASE WHEN mo.feature <> 'returned' THEN ks.ks END AS ks, ch.chi2,
  mo.feature = 'returned' AS bin, abs(mean_cur - mean_ref) AS abs_shift, abs(mean_cur - mean_ref) / (abs(mean_ref) + 1e-6) AS rel_shift
  FROM mo JOIN pq USING (feature) JOIN co USING (feature) LEFT JOIN ks USING (feature) LEFT JOIN ch USING (feature) LEFT JOIN pb USING (feature)),
av AS (SELECT *, CASE WHEN bin THEN 'binary' ELSE 'continuous' END AS kind, CASE WHEN bin THEN abs_shift ELSE psi END AS drift_score,
  CASE WHEN bin THEN abs_shift > 0.05 OR rel_shift > 0.2 ELSE psi > 0.2 END AS drifted,
  CASE WHEN bin THEN CASE WHEN abs_shift > 0.1 OR rel_shift > 0.4 THEN 'severe' WHEN abs_shift > 0.05 OR rel_shift > 0.2 THEN 'moderate' WHEN abs_shift > 0.02 THEN 'minor' ELSE 'stable' END
       ELSE CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'minor' WHEN psi < 0.35 THEN 'moderate' ELSE 'severe' END END AS severity FROM au)"""


def _audit(spark, d):
    return drift.audit(st.drift_long(spark, d), A, B, ["returned"])


#: Upper tail of chi-square with one degree of freedom and of Kolmogorov's distribution, as series.
_ERFC = """CASE WHEN {x} >= 6 THEN 0 WHEN {x} <= 0 THEN 1 ELSE greatest(0, 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) *
  list_sum(list_transform(range(0, 160), lambda n: exp(2 * n * ln(2) + lgamma(n + 1) + (2 * n + 1) * ln({x}) - lgamma(2 * n + 2))))) END"""
_KOLMOGOROV = """CASE WHEN {t} < 0.2 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k:
  (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * (k * {t}) * (k * {t})))))) END"""
TESTED = f"""{AUDIT}, aw AS (SELECT *, CASE WHEN NOT bin THEN {_KOLMOGOROV.format(t="(ks * sqrt(n_ref * n_cur / (n_ref + n_cur)))")} END AS ks_p,
  CASE WHEN bin THEN {_ERFC.format(x="sqrt(chi2 / 2)")} END AS chi2_p FROM av),
ax AS (SELECT *, coalesce(coalesce(ks_p, chi2_p) < 0.05 / count(coalesce(ks_p, chi2_p)) OVER (), false) AS significant FROM aw)"""
_SIX = ["mean_ref", "mean_cur", "sd_ref", "sd_cur", "psi", "d", "ks", "ks_p", "chi2", "chi2_p", "abs_shift", "rel_shift", "drift_score"]


@query(f"""WITH {st.LONG}, {TESTED} SELECT feature, n_ref, n_cur, {', '.join(f'round({c}, 6) AS {c}' for c in _SIX)},
kind, severity, drifted, significant FROM ax""")
def drift_audit(spark, d):
    return rounded(_audit(spark, d))


@query(f"""WITH {st.LONG}, {TESTED} SELECT count(*) AS n_features, count(*) FILTER (drifted) AS n_drifted, count(*) FILTER (significant) AS n_significant,
round(avg(psi), 6) AS mean_psi, round(max(psi), 6) AS max_psi,
CASE WHEN avg(psi) < 0.1 THEN 'stable' WHEN avg(psi) < 0.2 THEN 'minor' WHEN avg(psi) < 0.35 THEN 'moderate' ELSE 'severe' END AS level FROM ax""")
def drift_summary(spark, d):
    return rounded(drift.summary(_audit(spark, d)))


@query(f"WITH {st.LONG}, {AUDIT} SELECT feature, round(length(feature) / 10.0 * drift_score, 6) AS combined FROM av ORDER BY 2 DESC, 1 LIMIT 15")
def drift_importance(spark, d):
    audited = _audit(spark, d)
    importance = audited.select("feature", (F.length("feature") / 10.0).alias("importance"))
    return rounded(drift.combine_importance(audited, importance).select("feature", "combined"))


def scan_sql(long: str, k: int) -> str:
    pair = """SELECT '{a}' AS era, '{b}' AS next_era, (SELECT avg(psi) FROM (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM (SELECT feature, least(greatest(r / sum(r) OVER w, 1e-6), 1 - 1e-6) AS p, least(greatest(c / sum(c) OVER w, 1e-6), 1 - 1e-6) AS q FROM
      (SELECT l.feature, len(list_filter(list_sort(k)[2:len(k) - 1], lambda z: z <= value)) AS bin, count(*) FILTER (grp = '{a}') AS r, count(*) FILTER (grp = '{b}') AS c FROM l JOIN
       (SELECT feature, list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS k FROM l WHERE grp = '{a}' GROUP BY 1) USING (feature) WHERE grp IN ('{a}', '{b}') AND l.feature <> 'returned' GROUP BY ALL) WINDOW w AS (PARTITION BY feature)) GROUP BY 1)) AS distance"""
    years = [str(y) for y in range(1995, 2002)]
    rows = " UNION ALL ".join(pair.format(a=a, b=b) for a, b in zip(years, years[1:]))
    limit = f"(SELECT {k} * distance FROM sc WHERE era = '1995')"
    return f"WITH {long}, sc AS ({rows}) SELECT era, next_era, round(distance, 6) AS distance, round({limit}, 6) AS threshold, distance > {limit} AS drift FROM sc"


@query(scan_sql(st.LONG, 2))
def era_scan(spark, d):
    long = st.drift_long(spark, d).where("feature <> 'returned' and grp between '1995' and '2001'")
    return rounded(drift.scan_eras(long))


@query(f"WITH {st.LONG}, {EQUAL_WIDTH.format(n=20)} SELECT feature, bin, round(lo + bin * ((hi - lo) / 20), 4) AS left_edge, round(r / (sum(r) OVER w * ((hi - lo) / 20)), 6) AS density_ref, round(c / (sum(c) OVER w * ((hi - lo) / 20)), 6) AS density_cur FROM eg WINDOW w AS (PARTITION BY feature)")
def histogram(spark, d):
    h = drift.histogram(st.drift_long(spark, d), A, B)
    return h.select("feature", "bin", nearest(F.col("left"), 4).alias("left_edge"), nearest(F.col("density_ref"), 6).alias("density_ref"), nearest(F.col("density_cur"), 6).alias("density_cur"))


CUM = """c0 AS (SELECT model, label, prob, count(*) FILTER (y = 1) AS p, count(*) FILTER (y <> 1) AS n FROM p GROUP BY ALL),
cu AS (SELECT *, sum(p) OVER u AS tp, sum(n) OVER u AS fp, sum(p) OVER t AS np, sum(n) OVER t AS nn FROM c0 WINDOW u AS (PARTITION BY model, label ORDER BY prob DESC ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY model, label)),
ar AS (SELECT model, label, sum(n * (tp - p / 2)) / (max(np) * max(nn)) AS auroc FROM cu GROUP BY ALL)"""


@query(f"WITH {st.PREDICTIONS}, {CUM} SELECT model, label, round(auroc, 6) AS auroc FROM ar")
def auroc(spark, d):
    return rounded(evaluate.auroc(st.predictions(spark, d)))


@query(f"WITH {st.PREDICTIONS}, {CUM} SELECT model, label, round(sum(p * tp / (tp + fp)) / max(np), 6) AS ap FROM cu GROUP BY ALL")
def average_precision(spark, d):
    return rounded(evaluate.average_precision(st.predictions(spark, d)))


@query(f"WITH {st.PREDICTIONS} SELECT split, model, label, round(avg(pow(prob - y, 2)), 6) AS brier FROM p GROUP BY ALL")
def brier(spark, d):
    return rounded(evaluate.brier(st.predictions(spark, d), ["split", "model", "label"]))


_CONF = "count(*) FILTER (prob >= t AND y = 1) AS tp, count(*) FILTER (prob >= t AND y <> 1) AS fp, count(*) FILTER (prob < t AND y <> 1) AS tn, count(*) FILTER (prob < t AND y = 1) AS fn"
_RATES = "round(tp / greatest(tp + fn, 1), 6) AS sensitivity, round(tn / greatest(tn + fp, 1), 6) AS specificity, round(tp / greatest(tp + fp, 1), 6) AS precision, round(2 * (tp / greatest(tp + fp, 1)) * (tp / greatest(tp + fn, 1)) / greatest(tp / greatest(tp + fp, 1) + tp / greatest(tp + fn, 1), 1e-9), 6) AS f1"


@query(f"WITH {st.PREDICTIONS}, k AS (SELECT model, label, t::DOUBLE AS tau, {_CONF} FROM p, (VALUES (0.5)) v(t) GROUP BY ALL) SELECT *, {_RATES} FROM k")
def confusion(spark, d):
    return rounded(evaluate.confusion(st.predictions(spark, d)))


@query(f"WITH {st.PREDICTIONS}, k AS (SELECT model, label, t::DOUBLE AS tau, {_CONF} FROM p, (VALUES (0.3), (0.4), (0.5), (0.6), (0.7)) v(t) GROUP BY ALL) SELECT *, {_RATES} FROM k")
def threshold_sweep(spark, d):
    return rounded(evaluate.threshold_sweep(st.predictions(spark, d)))


@query(f"WITH {st.PREDICTIONS}, {CUM} SELECT model, round(max(auroc) FILTER (label = 'quality'), 6) AS quality, round(max(auroc) FILTER (label = 'toxic'), 6) AS toxic FROM ar GROUP BY 1")
def summary_table(spark, d):
    return rounded(evaluate.summary_table(evaluate.auroc(st.predictions(spark, d)), "auroc", ["quality", "toxic"]))


PAIRS, TAUS = [("a", "b"), ("a", "c"), ("b", "c")], [(0.5, 0.1), (0.5, 0.4), (0.6, 0.3)]
_WIDE = "wm AS (SELECT id, label, max(y) AS y, max(prob) FILTER (model = 'a') AS a, max(prob) FILTER (model = 'b') AS b, max(prob) FILTER (model = 'c') AS c FROM p GROUP BY ALL)"
_CASES = " UNION ALL ".join(f"SELECT label, y, '{x}' AS model_x, '{y}' AS model_y, {h}::DOUBLE AS hi, {lo}::DOUBLE AS lo, {x} AS px, {y} AS py FROM wm" for x, y in PAIRS for h, lo in TAUS)


@query(f"""WITH {st.PREDICTIONS}, {_WIDE}, cs AS ({_CASES}), k AS (SELECT label, model_x, model_y, hi, lo, count(*) AS n, count(*) FILTER (px >= hi AND py < lo) AS x_catch, count(*) FILTER (py >= hi AND px < lo) AS y_catch, count(*) FILTER (px >= hi AND py >= hi) AS both_high, count(*) FILTER (px < hi AND py < hi) AS both_low FROM cs WHERE y = 1 GROUP BY ALL)
SELECT * , CASE WHEN y_catch = 0 THEN NULL ELSE round(x_catch / y_catch, 6) END AS asymmetry FROM k""")
def disagreement(spark, d):
    out = evaluate.disagreement(st.predictions(spark, d), PAIRS, TAUS)
    return rounded(out.withColumn("asymmetry", F.when(F.col("asymmetry") < float("inf"), F.col("asymmetry"))))


@query(f"""WITH {st.PREDICTIONS}, {_WIDE}, cs AS ({_CASES}) SELECT label, model_x, model_y, hi, lo, count(*) AS n, count(*) FILTER (px >= hi AND py < lo) AS x_alarm, count(*) FILTER (py >= hi AND px < lo) AS y_alarm, count(*) FILTER (px >= hi AND py >= hi) AS both_alarm, count(*) FILTER (px < hi AND py < hi) AS neither FROM cs WHERE y = 0 GROUP BY ALL""")
def false_alarms(spark, d):
    return evaluate.false_alarms(st.predictions(spark, d), PAIRS, TAUS)


@query(f"""WITH {st.PREDICTIONS}, {CUM}, dl AS (SELECT x.label, x.model, x.auroc - b.auroc AS delta FROM ar x JOIN ar b ON b.label = x.label AND b.model = 'a' WHERE x.model <> 'a')
SELECT label, model, round(delta, 6) AS delta, CASE WHEN delta IS NULL THEN 'n/a' WHEN abs(delta) < 0.005 THEN 'negligible' WHEN abs(delta) < 0.015 THEN 'small' WHEN abs(delta) < 0.03 THEN 'moderate' ELSE 'large' END AS size, delta > 0 AS improved FROM dl""")
def metric_gains(spark, d):
    return rounded(evaluate.gains(evaluate.auroc(st.predictions(spark, d)), "a"))


@query(f"""WITH {st.PREDICTIONS}, {_WIDE}, v AS (SELECT label, id, a, b FROM wm WHERE y = 1)
SELECT label, 'largest_gap' AS kind, max_by(id, (a - b, -id)) AS id FROM v GROUP BY ALL
UNION ALL SELECT label, 'both_catch', max_by(id, (a + b, -id)) FROM v WHERE a >= 0.5 AND b >= 0.5 GROUP BY ALL
UNION ALL SELECT label, 'only_x', max_by(id, (a - b, -id)) FROM v WHERE a >= 0.5 AND b < 0.1 GROUP BY ALL""")
def worked_examples(spark, d):
    return evaluate.worked_examples(st.predictions(spark, d), "a", "b").select("label", "kind", "id")


@query(f"""WITH {st.PREDICTIONS}, {CUM}, v AS (SELECT p.id, p.model, p.label, p.y, cu.np, cu.nn, CASE WHEN y = 1 THEN (nn - fp + n / 2) / nn ELSE (tp - cu.p / 2) / np END AS v FROM p JOIN cu ON cu.model = p.model AND cu.label = p.label AND cu.prob = p.prob)
SELECT v.model, v.label, id, y, round((CASE WHEN y = 1 THEN np ELSE nn END * auroc - v) / (CASE WHEN y = 1 THEN np ELSE nn END - 1), 6) AS loo FROM v JOIN ar USING (model, label)""")
def jackknife(spark, d):
    return rounded(resample.jackknife(st.predictions(spark, d)))


REPLICATES = 1000


def _mixed(x: str, shift: int, factor: int) -> str:
    return f"(((xor({x}, {x} >> {shift}))::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def weights_sql(ids: str, replicates: int = REPLICATES) -> str:
    """(id, b, w): the weights of resample's replicates over the ids of a table."""
    start = "((id::UHUGEINT * 11400714819323198485::UHUGEINT + ((b + 1)::UHUGEINT * 15111065706836454659::UHUGEINT) % 18446744073709551616::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    poisson = " + ".join(f"(u >= {float(x)!r})::BIGINT" for x in resample._POISSON)
    return f"""w0 AS (SELECT id, b, {start} AS x FROM (SELECT DISTINCT id FROM {ids}), (SELECT unnest(range({replicates})) AS b)),
w1 AS (SELECT id, b, {_mixed('x', 30, 0xBF58476D1CE4E5B9)} AS x FROM w0), w2 AS (SELECT id, b, {_mixed('x', 27, 0x94D049BB133111EB)} AS x FROM w1),
wt AS (SELECT id, b, {poisson} AS w FROM (SELECT id, b, (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992 AS u FROM w2))"""


def replicates_sql(metric: str, models: str = "'a', 'c'") -> str:
    value = "sum(n * (tp - p / 2)) / (max(np) * max(nn))" if metric == "auroc" else "sum(CASE WHEN p > 0 THEN p * tp / (tp + fp) ELSE 0 END) / max(np)"
    ok = "max(np) > 0 AND max(nn) > 0" if metric == "auroc" else "max(np) > 0"
    part, order = "PARTITION BY model, label, b", "ORDER BY prob DESC ROWS UNBOUNDED PRECEDING"
    return f"""k0 AS (SELECT model, label, b, prob, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 1 THEN 0 ELSE w END) AS n
  FROM p JOIN wt USING (id) WHERE model IN ({models}) AND w > 0 GROUP BY ALL),
k1 AS (SELECT *, sum(p) OVER u AS tp, sum(n) OVER u AS fp, sum(p) OVER t AS np, sum(n) OVER t AS nn FROM k0 WINDOW u AS ({part} {order}), t AS ({part})),
kr AS (SELECT model, label, b, CASE WHEN {ok} THEN {value} END AS v FROM k1 GROUP BY ALL),
kd AS (SELECT label, b, max(v) FILTER (model = 'a') AS va, max(v) FILTER (model = 'c') AS vb FROM kr GROUP BY ALL),
ki AS (SELECT label, quantile_cont(va, 0.025) AS low_a, quantile_cont(va, 0.975) AS high_a, quantile_cont(vb, 0.025) AS low_b, quantile_cont(vb, 0.975) AS high_b,
  quantile_cont(vb - va, 0.025) AS low, quantile_cont(vb - va, 0.975) AS high, avg((vb - va <= 0)::INTEGER) AS p, avg((vb - va > 0)::INTEGER) AS win, count(*) AS n
  FROM kd WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY 1)"""


@query(f"WITH {st.PREDICTIONS}, {weights_sql('p')}, {replicates_sql('auroc', chr(39) + 'a' + chr(39) + ', ' + chr(39) + 'b' + chr(39) + ', ' + chr(39) + 'c' + chr(39))} SELECT model, label, b::INTEGER AS b, round(v, 6) AS auroc FROM kr")
def bootstrap_auroc(spark, d):
    """All replicates of every model and label."""
    return rounded(resample.replicate_metric(st.predictions(spark, d), REPLICATES).withColumnRenamed("value", "auroc"))


_INTERVALS = ["low_a", "high_a", "low_b", "high_b", "low", "high", "p", "win"]
_VERDICT = "CASE WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'undecided' END AS verdict"


@query(f"""WITH {st.PREDICTIONS}, {CUM}, {weights_sql('p')}, {replicates_sql('auroc')},
pt AS (SELECT label, max(auroc) FILTER (model = 'a') AS value_a, max(auroc) FILTER (model = 'c') AS value_b FROM ar GROUP BY 1)
SELECT label, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(value_b - value_a, 6) AS point, {', '.join(f'round({c}, 6) AS {c}' for c in _INTERVALS)}, n, {_VERDICT} FROM pt JOIN ki USING (label)""")
def bootstrap_delta(spark, d):
    return rounded(resample.verdict(resample.paired_bootstrap(st.predictions(spark, d), "a", "c", REPLICATES)))


@query(f"""WITH {st.PREDICTIONS}, {CUM}, {weights_sql('p')}, {replicates_sql('ap')}, ax AS (SELECT model, label, sum(p * tp / (tp + fp)) / max(np) AS ap FROM cu GROUP BY ALL),
pt AS (SELECT label, max(ap) FILTER (model = 'a') AS value_a, max(ap) FILTER (model = 'c') AS value_b FROM ax GROUP BY 1)
SELECT label, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(value_b - value_a, 6) AS point, {', '.join(f'round({c}, 6) AS {c}' for c in _INTERVALS)}, n, {_VERDICT} FROM pt JOIN ki USING (label)""")
def bootstrap_auprc(spark, d):
    return rounded(resample.verdict(resample.paired_bootstrap(st.predictions(spark, d), "a", "c", REPLICATES, metric="ap")))


BOOT = f"""{weights_sql('att')},
b0 AS (SELECT label, feature, model, b, sum(w * abs(value)) / nullif(sum(w), 0) AS phi FROM att JOIN wt USING (id) GROUP BY ALL),
b1 AS (SELECT label, feature, b, max(phi) FILTER (model = 'adapted') - max(phi) FILTER (model = 'source') AS d FROM b0 GROUP BY ALL),
b2 AS (SELECT label, feature, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM b1 WHERE d IS NOT NULL GROUP BY ALL),
b3 AS (SELECT label, feature, avg(abs(value)) FILTER (model = 'adapted') - avg(abs(value)) FILTER (model = 'source') AS delta FROM att GROUP BY ALL)"""


def _attribution_intervals(spark, d):
    """Every core sends one vector for each group, so that the vectors don't grow in number with the table."""
    return resample.bootstrap_mean_delta(st.attributions(spark, d, spark.sparkContext.defaultParallelism), "source", "adapted", REPLICATES)


@query(f"WITH {st.ATTR}, {BOOT} SELECT label, feature, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high FROM b2 JOIN b3 USING (label, feature)")
def bootstrap_attribution(spark, d):
    return rounded(_attribution_intervals(spark, d).where("label is not null"))


@query(f"WITH {st.ATTR}, {BOOT} SELECT label, count(*) AS n, count(*) FILTER (low > 0) AS up, count(*) FILTER (high < 0) AS down FROM b2 GROUP BY 1")
def attribution_significance(spark, d):
    return resample.significance(_attribution_intervals(spark, d), ["label"])


def _normal_cdf(z: str) -> str:
    """The normal distribution function as a series of 200 terms, in logarithms; for sizes up to 8."""
    term = f"exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(k + 1.5) - (k + 1) * ln(2) + 0.5 * ln(pi()))"
    return f"(0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(200), lambda k: {term})))"


_Z = 1.959963984540054  # the normal quantile of 0.975
_END = "greatest(least(" + _normal_cdf("z0 + (z0 + {z}) / (1 - accel * (z0 + {z}))") + ", 0.999), 0.001)"


def _place(at: str) -> str:
    """The value at a share of the sorted list ds, interpolated."""
    h = f"({at} * (len(ds) - 1))"
    return f"(ds[floor({h})::BIGINT + 1] + ({h} - floor({h})) * (ds[least(floor({h})::BIGINT + 2, len(ds))] - ds[floor({h})::BIGINT + 1]))"


#: Newton's steps from 0 climb to the quantile from below, as the function is concave beyond 0.
@query(f"""WITH RECURSIVE {st.PREDICTIONS}, {CUM}, {weights_sql('p')}, {replicates_sql('auroc')},
pv AS (SELECT p.id, p.model, p.label, p.y, CASE WHEN y = 1 THEN np ELSE nn END AS m, CASE WHEN y = 1 THEN (nn - fp + n / 2) / nn ELSE (tp - cu.p / 2) / np END AS v
  FROM p JOIN cu ON cu.model = p.model AND cu.label = p.label AND cu.prob = p.prob),
lo AS (SELECT label, id, y, max((m * auroc - v) / (m - 1)) FILTER (model = 'c') - max((m * auroc - v) / (m - 1)) FILTER (model = 'a') AS d FROM pv JOIN ar USING (model, label) WHERE m > 1 GROUP BY ALL),
lg AS (SELECT label, avg(d) OVER (PARTITION BY label) - d AS g FROM lo WHERE d IS NOT NULL),
la AS (SELECT label, sum(g * g * g) / (6 * pow(sum(g * g), 1.5)) AS accel FROM lg GROUP BY 1),
lp AS (SELECT label, max(auroc) FILTER (model = 'c') - max(auroc) FILTER (model = 'a') AS point FROM ar GROUP BY 1),
lr AS (SELECT label, vb - va AS d, point FROM kd JOIN lp USING (label) WHERE va IS NOT NULL AND vb IS NOT NULL),
ls AS (SELECT label, point, accel, greatest(least(avg((d < point)::INTEGER), 1 - 1e-6), 1e-6) AS below, list(d ORDER BY d) AS ds FROM lr JOIN la USING (label) GROUP BY ALL),
nt AS (SELECT label, 0 AS step, 0.0::DOUBLE AS z, below FROM ls UNION ALL
  SELECT label, step + 1, z - ({_normal_cdf('z')} - below) * sqrt(2 * pi()) * exp(z * z / 2), below FROM nt WHERE step < 40),
lz AS (SELECT label, point, accel, ds, z AS z0 FROM ls JOIN nt USING (label) WHERE step = 40)
SELECT label, round(point, 6) AS point, round({_place(_END.format(z=-_Z))}, 6) AS low, round({_place(_END.format(z=_Z))}, 6) AS high FROM lz""")
def bca_interval(spark, d):
    return rounded(resample.bca(st.predictions(spark, d), "a", "c", REPLICATES))


DELTA = f"dt AS (SELECT label, feature, avg(abs(value)) FILTER (model = 'source') AS phi_source, avg(abs(value)) FILTER (model = 'adapted') AS phi_adapted, CASE WHEN feature IN ({', '.join(chr(39) + f'mean_f{i}' + chr(39) for i in range(8))}) THEN 'treat' ELSE 'physio' END AS stream FROM att GROUP BY ALL)"


def _deltas(spark, d):
    return attribution.delta(st.attributions(spark, d), "source", "adapted", attribution.tag_stream(F.col("feature"), [f"f{i}" for i in range(8)]))


@query(f"WITH {st.ATTR}, {DELTA} SELECT label, feature, stream, round(phi_source, 6) AS phi_source, round(phi_adapted, 6) AS phi_adapted, round(phi_adapted - phi_source, 6) AS delta FROM dt")
def attribution_delta(spark, d):
    return rounded(_deltas(spark, d))


@query(f"WITH {st.ATTR}, {DELTA} SELECT label, stream, count(*) AS n, count(*) FILTER (phi_adapted > phi_source) AS up, count(*) FILTER (phi_adapted < phi_source) AS down, round(avg(abs(phi_adapted - phi_source)), 6) AS mean_abs_delta FROM dt GROUP BY ALL")
def attribution_streams(spark, d):
    return rounded(attribution.stream_summary(_deltas(spark, d)))


@query(f"WITH {st.ATTR}, {DELTA} SELECT label, stream, feature, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, stream ORDER BY abs(phi_adapted - phi_source) DESC, feature) AS rank FROM dt) WHERE rank <= 10")
def attribution_top(spark, d):
    return attribution.top_shifts(_deltas(spark, d)).select("label", "stream", "feature", "rank")


@query(f"""WITH {st.ATTR}, sc AS (SELECT label, greatest(quantile_cont(abs(value), 0.95), 1e-6) AS scale FROM att WHERE model = 'source' GROUP BY 1), pr AS (SELECT id, label, feature, max(value) FILTER (model = 'source') AS s, max(value) FILTER (model = 'adapted') AS a FROM att GROUP BY ALL)
SELECT label, substr(feature, 6) AS feature, round(max((a - s) / scale), 6) AS delta FROM pr JOIN sc USING (label) GROUP BY ALL""")
def normalized_delta(spark, d):
    return rounded(attribution.collapse_base(attribution.normalized_delta(st.attributions(spark, d), "source", "adapted").withColumnRenamed("shift", "delta")))


@query(f"WITH {st.hits_sql('h', 0, 64)} SELECT query_id, doc_id, round(sim, 6) AS sim, rank FROM h")
def topk_cosine(spark, d):
    q, docs = st.vectors(spark, d)
    return rounded(retrieval.topk(q, docs))


_TWO = f"{st.hits_sql('h', 0, 32)}, {st.hits_sql('k', 32, 64)}"


@query(f"""WITH {_TWO}, u AS (SELECT query_id, doc_id, max(sim) AS sim FROM (SELECT query_id, doc_id, sim FROM h UNION ALL SELECT query_id, doc_id, sim FROM k) GROUP BY ALL)
SELECT query_id, doc_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM u) WHERE rank <= 5""")
def two_stream_merge(spark, d):
    (q1, d1), (q2, d2) = st.vectors(spark, d, slice(0, 32)), st.vectors(spark, d, slice(32, 64))
    return rounded(retrieval.two_stream([q1, q2], [d1, d2]))


def _halves(spark, d, k=5):
    return [retrieval.topk(*st.vectors(spark, d, s), k=k) for s in (slice(0, 32), slice(32, 64))]


@query(f"""WITH {st.hits_sql('h', 0, 32, 20)}, {st.hits_sql('k', 32, 64, 20)}, x AS (SELECT query_id, list(doc_id) AS a FROM h GROUP BY 1), y AS (SELECT query_id, list(doc_id) AS b FROM k GROUP BY 1)
SELECT query_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM x JOIN y USING (query_id)""")
def doc_jaccard(spark, d):
    return rounded(retrieval.doc_jaccard(*_halves(spark, d, 20)))


@query(f"""WITH {st.hits_sql('h', 0, 32, 60)}, {st.hits_sql('k', 32, 64, 60)}, j AS (SELECT query_id, h.sim AS x, k.sim AS y FROM h JOIN k USING (query_id, doc_id)),
r AS (SELECT query_id, rank() OVER (PARTITION BY query_id ORDER BY x) + (count(*) OVER (PARTITION BY query_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY query_id ORDER BY y) + (count(*) OVER (PARTITION BY query_id, y) - 1) / 2 AS ry FROM j)
SELECT query_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END AS rho FROM r GROUP BY 1""")
def rank_correlation(spark, d):
    out = retrieval.rank_correlation(*_halves(spark, d, 60))
    return rounded(out.withColumn("rho", F.when(~F.isnan("rho"), F.col("rho"))))


def _relevant(spark, d):
    q, docs = st.vectors(spark, d)
    hits = retrieval.topk(q, docs)
    return hits.join(q.select("query_id", F.col("lab").alias("ql")), "query_id").join(docs.select("doc_id", F.col("lab").alias("dl")), "doc_id").withColumn("rel", (F.col("ql") == F.col("dl")).cast("int"))


@query(f"""WITH {st.hits_sql('h', 0, 64)}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM h)
SELECT query_id, round(avg(rel::INTEGER), 6) AS precision, CASE WHEN bool_or(rel) THEN round(sum(rel::INTEGER / log2(rank + 1)) / sum(rel::INTEGER / log2(best + 1)), 6) END AS ndcg FROM b GROUP BY 1""")
def precision_ndcg(spark, d):
    hits = _relevant(spark, d)
    out = retrieval.precision_at_k(hits).join(retrieval.ndcg_at_k(hits), "query_id")
    return rounded(out.withColumn("ndcg", F.when(~F.isnan("ndcg"), F.col("ndcg"))))


@query("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '\\s+'), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1), 6) AS jaccard FROM t""")
def token_jaccard(spark, d):
    return rounded(st.table(spark, d, "part").select("p_partkey", text.token_jaccard(F.col("p_name"), F.col("p_type")).alias("jaccard")))


_NAMES = ["physio:last_map", "last_spo2", "treat:x:mean_fio2_obs", "has_total_crystalloid_ml", "resp_rate_rollmean_3", "rollstd_4_hr", "max_peep_flag", "early_antibiotic_hrs", "WBC", "total_sbp_noninvasive", "std_dbp_last", "min_rr_first", "a:high_lactate_mask"]


@query(f"""WITH n AS (SELECT event_id, event_type, list_value({', '.join(repr(x) for x in _NAMES)})[event_id % {len(_NAMES)} + 1] || CASE WHEN event_id % 3 = 0 THEN '_' || event_type ELSE '' END AS feature FROM events),
a AS (SELECT *, regexp_replace(split_part(feature, ':', -1), '^(last|mean|std|min|max)_', '') AS x FROM n),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, '_?roll(mean|std|min|max|sum)_?[0-9]*', '', 'g'), '^(has_|early_|high_|total_)', ''), '_(obs|flag|mask|ml|hrs|first|last|invasive|noninvasive)$', '') AS z FROM a),
c AS (SELECT *, trim(replace(z, '_', ' ')) AS q FROM b)
SELECT event_id, feature, CASE lower(q) WHEN 'map' THEN 'MAP' WHEN 'spo2' THEN 'SpO2' WHEN 'fio2' THEN 'FiO2' WHEN 'peep' THEN 'PEEP' WHEN 'wbc' THEN 'WBC' WHEN 'hr' THEN 'heart rate' WHEN 'rr' THEN 'respiratory rate'
WHEN 'sbp' THEN 'systolic blood pressure' WHEN 'dbp' THEN 'diastolic blood pressure' ELSE q END AS name, 'error ' || event_type || ' ICU' AS anchor FROM c""")
def name_normalize(spark, d):
    names = F.array(*[F.lit(x) for x in _NAMES])
    end = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("_"), F.col("event_type"))).otherwise("")
    e = st.table(spark, d, "events").withColumn("feature", F.concat(F.get(names, (F.col("event_id") % len(_NAMES)).cast("int")), end))
    return e.select("event_id", "feature", text.normalize_feature_name(F.col("feature")).alias("name"), text.label_anchor(F.concat(F.lit("label_error_"), F.col("event_type"))).alias("anchor"))


@query(f"WITH {st.PREDICTIONS} SELECT id, label, y FROM (SELECT *, row_number() OVER (PARTITION BY label, y ORDER BY md5('7:' || id), id) AS r FROM p WHERE model = 'a') WHERE r <= 30")
def balanced_sample(spark, d):
    p = st.predictions(spark, d).where("model = 'a'")
    return splits.balanced_sample(p, 60, order=F.md5(F.concat(F.lit("7:"), F.col("id").cast("string")))).select("id", "label", "y")


@query("""WITH t AS (SELECT lang AS label, lower(source) AS term, count(*) AS count FROM documents GROUP BY ALL) SELECT label, term, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY count DESC, term) AS rank FROM t) WHERE rank <= 20""")
def oracle_terms(spark, d):
    return retrieval.oracle_terms(st.table(spark, d, "documents").select(F.col("lang").alias("label"), F.array(F.upper("source")).alias("mesh")))


@query(f"WITH {st.PREDICTIONS} SELECT coalesce(label, 'overall') AS label, count(*) AS n_prob, round(avg(prob), 6) AS mean_prob, round(stddev_pop(prob), 6) AS sd_prob FROM p GROUP BY ROLLUP (label)")
def summary_rollup(spark, d):
    return rounded(retrieval.summarize(st.predictions(spark, d), ["prob"]))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS k FROM documents) SELECT source || ':' || lang AS pmid, doc_id, left(source || '. ' || text, 2000) AS passage FROM r WHERE k = 1""")
def corpus_dedup(spark, d):
    docs = st.table(spark, d, "documents").select(F.concat_ws(":", "source", "lang").alias("pmid"), "doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), F.col("n_chars").alias("query_no"), F.col("doc_id").alias("rank"))
    return corpus.passages(corpus.dedup(docs)).select("pmid", "doc_id", "passage")


#: Rows that the trees learn from, and as many validation rows; all rows are scored.
LEARNED = 2000


@query()
def gbt_scores(spark, d):
    """Trees at the operator's defaults, 300 of depth 6 at most, ended early by the validation rows."""
    h = st.hourly(spark, d).fillna(0.0)
    flipped = F.pmod(F.xxhash64("stay_id", "hr"), F.lit(50)) == 0  # one label in fifty
    h = h.withColumn("y", ((F.col("click") + F.col("views") - F.col("signup") > 150) != flipped).cast("int"))
    tr, va = h.where("stay_id % 5 < 3"), h.where("stay_id % 5 = 3")
    feats = ["click", "views", "signup"]
    model = train.fit_gbt(train.bounded(tr, LEARNED, "stay_id", "hr"), train.bounded(va, LEARNED, "stay_id", "hr"), feats, "y")
    return rounded(train.score(model, h, feats, "y", "gbt"))


_SCORE = "1 / (1 + exp(-(0.01 * ({c}) - 0.005 * ({v}))))"


@query(f"""WITH {st.HOURLY}, x AS (SELECT coalesce(click, 0)::DOUBLE AS click, coalesce(views, 0)::DOUBLE AS views, avg(coalesce(click, 0)) OVER () AS mc, avg(coalesce(views, 0)) OVER () AS mv FROM h),
y AS (SELECT avg(abs({_SCORE.format(c='mc', v='views')} - {_SCORE.format(c='click', v='views')})) AS a, avg(abs({_SCORE.format(c='click', v='mv')} - {_SCORE.format(c='click', v='views')})) AS b FROM x),
z AS (SELECT 'click' AS feature, a AS raw FROM y UNION ALL SELECT 'views', b FROM y UNION ALL SELECT 'signup', 0 FROM y)
SELECT feature, round(raw, 6) AS raw, round(raw / greatest(max(raw) OVER (), 1e-12), 6) AS importance FROM z""")
def ablation_importance(spark, d):
    h = st.hourly(spark, d).fillna(0.0).withColumn("id", F.col("stay_id") * 10 + F.col("hr"))
    return rounded(attribution.ablation_importance(h, ["click", "views", "signup"], lambda x: x.withColumn("score", 1 / (1 + F.exp(-(0.01 * F.col("click") - 0.005 * F.col("views")))))))


@query()
def hashing_embed(spark, d):
    """A digest of each unit vector: entries that aren't 0, the largest and its place, the sum."""
    docs, _ = retrieval.embed(st.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "t")
    top = F.array_max("vec")
    return docs.select("doc_id", F.size(F.filter("vec", lambda x: x != 0)).alias("n_terms"), F.round(top, 6).alias("largest"), (F.array_position("vec", top) - 1).alias("place"),
                       F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
