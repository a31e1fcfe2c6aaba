"""Evaluation, fairness, drift and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelward.functions.columns import bucket_at_least, bucket_below, stamp
from modelward.operators import drift as d
from modelward.operators import evaluation as ev
from modelward.operators import state as st
from modelward.plans.registry import Registry
from modelward.sources.workload import AS_OF, check_sql, check_with

R = Registry()


def rnd(df, *cols, places=6):
    return df.select(*[F.round(c, places).alias(c) if c in cols else F.col(c) for c in df.columns])


METRIC_SQL = """count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS accuracy, 1 - avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS error_rate,
 coalesce(sum(y_true * y_pred) / nullif(CAST(sum(y_pred) AS DOUBLE), 0), 0) AS "precision", coalesce(sum(y_true * y_pred) / nullif(CAST(sum(y_true) AS DOUBLE), 0), 0) AS recall,
 coalesce(2 * sum(y_true * y_pred) / nullif(CAST(sum(y_pred) + sum(y_true) AS DOUBLE), 0), 0) AS f1_score, sqrt(avg(CAST((y_true - y_pred) * (y_true - y_pred) AS DOUBLE))) AS rmse, avg(CAST(abs(y_true - y_pred) AS DOUBLE)) AS mae"""
AUC_SQL = """sum(CASE WHEN y_true = 1 THEN r END) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2.0"""
RANKED = "rk AS (SELECT *, {over} FROM evaluation)"
SIX = ", ".join(f'round(CAST("{m}" AS DOUBLE), 6) AS "{m}"' for m in ev.METRICS)


@R.add("evaluation_metrics", check_with("evaluation", f"""m AS (SELECT {METRIC_SQL} FROM evaluation), rk AS (SELECT y_true, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM evaluation),
u AS (SELECT ({AUC_SQL}) / nullif(CAST(count(*) FILTER (y_true = 1) AS DOUBLE) * count(*) FILTER (y_true = 0), 0) AS auc FROM rk)""", f"SELECT n, {SIX}, (SELECT round(CAST(auc AS DOUBLE), 6) FROM u) AS auc_roc FROM m"))
def evaluation_metrics(w):
    return rnd(ev.evaluate(w.evaluation, score="score"), *ev.METRICS, "auc_roc")


@R.add("evaluation_by_language", check_with("evaluation", f"""m AS (SELECT lang, {METRIC_SQL} FROM evaluation GROUP BY lang),
rk AS (SELECT lang, y_true, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM evaluation),
u AS (SELECT lang, ({AUC_SQL}) / nullif(CAST(count(*) FILTER (y_true = 1) AS DOUBLE) * count(*) FILTER (y_true = 0), 0) AS auc FROM rk GROUP BY lang)""",
    f"SELECT m.lang, n, {SIX}, round(CAST(auc AS DOUBLE), 6) AS auc_roc FROM m JOIN u ON u.lang = m.lang"))
def evaluation_by_language(w):
    return rnd(ev.evaluate(w.evaluation, ["lang"], "score"), *ev.METRICS, "auc_roc")


TWO = "two AS (SELECT 'v1' AS version, y_true, y_pred FROM evaluation UNION ALL SELECT 'v2', y_true, CASE WHEN score > 0.3 THEN 1 ELSE 0 END FROM evaluation)"
PAIR = f"{TWO}, m AS (SELECT version, {METRIC_SQL} FROM two GROUP BY version), o AS (SELECT * FROM m WHERE version = 'v1'), nw AS (SELECT * FROM m WHERE version = 'v2')"


def two_versions(w):
    rows = w.evaluation
    return rows.select(F.lit("v1").alias("version"), "y_true", "y_pred").unionByName(rows.select(F.lit("v2").alias("version"), "y_true", F.when(F.col("score") > 0.3, 1).otherwise(0).alias("y_pred")))


@R.add("version_comparison", check_with("evaluation", PAIR, " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, round(CAST(o."{m}" AS DOUBLE), 6) AS old_value, round(CAST(nw."{m}" AS DOUBLE), 6) AS new_value, round(CAST(nw."{m}" - o."{m}" AS DOUBLE), 6) AS delta FROM o, nw""" for m in ev.METRICS)))
def version_comparison(w):
    return rnd(ev.compare_versions(two_versions(w), "version", "v1", "v2"), "old_value", "new_value", "delta")


@R.add("model_gate", check_with("evaluation", PAIR, """SELECT round(CAST(o.accuracy AS DOUBLE), 6) AS old_value, round(CAST(nw.accuracy AS DOUBLE), 6) AS new_value, round(CAST((o.accuracy - nw.accuracy) * 100 / o.accuracy AS DOUBLE), 6) AS drop_pct,
    nw.accuracy >= 0.85 AND (o.accuracy - nw.accuracy) * 100 / o.accuracy <= 5 AS passed FROM o, nw"""))
def model_gate(w):
    return rnd(ev.model_gate(ev.compare_versions(two_versions(w), "version", "v1", "v2")).drop("reasons"), "old_value", "new_value", "drop_pct")


def _rates(cols):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS "group", count(*) AS n, avg(CAST(y_pred AS DOUBLE)) AS selection_rate, avg(CASE WHEN y_true = 1 THEN CAST(y_pred AS DOUBLE) END) AS tpr,
        avg(CASE WHEN y_true = 0 THEN CAST(y_pred AS DOUBLE) END) AS fpr FROM evaluation GROUP BY {c}""" for c in cols)


SENSITIVE = ("lang", "source", "toxic")
RATES = f"gr AS ({_rates(SENSITIVE)}), fa AS (SELECT attribute, count(*) AS \"groups\", max(selection_rate) - min(selection_rate) AS dp, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo FROM gr GROUP BY attribute)"


@R.add("group_rates", check_with("evaluation", RATES, 'SELECT attribute, "group", n, round(selection_rate, 6) AS selection_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM gr'))
def group_rates(w):
    return rnd(ev.group_rates(w.evaluation, SENSITIVE), "selection_rate", "tpr", "fpr")


@R.add("fairness_metrics", check_with("evaluation", RATES, 'SELECT attribute, "groups", round(dp, 6) AS demographic_parity_diff, round(eo, 6) AS equalized_odds_diff FROM fa'))
def fairness_metrics(w):
    return rnd(ev.fairness(w.evaluation, SENSITIVE), "demographic_parity_diff", "equalized_odds_diff")


@R.add("fairness_gate", check_with("evaluation", RATES + ", b AS (SELECT 'demographic_parity_diff_' || attribute AS m, dp AS v FROM fa UNION ALL SELECT 'equalized_odds_diff_' || attribute, eo FROM fa)",
    "SELECT count(*) AS metrics, coalesce(string_agg(m, ',' ORDER BY m) FILTER (abs(v) > 0.2), '') AS breaches, count(*) FILTER (abs(v) > 0.2) = 0 AS passed FROM b"))
def fairness_gate(w):
    return ev.fairness_gate(ev.fairness(w.evaluation, SENSITIVE), 20.0).withColumn("breaches", F.array_join("breaches", ","))


CAL = " UNION ALL ".join(f"""SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS "group", count(*) AS n, abs(sum(score) - sum(y_true)) AS gap FROM evaluation GROUP BY {c}, least(CAST(floor(score * 10) AS INT), 9)""" for c in ("lang", "source"))


@R.add("calibration_by_group", check_with("evaluation", f"c AS ({CAL})", 'SELECT attribute, "group", CAST(sum(n) AS BIGINT) AS n, round(sum(gap) / sum(n), 6) AS calibration_error FROM c GROUP BY attribute, "group"'))
def calibration_by_group(w):
    return rnd(ev.calibration(w.evaluation, ["lang", "source"]), "calibration_error")


@R.add("calibration_spread", check_with("evaluation", f'c AS ({CAL}), g AS (SELECT attribute, "group", sum(gap) / sum(n) AS e FROM c GROUP BY attribute, "group")', "SELECT attribute, round(max(e) - min(e), 6) AS calibration_diff FROM g GROUP BY attribute"))
def calibration_spread(w):
    return rnd(ev.calibration_spread(ev.calibration(w.evaluation, ["lang", "source"])), "calibration_diff")


@R.add("canary_verdicts", check_with("model_versions model_performance", "s AS (SELECT version_id, max(CASE WHEN performance_degraded THEN 1 ELSE 0 END) AS bad, max(degradation_pct) AS worst, count(*) AS n FROM model_performance WHERE measurement_timestamp >= TIMESTAMP '2001-07-01' GROUP BY version_id)",
    """SELECT v.version_id, coalesce(s.n, 0) AS measurements, worst AS worst_degradation_pct, CASE WHEN s.n > 0 THEN NOT (bad = 1 OR worst >= 15) END AS passed FROM model_versions v LEFT JOIN s ON s.version_id = v.version_id"""))
def canary_verdicts(w):
    recent = w.model_performance.where(F.col("measurement_timestamp") >= F.lit("2001-07-01").cast("timestamp_ntz"))
    return ev.canary(recent, w.model_versions.select("version_id"), 15.0)


VERS = """vm AS (SELECT l_suppkey, l_linenumber, avg(l_discount) * 10 AS accuracy, avg(l_extendedprice) AS p95, avg(l_tax) AS error_rate, stddev(l_quantity) / 100 AS fairness_gap, count(*) FILTER (l_quantity > 49) AS nulls FROM lineitem GROUP BY 1, 2),
cur AS (SELECT c.*, p.accuracy AS pa, p.p95 AS pp, p.fairness_gap AS pf FROM vm c JOIN vm p ON p.l_suppkey = c.l_suppkey AND p.l_linenumber = c.l_linenumber - 1)"""


@R.add("rollback_verdicts", f"""WITH {VERS} SELECT l_suppkey, l_linenumber, (pa - accuracy > 0.02) OR (p95 > pp * 1.1) OR error_rate > 0.042 OR (fairness_gap - pf > 0.01) OR nulls > 3 AS roll_back,
    concat_ws(',', CASE WHEN pa - accuracy > 0.02 THEN 'accuracy_drop' END, CASE WHEN p95 > pp * 1.1 THEN 'latency_times' END, CASE WHEN error_rate > 0.042 THEN 'error_rate' END, CASE WHEN fairness_gap - pf > 0.01 THEN 'fairness_gap' END, CASE WHEN nulls > 3 THEN 'null_predictions' END) AS reasons FROM cur""")
def rollback_verdicts(w):
    vm = w.lineitem.groupBy("l_suppkey", "l_linenumber").agg(
        (F.avg("l_discount") * 10).alias("accuracy"), F.avg("l_extendedprice").alias("p95"), F.avg("l_tax").alias("error_rate"), (F.stddev("l_quantity") / 100).alias("fairness_gap"),
        F.count_if(F.col("l_quantity") > 49).alias("null_predictions"),
    )
    prev = vm.select("l_suppkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), *[F.col(c).alias(f"prev_{c}") for c in ("accuracy", "p95", "fairness_gap")])
    limits = {"accuracy_drop": 0.02, "latency_times": 1.1, "error_rate": 0.042, "fairness_gap": 0.01, "null_predictions": 3}
    out = ev.rollback_verdict(vm.join(prev, ["l_suppkey", "l_linenumber"]), limits)
    return out.select("l_suppkey", "l_linenumber", "roll_back", F.array_join("reasons", ",").alias("reasons"))


@R.add("retrain_decisions", """WITH m AS (SELECT l_suppkey, abs(avg(l_discount) - 0.05) * 20 AS ks, avg(l_tax) * 120 AS deg, count(*) FILTER (l_returnflag = 'N') AS labels, max(l_shipdate) < TIMESTAMP '2001-11-01' AS due FROM lineitem GROUP BY 1)
SELECT l_suppkey, concat_ws(',', CASE WHEN ks > 0.02 THEN 'data_drift' END, CASE WHEN deg > 4.85 THEN 'performance_drift' END, CASE WHEN labels >= 205 THEN 'new_labels' END, CASE WHEN due THEN 'schedule' END) AS reasons,
       ks > 0.02 OR deg > 4.85 OR labels >= 205 OR due AS retrain FROM m""")
def retrain_decisions(w):
    models = w.lineitem.groupBy("l_suppkey").agg(
        (F.abs(F.avg("l_discount") - 0.05) * 20).alias("ks_stat"), (F.avg("l_tax") * 120).alias("degradation_pct"), F.count_if(F.col("l_returnflag") == "N").alias("new_labels"),
        (F.max("l_shipdate") < F.lit("2001-11-01").cast("timestamp_ntz")).alias("schedule_due"),
    )
    out = ev.retrain_decision(models, ks_limit=0.02, degradation_limit=4.85, label_limit=205)
    return out.select("l_suppkey", F.array_join("reasons", ",").alias("reasons"), "retrain")


def _side(j):
    terms = "list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CASE WHEN bit_count(CAST((i - 1) & %d AS INT)) %% 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)" % (2 * j + 1)
    return f"CASE WHEN list_sum({terms}) >= 0 THEN '1' ELSE '0' END"


@R.add("individual_fairness", "WITH c AS (SELECT concat(" + ", ".join(_side(j) for j in range(8)) + """) AS cell, CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS DOUBLE) AS p FROM embeddings),
m AS (SELECT cell, avg(p) AS mean FROM c GROUP BY cell) SELECT c.cell, count(*) AS n, round(avg(abs(p - mean)), 6) AS mean_deviation FROM c JOIN m ON m.cell = c.cell GROUP BY c.cell""")
def individual_fairness(w):
    df = w.embeddings.withColumn("prediction", F.when(F.col("label") < 5, 1).otherwise(0))
    return rnd(ev.individual_fairness(df, "embedding", "prediction"), "mean_deviation")


# ── drift ──

COLS = ("l_quantity", "l_discount", "l_tax")
SPLIT = "TIMESTAMP '1998-01-01 00:00:00'"
SIDES = f"li AS (SELECT nullif(l_quantity, 13) AS l_quantity, l_discount, l_tax, l_returnflag, l_shipdate FROM lineitem), b AS (SELECT * FROM li WHERE l_shipdate < {SPLIT}), c AS (SELECT l_quantity + CASE WHEN l_quantity > 40 THEN 5 ELSE 0 END AS l_quantity, l_discount, l_tax, l_returnflag, l_shipdate FROM li WHERE l_shipdate >= {SPLIT})"


def sides(w):
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    rows = w.lineitem.select(F.nullif("l_quantity", F.lit(13.0)).alias("l_quantity"), "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    now = rows.where(F.col("l_shipdate") >= at).withColumn("l_quantity", F.col("l_quantity") + F.when(F.col("l_quantity") > 40, 5).otherwise(0))
    return rows.where(F.col("l_shipdate") < at), now


def _stats(src, cols, group=""):
    g = f", {group} AS window_date" if group else ""
    return " UNION ALL ".join(f"SELECT '{c}' AS field_name{g}, avg({c}) AS mean_value, stddev({c}) AS stddev_value, min({c}) AS min_value, max({c}) AS max_value, (count(*) - count({c})) * 100.0 / count(*) AS null_pct, count(*) AS n_rows FROM {src}" + (f" GROUP BY {group}" if group else "") for c in cols)


_R = "round(mean_value, 6) AS mean_value, round(stddev_value, 6) AS stddev_value, min_value, max_value, round(CAST(null_pct AS DOUBLE), 6) AS null_pct, n_rows"


@R.add("field_baseline", f"""WITH {SIDES}, s AS ({_stats('b', COLS)} UNION ALL SELECT 'l_returnflag', NULL, NULL, NULL, NULL, (count(*) - count(l_returnflag)) * 100.0 / count(*), count(*) FROM b),
v AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM b WHERE {c} IS NOT NULL GROUP BY {c}" for c in (*COLS, 'l_returnflag'))}),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY n DESC, v) AS rn, count(*) OVER (PARTITION BY f) AS u FROM v),
t AS (SELECT f, max(u) AS unique_count, '[' || string_agg('{{"value":"' || v || '","count":' || n || '}}', ',' ORDER BY rn) || ']' AS top_values_json FROM k WHERE rn <= 5 GROUP BY f)
SELECT field_name, {_R}, unique_count, top_values_json FROM s JOIN t ON t.f = s.field_name""")
def field_baseline(w):
    return rnd(d.baseline(sides(w)[0], COLS, ["l_returnflag"]), "mean_value", "stddev_value", "null_pct")


@R.add("field_daily_stats", f"WITH {SIDES}, s AS ({_stats('c', COLS, chr(39).join(['strftime(l_shipdate, ', '%Y-%m-%d', ')']))}) SELECT field_name, window_date, {_R} FROM s")
def field_daily_stats(w):
    out = d.daily_stats(sides(w)[1], COLS, "l_shipdate").withColumn("window_date", F.col("window_date").cast("string"))
    return rnd(out, "mean_value", "stddev_value", "null_pct")


def _ks(c):
    return f"""SELECT '{c}' AS field_name, max(abs(fb - fc)) AS d, max(nb) AS nb, max(nc) AS nc FROM (
      SELECT sum(b) OVER w / CAST(sum(b) OVER () AS DOUBLE) AS fb, sum(c) OVER w / CAST(sum(c) OVER () AS DOUBLE) AS fc, sum(b) OVER () AS nb, sum(c) OVER () AS nc
      FROM (SELECT v, sum(b) AS b, sum(c) AS c FROM (SELECT {c} AS v, 1 AS b, 0 AS c FROM b UNION ALL SELECT {c}, 0, 1 FROM c) u WHERE v IS NOT NULL GROUP BY v) g WINDOW w AS (ORDER BY v)) z"""


KS = f"ks AS ({' UNION ALL '.join(_ks(c) for c in COLS)}), kl AS (SELECT *, d * sqrt(CAST(nb AS DOUBLE) * nc / (nb + nc)) AS lam FROM ks)"


@R.add("ks_drift", f"""WITH {SIDES}, {KS} SELECT field_name, round(d, 6) AS ks_stat, CAST(nb AS BIGINT) AS n_base, CAST(nc AS BIGINT) AS n_current,
    round(CASE WHEN lam < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * lam * lam))))) END, 6) AS ks_pvalue, d > 0.05 AS drifted FROM kl""")
def ks_drift(w):
    return rnd(d.ks_test(*sides(w), COLS, 0.05), "ks_stat", "ks_pvalue")


PSI = f"""ed AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM b" for c in COLS)}),
lb AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, {c} AS v FROM b" for c in COLS)}), lc AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, l_shipdate AS day, {c} AS v FROM c" for c in COLS)}),
bb AS (SELECT lb.f, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(e, lambda x: x <= v)) END AS bin, count(*) AS n FROM lb JOIN ed ON ed.f = lb.f GROUP BY 1, 2), bs AS (SELECT f, bin, n / CAST(sum(n) OVER (PARTITION BY f) AS DOUBLE) AS s FROM bb),
cb AS (SELECT lc.f, day, CASE WHEN v IS NULL THEN -1 ELSE len(list_filter(e, lambda x: x <= v)) END AS bin, count(*) AS n FROM lc JOIN ed ON ed.f = lc.f GROUP BY 1, 2, 3), ct AS (SELECT f, day, sum(n) AS t FROM cb GROUP BY 1, 2),
gr AS (SELECT ct.f, ct.day, ct.t, unnest(generate_series(-1, len(e))) AS bin FROM ct JOIN ed ON ed.f = ct.f),
te AS (SELECT gr.f, gr.day, gr.t, greatest(coalesce(cb.n, 0) / CAST(gr.t AS DOUBLE), 0.0001) AS c, greatest(coalesce(bs.s, 0), 0.0001) AS b FROM gr LEFT JOIN cb ON cb.f = gr.f AND cb.day = gr.day AND cb.bin = gr.bin LEFT JOIN bs ON bs.f = gr.f AND bs.bin = gr.bin),
psi AS (SELECT f AS field_name, strftime(day, '%Y-%m-%d') AS window_date, sum((c - b) * ln(c / b)) AS psi_score, max(t) AS n_rows FROM te GROUP BY f, day)"""
BAND = "CASE WHEN psi_score < 0.1 THEN 'none' WHEN psi_score < 0.2 THEN 'moderate' ELSE 'significant' END AS band"


@R.add("psi_drift_daily", f"WITH {SIDES}, {PSI} SELECT field_name, window_date, round(psi_score, 6) AS psi_score, CAST(n_rows AS BIGINT) AS n_rows, {BAND} FROM psi")
def psi_drift_daily(w):
    return rnd(d.psi_daily(*sides(w), COLS, "l_shipdate").withColumn("window_date", F.col("window_date").cast("string")), "psi_score")


@R.add("latest_drift_per_field", f"WITH {SIDES}, {PSI}, r AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY window_date DESC) AS rn FROM psi) SELECT field_name, window_date, round(psi_score, 6) AS psi_score FROM r WHERE rn = 1 ORDER BY psi_score DESC, field_name LIMIT 2")
def latest_drift_per_field(w):
    out = d.latest_per_field(d.psi_daily(*sides(w), COLS, "l_shipdate"), 2)
    return out.select("field_name", F.col("window_date").cast("string").alias("window_date"), F.round("psi_score", 6).alias("psi_score"))


@R.add("psi_drift_categorical", f"""WITH {SIDES}, x AS (SELECT l_returnflag AS v, count(*) / CAST((SELECT count(*) FROM b) AS DOUBLE) AS s FROM b GROUP BY 1), y AS (SELECT l_returnflag AS v, count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE) AS s FROM c GROUP BY 1),
p AS (SELECT sum((greatest(coalesce(y.s, 0), 0.0001) - greatest(coalesce(x.s, 0), 0.0001)) * ln(greatest(coalesce(y.s, 0), 0.0001) / greatest(coalesce(x.s, 0), 0.0001))) AS psi_score FROM x FULL OUTER JOIN y ON y.v = x.v)
SELECT 'l_returnflag' AS field_name, round(psi_score, 8) AS psi_score, {BAND} FROM p""")
def psi_drift_categorical(w):
    return rnd(d.psi_categorical(*sides(w), ["l_returnflag"]), "psi_score", places=8)


@R.add("baseline_change", f"WITH {SIDES}, sb AS ({_stats('b', COLS)}), sc AS ({_stats('c', COLS)}) SELECT sc.field_name, " + ", ".join(f"round(CAST((sc.{s} - sb.{s}) / nullif(sb.{s}, 0) * 100 AS DOUBLE), 6) AS {s}_change_pct" for s in d.STATS) + " FROM sc JOIN sb ON sb.field_name = sc.field_name")
def baseline_change(w):
    b, c = sides(w)
    return rnd(d.baseline_change(d.field_stats(b, COLS), d.field_stats(c, COLS)), *[f"{s}_change_pct" for s in d.STATS])


WATCH = [{"column_name": "l_quantity", "monitor_for_drift": True, "drift_threshold": 0.02}, {"column_name": "l_discount", "monitor_for_drift": True, "drift_threshold": 0.15}, {"column_name": "l_tax", "monitor_for_drift": False}]
RESULT = "rs AS (SELECT field_name, d, CASE field_name WHEN 'l_quantity' THEN 0.02 ELSE 0.15 END AS th FROM ks WHERE field_name <> 'l_tax')"


def drift_rows(w):
    scores = d.ks_test(*sides(w), COLS).select("field_name", F.lit("data").alias("drift_type"), F.col("ks_stat").alias("score"), "n_base", "n_current")
    return d.drift_results(scores, WATCH, AS_OF)


@R.add("drift_results", f"""WITH {SIDES}, {KS}, {RESULT} SELECT field_name, 'data' AS drift_type, round(d, 6) AS drift_score, CAST(th AS DOUBLE) AS threshold, CASE WHEN d / th < 1 THEN 'none' WHEN d / th < 1.5 THEN 'low' WHEN d / th < 2 THEN 'medium' WHEN d / th < 3 THEN 'high' ELSE 'critical' END AS severity,
    d > th AS drift_detected FROM rs""")
def drift_results(w):
    return rnd(drift_rows(w).drop("result_id", "details_json"), "drift_score")


_STAT = """'{{"mean_value":' || to_json(round(avg({c}), 6)) || ',"stddev_value":' || to_json(round(stddev_samp({c}), 6)) || ',"min_value":' || to_json(round(CAST(min({c}) AS DOUBLE), 6)) || ',"max_value":' || to_json(round(CAST(max({c}) AS DOUBLE), 6))
    || ',"null_pct":' || to_json(round((count(*) - count({c})) * 100.0 / count(*), 6)) || ',"n_rows":' || count(*) || '}}' AS js, avg({c}) AS m, stddev_samp({c}) AS sd, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS miss"""
LIMITS = {"data": 0.02, "quality": 0.001, "value": 0.05}
TYPED = f"""bt AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, {_STAT.format(c=c)} FROM b" for c in COLS)}), ct2 AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, {_STAT.format(c=c)} FROM c" for c in COLS)}),
ty AS (SELECT bt.f AS field_name, bt.js AS baseline_distribution, ct2.js AS current_distribution, unnest(['data', 'quality', 'value']) AS drift_type, unnest([d, abs(ct2.miss - bt.miss), abs(ct2.m - bt.m) / bt.sd]) AS score, unnest([0.02, 0.001, 0.05]) AS th
       FROM bt JOIN ct2 ON ct2.f = bt.f JOIN ks ON ks.field_name = bt.f)"""


@R.add("drift_results_by_type", f"""WITH {SIDES}, {KS}, {TYPED} SELECT sha256(field_name || ':' || drift_type || ':{AS_OF}') AS result_id, field_name, drift_type, round(score, 6) AS drift_score, CAST(th AS DOUBLE) AS threshold,
    CASE WHEN score / th < 1 THEN 'none' WHEN score / th < 1.5 THEN 'low' WHEN score / th < 2 THEN 'medium' WHEN score / th < 3 THEN 'high' ELSE 'critical' END AS severity, score > th AS drift_detected, baseline_distribution, current_distribution, '{{}}' AS details_json FROM ty""")
def drift_results_by_type(w):
    config = [{"column_name": c, "monitor_for_drift": True, **{f"{t}_threshold": v for t, v in LIMITS.items()}} for c in COLS]
    return rnd(d.drift_results(d.drift_scores(*sides(w), COLS), config, AS_OF), "drift_score")


@R.add("drift_series", f"""WITH {SIDES}, {PSI}, r AS (SELECT *, row_number() OVER (PARTITION BY field_name ORDER BY window_date DESC) AS rn FROM psi), t AS (SELECT field_name, row_number() OVER (ORDER BY psi_score DESC, field_name) AS place FROM r WHERE rn = 1)
    SELECT psi.field_name, window_date, round(psi_score, 6) AS psi_score, n_rows, {BAND}, place FROM psi JOIN t ON t.field_name = psi.field_name WHERE place <= 2""")
def drift_series(w):
    out = d.field_series(d.psi_daily(*sides(w), COLS, "l_shipdate"), 2)
    return out.select("field_name", F.col("window_date").cast("string").alias("window_date"), F.round("psi_score", 6).alias("psi_score"), "n_rows", "band", "place")


@R.add("distribution_issues", f"WITH {SIDES}, {KS}, {RESULT} SELECT count(*) AS fields_watched, count(*) FILTER (d > th) AS distribution_issues_found FROM rs")
def distribution_issues(w):
    return d.distribution_issues(drift_rows(w))


@R.add("prediction_drift", """WITH b AS (SELECT prediction, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM (SELECT value > 50 AS prediction FROM events WHERE ts < TIMESTAMP '2024-01-16 00:00:00') x GROUP BY 1),
c AS (SELECT prediction, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM (SELECT value > 50 AS prediction FROM events WHERE ts >= TIMESTAMP '2024-01-16 00:00:00') x GROUP BY 1),
p AS (SELECT sum((c.s - b.s) * ln(c.s / b.s)) AS psi_score FROM b JOIN c ON c.prediction = b.prediction), m AS (SELECT abs(c.s - b.s) / b.s * 100 AS sh FROM b JOIN c ON c.prediction = b.prediction WHERE b.prediction)
SELECT 'prediction' AS field_name, round(psi_score, 8) AS psi_score, CASE WHEN psi_score < 0.1 THEN 'none' WHEN psi_score < 0.2 THEN 'moderate' ELSE 'significant' END AS band, round(sh, 6) AS mean_shift_pct, sh > 5 AS drifted FROM p, m""")
def prediction_drift(w):
    rows = w.requests.withColumn("prediction", F.col("prediction").cast("int"))
    at = F.lit("2024-01-16").cast("timestamp_ntz")
    return rnd(rnd(d.prediction_drift(rows.where(F.col("ts") < at), rows.where(F.col("ts") >= at), "prediction"), "psi_score", places=8), "mean_shift_pct")


@R.add("performance_drift", check_sql("model_performance", f"""SELECT b.model_id, round(b.a, 6) AS baseline_value, round(c.a, 6) AS current_value, round((b.a - c.a) * 100 / b.a, 6) AS degradation_pct, (b.a - c.a) * 100 / b.a > 5 AS performance_degraded
    FROM (SELECT model_id, avg(degradation_pct) AS a FROM model_performance WHERE measurement_timestamp < {SPLIT} GROUP BY 1) b JOIN (SELECT model_id, avg(degradation_pct) AS a FROM model_performance WHERE measurement_timestamp >= {SPLIT} GROUP BY 1) c ON c.model_id = b.model_id"""))
def performance_drift(w):
    at = F.lit("1998-01-01").cast("timestamp_ntz")
    perf = w.model_performance
    mean = lambda rows: rows.groupBy("model_id").agg(F.avg("degradation_pct").alias("m"))
    out = d.performance_drift(mean(perf.where(F.col("measurement_timestamp") < at)), mean(perf.where(F.col("measurement_timestamp") >= at)), ["model_id"], "m")
    return rnd(out, "baseline_value", "current_value", "degradation_pct")


@R.add("service_anomalies", check_with("requests", """dd AS (SELECT model_id, CAST(ts AS DATE) AS day, count(*) AS volume, avg(latency_ms) AS ml, avg(CASE WHEN slow THEN 1.0 ELSE 0.0 END) AS er FROM requests GROUP BY 1, 2),
w AS (SELECT *, avg(ml) OVER x AS bl, avg(volume) OVER x AS bv, stddev(volume) OVER x AS sv FROM dd WINDOW x AS (PARTITION BY model_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))""",
    """SELECT model_id, strftime(day, '%Y-%m-%d') AS day, volume, round(ml, 6) AS mean_latency, round(er, 6) AS error_rate, round(bl, 6) AS baseline_latency, coalesce(ml > bl * 1.1, false) AS latency_spike, er > 0.08 AS error_spike, coalesce(abs(volume - bv) > sv * 2, false) AS volume_anomaly FROM w"""))
def service_anomalies(w):
    out = d.service_anomalies(w.requests, "ts", "model_id", "latency_ms", "slow", latency_times=1.1, max_error_rate=0.08, sigmas=2.0)
    return rnd(out.withColumn("day", F.col("day").cast("string")), "mean_latency", "error_rate", "baseline_latency")


SLICED = "sl AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, model_id, {s} AS slice, {v} AS slice_value, count(*) AS n_rows, round(avg(latency_ms), 6) AS mean_value, round(stddev(latency_ms), 5) AS stddev_value, min(latency_ms) AS min_value, max(latency_ms) AS max_value, round(CAST(0 AS DOUBLE), 6) AS null_pct, round(avg(CASE WHEN prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM requests GROUP BY 1, 2, 3, 4)"


def _sliced(s, v):
    return SLICED.format(s=s, v=v)[len("sl AS ("):-1]


@R.add("sliced_monitoring", check_sql("requests", f"{_sliced(chr(39) + 'all' + chr(39), chr(39) + 'all' + chr(39))} UNION ALL {_sliced(chr(39) + 'slow' + chr(39), 'CAST(slow AS VARCHAR)')} UNION ALL {_sliced(chr(39) + 'user_id' + chr(39), 'CAST(user_id AS VARCHAR)')}"))
def sliced_monitoring(w):
    out = d.sliced_monitor(w.requests, "ts", "1 day", "model_id", ["slow", "user_id"], "latency_ms", "prediction")
    out = out.withColumn("day", stamp("window_start", "yyyy-MM-dd")).drop("window_start")
    return rnd(rnd(out, "mean_value", "accuracy", "null_pct"), "stddev_value", places=5)


@R.add("sustained_breaches", check_with("requests", """m AS (SELECT model_id, ts, event_id, latency_ms > 30 AS f, coalesce(lag(latency_ms > 30) OVER (PARTITION BY model_id ORDER BY ts, event_id), false) AS p FROM requests),
n AS (SELECT *, sum(CASE WHEN f AND NOT p THEN 1 ELSE 0 END) OVER (PARTITION BY model_id ORDER BY ts, event_id) AS run_no FROM m), r AS (SELECT model_id, run_no, min(ts) AS s, max(ts) AS e, count(*) AS k FROM n WHERE f GROUP BY 1, 2)""",
    """SELECT model_id, CAST(run_no AS BIGINT) AS run_no, strftime(s, '%Y-%m-%d %H:%M:%S') AS run_start, strftime(e, '%Y-%m-%d %H:%M:%S') AS run_end, k AS rows_in_run, date_sub('second', s, e) AS duration_s FROM r WHERE date_sub('second', s, e) >= 1800"""))
def sustained_breaches(w):
    out = d.sustained_breaches(w.requests.withColumn("breach", F.col("latency_ms") > 30), "model_id", "ts", "event_id", "breach", 1800)
    return out.withColumn("run_start", stamp("run_start")).withColumn("run_end", stamp("run_end"))


@R.add("repeated_alerts", check_sql("requests", """SELECT event_id, model_id, firings FROM (SELECT event_id, model_id, count(*) OVER (PARTITION BY model_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS firings FROM requests WHERE slow) z WHERE firings >= 2"""))
def repeated_alerts(w):
    return d.repeated_alerts(w.requests.where("slow"), "model_id", "ts", 3600, 2).select("event_id", "model_id", "firings")


DUE = """lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY config_version DESC) AS rn FROM project_configs) z WHERE rn = 1),
w AS (SELECT model_id, max(degradation_pct) AS v FROM model_performance WHERE performance_degraded AND measurement_timestamp >= DATE '2001-08-01' - INTERVAL 1 DAY GROUP BY 1),
h AS (SELECT sha256(concat('perf-alert:m', l_suppkey)) AS alert_id, max(l_shipdate) AS last FROM lineitem WHERE l_linenumber = 2 AND l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY 1),
du AS (SELECT w.model_id, m.project_id, w.v, sha256(concat('perf-alert:', w.model_id)) AS alert_id, CAST(json_extract(interview_responses, '$.performance_alert_threshold_pct') AS DOUBLE) AS threshold,
    CASE WHEN coalesce(date_sub('second', h.last, TIMESTAMP '2001-08-01 00:00:00') < 86400, false) THEN 'repeated' ELSE 'alert' END AS outcome
    FROM w JOIN models m ON m.model_id = w.model_id JOIN lc ON lc.project_id = m.project_id LEFT JOIN h ON h.alert_id = sha256(concat('perf-alert:', w.model_id))
    WHERE json_extract(interview_responses, '$.alert_destination_configs') IS NOT NULL AND w.v >= CAST(json_extract(interview_responses, '$.performance_alert_threshold_pct') AS DOUBLE))"""


def alerts_due(w):
    history = w.lineitem.where("l_linenumber = 2 AND l_shipdate <= TIMESTAMP_NTZ '2001-08-01 00:00:00'").select(
        F.sha2(F.concat(F.lit("perf-alert:m"), F.col("l_suppkey")), 256).alias("alert_id"), F.col("l_shipdate").alias("triggered_timestamp")
    )
    return d.performance_alerts(w.model_performance, w.models, w.project_configs, history, AS_OF)


@R.add("performance_alerts", check_with("model_performance models project_configs", """lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY config_version DESC) AS rn FROM project_configs) z WHERE rn = 1),
w AS (SELECT model_id, max(degradation_pct) AS v FROM model_performance WHERE performance_degraded AND measurement_timestamp >= DATE '2001-08-01' - INTERVAL 1 DAY GROUP BY 1),
h AS (SELECT sha256(concat('perf-alert:m', l_suppkey)) AS alert_id, max(l_shipdate) AS last FROM lineitem WHERE l_linenumber = 2 AND l_shipdate <= TIMESTAMP '2001-08-01' GROUP BY 1)""",
    """SELECT w.model_id, m.project_id, w.v AS alert_value, CAST(json_extract(interview_responses, '$.performance_alert_threshold_pct') AS DOUBLE) AS threshold,
    CASE WHEN coalesce(date_sub('second', h.last, TIMESTAMP '2001-08-01 00:00:00') < 86400, false) THEN 'repeated' ELSE 'alert' END AS outcome
    FROM w JOIN models m ON m.model_id = w.model_id JOIN lc ON lc.project_id = m.project_id LEFT JOIN h ON h.alert_id = sha256(concat('perf-alert:', w.model_id))
    WHERE json_extract(interview_responses, '$.alert_destination_configs') IS NOT NULL AND w.v >= CAST(json_extract(interview_responses, '$.performance_alert_threshold_pct') AS DOUBLE)"""))
def performance_alerts(w):
    return alerts_due(w).select("model_id", "project_id", "alert_value", "threshold", "outcome")


@R.add("alert_events_of_pass", check_with("model_performance models project_configs", DUE, """SELECT sha256(concat(alert_id, ':2001-08-01 00:00:00')) AS event_id, alert_id, model_id, '2001-08-01 00:00:00' AS triggered, v AS alert_value, 'warning' AS alert_severity, true AS notification_sent,
    false AS resolved FROM du WHERE outcome = 'alert'"""))
def alert_events_of_pass(w):
    out = d.alert_events(alerts_due(w), AS_OF)
    return out.select("event_id", "alert_id", "model_id", stamp("triggered_timestamp").alias("triggered"), "alert_value", "alert_severity", "notification_sent", "resolved")


@R.add("alert_definitions_of_pass", check_with("model_performance models project_configs", f"""{DUE}, cu AS (SELECT sha256(concat('perf-alert:m', s_suppkey)) AS alert_id, concat('m', s_suppkey) AS model_id, CAST(s_nationkey AS DOUBLE) AS threshold_value FROM supplier WHERE s_nationkey < 15)""",
    """SELECT coalesce(cu.alert_id, du.alert_id) AS alert_id, coalesce(cu.model_id, du.model_id) AS model_id, 'Performance degradation' AS alert_name, 'standard' AS alert_type, 'degradation_pct' AS metric_name, coalesce(threshold, threshold_value) AS threshold_value,
    '>=' AS comparison_operator, 'warning' AS severity, true AS is_enabled, CASE WHEN du.alert_id IS NULL THEN 'kept' WHEN cu.alert_id IS NULL THEN 'added' ELSE 'updated' END AS action FROM cu FULL JOIN du ON du.alert_id = cu.alert_id"""))
def alert_definitions_of_pass(w):
    current = w.supplier.where("s_nationkey < 15").select(
        F.sha2(F.concat(F.lit("perf-alert:m"), F.col("s_suppkey")), 256).alias("alert_id"), F.concat(F.lit("m"), F.col("s_suppkey")).alias("model_id"), F.lit("Performance degradation").alias("alert_name"), F.lit("standard").alias("alert_type"),
        F.lit("degradation_pct").alias("metric_name"), F.col("s_nationkey").cast("double").alias("threshold_value"), F.lit(">=").alias("comparison_operator"), F.lit("warning").alias("severity"), F.lit(True).alias("is_enabled"),
        F.lit("2001-01-01").cast("timestamp_ntz").alias("created_timestamp"),
    )
    return d.alert_definitions(current, alerts_due(w), "degradation_pct", AS_OF).drop("created_timestamp")


@R.add("alert_definitions_after_pass", check_with("model_performance", "w AS (SELECT model_id, max(degradation_pct) AS v FROM model_performance WHERE performance_degraded GROUP BY 1)",
    """SELECT model_id, CASE WHEN w.v >= 19 THEN w.v ELSE 5 END AS threshold_value, CASE WHEN w.v >= 19 THEN 'updated' ELSE 'kept' END AS merge_action FROM w"""))
def alert_definitions_after_pass(w):
    worst = w.model_performance.where("performance_degraded").groupBy("model_id").agg(F.max("degradation_pct").alias("v"))
    current = worst.select("model_id", F.lit(5.0).alias("threshold_value"))
    changes = worst.where("v >= 19").select("model_id", F.col("v").alias("threshold_value"))
    return st.merge_upsert(current, changes, ["model_id"], ["threshold_value"], [F.asc("threshold_value")], action="merge_action")


@R.add("score_bands", """SELECT event_id, CASE WHEN value / 500 >= 0.95 THEN 'excellent' WHEN value / 500 >= 0.85 THEN 'good' WHEN value / 500 >= 0.7 THEN 'acceptable' WHEN value / 500 >= 0.5 THEN 'poor' ELSE 'critical' END AS status,
    CASE WHEN value / 500 < 0.1 THEN 'none' WHEN value / 500 < 0.2 THEN 'moderate' ELSE 'significant' END AS band FROM events""")
def score_bands(w):
    score = F.col("value") / 500
    return w.events.select("event_id", bucket_at_least(score).alias("status"), bucket_below(score).alias("band"))



