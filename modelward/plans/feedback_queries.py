"""Predictions joined to labels, and what follows."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelward.functions.columns import stamp
from modelward.operators import feedback as fb
from modelward.operators.state import insert_if_absent
from modelward.plans.registry import Registry
from modelward.session import fresh_folder
from modelward.sources.workload import AS_OF, check_sql, check_with

R = Registry()

FEEDBACK = """fl AS (SELECT client_request_id AS id, arrived_timestamp AS arrived, label FROM (
    SELECT *, row_number() OVER (PARTITION BY client_request_id ORDER BY arrived_timestamp, label) AS rn FROM label_source) z WHERE rn = 1),
fb AS (SELECT i.client_request_id AS prediction_id, i.project_id, i.prediction AS predicted_value, fl.label AS actual_label, i.request_time, fl.arrived,
              CAST(date_diff('second', i.request_time, fl.arrived) AS DOUBLE) / 86400 AS latency_days, i.prediction = fl.label AS correct
       FROM inference_log i JOIN fl ON fl.id = i.client_request_id)"""


def feedback_sql(body: str, extra: str = "") -> str:
    return check_with("inference_log label_source", FEEDBACK + (", " + extra if extra else ""), body)


def feedback(w):
    return fb.join_labels(w.inference_log, w.label_source, label_column="label", label_source_table="sales.labels")


@R.add(
    "feedback_join",
    feedback_sql(
        """SELECT prediction_id, project_id, predicted_value, actual_label, strftime(request_time, '%Y-%m-%d %H:%M:%S') AS predicted_at,
           strftime(arrived, '%Y-%m-%d %H:%M:%S') AS arrived_at, round(latency_days, 6) AS latency_days, correct FROM fb"""
    ),
)
def feedback_join(w):
    return feedback(w).select(
        "prediction_id", "project_id", "predicted_value", "actual_label", stamp("prediction_timestamp").alias("predicted_at"),
        stamp("label_arrived_timestamp").alias("arrived_at"), F.round("latency_days", 6).alias("latency_days"), "correct",
    )


@R.add("live_accuracy", feedback_sql("""SELECT project_id, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS live_accuracy, count(*) AS labels_count
    FROM fb WHERE arrived >= DATE '2001-08-01' - INTERVAL 1095 DAY GROUP BY project_id"""))
def live_accuracy(w):
    return fb.live_accuracy(feedback(w), AS_OF, 1095).withColumn("live_accuracy", F.round("live_accuracy", 6))


@R.add("live_accuracy_records", feedback_sql("""SELECT project_id, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS live_accuracy, count(*) AS labels_count, 'last_30d' AS measurement_window
    FROM fb WHERE arrived >= DATE '2001-08-01' - INTERVAL 30 DAY GROUP BY project_id"""))
def live_accuracy_records(w):
    return fb.accuracy_records(fb.live_accuracy(feedback(w), AS_OF, 30, null_policy="ignore").withColumn("live_accuracy", F.round("live_accuracy", 6)), 30)


@R.add("feedback_insert_if_absent", feedback_sql("""SELECT project_id, count(*) AS appended FROM fb WHERE NOT EXISTS (SELECT 1 FROM inference_log o WHERE o.client_request_id = fb.prediction_id AND o.prediction = 'P') GROUP BY project_id"""))
def feedback_insert_if_absent(w):
    held = w.inference_log.where("prediction = 'P'").select(F.col("client_request_id").alias("prediction_id"))
    return insert_if_absent(held, feedback(w), ["prediction_id"]).groupBy("project_id").agg(F.count(F.lit(1)).alias("appended"))


@R.add("declared_label_sources", """SELECT c_custkey AS contract_id, c_mktsegment AS label_source_table FROM customer WHERE c_acctbal > 0 AND nullif(c_mktsegment, 'BUILDING') IS NOT NULL""")
def declared_label_sources(w):
    contracts = w.customer.select(F.col("c_custkey").alias("contract_id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("label_source_table"), (F.col("c_acctbal") > 0).alias("is_active"))
    return fb.declared_sources(contracts).drop("is_active")


@R.add("retrain_candidates", feedback_sql(
    """SELECT t.project_id, strftime(t.since, '%Y-%m-%d %H:%M:%S') AS last_training, count(*) AS new_labels, 20 AS threshold FROM fb JOIN t ON t.project_id = fb.project_id
    WHERE t.since IS NULL OR fb.arrived > t.since GROUP BY t.project_id, t.since HAVING count(*) >= 20""",
    "t AS (SELECT o_orderpriority AS project_id, CASE WHEN o_orderpriority <> '5-LOW' THEN max(o_orderdate) - INTERVAL 400 DAY END AS since FROM orders GROUP BY o_orderpriority)",
))
def retrain_candidates(w):
    trained = w.orders.groupBy(F.col("o_orderpriority").alias("project_id")).agg((F.max("o_orderdate") - F.expr("INTERVAL 400 DAYS")).alias("at"))
    trained = trained.select("project_id", F.when(F.col("project_id") != "5-LOW", F.col("at")).alias("last_training_timestamp"))
    out = fb.retrain_candidates(feedback(w), trained, 20)
    return out.select("project_id", stamp("last_training_timestamp").alias("last_training"), "new_labels", "threshold")


@R.add("retraining_set", feedback_sql("SELECT prediction_id, predicted_value, actual_label FROM fb WHERE request_time >= DATE '2001-08-01' - INTERVAL 365 DAY"))
def retraining_set(w):
    out = fb.retraining_set(w.inference_log, w.label_source, AS_OF, 365, label_column="label", label_source_table="sales.labels")
    return out.select("prediction_id", "predicted_value", "actual_label")


SET_CONTRACT = [
    {"column_name": "prediction_id", "is_nullable": False, "quality_rules": '{"uniqueness_check": {"must_be_unique": true}}'},
    {"column_name": "predicted_value", "is_nullable": False, "allowed_values": ["F", "O"]},
    {"column_name": "actual_label", "is_nullable": False},
]


@R.add("retraining_set_version", feedback_sql(
    """SELECT substr(sha256('p:c:2001-08-01 00:00:00'), 1, 16) AS version, n AS row_count, 5 AS checks_run, round(1 - bad / 5.0, 6) AS quality_score, CASE WHEN 1 - bad / 5.0 >= 0.85 THEN 'ready' ELSE 'refused' END AS status FROM (
    SELECT count(*) AS n, CAST(count(*) > count(prediction_id) AS INT) + CAST(count(prediction_id) > count(DISTINCT prediction_id) AS INT) + CAST(count(*) > count(predicted_value) AS INT)
           + CAST(count(*) FILTER (predicted_value NOT IN ('F', 'O')) > 0 AS INT) + CAST(count(*) > count(actual_label) AS INT) AS bad FROM fb WHERE request_time >= DATE '2001-08-01' - INTERVAL 365 DAY) z"""))
def retraining_set_version(w):
    rows = fb.retraining_set(w.inference_log, w.label_source, AS_OF, 365, label_column="label", label_source_table="sales.labels").select("prediction_id", "predicted_value", "actual_label")
    out = fb.versioned_training_set(rows, SET_CONTRACT, fresh_folder(w.spark, "training_sets"), project_id="p", contract_id="c", as_of=AS_OF)
    return out.select("version", "row_count", "checks_run", F.round("quality_score", 6).alias("quality_score"), "status")


@R.add("shadow_comparison", """WITH s AS (SELECT * FROM (SELECT l_orderkey AS id, l_shipdate AS ts, l_linestatus AS prediction, l_extendedprice / 100000 AS score,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linestatus, l_extendedprice) AS rn FROM lineitem) z WHERE rn = 1)
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS compared, round(avg(CASE WHEN o_orderstatus = s.prediction THEN 1.0 ELSE 0.0 END), 6) AS agreement_rate,
       round(avg(score - o_totalprice / 500000), 6) AS mean_score_gap, round(avg(abs(score - o_totalprice / 500000)), 6) AS mean_abs_score_gap
FROM orders JOIN s ON s.id = o_orderkey GROUP BY 1""")
def shadow_comparison(w):
    current = w.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("prediction"), (F.col("o_totalprice") / 500000).alias("score"))
    shadow = w.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_linestatus").alias("prediction"), (F.col("l_extendedprice") / 100000).alias("score"))
    out = fb.shadow_comparison(current, shadow)
    rounded = [F.round(c, 6).alias(c) for c in ("agreement_rate", "mean_score_gap", "mean_abs_score_gap")]
    return out.select(F.col("day").cast("string").alias("day"), "compared", *rounded)


@R.add("service_metrics", check_sql("requests", """SELECT model_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS requests, round(avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
    round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99, round(count(*) / 86400.0, 9) AS per_second
    FROM requests GROUP BY 1, 2"""))
def service_metrics(w):
    out = fb.service_metrics(w.requests, "1 day", 86400)
    return out.select(
        "model_id", stamp("window_start", "yyyy-MM-dd").alias("day"), "requests", F.round("error_rate", 6).alias("error_rate"),
        *[F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")], F.round("per_second", 9).alias("per_second"),
    )


VALUE_FNS = """SELECT o_orderpriority AS project_id, concat('{"true_positive_usd":', CAST(min(o_custkey) + 120 AS STRING), ',"false_positive_usd":-8,"true_negative_usd":2.5}') AS definition_json
FROM orders GROUP BY o_orderpriority"""


@R.add("business_value", feedback_sql(
    """SELECT fb.project_id, strftime(arrived, '%Y-%m') AS period, count(*) AS decisions,
       round(CAST(sum(CASE WHEN predicted_value = actual_label AND predicted_value = 'F' THEN CAST(json_extract(definition_json, '$.true_positive_usd') AS DOUBLE)
                WHEN predicted_value <> actual_label AND predicted_value = 'F' THEN -8 WHEN predicted_value = actual_label THEN 2.5 ELSE 0 END) AS DOUBLE), 4) AS value_usd
       FROM fb JOIN v ON v.project_id = fb.project_id GROUP BY 1, 2""", f"v AS ({VALUE_FNS})"))
def business_value(w):
    fns = w.spark.sql(VALUE_FNS.replace("FROM orders", "FROM {orders}").replace('{"true', '{{"true').replace("2.5}'", "2.5}}'"), orders=w.orders)
    return fb.business_value(feedback(w), fns, "F").withColumn("value_usd", F.round("value_usd", 4))


@R.add("automation_rate", check_sql("hitl_reviews", """SELECT project_id, count(*) AS decisions, round(1 - avg(CASE WHEN decision IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS automation_rate FROM hitl_reviews GROUP BY project_id"""))
def automation_rate(w):
    return fb.automation_rate(w.hitl_reviews, F.col("decision").isNotNull(), ["project_id"]).withColumn("automation_rate", F.round("automation_rate", 6))


def _linear(pdf):
    return (pdf["l_quantity"] * 2 + pdf["l_discount"] * 100).where(pdf["l_quantity"] < 49)


@R.add("batch_scoring", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity < 49 THEN round(l_quantity * 2 + l_discount * 100, 6) END AS prediction FROM lineitem""")
def batch_scoring(w):
    out = fb.score(w.lineitem, _linear, ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.nanvl("prediction", F.lit(None)), 6).alias("prediction"))


@R.add("scoring_metrics", """SELECT count(*) AS rows_processed, count(*) FILTER (l_quantity >= 49) AS rows_failed, round(count(*) FILTER (l_tax <= 0.05) / CAST(count(*) AS DOUBLE), 6) AS schema_pass_rate FROM lineitem""")
def scoring_metrics(w):
    scored = w.lineitem.withColumn("prediction", F.when(F.col("l_quantity") < 49, F.col("l_quantity") * 2))
    return fb.scoring_metrics(scored, "prediction", F.col("l_tax") <= 0.05).withColumn("schema_pass_rate", F.round("schema_pass_rate", 6))


DRAW = "CAST(concat('0x', substr(md5(CAST({k} AS VARCHAR)), 1, 8)) AS BIGINT) % 10000"


@R.add("review_sample", f"SELECT event_id, user_id FROM events WHERE {DRAW.format(k='event_id')} < 500")
def review_sample(w):
    return fb.review_sample(w.events.select("event_id", "user_id"), "event_id", 0.05)


@R.add("low_confidence_reviews", check_sql("inference_log", "SELECT client_request_id, confidence FROM inference_log WHERE confidence < 0.1"))
def low_confidence_reviews(w):
    return fb.low_confidence(w.inference_log, "confidence", 0.1).select("client_request_id", "confidence")


@R.add("periodic_audit_sample", """SELECT period, event_id FROM (SELECT strftime(ts, '%Y-%m-%d') AS period, event_id,
    row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) z WHERE rn <= 3""")
def periodic_audit_sample(w):
    return fb.audit_sample(w.events.select("event_id", "ts"), F.date_format("ts", "yyyy-MM-dd"), "event_id", 3).select("period", "event_id")


@R.add("pending_reviews", check_sql("hitl_reviews telemetry", """SELECT h.prediction_id, h.project_id, strftime(h.presented_timestamp, '%Y-%m-%d') AS presented, t.confidence_bucket, t.resolved_alias
    FROM hitl_reviews h LEFT JOIN telemetry t ON t.client_request_id = h.prediction_id WHERE h.decision IS NULL ORDER BY h.presented_timestamp, h.prediction_id LIMIT 50"""))
def pending_reviews(w):
    return fb.pending_reviews(w.hitl_reviews, w.telemetry).select("prediction_id", "project_id", stamp("presented_timestamp", "yyyy-MM-dd").alias("presented"), "confidence_bucket", "resolved_alias")
