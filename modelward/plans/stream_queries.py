"""Streaming queries, each run over all that its source holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelward.functions.columns import stamp
from modelward.operators.feedback import low_confidence, review_sample
from modelward.plans.feedback_queries import DRAW
from modelward.plans.governance_queries import FIRST
from modelward.plans.registry import Registry
from modelward.session import fresh_folder
from modelward.sources.ticks import replayed
from modelward.sources.workload import Workload, check_sql, check_with
from modelward.streaming import jobs, keyed

R = Registry()


def beside(w, on_disk=False):
    """The same tables in a session for streams."""
    # on one machine, more state partitions than cores only cost time
    sc = w.spark.sparkContext
    return Workload(jobs.stream_session(w.spark, sc.defaultParallelism if sc.master.startswith("local") else None, on_disk), w.folder)


def stream(w, table):
    return jobs.read_stream(beside(w).spark, f"{w.folder}/{table}.parquet")


def arrivals(w, rows, part, n=3):
    """Rows as a stream of ``n`` batches in the order of ``part``, which counts from 0.

    All tasks write. Every batch has the same number of files, so that the source can take them by their number: a task
    without rows writes none, and empty files stand in.
    """
    folder, files = fresh_folder(w.spark, "arrivals"), max(1, rows.rdd.getNumPartitions())
    for k in range(n):
        rows.where(part == k).write.mode("append").parquet(folder)
        for _ in range((k + 1) * files - len(w.spark.read.parquet(folder).inputFiles())):
            w.spark.createDataFrame([], rows.schema).write.mode("append").parquet(folder)
    return jobs.read_stream(w.spark, folder, files_per_batch=files)


def drain(w, df, mode="append", keys=()):
    return jobs.drain(df, mode, keys, spark=w.spark)


def third(ts, first, second):
    """0, 1 or 2 by time."""
    return (F.col(ts) >= F.lit(first).cast("timestamp_ntz")).cast("int") + (F.col(ts) >= F.lit(second).cast("timestamp_ntz")).cast("int")


def ltz(c):
    return F.col(c).cast("timestamp")


@R.add("stream_scoring", "SELECT event_id, round(value * 0.5 + 1, 6) AS prediction FROM events")
def stream_scoring(w):
    return drain(w, jobs.score_stream(stream(w, "events"), F.round(F.col("value") * 0.5 + 1, 6)).select("event_id", "prediction"))


@R.add("stream_once_per_id", "SELECT DISTINCT l_orderkey FROM lineitem")
def stream_once_per_id(w):
    rows = stream(w, "lineitem").select("l_orderkey", ltz("l_shipdate").alias("ts"))
    return drain(w, jobs.once_per_id(rows, "l_orderkey", "ts", "4000 days").select("l_orderkey"))


@R.add("stream_metric_windows", "SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value, round(avg(CASE WHEN value > 120 THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events GROUP BY 1, 2")
def stream_metric_windows(w):
    rows = stream(w, "events").withColumn("ts", ltz("ts")).withColumn("slow", F.col("value") > 120)
    out = drain(w, jobs.metric_windows(rows, "ts", "1 hour", "event_type", "value", "slow", "1 hour"), "update", ["window_start", "event_type"])
    return out.select("event_type", stamp("window_start").alias("window_start"), "n", F.round("mean_value", 6).alias("mean_value"), "max_value", F.round("error_rate", 6).alias("error_rate"))


@R.add("stream_rollback_triggers", """WITH x AS (SELECT 'all' AS model_id, date_trunc('minute', ts) - to_minutes(i) AS ws, value > 60 AS bad FROM events, (SELECT unnest(generate_series(0, 4)) AS i) s),
g AS (SELECT model_id, ws, count(*) AS n, count(*) FILTER (bad) AS errors FROM x GROUP BY 1, 2) SELECT model_id, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, n, errors FROM g WHERE errors >= 2 OR errors / CAST(n AS DOUBLE) > 0.5""")
def stream_rollback_triggers(w):
    rows = stream(w, "events").select(ltz("ts").alias("ts"), F.lit("all").alias("model_id"), (F.col("value") > 60).alias("bad"))
    out = drain(w, jobs.rollback_triggers(rows, "ts", "model_id", "bad", "10 minutes", max_errors=2, max_rate=0.5), "update", ["window_start", "model_id"])
    return out.withColumn("window_start", stamp("window_start"))


@R.add("stream_feedback_join", check_sql("inference_log label_source", """SELECT i.client_request_id AS prediction_id, prediction AS predicted_value, label AS actual_label, strftime(arrived_timestamp, '%Y-%m-%d') AS arrived,
    round(CAST(date_diff('second', request_time, arrived_timestamp) AS DOUBLE) / 86400, 6) AS latency_days, prediction = label AS correct FROM inference_log i JOIN label_source l ON l.client_request_id = i.client_request_id
    AND arrived_timestamp >= request_time AND arrived_timestamp <= request_time + INTERVAL 90 DAY"""))
def stream_feedback_join(w):
    own, parts = beside(w), ("1997-05-01", "1999-09-01")
    asked = arrivals(own, own.orders.select(F.col("o_orderkey").cast("string").alias("prediction_id"), F.col("o_orderdate").alias("predicted_at"), F.col("o_orderstatus").alias("predicted_value")), third("predicted_at", *parts))
    labels = arrivals(own, own.lineitem.select(F.col("l_orderkey").cast("string").alias("label_id"), F.col("l_shipdate").alias("arrived_at"), F.col("l_linestatus").alias("actual_label")), third("arrived_at", *parts))
    # what a batch brings is ahead of all batches before, so a day is delay enough; predictions are kept for the latency
    asked, labels = asked.withColumn("predicted_at", ltz("predicted_at")), labels.withColumn("arrived_at", ltz("arrived_at"))
    out = drain(w, jobs.feedback_stream(asked, labels, latency="90 DAYS", prediction_delay="1 day", label_delay="1 day"))
    return out.select("prediction_id", "predicted_value", "actual_label", stamp("arrived_at", "yyyy-MM-dd").alias("arrived"), F.round("latency_days", 6).alias("latency_days"), "correct")


@R.add("stream_sla_breaches", """SELECT CAST(o_orderkey AS VARCHAR) AS prediction_id, strftime(o_orderdate, '%Y-%m-%d') AS presented FROM orders
    WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'A' AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY)
    AND o_orderdate + INTERVAL 30 DAY < least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem WHERE l_returnflag <> 'A'))""")
def stream_sla_breaches(w):
    presented = stream(w, "orders").select(F.col("o_orderkey").cast("string").alias("prediction_id"), ltz("o_orderdate").alias("presented_at"))
    decided = stream(w, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").cast("string").alias("decided_id"), ltz("l_shipdate").alias("decided_at"))
    out = drain(w, jobs.sla_breaches(presented, decided, sla="30 DAYS", delay="0 seconds"))
    return out.select("prediction_id", stamp("presented_at", "yyyy-MM-dd").alias("presented"))


@R.add("stream_gate_states", check_with("vote_log approvals", FIRST, """SELECT cl.approval_id, cl.required_count, cl.status, strftime(cl.closed_at[1], '%Y-%m-%d') AS completed,
    count(*) FILTER (f.decision = 'approve') AS approved_count, count(*) FILTER (f.decision = 'reject') AS rejected_count, count(f.voter) AS responses
    FROM cl LEFT JOIN fv f ON f.approval_id = cl.approval_id AND (cl.closed_at IS NULL OR (f.event_time, f.event_id) <= cl.closed_at)
    WHERE cl.approval_id IN (SELECT approval_id FROM vote_log) GROUP BY cl.approval_id, cl.required_count, cl.status, cl.closed_at"""))
def stream_gate_states(w):
    own = beside(w, on_disk=True)
    votes = arrivals(own, own.vote_log.where("approval_id IS NOT NULL"), third("event_time", "1997-05-01", "1999-09-01"))
    gates = own.approvals.select("approval_id", "required_count")
    out = drain(w, keyed.gate_votes(votes, gates, max(keyed.GATE_SLOTS, gates.count() // 1000)), "update", ["approval_id"])
    voted = w.vote_log.select("approval_id").distinct()
    # gates whose votes don't count have no state
    every = w.approvals.select("approval_id", F.greatest("required_count", F.lit(1)).alias("_need")).join(voted, "approval_id").join(out, "approval_id", "left").fillna(0, ["approved_count", "rejected_count", "responses"])
    return every.select("approval_id", F.col("_need").alias("required_count"), F.coalesce("status", F.lit("pending")).alias("status"), stamp("completed_timestamp", "yyyy-MM-dd").alias("completed"), "approved_count", "rejected_count", "responses")


@R.add("stream_alert_once_per_day", "SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'error'")
def stream_alert_once_per_day(w):
    rows = stream(w, "events").where("event_type = 'error'").select("user_id", ltz("ts").alias("ts"))
    return drain(w, jobs.once_per_period(rows, "user_id", "ts", "1 day", "2 days")).select("user_id", stamp("period_start", "yyyy-MM-dd").alias("day"))


@R.add("stream_alert_firings", """WITH RECURSIVE e AS (SELECT user_id, ts FROM events WHERE event_type = 'error' AND user_id IS NOT NULL AND ts IS NOT NULL),
f AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id UNION ALL SELECT f.user_id, min(e.ts) FROM f JOIN e ON e.user_id = f.user_id AND e.ts >= f.ts + INTERVAL 24 HOUR GROUP BY f.user_id, f.ts)
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fired FROM f""")
def stream_alert_firings(w):
    own = beside(w, on_disk=True)
    rows = arrivals(own, own.events.where("event_type = 'error'").select("user_id", "ts"), third("ts", "2024-01-11", "2024-01-21"))
    return drain(w, keyed.firings(rows, "user_id", "ts", 24 * 3600, "1 hour")).select("user_id", stamp("ts").alias("fired"))


@R.add("stream_intake_once", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value FROM events")
def stream_intake_once(w):
    own = beside(w)
    part = third("ts", "2024-01-11", "2024-01-21")
    # a third comes twice in one batch, a fifth again with the batch after
    rows = own.events.select("event_id", "ts", "value", part.alias("part"), F.lit(0).alias("again"))
    more = rows.where("event_id % 3 = 0").union(rows.where("event_id % 5 = 0 AND part < 2").withColumn("part", F.col("part") + 1))
    came = arrivals(own, rows.union(more), F.col("part")).withColumn("ts", ltz("ts"))
    return drain(w, jobs.once_per_id(came, "event_id", "ts", "20 days")).select("event_id", stamp("ts").alias("ts"), "value")


@R.add("stream_late_rows", """WITH a AS (SELECT *, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 2 WHEN ts >= TIMESTAMP '2024-01-11' THEN 1 ELSE 0 END AS own FROM events),
b AS (SELECT *, least(own + CASE WHEN event_id % 10 = 0 THEN 1 WHEN event_id % 25 = 0 THEN 2 ELSE 0 END, 2) AS part FROM a),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b GROUP BY part)
SELECT event_id, event_type, user_id, value, coalesce(ts < date_trunc('millisecond', seen) - INTERVAL 1 DAY, false) AS late, count(*) FILTER (ts < date_trunc('millisecond', seen) - INTERVAL 1 DAY) OVER () AS counted FROM b JOIN m USING (part)""")
def stream_late_rows(w):
    own = beside(w)
    delayed = F.when(F.col("event_id") % 10 == 0, 1).when(F.col("event_id") % 25 == 0, 2).otherwise(0)
    rows = own.events.select("event_id", "event_type", "user_id", "value", "ts", F.least(third("ts", "2024-01-11", "2024-01-21") + delayed, F.lit(2)).alias("part"))
    came = keyed.with_lateness(arrivals(own, rows, F.col("part")), "ts", "1 day")
    folder, listener = fresh_folder(w.spark, "lateness"), keyed.LateRows()
    own.spark.streams.addListener(listener)
    try:
        query = keyed.start_split(came, folder, once=True)
        query.awaitTermination()
        # the listener hears of the last batch soon after
        counted = listener.settled(str(query.id), query.lastProgress["batchId"] if query.lastProgress else -1)
    finally:
        own.spark.streams.removeListener(listener)
    found = jobs.results(w.spark, folder, came.schema)
    return found.select("event_id", "event_type", "user_id", "value", "late", F.lit(counted).cast("long").alias("counted"))


@R.add("stream_ticks", "SELECT event_id, event_type, value, CASE WHEN event_id < 500 THEN 0 ELSE 1 + (event_id - 500) // 25 END AS tick FROM events")
def stream_ticks(w):
    own = beside(w)
    rows = replayed(own.events.select("event_id", "event_type", "value"), "event_id", since=0.0)
    return drain(w, rows.select("event_id", "event_type", "value", "tick"))


@R.add("stream_period_samples", """SELECT strftime(period, '%Y-%m-%d') AS period, event_id FROM (SELECT date_trunc('day', ts) AS period, event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) z
    WHERE rn <= 3 AND period + INTERVAL 1 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_period_samples(w):
    own = beside(w, on_disk=True)
    rows = arrivals(own, own.events.select("event_id", "ts"), third("ts", "2024-01-11", "2024-01-21"))
    return drain(w, keyed.period_samples(rows, "event_id", "ts", 86400, 3, "1 hour")).select(stamp("period", "yyyy-MM-dd").alias("period"), "event_id")


@R.add("stream_review_sample", f"SELECT event_id FROM events WHERE {DRAW.format(k='event_id')} < 500")
def stream_review_sample(w):
    return drain(w, review_sample(stream(w, "events").select("event_id"), "event_id", 0.05))


@R.add("stream_low_confidence", "SELECT o_orderkey, o_totalprice / 500000 AS confidence FROM orders WHERE o_totalprice / 500000 < 0.1")
def stream_low_confidence(w):
    rows = stream(w, "orders").select("o_orderkey", (F.col("o_totalprice") / 500000).alias("confidence"))
    return drain(w, low_confidence(rows, "confidence", 0.1))
