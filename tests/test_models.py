import math
import random

import pytest
from pyspark.sql import functions as F

from modelward.operators import drift as d
from modelward.operators import evaluation as ev
from modelward.operators import feedback as fb


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v DOUBLE")


def ks(spark, a, b):
    return d.ks_test(frame(spark, a), frame(spark, b), ["v"]).first()


def test_ks_known_value_and_strict_threshold(spark):
    out = ks(spark, [1, 2, 3, 4, 5], [2, 3, 4, 5, 6])
    assert out.ks_stat == pytest.approx(0.2) and out.drifted
    assert not d.ks_test(frame(spark, range(10)), frame(spark, range(1, 11)), ["v"], threshold=0.1).first().drifted


def test_ks_is_symmetric_and_bounded(spark):
    rnd = random.Random(1)
    a, b = [rnd.gauss(0, 1) for _ in range(80)] + [None], [rnd.gauss(1, 2) for _ in range(50)]
    one, two = ks(spark, a, b), ks(spark, b, a)
    assert one.ks_stat == pytest.approx(two.ks_stat) and 0 <= one.ks_stat <= 1 and one.ks_pvalue == pytest.approx(two.ks_pvalue)
    want = max(abs(sum(x <= t for x in a if x is not None) / 80 - sum(x <= t for x in b) / 50) for t in [*a[:-1], *b])
    assert one.ks_stat == pytest.approx(want)
    assert ks(spark, [1, 1], [1, 1]).ks_pvalue == 1.0


def test_psi(spark):
    day = lambda df: df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    rnd = random.Random(2)
    a = [rnd.random() for _ in range(200)] + [None] * 5
    same = d.psi_daily(frame(spark, a), day(frame(spark, a)), ["v"], "ts").first()
    assert same.psi_score == pytest.approx(0) and same.band == "none"
    moved = d.psi_daily(frame(spark, a), day(frame(spark, [1 + (x or 0) for x in a])), ["v"], "ts").first()
    assert moved.psi_score > 0.2 and moved.band == "significant"
    flat = d.psi_daily(frame(spark, [3] * 9), day(frame(spark, [3] * 4)), ["v"], "ts").first()
    assert flat.psi_score == pytest.approx(0)


def test_psi_of_categories(spark):
    df = lambda s: spark.createDataFrame([(c,) for c in s], "c STRING")
    out = d.psi_categorical(df("aab"), df("abb"), ["c"]).first()
    assert out.psi_score == pytest.approx(2 * (1 / 3) * math.log(2))


def test_change_is_blank_on_zero_baseline(spark):
    stats = d.field_stats(frame(spark, [-1, 1]), ["v"])
    out = d.baseline_change(stats, d.field_stats(frame(spark, [1, 3]), ["v"])).first()
    assert out.mean_value_change_pct is None and out.max_value_change_pct == pytest.approx(200)


def test_drift_severity(spark):
    scores = spark.createDataFrame([("a", "data", s) for s in (0.05, 0.12, 0.16, 0.25, 0.9)], "field_name STRING, drift_type STRING, score DOUBLE").withColumn("n", F.lit(1))
    rows = d.drift_results(scores, [{"column_name": "a", "monitor_for_drift": True, "drift_threshold": 0.1}], "2024-01-01").orderBy("drift_score").collect()
    assert [r.severity for r in rows] == ["none", "low", "medium", "high", "critical"]


def labelled(spark, rows):
    return spark.createDataFrame(rows, "y_true INT, y_pred INT, score DOUBLE, g STRING")


def test_auc_mirrors(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), 0, rnd.randrange(20) / 20, "a") for _ in range(200)]
    df = labelled(spark, rows)
    up = ev.auc(df).first().auc_roc
    down = ev.auc(df.withColumn("score", -F.col("score"))).first().auc_roc
    pos, neg = [r[2] for r in rows if r[0]], [r[2] for r in rows if not r[0]]
    assert up == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)) and up + down == pytest.approx(1)
    assert ev.auc(df.where("y_true = 1")).first().auc_roc is None


def test_zero_denominators(spark):
    out = ev.evaluate(labelled(spark, [(0, 0, 0.1, "a"), (0, 0, 0.2, "a")])).first()
    assert (out.precision, out.recall, out.f1_score, out.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_fairness_and_gate(spark):
    df = labelled(spark, [(1, 1, 0.9, "a"), (0, 1, 0.8, "a"), (1, 0, 0.3, "b"), (0, 0, 0.2, "b"), (0, 0, 0.1, None)])
    out = ev.fairness(df, ["g"]).first()
    assert (out.groups, out.demographic_parity_diff, out.equalized_odds_diff) == (3, 1.0, 1.0)
    gate = ev.fairness_gate(ev.fairness(df, ["g"]), 99.0).first()
    assert not gate.passed and gate.breaches == ["demographic_parity_diff_g", "equalized_odds_diff_g"]
    assert ev.fairness_gate(ev.fairness(df, ["g"]), 100.0).first().passed  # the limit itself passes


def test_canary_has_three_answers(spark):
    perf = spark.createDataFrame([("a", False, 2.0), ("b", False, 7.5), ("d", True, 0.0), ("e", None, None)], "version_id STRING, performance_degraded BOOLEAN, degradation_pct DOUBLE")
    want = spark.createDataFrame([(v,) for v in "abcde"], "version_id STRING")
    assert {r.version_id: r.passed for r in ev.canary(perf, want, 5.0).collect()} == {"a": True, "b": False, "c": None, "d": False, "e": True}


def test_feedback_keeps_one_row_per_prediction(spark):
    asked = spark.sql("SELECT * FROM VALUES ('1', 'p', 'A', TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('1', 'p', 'A', TIMESTAMP_NTZ '2024-01-05 00:00:00'), (NULL, 'p', 'A', TIMESTAMP_NTZ '2024-01-01 00:00:00'), ('2', 'p', NULL, TIMESTAMP_NTZ '2024-01-01 00:00:00') AS t(client_request_id, project_id, prediction, request_time)")
    labels = spark.sql("SELECT * FROM VALUES ('1', 'B', TIMESTAMP_NTZ '2024-01-03 12:00:00'), ('1', 'A', TIMESTAMP_NTZ '2024-01-02 12:00:00'), ('2', 'A', TIMESTAMP_NTZ '2024-01-02 00:00:00'), (NULL, 'A', TIMESTAMP_NTZ '2024-01-02 00:00:00') AS t(client_request_id, label, arrived_timestamp)")
    out = fb.join_labels(asked, labels, label_column="label", label_source_table="a.b")
    rows = {r.prediction_id: r for r in out.collect()}
    assert set(rows) == {"1", "2"} and rows["1"].actual_label == "A" and rows["1"].latency_days == 1.5 and rows["1"].correct and rows["2"].correct is None
    acc = fb.live_accuracy(out, "2024-01-10", 30).first()
    assert (acc.live_accuracy, acc.labels_count) == (0.5, 2)
    assert fb.live_accuracy(out, "2024-01-10", 30, null_policy="ignore").first().live_accuracy == 1.0
    assert fb.live_accuracy(out, "2025-01-10", 30).count() == 0
    with pytest.raises(ValueError):
        fb.join_labels(asked, labels, label_column="label; drop", label_source_table="a.b")


def test_window_edge_is_midnight(spark):
    rows = spark.sql("SELECT 'p' AS project_id, true AS correct, TIMESTAMP_NTZ '2024-01-09 00:00:00' AS label_arrived_timestamp")
    assert fb.live_accuracy(rows, "2024-01-10 18:00:00", 1).count() == 1


def test_retrain_threshold(spark):
    rows = spark.sql("SELECT 'p' AS project_id, TIMESTAMP_NTZ '2024-01-02' + make_interval(0, 0, 0, CAST(id AS INT)) AS label_arrived_timestamp FROM range(10)")
    since = spark.sql("SELECT 'p' AS project_id, TIMESTAMP_NTZ '2024-01-04 00:00:00' AS last_training_timestamp")
    assert fb.retrain_candidates(rows, since, 7).first().new_labels == 7
    assert fb.retrain_candidates(rows, since, 8).count() == 0


def test_scoring_runs_on_batches(spark):
    out = fb.score(spark.range(10).withColumn("b", F.lit(2.0)), lambda pdf: pdf["id"] * pdf["b"], ["id", "b"])
    assert [r.prediction for r in out.orderBy("id").collect()] == [i * 2.0 for i in range(10)]
