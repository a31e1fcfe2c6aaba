"""Inputs on which order, NULLs, signs or calendars matter."""

import pytest
from pyspark.sql import functions as F

from modelward.functions.identifiers import UnsafeName, check_column, check_table
from modelward.operators import drift, feedback, lineage, quality, state


def test_names_may_not_end_in_a_newline():
    for check, name in ((check_table, "a.b\n"), (check_column, "a\n")):
        with pytest.raises(UnsafeName):
            check(name)


def test_checksum_tells_where_a_null_is(spark):
    rows = [spark.createDataFrame([r], "a string, b string") for r in (("a", None), (None, "a"))]
    assert len({state.text_fingerprint(df, ["a", "b"]).first().checksum for df in rows}) == 2


def test_signed_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "x double")
    assert quality.duplicate_counts(df, ["x"]).first().duplicate_count == 1


def test_rows_that_differ_in_a_map_are_no_duplicates(spark):
    df = spark.range(2).select(F.lit(1).alias("a"), F.create_map(F.lit("k"), F.col("id")).alias("m"))
    assert quality.row_summary(df).first().duplicate_rows_pct == 0.0
    same = spark.range(2).select(F.when(F.col("id") == 0, F.expr("map('x', 1, 'y', 2)")).otherwise(F.expr("map('y', 2, 'x', 1)")).alias("m"))
    assert quality.row_summary(same).first().duplicate_rows_pct == 50.0


def test_newest_version_goes_by_number(spark):
    features = spark.createDataFrame([("f", "v9"), ("f", "v10"), ("g", "first")], "feature_id string, feature_version string")
    pins = spark.createDataFrame([("p", "f", None), ("p", "g", None)], "project_id string, feature_id string, pinned_version string")
    assert {r.feature_version for r in lineage.pinned_features(features, pins).collect()} == {"v10", "first"}


def test_anomalies_look_back_calendar_days(spark):
    rows = [("m", f"{day} 00:00:00", 10.0, False) for day in ("2024-01-01", "2024-06-01", "2024-06-02")]
    df = spark.createDataFrame(rows, "k string, ts string, latency double, bad boolean").withColumn("ts", F.to_timestamp("ts"))
    got = {str(r.day): r.baseline_latency for r in drift.service_anomalies(df, "ts", "k", "latency", "bad").collect()}
    assert got == {"2024-01-01": None, "2024-06-01": None, "2024-06-02": 10.0}


def test_versions_of_large_ids_stay_apart(spark):
    new = spark.createDataFrame([("p", 2**53 + i) for i in range(4)], "k STRING, o BIGINT")
    current = spark.createDataFrame([("p", 7)], "k STRING, v BIGINT")
    got = state.next_versions(current, new, "k", "v", "o", newest="last").orderBy("o").collect()
    assert [(r.v, r["last"]) for r in got] == [(8, False), (9, False), (10, False), (11, True)]


def test_ks_reads_each_side_once(spark):
    a, b = spark.range(100).select(F.col("id").cast("double").alias("v")), spark.range(50, 150).select(F.col("id").cast("double").alias("v"))
    df = drift.ks_test(a, b, ["v"])
    row = df.collect()[0]
    assert row.ks_stat == 0.5
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Range (") == 2


def test_psi_plans_without_a_job(spark):
    base = spark.range(1000).select(F.col("id").cast("double").alias("v"), F.timestamp_seconds(F.col("id")).alias("ts"))
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("psi-plan", "planning")
    df = drift.psi_daily(base, base, ["v"], "ts")
    assert list(seen.getJobIdsForGroup("psi-plan")) == []
    assert [(r.psi_score, r.band) for r in df.collect()] == [(0.0, "none")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_labels_since_a_training_count_to_the_second(spark):
    rows = [("p", f"2024-01-0{d} {h:02}:00:00") for d in (1, 2, 3) for h in (1, 9, 20)] + [("q", "2024-01-01 00:00:00"), ("r", "2024-01-02 09:00:00"), ("p", None)]
    labels = spark.createDataFrame(rows, "project_id STRING, label_arrived_timestamp STRING").withColumn("label_arrived_timestamp", F.col("label_arrived_timestamp").cast("timestamp_ntz"))
    trained = spark.createDataFrame([("p", "2024-01-02 09:00:00"), ("q", None), ("r", "2024-01-02 09:00:00")], "project_id STRING, t STRING").select("project_id", F.col("t").cast("timestamp_ntz").alias("last_training_timestamp"))
    got = {r.project_id: (r.new_labels, str(r.last_training_timestamp)) for r in feedback.retrain_candidates(labels, trained, 1).collect()}
    assert got == {"p": (4, "2024-01-02 09:00:00"), "q": (1, "None")}


def test_training_sets_are_versions_that_may_be_refused(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("b", 3)], "id STRING, v INT")
    contract = [{"column_name": "id", "is_nullable": False, "quality_rules": '{"uniqueness_check": {"must_be_unique": true}}'}, {"column_name": "v", "is_nullable": False}]
    make = lambda df: feedback.versioned_training_set(df, contract, str(tmp_path), project_id="p", contract_id="c", as_of="2024-01-01").first()
    bad, good = make(rows), make(rows.where("id = 'a'"))
    assert (bad.status, bad.row_count, good.status, good.row_count) == ("refused", 3, "ready", 1)
    assert bad.version == good.version and spark.read.parquet(good.path).count() == 1
