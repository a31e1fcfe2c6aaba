"""Predictions joined to labels that arrive later, and what follows from the join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.functions.columns import count_where, days_between, ratio, share, within_days
from modelward.functions.identifiers import check_column, check_table
from modelward.functions.ordered import exact_quantiles
from modelward.functions.relational import null_safe_join, top_per_key
from modelward.operators.quality import assess_contract


def join_labels(
    inference: DataFrame,
    labels: DataFrame,
    *,
    label_column: str,
    label_source_table: str,
    join_key: str = "client_request_id",
    prediction_column: str = "prediction",
    arrived_column: str = "arrived_timestamp",
    carry: Sequence[str] = ("project_id",),
) -> DataFrame:
    """One feedback row per labelled prediction: its earliest label, the delay in days and whether they agree as text.

    Both sides are reduced to one row per id before the join, so repeated ids neither multiply rows nor fill one task;
    the join then reuses the same partitioning.
    """
    check_table(label_source_table)
    for name in (label_column, join_key, prediction_column, arrived_column):
        check_column(name)
    first_label = (
        labels.where(F.col(join_key).isNotNull())
        .groupBy(F.col(join_key).alias("prediction_id"))
        .agg(F.min(F.struct(F.col(arrived_column).alias("at"), F.col(label_column).cast("string").alias("value"))).alias("_l"))
    )
    first_ask = (
        inference.where(F.col("client_request_id").isNotNull())
        .groupBy(F.col("client_request_id").alias("prediction_id"))
        .agg(F.min(F.struct(F.col("request_time").alias("at"), F.col(prediction_column).cast("string").alias("value"), *carry)).alias("_i"))
    )
    joined = first_ask.join(first_label, "prediction_id")
    return joined.select(
        "prediction_id",
        *[F.col(f"_i.{c}").alias(c) for c in carry],
        F.col("_i.value").alias("predicted_value"),
        F.col("_l.value").alias("actual_label"),
        F.lit(label_source_table).alias("label_source_table"),
        F.col("_i.at").alias("prediction_timestamp"),
        F.col("_l.at").alias("label_arrived_timestamp"),
        days_between(F.col("_i.at"), F.col("_l.at")).alias("latency_days"),
        (F.col("_i.value") == F.col("_l.value")).alias("correct"),
    )


def declared_sources(contracts: DataFrame) -> DataFrame:
    """Active contracts that name a label source."""
    return contracts.where(F.col("is_active") & F.col("label_source_table").isNotNull())


def live_accuracy(feedback: DataFrame, as_of, window_days: int = 30, keys: Sequence[str] = ("project_id",), null_policy: str = "wrong") -> DataFrame:
    """Accuracy and label count over labels of the last days; an undecided comparison counts as wrong unless ignored."""
    rows = feedback.where(within_days("label_arrived_timestamp", as_of, window_days))
    if null_policy == "ignore":
        rows = rows.where(F.col("correct").isNotNull())
    return rows.groupBy(*keys).agg(share(F.col("correct")).alias("live_accuracy"), F.count(F.lit(1)).alias("labels_count"))


def accuracy_records(accuracy: DataFrame, window_days: int) -> DataFrame:
    """Performance rows to append from ``live_accuracy``."""
    return accuracy.where(F.col("live_accuracy").isNotNull()).withColumn("measurement_window", F.lit(f"last_{window_days}d"))


def retrain_candidates(feedback: DataFrame, last_training: DataFrame, threshold: int) -> DataFrame:
    """Projects with at least ``threshold`` labels since their last training; never-trained projects count all labels.

    Labels are summed per project and day before the join, so it sees one row a day however many labels a project has; only
    on the day of a training are labels compared with its time one by one.
    """
    labels = feedback.select("project_id", F.col("label_arrived_timestamp").alias("_at"), F.to_date("label_arrived_timestamp").alias("_day")).where(F.col("_at").isNotNull())
    known = last_training.select("project_id", F.col("last_training_timestamp").alias("_since"), F.to_date("last_training_timestamp").alias("_since_day"))
    days = labels.groupBy("project_id", "_day").agg(F.count(F.lit(1)).alias("_n")).join(known, "project_id", "left")
    whole = days.where(F.col("_since").isNull() | (F.col("_day") > F.col("_since_day"))).select("project_id", "_since", "_n")
    that_day = labels.join(known.where(F.col("_since").isNotNull()).withColumnRenamed("_since_day", "_day"), ["project_id", "_day"]).where(F.col("_at") > F.col("_since"))
    part = that_day.groupBy("project_id", "_since").agg(F.count(F.lit(1)).alias("_n"))
    return (
        whole.unionByName(part).groupBy("project_id")
        .agg(F.sum("_n").alias("new_labels"), F.max("_since").alias("last_training_timestamp"))
        .where(F.col("new_labels") >= threshold)
        .withColumn("threshold", F.lit(threshold))
    )


def retraining_set(inference: DataFrame, labels: DataFrame, as_of, days: int = 30, **join_args) -> DataFrame:
    """Labelled predictions of the last days, to train on."""
    recent = inference.where(within_days("request_time", as_of, days))
    return join_labels(recent, labels, **join_args)


def versioned_training_set(rows: DataFrame, contract: Sequence, folder: str, *, project_id: str, contract_id: str, as_of, minimum_score: float = 0.85) -> DataFrame:
    """Writes a training set as a version of its own, if its quality allows, and returns the version's row.

    The set is written once and assessed as written; the version is named by project and time, so a repeated run replaces it.
    One row: version, path, rows, quality score and status, and whether it may be used for training; one that may not stays
    marked as refused.
    """
    version = hashlib.sha256(f"{project_id}:{contract_id}:{as_of}".encode()).hexdigest()[:16]
    path = f"{folder}/version={version}"
    rows.write.mode("overwrite").parquet(path)
    written = rows.sparkSession.read.parquet(path)
    found = assess_contract(written, contract, project_id=project_id, contract_id=contract_id, table_name="retraining_set", as_of=as_of, all_rules=True)
    return found.select(
        F.lit(version).alias("version"), "project_id", F.lit(path).alias("path"), "row_count", "checks_run", "quality_score", "quality_status",
        F.when(F.col("quality_score") >= minimum_score, "ready").otherwise("refused").alias("status"),
    )


def shadow_comparison(current: DataFrame, shadow: DataFrame) -> DataFrame:
    """Agreement of two models on the same requests per day: both sides carry id, ts, prediction and score."""

    def one(df, tag):
        picked = F.min(F.struct("ts", "prediction", "score")).alias(f"_{tag}")
        return df.where(F.col("id").isNotNull()).groupBy("id").agg(picked)

    both = one(current, "c").join(one(shadow, "s"), "id")
    agree = F.col("_c.prediction") == F.col("_s.prediction")
    gap = F.col("_s.score") - F.col("_c.score")
    return both.groupBy(F.to_date("_c.ts").alias("day")).agg(
        F.count(F.lit(1)).alias("compared"), share(agree).alias("agreement_rate"), F.avg(gap).alias("mean_score_gap"), F.avg(F.abs(gap)).alias("mean_abs_score_gap")
    )


def service_metrics(requests: DataFrame, size: str, seconds: int, ts: str = "ts", key: str = "model_id") -> DataFrame:
    """Latency percentiles, error rate and throughput per model and time window."""
    keys = [key, "window_start"]
    rows = requests.withColumn("window_start", F.window(ts, size)["start"])
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), share(F.col("is_error")).alias("error_rate"))
    lat = exact_quantiles(rows, keys, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return null_safe_join(counts, lat, keys, "left").withColumn("per_second", F.col("requests") / F.lit(float(seconds)))


def business_value(feedback: DataFrame, value_fns: DataFrame, positive: str) -> DataFrame:
    """Declared money value of each outcome summed per project and month; undeclared outcomes are worth nothing."""
    outcome = F.concat(
        F.when(F.col("predicted_value") == F.col("actual_label"), "true").otherwise("false"), F.when(F.col("predicted_value") == positive, "_positive").otherwise("_negative"), F.lit("_usd")
    )
    month = F.date_format("label_arrived_timestamp", "yyyy-MM")
    counts = feedback.groupBy("project_id", month.alias("period"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    worth = value_fns.select("project_id", F.from_json("definition_json", "map<string,double>").alias("_worth"))
    return (
        counts.join(worth, "project_id", "left")
        .groupBy("project_id", "period")
        .agg(F.sum("n").alias("decisions"), F.sum(F.col("n") * F.coalesce(F.try_element_at("_worth", F.col("outcome")), F.lit(0.0))).alias("value_usd"))
    )


def automation_rate(decisions: DataFrame, reviewed: Column, keys: Sequence[str]) -> DataFrame:
    """Share of decisions that no person had to make."""
    return decisions.groupBy(*keys).agg(F.count(F.lit(1)).alias("decisions"), (1.0 - share(reviewed)).alias("automation_rate"))


def score(df: DataFrame, predict: Callable[[pd.DataFrame], pd.Series], features: Sequence[str], out: str = "prediction", out_type: str = "double") -> DataFrame:
    """Add a model's output; the model sees Arrow batches on the executors and only its feature columns."""

    @F.pandas_udf(out_type)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield predict(pd.concat(cols, axis=1, keys=list(features)))

    return df.withColumn(out, run(*[F.col(c) for c in features]))


def scoring_metrics(scored: DataFrame, output: str, valid: Column) -> DataFrame:
    """Rows seen, rows without a score and the share of rows with a valid input."""
    return scored.agg(
        F.count(F.lit(1)).alias("rows_processed"),
        count_where(F.col(output).isNull() | F.isnan(F.col(output).cast("double"))).alias("rows_failed"),
        ratio(count_where(valid), F.count(F.lit(1))).alias("schema_pass_rate"),
    )


def stable_draw(key: str | Column) -> Column:
    """A number in [0, 10000) that depends on the key alone: the same rows are drawn on every run and every engine."""
    col = (F.col(key) if isinstance(key, str) else key).cast("string")
    return F.pmod(F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("long"), F.lit(10000))


def review_sample(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Statistical sample of predictions to review."""
    return df.where(stable_draw(key) < int(rate * 10000))


def low_confidence(df: DataFrame, confidence: str, threshold: float) -> DataFrame:
    """Predictions to escalate because the model was unsure; unknown confidence is unsure."""
    return df.where(F.coalesce(F.col(confidence), F.lit(0.0)) < threshold)


def audit_sample(df: DataFrame, period: Column, key: str, per_period: int) -> DataFrame:
    """A fixed number of rows per period, the same on every run."""
    return top_per_key(df.withColumn("period", period), ["period"], [F.md5(F.col(key).cast("string")), F.col(key)], per_period)


def pending_reviews(queue: DataFrame, telemetry: DataFrame, limit: int = 50) -> DataFrame:
    """Oldest undecided reviews with the explanation that has landed for them, if any.

    The queue is cut first; its few ids then pick the telemetry rows, so the telemetry table is filtered and not shuffled.
    """
    head = queue.where(F.col("decision").isNull()).orderBy("presented_timestamp", "prediction_id").limit(limit)
    # at most ``limit`` ids
    wanted = F.broadcast(head.select(F.col("prediction_id").alias("client_request_id")))
    notes = telemetry.join(wanted, "client_request_id", "left_semi").withColumnRenamed("client_request_id", "prediction_id")
    return head.join(notes, "prediction_id", "left").orderBy("presented_timestamp", "prediction_id").limit(limit)
