"""Evaluation metrics, fairness and model gates, each from one or two aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.functions.columns import count_where, ratio, ratio_or_zero
from modelward.functions.ordered import running_totals
from modelward.functions.relational import null_safe_join, wide_to_rows

METRICS = ("accuracy", "error_rate", "precision", "recall", "f1_score", "rmse", "mae")


def _confusion() -> list[Column]:
    t, p = F.col("y_true"), F.col("y_pred")
    return [
        F.count(F.lit(1)).alias("n"),
        count_where((t == 1) & (p == 1)).alias("_tp"),
        count_where((t == 0) & (p == 1)).alias("_fp"),
        count_where((t == 1) & (p == 0)).alias("_fn"),
        count_where(t == p).alias("_same"),
        F.sum(F.pow(t - p, F.lit(2.0))).alias("_sq"),
        F.sum(F.abs(t - p).cast("double")).alias("_abs"),
    ]


def _metrics() -> dict[str, Column]:
    n, tp, fp, fn = (F.col(c) for c in ("n", "_tp", "_fp", "_fn"))
    return {
        "accuracy": ratio(F.col("_same"), n),
        "error_rate": 1.0 - ratio(F.col("_same"), n),
        "precision": ratio_or_zero(tp, tp + fp),
        "recall": ratio_or_zero(tp, tp + fn),
        "f1_score": ratio_or_zero(tp * 2, tp * 2 + fp + fn),
        "rmse": F.sqrt(ratio(F.col("_sq"), n)),
        "mae": ratio(F.col("_abs"), n),
    }


def auc(df: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums over distinct scores; NULL when one class is missing."""
    keys = list(keys)
    src = df.where(F.col("y_true").isNotNull()).select(
        *keys, F.col(score).cast("double").alias("_s"), (F.col("y_true") == 1).cast("long").alias("pos"), (F.col("y_true") == 0).cast("long").alias("neg")
    )
    runs = running_totals(src, keys, "_s", ["pos", "neg"])
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return runs.groupBy(*keys).agg(ratio(won, F.max("pos_total").cast("double") * F.max("neg_total")).alias("auc_roc"))


def evaluate(df: DataFrame, keys: Sequence[str] = (), score: str | None = None) -> DataFrame:
    """All metrics of a labelled, predicted table (``y_true``, ``y_pred`` in 0/1), overall or per key."""
    out = df.groupBy(*keys).agg(*_confusion()).select(*keys, "n", *[c.alias(m) for m, c in _metrics().items()])
    if score is None:
        return out
    curve = auc(df, keys, score)
    if keys:
        return null_safe_join(out, curve, list(keys), "left")
    return out.withColumn("auc_roc", curve.scalar())


def compare_versions(df: DataFrame, version: str, old: str, new: str) -> DataFrame:
    """Each metric of two versions scored on the same rows, and the change."""
    per = evaluate(df.where(F.col(version).isin(old, new)), [version])
    sides = [F.max(F.when(F.col(version) == v, F.col(m))).alias(f"_{tag}_{m}") for v, tag in ((old, "old"), (new, "new")) for m in METRICS]
    wide = per.agg(*sides)
    rows = wide_to_rows(wide, [(m, {"old_value": F.col(f"_old_{m}"), "new_value": F.col(f"_new_{m}")}) for m in METRICS], name="metric")
    return rows.withColumn("delta", F.col("new_value") - F.col("old_value"))


def model_gate(comparison: DataFrame, minimum_accuracy: float = 0.85, max_drop_pct: float = 5.0) -> DataFrame:
    """Verdict on a new version: accurate enough, and not worse than the old one by more than the allowed share."""
    acc = comparison.where("metric = 'accuracy'")
    drop = ratio((F.col("old_value") - F.col("new_value")) * 100.0, F.col("old_value"))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce(F.col("new_value") < minimum_accuracy, F.lit(True)), "accuracy below minimum"),
            F.when(drop > max_drop_pct, "worse than the previous version"),
        )
    )
    return acc.select("old_value", "new_value", drop.alias("drop_pct"), reasons.alias("reasons")).withColumn("passed", F.size("reasons") == 0)


def group_rates(df: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """Selection, true-positive and false-positive rates per group of each sensitive column; NULL is a group.

    Rows are first counted per combination of groups and outcome, so the unpivot works on few rows.
    """
    cells = df.groupBy(*sensitive, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.array(*[F.struct(F.lit(c).alias("attribute"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("group")) for c in sensitive])
    rows = cells.select(F.explode(parts).alias("_g"), "y_true", "y_pred", "_n").select("_g.*", "y_true", "y_pred", "_n")

    def total(cond):
        return F.sum(F.when(cond, F.col("_n")).otherwise(F.lit(0)))

    t, p = F.col("y_true"), F.col("y_pred")
    return rows.groupBy("attribute", "group").agg(
        F.sum("_n").alias("n"),
        ratio(total(p == 1), F.sum("_n")).alias("selection_rate"),
        ratio(total((t == 1) & (p == 1)), total(t == 1)).alias("tpr"),
        ratio(total((t == 0) & (p == 1)), total(t == 0)).alias("fpr"),
    )


def fairness(df: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """Demographic-parity and equalized-odds difference per sensitive column.

    Groups without positives (negatives) stay out of the range of true (false) positive rates.
    """

    def spread(c):
        return F.max(c) - F.min(c)

    return group_rates(df, sensitive).groupBy("attribute").agg(
        F.count(F.lit(1)).alias("groups"), spread("selection_rate").alias("demographic_parity_diff"), F.greatest(spread("tpr"), spread("fpr")).alias("equalized_odds_diff")
    )


def fairness_gate(results: DataFrame, threshold_pct: float) -> DataFrame:
    """One verdict row: any disparity beyond the threshold fails, with the breaches listed."""
    cells = F.array(*[F.struct(F.concat(F.lit(f"{m}_"), F.col("attribute")).alias("metric"), F.col(m).alias("value")) for m in ("demographic_parity_diff", "equalized_odds_diff")])
    rows = results.select(F.explode(cells).alias("_c")).select("_c.*")
    hit = F.abs("value") > threshold_pct / 100.0
    # at most two entries per sensitive column
    return rows.agg(F.sort_array(F.array_compact(F.collect_list(F.when(hit, F.col("metric"))))).alias("breaches"), F.count(F.lit(1)).alias("metrics")).withColumn("passed", F.size("breaches") == 0)


def calibration(df: DataFrame, sensitive: Sequence[str], score: str = "score", bins: int = 10) -> DataFrame:
    """Expected calibration error per group over equal-width score bins, and the spread per sensitive column."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    cells = df.where(F.col(score).isNotNull() & F.col("y_true").isNotNull()).groupBy(*sensitive, at.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"), F.sum(score).alias("_s"), F.sum("y_true").alias("_y"))
    parts = F.array(*[F.struct(F.lit(c).alias("attribute"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("group")) for c in sensitive])
    binned = (
        cells.select(F.explode(parts).alias("_g"), "_bin", "_n", "_s", "_y")
        .groupBy("_g.attribute", "_g.group", "_bin")
        .agg(F.sum("_n").alias("_n"), F.abs(F.sum("_s") - F.sum("_y")).alias("_gap"))
    )
    return binned.groupBy("attribute", "group").agg(F.sum("_n").alias("n"), (F.sum("_gap") / F.sum("_n")).alias("calibration_error"))


def calibration_spread(per_group: DataFrame) -> DataFrame:
    return per_group.groupBy("attribute").agg((F.max("calibration_error") - F.min("calibration_error")).alias("calibration_diff"))


def canary(performance: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Verdict per candidate version: passed, breached, or NULL when it has no monitoring rows yet."""
    seen = performance.groupBy("version_id").agg(F.max(F.col("performance_degraded")).alias("_bad"), F.max("degradation_pct").alias("worst_degradation_pct"), F.count(F.lit(1)).alias("_n"))
    ok = ~(F.coalesce("_bad", F.lit(False)) | (F.coalesce("worst_degradation_pct", F.lit(0.0)) >= threshold))
    return candidates.join(seen, "version_id", "left").select(
        *candidates.columns, F.coalesce("_n", F.lit(0)).alias("measurements"), "worst_degradation_pct", F.when(F.coalesce("_n", F.lit(0)) > 0, ok).alias("passed")
    )


def rollback_verdict(versions: DataFrame, limits: Mapping[str, float]) -> DataFrame:
    """Reasons to roll a version back, from its metrics next to the previous version's.

    ``limits``: accuracy_drop, latency_times, error_rate, fairness_gap, null_predictions; an absent limit is not checked.
    """
    tests = {
        "accuracy_drop": (F.col("prev_accuracy") - F.col("accuracy")) > limits.get("accuracy_drop", 0),
        "latency_times": F.col("p95") > F.col("prev_p95") * limits.get("latency_times", 0),
        "error_rate": F.col("error_rate") > limits.get("error_rate", 0),
        "fairness_gap": (F.col("fairness_gap") - F.col("prev_fairness_gap")) > limits.get("fairness_gap", 0),
        "null_predictions": F.col("null_predictions") > limits.get("null_predictions", 0),
    }
    reasons = F.array_compact(F.array(*[F.when(tests[name], F.lit(name)) for name in tests if name in limits]))
    return versions.withColumn("reasons", reasons).withColumn("roll_back", F.size("reasons") > 0)


def retrain_decision(models: DataFrame, *, ks_limit: float = 0.1, degradation_limit: float = 5.0, label_limit: int = 1000) -> DataFrame:
    """Reasons to retrain each model: input drift, lost performance, enough new labels, or the schedule."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("ks_stat") > ks_limit, "data_drift"),
            F.when(F.col("degradation_pct") > degradation_limit, "performance_drift"),
            F.when(F.col("new_labels") >= label_limit, "new_labels"),
            F.when(F.col("schedule_due"), "schedule"),
        )
    )
    return models.withColumn("reasons", reasons).withColumn("retrain", F.size("reasons") > 0)


def individual_fairness(df: DataFrame, vector: str, prediction: str, planes: int = 8) -> DataFrame:
    """How far predictions stray from those of similar rows.

    Rows are alike when their vectors fall on the same side of a fixed set of sign planes; each row is held against the
    mean of its cell, so no pairs are formed and cells are summed in partial aggregates.
    """
    def side(j):
        sign = lambda i: F.when(F.bit_count(i.bitwiseAND(F.lit(2 * j + 1))) % 2 == 0, 1.0).otherwise(-1.0)
        dot = F.aggregate(F.transform(F.col(vector), lambda x, i: x.cast("double") * sign(i)), F.lit(0.0), lambda a, x: a + x)
        return F.when(dot >= 0, "1").otherwise("0")

    cells = df.select(F.concat(*[side(j) for j in range(planes)]).alias("cell"), F.col(prediction).cast("double").alias("_p"))
    # the mean deviation of a cell needs its mean first; predictions are compressed to counts per value
    counts = cells.groupBy("cell", "_p").agg(F.count(F.lit(1)).alias("_n"))
    means = counts.groupBy("cell").agg((F.sum(F.col("_p") * F.col("_n")) / F.sum("_n")).alias("_m"))
    return counts.join(means, "cell").groupBy("cell").agg(F.sum("_n").alias("n"), (F.sum(F.abs(F.col("_p") - F.col("_m")) * F.col("_n")) / F.sum("_n")).alias("mean_deviation"))
