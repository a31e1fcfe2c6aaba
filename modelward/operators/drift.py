"""Field baselines, distribution drift and the alerts that follow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelward.functions.columns import bucket_below, count_where, drift_severity, instant, ks_p_value, psi_term, ratio, ratio_or_zero, row_id, share, within_days
from modelward.functions.ordered import count_in_trailing, exact_quantiles, islands, running_totals
from modelward.functions.relational import long_form, top_per_key, wide_to_rows
from modelward.operators.quality import value_counts

STATS = ("mean_value", "stddev_value", "min_value", "max_value", "null_pct")


def _stat_aggs(columns: Sequence[str]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        out += [
            F.avg(c).alias(f"_mean_{c}"), F.stddev(c).alias(f"_sd_{c}"), F.min(c).cast("double").alias(f"_min_{c}"), F.max(c).cast("double").alias(f"_max_{c}"),
            count_where(F.col(c).isNull()).alias(f"_null_{c}"),
        ]
    return out


def _stat_rows(wide: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return wide_to_rows(
        wide,
        [
            (c, {"mean_value": F.col(f"_mean_{c}"), "stddev_value": F.col(f"_sd_{c}"), "min_value": F.col(f"_min_{c}"), "max_value": F.col(f"_max_{c}"),
                 "null_pct": ratio_or_zero(F.col(f"_null_{c}") * 100.0, F.col("_n")), "n_rows": F.col("_n")})
            for c in columns
        ],
        keep, "field_name",
    )


def field_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, deviation, range and null share of numeric columns in one pass."""
    return _stat_rows(df.agg(*_stat_aggs(columns)), columns)


def daily_stats(df: DataFrame, columns: Sequence[str], ts: str) -> DataFrame:
    """The same per day: one shuffle of one wide partial row per day and task."""
    return _stat_rows(df.groupBy(F.to_date(ts).alias("window_date")).agg(*_stat_aggs(columns)), columns, ["window_date"])


def baseline(df: DataFrame, columns: Sequence[str], categorical: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Baseline per field: statistics (numeric fields), distinct count and the commonest values as JSON."""
    fields = [*columns, *categorical]
    none = F.lit(None).cast("double")
    aggs = _stat_aggs(columns) + [count_where(F.col(c).isNull()).alias(f"_null_{c}") for c in categorical]
    wide = df.agg(*aggs)
    for c in categorical:
        for s in ("mean", "sd", "min", "max"):
            wide = wide.withColumn(f"_{s}_{c}", none)
    counts = value_counts(df, fields)
    distinct = counts.groupBy("field").agg(F.count(F.lit(1)).alias("unique_count"))
    common = (
        top_per_key(counts, ["field"], [F.desc("n"), F.asc("value")], top, rank="_rank")
        .groupBy("field")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "value", "n"))).alias("_top"))
    )
    json = F.to_json(F.transform("_top", lambda t: F.struct(t["value"].alias("value"), t["n"].alias("count"))))
    return (
        _stat_rows(wide, fields)
        .join(distinct.withColumnRenamed("field", "field_name"), "field_name", "left")
        .join(common.select(F.col("field").alias("field_name"), json.alias("top_values_json")), "field_name", "left")
    )


def ks_test(base: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.1) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value per field; drift is a statistic above the threshold."""
    sides = long_form(base, columns, as_type="double").select("field", "value", F.lit(1).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).unionByName(
        long_form(current, columns, as_type="double").select("field", "value", F.lit(0).cast("long").alias("b"), F.lit(1).cast("long").alias("c"))
    )
    runs = running_totals(sides, ["field"], "value", ["b", "c"])
    # one division at the end: whole counts stay exact, so a statistic equal to the threshold is not above it
    nb, nc = F.col("b_total").cast("double"), F.col("c_total").cast("double")
    gap = ratio(F.abs((F.col("b_below") + F.col("b")) * nc - (F.col("c_below") + F.col("c")) * nb), nb * nc)
    out = runs.groupBy("field").agg(F.max(gap).alias("ks_stat"), F.max("b_total").alias("n_base"), F.max("c_total").alias("n_current"))
    return out.withColumn("ks_pvalue", ks_p_value(F.col("ks_stat"), F.col("n_base"), F.col("n_current"))).withColumn("drifted", F.coalesce(F.col("ks_stat") > threshold, F.lit(False))).withColumnRenamed("field", "field_name")


def decile_edges(base: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Inner bin edges per field from the baseline's quantiles, to be kept with the baseline."""
    cells = long_form(base, columns, as_type="double")
    names = {f"q{i:02d}": i / bins for i in range(1, bins)}
    cut = exact_quantiles(cells, ["field"], "value", names)
    return cut.select("field", F.array_distinct(F.array(*names)).alias("edges"))


def _binned(df: DataFrame, columns: Sequence[str], cuts: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Rows per field and bin; ``cuts`` maps a field to its edges."""

    def bin_of(c):
        edges = F.coalesce(F.try_element_at("_cuts", F.lit(c)), F.array().cast("array<double>"))
        return F.when(F.col(c).isNull(), F.lit(-1)).otherwise(F.size(F.filter(edges, lambda e: e <= F.col(c).cast("double"))))

    cells = F.array(*[F.struct(F.lit(c).alias("field"), bin_of(c).alias("bin")) for c in columns])
    return df.withColumn("_cuts", cuts).select(*keep, F.explode(cells).alias("_c")).groupBy(*keep, "_c.field", "_c.bin").agg(F.count(F.lit(1)).alias("n"))


def psi_daily(base: DataFrame, current: DataFrame, columns: Sequence[str], ts: str, bins: int = 10, eps: float = 1e-4, edges: DataFrame | None = None) -> DataFrame:
    """Population stability index per field and day against baseline deciles; NULL is a bin of its own.

    The edges (a few numbers per field of the schema) are a scalar that the query itself finds, or that is kept with the
    baseline; rows then shrink to (day, field, bin) counts in the first aggregate.
    """
    kept = edges if edges is not None else decile_edges(base, columns, bins)
    cuts = kept.agg(F.map_from_entries(F.collect_list(F.struct("field", "edges")))).scalar()
    shares = _binned(base, columns, cuts)
    shares = shares.withColumn("_b", F.col("n") / F.sum("n").over(Window.partitionBy("field"))).select("field", "bin", "_b")
    days = _binned(current.withColumn("window_date", F.to_date(ts)), columns, cuts, ["window_date"])
    # every bin counts on every day, also where neither side has rows
    top = F.coalesce(F.size(F.try_element_at(cuts, F.col("field"))), F.lit(0))
    found = days.groupBy("window_date", "field").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"), F.sum("n").alias("_t"))
    cells = found.select("window_date", "field", "_t", "_m", F.explode(F.sequence(F.lit(-1), top)).alias("bin")).withColumn("n", F.try_element_at("_m", F.col("bin")))
    # bins x fields rows: small by construction
    cells = cells.join(F.broadcast(shares), ["field", "bin"], "left")
    term = psi_term(F.coalesce("n", F.lit(0)) / F.col("_t"), F.col("_b"), eps)
    out = cells.groupBy("window_date", F.col("field").alias("field_name")).agg(F.sum(term).alias("psi_score"), F.max("_t").alias("n_rows"))
    return out.withColumn("band", bucket_below(F.col("psi_score")))


def psi_categorical(base: DataFrame, current: DataFrame, columns: Sequence[str], eps: float = 1e-4) -> DataFrame:
    """Population stability index with the values themselves as bins; NULL is a value."""

    def shares(df, name):
        n = long_form(df, columns).groupBy("field", F.coalesce("value", F.lit("\u0000")).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
        total = n.groupBy("field").agg(F.sum("_n").alias("_t"))
        return n.join(F.broadcast(total), "field").select("field", "value", (F.col("_n") / F.col("_t")).alias(name))

    both = shares(base, "_b").join(shares(current, "_c"), ["field", "value"], "full_outer")
    out = both.groupBy(F.col("field").alias("field_name")).agg(F.sum(psi_term(F.col("_c"), F.col("_b"), eps)).alias("psi_score"))
    return out.withColumn("band", bucket_below(F.col("psi_score")))


def baseline_change(base: DataFrame, current: DataFrame, stats: Sequence[str] = STATS) -> DataFrame:
    """Percent change of each statistic per field; blank where the baseline is 0."""
    was = base.select("field_name", *[F.col(s).alias(f"_b_{s}") for s in stats])
    cols = [((F.col(s) - F.col(f"_b_{s}")) / F.nullif(F.col(f"_b_{s}"), F.lit(0.0)) * 100.0).alias(f"{s}_change_pct") for s in stats]
    return current.join(was, "field_name").select("field_name", *cols)


# The types of drift.
DRIFT_TYPES = ("data", "quality", "value")


def _distribution(tag: str) -> Column:
    """Statistics of one side as JSON."""
    return F.to_json(F.struct(*[F.round(F.col(f"_{tag}_{s}"), 6).alias(s) for s in (*STATS, "n_rows")]))


def drift_scores(base: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per field and type of drift, with its score and both distributions as JSON.

    ``data`` is the Kolmogorov-Smirnov statistic, ``quality`` the change of the share of NULLs, ``value`` the shift of the mean
    in deviations of the baseline. Each side is read once for its statistics and once for its distribution.
    """
    side = lambda df, tag: field_stats(df, columns).select("field_name", *[F.col(s).alias(f"_{tag}_{s}") for s in (*STATS, "n_rows")])
    both = side(base, "b").join(side(current, "c"), "field_name").join(ks_test(base, current, columns).select("field_name", "ks_stat"), "field_name", "left")
    scores = {
        "data": F.col("ks_stat"), "quality": F.abs(F.col("_c_null_pct") - F.col("_b_null_pct")) / 100.0,
        "value": ratio(F.abs(F.col("_c_mean_value") - F.col("_b_mean_value")), F.col("_b_stddev_value")),
    }
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("drift_type"), scores[t].alias("score")) for t in DRIFT_TYPES])).alias("_s")
    return both.select("field_name", rows, _distribution("b").alias("baseline_distribution"), _distribution("c").alias("current_distribution")).select("field_name", "_s.*", "baseline_distribution", "current_distribution")


def drift_results(scores: DataFrame, config: Sequence[Mapping], as_of) -> DataFrame:
    """Result rows for the fields to watch: type, score against the field's own threshold, severity and flag.

    ``scores``: field_name, drift_type, score, the two distributions where they are known, and any columns to keep as JSON.
    A field's threshold may be given for each type as ``data_threshold``, ``quality_threshold`` and ``value_threshold``, or for
    all as ``drift_threshold``; ``drift_types`` names those to watch, all if it is absent.
    """
    told = [c for c in ("baseline_distribution", "current_distribution") if c in scores.columns]
    extra = [c for c in scores.columns if c not in ("field_name", "drift_type", "score", *told)]
    threshold = watched = None
    for c in config:
        if not c.get("monitor_for_drift"):
            continue
        for kind in c.get("drift_types") or DRIFT_TYPES:
            here = (F.col("field_name") == c["column_name"]) & (F.col("drift_type") == kind)
            limit = F.lit(float(c.get(f"{kind}_threshold") or c.get("drift_threshold") or 0.1))
            threshold = F.when(here, limit) if threshold is None else threshold.when(here, limit)
            watched = here if watched is None else watched | here
    if threshold is None:
        threshold, watched = F.lit(0.1), F.lit(False)
    rows = scores.where(watched).withColumn("threshold", threshold)
    details = F.to_json(F.struct(*extra)) if extra else F.lit("{}")
    return rows.select(
        row_id("field_name", "drift_type", F.lit(str(as_of))).alias("result_id"), "field_name", "drift_type", F.col("score").alias("drift_score"), "threshold",
        drift_severity(F.col("score"), F.col("threshold")).alias("severity"), (F.col("score") > F.col("threshold")).alias("drift_detected"), *told, details.alias("details_json"),
    )


def latest_per_field(log: DataFrame, fields: int | None = None) -> DataFrame:
    """Newest row of each field; optionally only the fields with the highest scores."""
    last = top_per_key(log, ["field_name"], [F.desc("window_date")])
    return last.orderBy(F.desc("psi_score"), "field_name").limit(fields) if fields else last


def field_series(log: DataFrame, fields: int = 6) -> DataFrame:
    """All rows of the fields whose newest score is highest, with the field's place among them."""
    ranked = latest_per_field(log, fields).select("field_name", F.row_number().over(Window.orderBy(F.desc("psi_score"), "field_name")).alias("place"))
    # as many rows as the limit says
    return log.join(F.broadcast(ranked), "field_name")


def prediction_drift(base: DataFrame, current: DataFrame, prediction: str, max_shift_pct: float = 5.0) -> DataFrame:
    """Shift of the output: PSI over its values, and the change of its mean."""
    psi = psi_categorical(base, current, [prediction])
    mean = lambda df: df.agg(F.avg(F.col(prediction).cast("double")))
    was, now = mean(base).scalar(), mean(current).scalar()
    shift = F.abs(now - was) / F.nullif(F.abs(was), F.lit(0.0)) * 100.0
    return psi.withColumn("mean_shift_pct", shift).withColumn("drifted", F.coalesce(F.col("mean_shift_pct") > max_shift_pct, F.lit(False)))


def performance_drift(base: DataFrame, current: DataFrame, keys: Sequence[str], metric: str, threshold_pct: float = 5.0) -> DataFrame:
    """Loss of a metric against its baseline per model."""
    was = base.select(*keys, F.col(metric).alias("baseline_value"))
    pct = ratio((F.col("baseline_value") - F.col("current_value")) * 100.0, F.col("baseline_value"))
    both = was.join(current.select(*keys, F.col(metric).alias("current_value")), list(keys))
    return both.withColumn("degradation_pct", pct).withColumn("performance_degraded", F.coalesce(F.col("degradation_pct") > threshold_pct, F.lit(False)))


def service_anomalies(requests: DataFrame, ts: str, key: str, latency: str, is_error: str, *, days: int = 7, latency_times: float = 2.0, max_error_rate: float = 0.01, sigmas: float = 3.0) -> DataFrame:
    """Days on which a model is slow, failing or off its usual volume, against the days before.

    Requests are first summed per model and day, so the rolling window sees one row per day; it goes by calendar days, and
    days without requests count for nothing.
    """
    daily = requests.groupBy(key, F.to_date(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("volume"), F.avg(latency).alias("mean_latency"), share(F.col(is_error)).alias("error_rate")
    )
    before = Window.partitionBy(key).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    base, usual, spread = F.avg("mean_latency").over(before), F.avg("volume").over(before), F.stddev("volume").over(before)
    return daily.select(
        "*", base.alias("baseline_latency"), F.coalesce(F.col("mean_latency") > base * latency_times, F.lit(False)).alias("latency_spike"),
        (F.col("error_rate") > max_error_rate).alias("error_spike"), F.coalesce(F.abs(F.col("volume") - usual) > spread * sigmas, F.lit(False)).alias("volume_anomaly"),
    )


def sliced_monitor(df: DataFrame, ts: str, size: str, key: str, slices: Sequence[str], value: str, correct: str | None = None) -> DataFrame:
    """Profile per time window, model and slice, the slice ``all`` included.

    A row is repeated once per slice inside the task and partial sums leave it, so the one shuffle carries a row per
    (window, model, slice value) and task.
    """
    v = F.col(value).cast("double")
    tags = F.array(
        F.struct(F.lit("all").alias("slice"), F.lit("all").alias("slice_value")),
        *[F.struct(F.lit(s).alias("slice"), F.coalesce(F.col(s).cast("string"), F.lit("null")).alias("slice_value")) for s in slices],
    )
    ok = F.col(correct) if correct else F.lit(None).cast("boolean")
    rows = df.select(F.window(ts, size)["start"].alias("window_start"), key, v.alias("_v"), ok.alias("_ok"), F.explode(tags).alias("_t"))
    return rows.groupBy("window_start", key, "_t.slice", "_t.slice_value").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("_v").alias("mean_value"), F.stddev("_v").alias("stddev_value"), F.min("_v").alias("min_value"), F.max("_v").alias("max_value"),
        ratio(count_where(F.col("_v").isNull()) * 100.0, F.count(F.lit(1))).alias("null_pct"), (share(F.col("_ok")) if correct else F.lit(None).cast("double")).alias("accuracy"),
    )


def sustained_breaches(df: DataFrame, key: str, ts: str, tie: str, breach: str, seconds: int, bucket_seconds: int = 3600) -> DataFrame:
    """Runs of consecutive breaches that last at least ``seconds``."""
    runs = islands(df, key, ts, tie, breach, bucket_seconds)
    return runs.withColumn("duration_s", F.timestamp_diff("SECOND", F.col("run_start"), F.col("run_end"))).where(F.col("duration_s") >= seconds)


def repeated_alerts(events: DataFrame, alert: str, ts: str, seconds: int, times: int) -> DataFrame:
    """Firings that are at least the ``times``-th of their alert within the trailing interval."""
    return count_in_trailing(events, [alert], ts, seconds, "firings").where(F.col("firings") >= times)


def performance_alerts(performance: DataFrame, models: DataFrame, configs: DataFrame, history: DataFrame, as_of, dedup_hours: int = 24) -> DataFrame:
    """Models whose recent degradation reaches their project's alert threshold, with what the pass does.

    One row per model, at its worst measurement. Projects without a threshold or a destination are left out; an alert
    that fired within the last hours is not repeated. Measurements are reduced per model before the joins.
    """
    recent = performance.where(within_days("measurement_timestamp", as_of, 1) & F.col("performance_degraded"))
    worst = recent.groupBy("model_id").agg(F.max(F.coalesce("degradation_pct", F.lit(0.0))).alias("alert_value"))
    latest = top_per_key(configs.select("project_id", "config_version", "interview_responses"), ["project_id"], [F.desc("config_version")])
    text = F.col("interview_responses")
    targets = F.size(F.coalesce(F.from_json(F.get_json_object(text, "$.alert_destination_configs"), "array<string>"), F.array().cast("array<string>")))
    limits = latest.select("project_id", F.get_json_object(text, "$.performance_alert_threshold_pct").try_cast("double").alias("threshold"), targets.alias("_targets"))
    fired = history.groupBy("alert_id").agg(F.max("triggered_timestamp").alias("last_fired"))
    due = (
        worst.join(models, "model_id")
        .join(limits.where(F.col("threshold").isNotNull() & (F.col("_targets") > 0)).drop("_targets"), "project_id")
        .where(F.col("alert_value") >= F.col("threshold"))
        .withColumn("alert_id", row_id(F.lit("perf-alert"), F.col("model_id")))
        .join(fired, "alert_id", "left")
    )
    hushed = F.coalesce(F.timestamp_diff("SECOND", F.col("last_fired"), instant(as_of)) < dedup_hours * 3600, F.lit(False))
    return due.withColumn("outcome", F.when(hushed, "repeated").otherwise("alert"))


# What a performance alert is written with.
ALERT = {"alert_name": "Performance degradation", "alert_type": "standard", "comparison_operator": ">=", "severity": "warning"}


def alert_events(due: DataFrame, as_of) -> DataFrame:
    """The history rows that a pass adds: one for each alert that fires, none for those that fired lately."""
    now = instant(as_of)
    return due.where("outcome = 'alert'").select(
        row_id("alert_id", F.lit(str(as_of))).alias("event_id"), "alert_id", "model_id", now.alias("triggered_timestamp"), "alert_value", F.lit(ALERT["severity"]).alias("alert_severity"),
        F.lit(True).alias("notification_sent"), now.alias("notification_timestamp"), F.lit(False).alias("resolved"), now.alias("created_timestamp"),
    )


def alert_definitions(current: DataFrame, due: DataFrame, metric: str, as_of) -> DataFrame:
    """The alert definitions after a pass: thresholds of known alerts as the pass found them, new alerts added.

    Alerts that are silent for now are defined as well. ``action`` tells kept, updated and added rows apart.
    """
    fresh = due.select("alert_id", "model_id", F.col("threshold").alias("_threshold"))
    both = current.join(fresh.select("alert_id", "_threshold"), "alert_id", "left")
    kept = both.withColumn("action", F.when(F.col("_threshold").isNull(), "kept").otherwise("updated")).withColumn("threshold_value", F.coalesce("_threshold", "threshold_value")).drop("_threshold")
    added = fresh.join(current.select("alert_id"), "alert_id", "left_anti").select(
        "alert_id", "model_id", F.lit(ALERT["alert_name"]).alias("alert_name"), F.lit(ALERT["alert_type"]).alias("alert_type"), F.lit(metric).alias("metric_name"), F.col("_threshold").alias("threshold_value"),
        F.lit(ALERT["comparison_operator"]).alias("comparison_operator"), F.lit(ALERT["severity"]).alias("severity"), F.lit(True).alias("is_enabled"), instant(as_of).alias("created_timestamp"), F.lit("added").alias("action"),
    )
    return kept.unionByName(added)


def distribution_issues(results: DataFrame) -> DataFrame:
    """Number of watched fields whose drift passes its threshold."""
    return results.agg(F.count(F.lit(1)).alias("fields_watched"), count_where(F.col("drift_detected")).alias("distribution_issues_found"))
