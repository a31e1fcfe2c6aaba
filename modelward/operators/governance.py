"""Governance rollups: speed, reliability, reuse, impact, revalidation, monitoring coverage and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.functions.columns import CLASSIFICATIONS, ON_DUE_ACTIONS, count_where, instant, ladder_level, level_rank, ratio, row_id, share, strictest, within_days
from modelward.functions.relational import top_per_key
from modelward.operators.state import merge_upsert

# Oldest review date that still counts as reviewed, in days.
VALUE_FN_MAX_AGE_DAYS = 365


def speed(approvals: DataFrame, deployments: DataFrame, as_of, days_back: int = 90, distinct_deployments: bool = False) -> DataFrame:
    """Promotions and mean whole hours from approval to deployment, matched on the reviewed plan.

    A plan approved several times counts once per approval unless ``distinct_deployments``.
    """
    done = approvals.where("status = 'approved'").select("plan_hash", "completed_timestamp")
    if distinct_deployments:
        done = done.groupBy("plan_hash").agg(F.min("completed_timestamp").alias("completed_timestamp"))
    live = deployments.where((F.col("status") == "deployed") & within_days("created_timestamp", as_of, days_back)).select("plan_hash", "created_timestamp")
    hours = F.timestamp_diff("HOUR", F.col("completed_timestamp"), F.col("created_timestamp"))
    return live.join(done, "plan_hash").agg(F.count(F.lit(1)).alias("promotions"), F.avg(hours).alias("avg_approval_to_deploy_hours"))


def reliability(deployments: DataFrame, as_of, days_back: int = 90) -> DataFrame:
    """Deployments, failures and failure rate; the rate is NULL when nothing was deployed."""
    failed = count_where(F.col("status").isin("failed", "verify_failed"))
    total = F.count(F.lit(1))
    return deployments.where(within_days("created_timestamp", as_of, days_back)).agg(
        total.alias("deployments"), failed.alias("failed"), F.round(ratio(failed * 100.0, total), 2).alias("failure_rate_pct")
    )


def status_counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def revalidation_debt(flags: DataFrame) -> DataFrame:
    """Flags that are due or under review, and how many of them block traffic."""
    due, review = count_where(F.col("status") == "due"), count_where(F.col("status") == "in_revalidation")
    return flags.where(F.col("status").isin("due", "in_revalidation")).agg(
        due.alias("revalidation_due"),
        review.alias("in_revalidation"),
        count_where(F.col("on_due_action").isin("block_new_traffic", "block_all_traffic")).alias("promotion_blocked"),
        (due + review).alias("governance_coverage_penalty"),
    )


def business_impact(impact: DataFrame, value_fns: DataFrame, as_of, days_back: int = 90) -> DataFrame:
    """Impact per confidence class, with the projects whose value function nobody reviewed lately.

    The two figures are never added up. Impact is summed per project before the join.
    """
    usd = F.coalesce("revenue_lift_usd", F.lit(0.0)) + F.coalesce("loss_avoided_usd", F.lit(0.0))
    per_project = impact.where(within_days("period_end", as_of, days_back)).groupBy("project_id").agg(F.sum(usd).alias("_usd"), F.count(F.lit(1)).alias("_n"))
    fresh = F.coalesce(within_days("last_reviewed_date", as_of, VALUE_FN_MAX_AGE_DAYS), F.lit(False))
    reviewed = value_fns.groupBy("project_id").agg(F.max(fresh).alias("_ok"), F.count(F.lit(1)).alias("_fns"))
    # each function row of a project repeats its impact rows, as a plain join of the two would
    scored = per_project.join(reviewed, "project_id", "left").select(
        "project_id", (F.col("_usd") * F.coalesce("_fns", F.lit(1))).alias("_usd"), F.when(F.col("_ok"), "high").otherwise("low").alias("confidence")
    )
    return scored.groupBy("confidence").agg(F.sum("_usd").alias("impact_usd"), F.count(F.lit(1)).alias("projects"))


def unreviewed_projects(impact: DataFrame, value_fns: DataFrame, as_of, days_back: int = 90) -> DataFrame:
    """Projects with impact in the window but no recently reviewed value function, one row each."""
    fresh = value_fns.where(within_days("last_reviewed_date", as_of, VALUE_FN_MAX_AGE_DAYS)).select("project_id")
    return impact.where(within_days("period_end", as_of, days_back)).select("project_id").distinct().join(fresh, "project_id", "left_anti")


def approval_listing(approvals: DataFrame, models: DataFrame, projects: DataFrame, status: Sequence[str] = ("pending",)) -> DataFrame:
    """Approvals with their model's project, kept when either is unknown."""
    named = projects.select("project_id", "project_name")
    return approvals.where(F.col("status").isin(*status)).join(models, "model_id", "left").join(named, "project_id", "left")


def project_listing(projects: DataFrame, include_archived: bool = False, newest_by: str | None = None) -> DataFrame:
    """Projects, without the archived ones unless asked for; newest first by the given time, those without one last."""
    rows = projects if include_archived else projects.where(~F.coalesce(F.col("is_archived"), F.lit(False)))
    return rows.orderBy(F.desc_nulls_last(newest_by), "project_id") if newest_by else rows


def approval_summary(approvals: DataFrame) -> DataFrame:
    return approvals.agg(*[count_where(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")])


def project_tiers(projects: DataFrame, packs: DataFrame) -> DataFrame:
    """The requirement row of every pack that applies to a project at its risk tier."""
    applied = projects.where(F.col("risk_tier").isNotNull()).select("project_id", "risk_tier", F.explode("regulatory_frameworks").alias("policy_pack_id"))
    return applied.distinct().join(packs, ["policy_pack_id", "risk_tier"])


def required_gates(tiers: DataFrame) -> DataFrame:
    """Union of the gates over a project's packs, one row per gate."""
    return tiers.select("project_id", F.explode("required_approval_gates").alias("approval_gate")).distinct()


def unsatisfied_gates(required: DataFrame, approvals: DataFrame, models: DataFrame) -> DataFrame:
    """Required gates without an approved record."""
    # distinct before the join: one row per model and gate, however many approvals there are
    done = approvals.where("status = 'approved'").select("model_id", "approval_gate").distinct().join(models, "model_id").select("project_id", "approval_gate").distinct()
    return required.join(done, ["project_id", "approval_gate"], "left_anti")


def revalidation_block(flags: DataFrame) -> DataFrame:
    """Strictest action among a project's open flags; NULL when none is known."""
    return flags.where(F.col("status").isin("due", "in_revalidation")).groupBy("project_id").agg(strictest(F.col("on_due_action"), ON_DUE_ACTIONS).alias("block_action"))


def revalidation_candidates(projects: DataFrame, models: DataFrame, versions: DataFrame) -> DataFrame:
    """Registered models of projects that have a risk tier, each once."""
    named = versions.where(F.col("uc_full_name").isNotNull()).select("model_id", "uc_full_name").distinct()
    tiered = projects.where(F.col("risk_tier").isNotNull()).select("project_id")
    return named.join(models, "model_id").join(tiered, "project_id").select("project_id", "uc_full_name").distinct()


def start_revalidation(flags: DataFrame, gates: DataFrame, models: DataFrame, requested_by: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Open the gate re-runs of all due flags: (new approval requests, flags under review with their request ids).

    A project without required gates or without a tracked model stays due.
    """
    keys = ["project_id", "uc_full_name"]
    model = models.groupBy("project_id").agg(F.min("model_id").alias("model_id"))
    due = flags.where("status = 'due'").select(*keys).join(gates.distinct(), "project_id").join(model, "project_id")
    opened = due.select(
        *keys, "model_id", "approval_gate", row_id(F.lit("revalidation"), *keys, "approval_gate", F.lit(str(as_of))).alias("approval_id"), F.lit("pending").alias("status"),
        F.lit(1).alias("required_count"), F.lit(requested_by).alias("requested_by"), instant(as_of).alias("requested_timestamp"),
    )
    # as many ids as the project has gates
    ids = opened.groupBy(*keys).agg(F.sort_array(F.collect_set("approval_id")).alias("_ids"))
    moved = flags.join(ids, keys, "left")
    started = F.col("_ids").isNotNull()
    out = moved.withColumn("status", F.when(started, "in_revalidation").otherwise(F.col("status"))).withColumn("revalidation_approval_ids", F.coalesce("_ids", "revalidation_approval_ids"))
    return opened, out.select(*flags.columns)


def clear_completed(flags: DataFrame, complete: DataFrame, as_of) -> DataFrame:
    """Flags after the completion check: those whose gates are all approved are cleared now."""
    keys = ["project_id", "uc_full_name"]
    done = complete.where("is_complete").select(*keys).withColumn("_done", F.lit(True))
    hit = F.coalesce("_done", F.lit(False)) & (F.col("status") == "in_revalidation")
    out = flags.join(done, keys, "left").withColumn("cleared_timestamp", F.when(hit, instant(as_of)).otherwise(F.col("cleared_timestamp"))).withColumn("status", F.when(hit, "cleared").otherwise(F.col("status")))
    return out.select(*flags.columns)


def dataset_classification(columns: DataFrame, key: str, level: str = "classification") -> DataFrame:
    """Classification of each data set: the most restrictive among its columns; unknown levels do not count."""
    return columns.groupBy(key).agg(strictest(F.col(level), CLASSIFICATIONS).alias("classification"))


def revalidate(champions: DataFrame, tiers: DataFrame, flags: DataFrame, as_of) -> DataFrame:
    """Next revalidation flag of every champion, with the transition taken.

    The clock runs from the later of promotion and last clearing. When neither is known every window counts as lapsed.
    Open flags stay; a lapsed window opens one with the strictest action and the shortest lapsed frequency; a due flag
    whose window no longer lapses is cleared. ``champions``: project_id, uc_full_name, champion_version,
    promoted_timestamp.
    """
    keys = ["project_id", "uc_full_name"]
    windows = tiers.where(F.col("revalidation_frequency_days").isNotNull()).select("project_id", "revalidation_frequency_days", F.coalesce("on_revalidation_due", F.lit("warn")).alias("_action"))
    held = flags.select(*keys, F.col("status").alias("_status"), F.col("cleared_timestamp").alias("_cleared"))
    clock = F.greatest("promoted_timestamp", "_cleared")
    age = F.timestamp_diff("DAY", clock, instant(as_of))
    lapsed = clock.isNull() | (age >= F.col("revalidation_frequency_days"))
    folded = (
        champions.join(held, keys, "left")
        .join(windows, "project_id")
        .groupBy(*keys, "champion_version", "promoted_timestamp", "_status")
        .agg(
            F.min(F.when(lapsed, F.col("revalidation_frequency_days"))).alias("frequency_days"),
            F.max(F.when(lapsed, level_rank(F.col("_action"), ON_DUE_ACTIONS))).alias("_rank"),
        )
    )
    any_lapsed, open_now = F.col("frequency_days").isNotNull(), F.coalesce(F.col("_status").isin("due", "in_revalidation"), F.lit(False))
    step = F.when(any_lapsed & open_now, "unchanged").when(any_lapsed, "flagged").when(F.col("_status") == "due", "cleared").otherwise("unchanged")
    return folded.withColumn("transition", step).select(
        *keys, "champion_version", "promoted_timestamp", "frequency_days",
        F.when(any_lapsed, F.coalesce(ladder_level(F.col("_rank"), ON_DUE_ACTIONS), F.lit("warn"))).alias("on_due_action"),
        F.when(F.col("transition") == "flagged", "due").when(F.col("transition") == "cleared", "cleared").otherwise(F.col("_status")).alias("status"),
        "transition",
    )


def apply_revalidation(flags: DataFrame, passed: DataFrame, as_of) -> DataFrame:
    """The flag table after a pass: opened flags start afresh, cleared ones get their time."""
    keys = ["project_id", "uc_full_name"]
    moved = passed.where(F.col("transition") != "unchanged").select(*keys, *[F.col(c).alias(f"_n_{c}") for c in ("champion_version", "promoted_timestamp", "frequency_days", "on_due_action", "transition")])
    both = flags.join(moved, keys, "full_outer")
    opened, cleared = F.col("_n_transition") == "flagged", F.col("_n_transition") == "cleared"
    now = instant(as_of)

    def kept(name):
        return F.when(opened, F.col(f"_n_{name}")).otherwise(F.col(name)).alias(name)

    return both.select(
        *keys, kept("champion_version"), kept("promoted_timestamp"), kept("frequency_days"), kept("on_due_action"),
        F.when(opened, "due").when(cleared, "cleared").otherwise(F.col("status")).alias("status"),
        F.when(opened, F.array().cast("array<string>")).otherwise(F.col("revalidation_approval_ids")).alias("revalidation_approval_ids"),
        F.when(opened, now).otherwise(F.col("due_since")).alias("due_since"),
        F.when(opened, F.lit(None)).when(cleared, now).otherwise(F.col("cleared_timestamp")).alias("cleared_timestamp"),
    )


def revalidation_complete(flags: DataFrame, approvals: DataFrame) -> DataFrame:
    """Whether every re-run gate of a flag under review is approved; missing, pending or no gates is not complete."""
    keys = ["project_id", "uc_full_name"]
    wanted = flags.where("status = 'in_revalidation'").select(*keys, F.explode_outer("revalidation_approval_ids").alias("approval_id"))
    found = approvals.groupBy("approval_id").agg(F.max(F.col("status") == "approved").alias("_ok"))
    done = F.every(F.coalesce("_ok", F.lit(False)))
    return wanted.join(found, "approval_id", "left").groupBy(*keys).agg(done.alias("is_complete"), F.count("approval_id").alias("gates"))


def alert_listing(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alert events with their definition."""
    return events.join(alerts, "alert_id")


def alert_summary(events: DataFrame) -> DataFrame:
    """Alerts per day: total, critical and unresolved."""
    return events.groupBy(F.to_date("triggered_timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("alerts"), count_where(F.col("alert_severity") == "critical").alias("critical"), count_where(~F.col("resolved")).alias("unresolved")
    )


def monitoring_coverage(versions: DataFrame, monitored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of model versions in production that have a monitor."""
    have = monitored.select("model_id").distinct().withColumn("_m", F.lit(True))
    return versions.join(have, "model_id", "left").groupBy(*by).agg(F.count(F.lit(1)).alias("versions"), (share(F.col("_m")) * 100).alias("coverage_pct"))


def audit_trail(log: DataFrame, *, actor: str | None = None, resource_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Audit events of one actor or resource, newest first."""
    rows = log
    if actor is not None:
        rows = rows.where(F.col("actor_email") == actor)
    if resource_id is not None:
        rows = rows.where(F.col("resource_id") == resource_id)
    rows = rows.orderBy(F.desc("event_timestamp"), "event_id")
    return rows.limit(limit) if limit else rows


def interview_speed(telemetry: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Per version: median step time with the shares of defaults taken and sessions abandoned."""
    rates = telemetry.groupBy("version").agg(share(F.col("used_default")).alias("default_rate"), share(F.col("abandoned")).alias("abandon_rate"))
    return rates.join(quantiles, "version")


def default_suggestions(choices: DataFrame, group: str, field: str, value: str, minimum_share: float = 0.9) -> DataFrame:
    """The commonest choice of a group per field, where it makes up the minimum share."""
    counts = choices.groupBy(group, field, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(group, field).agg(F.sum("_n").alias("_total"), F.max(F.struct(F.col("_n"), F.col(value))).alias("_top"))
    part = F.col("_top._n") / F.col("_total")
    return totals.where(part >= minimum_share).select(group, field, F.col(f"_top.{value}").alias(value), part.alias("choice_share"))


def duty_conflicts(deployments: DataFrame, votes: DataFrame, approvals: DataFrame, minimum_approvers: int = 2) -> DataFrame:
    """Deployments whose author approved them, or which were overridden without enough approvers."""
    yes = votes.where("decision = 'approve'").join(approvals.select("approval_id", "plan_hash"), "approval_id")
    pairs = yes.select("plan_hash", "voter").distinct()
    approvers = pairs.groupBy("plan_hash").agg(F.count(F.lit(1)).alias("approvers"))
    live = deployments.where("status = 'deployed'").select("plan_hash", "author").distinct()
    own = live.join(pairs, (live.plan_hash == pairs.plan_hash) & (live.author == pairs.voter), "left_semi").withColumn("_own", F.lit(True))
    return (
        live.join(own, ["plan_hash", "author"], "left")
        .join(approvers, "plan_hash", "left")
        .select(
            "plan_hash", "author", F.coalesce("_own", F.lit(False)).alias("approved_by_author"),
            (F.coalesce("approvers", F.lit(0)) < minimum_approvers).alias("too_few_approvers"),
        )
        .where("approved_by_author OR too_few_approvers")
    )


def sync_packs(current: DataFrame, packs: DataFrame) -> DataFrame:
    """Upsert the requirement rows, one per pack and tier."""
    keys = ["policy_pack_id", "risk_tier"]
    return merge_upsert(current, packs, keys, [c for c in current.columns if c not in keys], [F.asc("source_file")] if "source_file" in packs.columns else [F.asc("risk_tier")])


def risk_buckets(models: DataFrame) -> DataFrame:
    """Models by the worst thing known about them: fairness breach is high, lost performance medium, else low."""
    bucket = F.when(F.col("fairness_breach"), "high").when(F.col("performance_degraded"), "medium").otherwise("low")
    return models.groupBy(bucket.alias("risk")).agg(F.count(F.lit(1)).alias("models"), count_where(F.col("retrain_due")).alias("due_for_retraining"))


def most_expensive(costs: DataFrame, key: str, n: int = 10) -> DataFrame:
    return costs.groupBy(key).agg(F.sum("total_cost_usd").alias("total_usd")).orderBy(F.desc("total_usd"), key).limit(n)


def latest_config(configs: DataFrame) -> DataFrame:
    return top_per_key(configs, ["project_id"], [F.desc("config_version")])


def json_number(text: Column, path: str) -> Column:
    return F.get_json_object(text, path).try_cast("double")
