"""Usage priced with the price in force, cost rollups and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.functions.columns import budget_status, in_period, instant, row_id, within_days
from modelward.functions.ordered import max_before
from modelward.functions.relational import top_per_key
from modelward.operators.state import merge_upsert

# Length of each budget period in days.
PERIOD_DAYS = {"monthly": 30, "quarterly": 90, "annual": 365}
PERIOD_DAYS_ELSE = 30


def price_in_force(usage: DataFrame, prices: DataFrame, bucket_days: int = 365, salts: int = 1, until=None) -> DataFrame:
    """Each usage row with every price whose window [start, end) holds its start time; an open end has no limit.

    Windows are cut into time buckets so that the join key is (SKU, bucket): usage of one dominant SKU spreads over the
    buckets, and a row meets only the windows of its own bucket. ``salts`` deals each bucket's usage out once more, at
    the price of as many copies of the price list. Both sides are sorted and merged, so no node holds the whole list: Spark
    would judge it by the size of its file, which says little of the windows cut from it, and send it to all. All time
    after ``until`` (today, if not given) is one bucket: it bounds the buckets of an open window, not the rows.
    """
    size = bucket_days * 86400
    last = F.floor(F.unix_seconds((instant(until) if until is not None else F.current_date()).cast("timestamp")) / F.lit(size)).cast("long")

    def bucket(c):
        return F.least(F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(size)).cast("long"), last)

    first = bucket(F.col("price_start_time"))
    end = F.greatest(F.coalesce(bucket(F.col("price_end_time")), last), first)
    windows = prices.where(F.col("price_start_time").isNotNull()).select(
        F.col("sku_name").alias("_sku"),
        F.col("price_start_time").alias("_from"),
        F.col("price_end_time").alias("_to"),
        F.col("pricing.effective_list.default").alias("unit_price"),
        F.explode(F.sequence(first, end)).alias("_pb"),
    )
    dealt, pairing = usage, F.lit(True)
    if salts > 1:
        windows = windows.withColumn("_ps", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = usage.withColumn("_s", F.pmod(F.xxhash64("usage_start_time", "usage_quantity", "usage_date"), F.lit(salts)).cast("int"))
        pairing = F.col("_s") == F.col("_ps")
    at = F.col("usage_start_time")
    held = (F.col("sku_name") == F.col("_sku")) & (F.col("_b") == F.col("_pb")) & (at >= F.col("_from")) & (F.col("_to").isNull() | (at < F.col("_to")))
    return dealt.withColumn("_b", bucket(at)).join(windows.hint("merge"), held & pairing).drop("_b", "_pb", "_s", "_ps", "_sku", "_from", "_to")


def overlapping_prices(prices: DataFrame) -> DataFrame:
    """Price windows that begin before an earlier window of the same SKU ended: usage there would be charged twice."""
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    reach = prices.withColumn("_end", F.coalesce(F.col("price_end_time"), far))
    year = 365 * 86400
    return max_before(reach, ["sku_name"], "price_start_time", ["_end"], "_end", "_reach", year).where(F.col("price_start_time") < F.col("_reach")).drop("_reach", "_end")


def _tagged(usage: DataFrame, as_of, days_back: int | None) -> DataFrame:
    return usage.where(within_days("usage_date", as_of, days_back)) if days_back is not None else usage


def project_costs(usage: DataFrame, prices: DataFrame, as_of, days_back: int | None = 7, salts: int = 1) -> DataFrame:
    """Daily cost per project from usage that carries a project tag."""
    tag = F.col("custom_tags")["project_id"]
    rows = _tagged(usage, as_of, days_back).withColumn("project_id", tag).where(F.col("project_id").isNotNull()).drop("custom_tags")
    cost = F.sum(F.col("usage_quantity") * F.col("unit_price"))
    return (
        price_in_force(rows, prices, salts=salts, until=as_of)
        .groupBy("project_id", F.col("usage_date").alias("date"))
        .agg(cost.alias("total_cost_usd"))
        .withColumn("compute_cost_usd", F.col("total_cost_usd"))
        .withColumn("cost_id", row_id("project_id", F.col("date").cast("string")))
    )


def control_plane_costs(usage: DataFrame, prices: DataFrame, as_of, days_back: int | None = 30, salts: int = 1) -> DataFrame:
    """Daily cost of the control plane's own usage."""
    rows = _tagged(usage, as_of, days_back).where(F.col("custom_tags")["component"] == "control_plane").drop("custom_tags")
    return price_in_force(rows, prices, salts=salts, until=as_of).groupBy(F.col("usage_date").alias("date")).agg(F.sum(F.col("usage_quantity") * F.col("unit_price")).alias("total_cost_usd"))


def refresh_costs(current: DataFrame, fresh: DataFrame, keys: Sequence[str] = ("project_id", "date"), action: str | None = None) -> DataFrame:
    """Upsert recomputed daily rows, so a re-run replaces instead of adding."""
    return merge_upsert(current, fresh, keys, ["total_cost_usd", "compute_cost_usd"], [F.desc("total_cost_usd")], action)


def plane_budget(costs: DataFrame, as_of, warn: float, crit: float, days_back: int = 30) -> DataFrame:
    """Spend of the last days against the two limits; no rows is 0 and ok."""
    total = F.coalesce(F.sum("total_cost_usd"), F.lit(0.0))
    return costs.where(within_days("date", as_of, days_back)).agg(total.alias("total_usd")).withColumn("status", budget_status(F.col("total_usd"), F.lit(warn), F.lit(crit)))


def rollup_by_project(costs: DataFrame, as_of, days_back: int = 30) -> DataFrame:
    rows = costs.where(within_days("date", as_of, days_back))
    return rows.groupBy("project_id").agg(F.sum("total_cost_usd").alias("total_usd")).orderBy(F.desc("total_usd"), "project_id")


def _by_attribute(costs, attributes, column, as_of, days_back, how, unknown=None):
    # summed per project before the join: the attribute table meets one row per project; both are merged, as the size of the
    # attributes' file says little of their rows in memory
    per_project = costs.where(within_days("date", as_of, days_back)).groupBy("project_id").agg(F.sum("total_cost_usd").alias("_usd"))
    label = F.coalesce(F.col(column), F.lit(unknown)) if unknown else F.col(column)
    return (
        per_project.join(attributes.select("project_id", column).hint("merge"), "project_id", how)
        .groupBy(label.alias(column))
        .agg(F.sum("_usd").alias("total_usd"))
        .orderBy(F.desc("total_usd"), column)
    )


def rollup_by_team(costs: DataFrame, projects: DataFrame, as_of, days_back: int = 30) -> DataFrame:
    return _by_attribute(costs, projects, "team_name", as_of, days_back, "inner")


def rollup_by_deployment_type(costs: DataFrame, configs: DataFrame, as_of, days_back: int = 30) -> DataFrame:
    """Cost by the deployment type of each project's latest configuration."""
    latest = top_per_key(configs, ["project_id"], [F.desc("config_version")]).withColumnRenamed("inference_type", "deployment_type")
    return _by_attribute(costs, latest, "deployment_type", as_of, days_back, "left", "unknown")


def period_length(period: Column) -> Column:
    out = F
    for name, days in PERIOD_DAYS.items():
        out = out.when(period == name, F.lit(days))
    return out.otherwise(F.lit(PERIOD_DAYS_ELSE))


def budget_checks(budgets: DataFrame, costs: DataFrame, as_of) -> DataFrame:
    """Every enabled budget with its spend and what the pass does: skipped, under, repeated or alert.

    Spend over all period lengths is summed in one pass per project, then each budget picks its own.
    """
    lengths = sorted(set(PERIOD_DAYS.values()))
    spend = costs.where(within_days("date", as_of, max(lengths))).groupBy("project_id").agg(
        *[F.coalesce(F.sum(F.when(within_days("date", as_of, n), F.col("total_cost_usd"))), F.lit(0.0)).alias(f"_{n}") for n in lengths]
    )
    days = period_length(F.coalesce(F.col("budget_period"), F.lit("monthly")))
    chosen, bucket = F, F
    for n in lengths:
        chosen, bucket = chosen.when(days == n, F.col(f"_{n}")), bucket.when(days == n, in_period(instant(as_of), n))
    limit = F.coalesce(F.col("budget_threshold_usd"), F.lit(0.0))
    pct = F.coalesce(F.col("alert_at_pct"), F.lit(100.0))
    seen = F.coalesce(F.col("last_alerted_period"), F.lit("")) == F.col("period_bucket")
    return (
        budgets.where("enabled")
        .join(spend, "project_id", "left")
        .withColumn("spend_usd", F.coalesce(chosen, F.lit(0.0)))
        .withColumn("period_bucket", bucket.cast("string"))
        .withColumn("outcome", F.when(limit <= 0, "skipped").when(F.col("spend_usd") < limit * (pct / 100.0), "under").when(seen, "repeated").otherwise("alert"))
        .drop(*[f"_{n}" for n in lengths])
    )


def mark_alerted(budgets: DataFrame, checks: DataFrame) -> DataFrame:
    """Budgets after the pass: alerted ones remember the period."""
    hits = checks.where(F.col("outcome") == "alert").select("budget_id", F.col("period_bucket").alias("_period"))
    return budgets.join(hits, "budget_id", "left").withColumn("last_alerted_period", F.coalesce("_period", "last_alerted_period")).drop("_period").select(*budgets.columns)


def cost_rollup(costs: DataFrame, levels: Sequence[str], warn: float, crit: float) -> DataFrame:
    """Subtotals along ``levels`` down to the grand total, each with its budget status."""
    per_leaf = costs.groupBy(*levels).agg(F.sum("total_cost_usd").alias("_usd"))
    return (
        per_leaf.rollup(*levels)
        .agg(F.sum("_usd").alias("total_usd"), F.grouping_id().cast("int").alias("level"))
        .withColumn("status", budget_status(F.col("total_usd"), F.lit(warn), F.lit(crit)))
    )


def rising_costs(costs: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Monthly cost trend per key; a positive slope is an alert."""
    month = F.year("date") * 12 + F.month("date")
    monthly = costs.groupBy(*keys, month.alias("_m")).agg(F.sum("total_cost_usd").alias("_usd"))
    return (
        monthly.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("months"), F.regr_slope("_usd", F.col("_m").cast("double")).alias("usd_per_month"))
        .withColumn("is_rising", F.coalesce(F.col("usd_per_month") > 0, F.lit(False)))
    )
