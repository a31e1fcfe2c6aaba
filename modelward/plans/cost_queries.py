"""Cost attribution and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelward.operators import cost
from modelward.operators.state import upsert_touched
from modelward.plans.registry import Registry
from modelward.session import fresh_folder
from modelward.sources.tables import overwrite_partitions
from modelward.sources.workload import AS_OF, check_with

R = Registry()

PRICED = """priced AS (SELECT u.*, lp.list_price FROM usage u JOIN list_prices lp ON lp.sku_name = u.sku_name AND u.usage_start_time >= lp.price_start
    AND (lp.price_end IS NULL OR u.usage_start_time < lp.price_end)),
costs AS (SELECT project_tag AS project_id, usage_date AS date, sum(usage_quantity * list_price) AS total FROM priced WHERE project_tag IS NOT NULL GROUP BY 1, 2)"""


def cost_sql(body: str, views: str = "usage list_prices", extra: str = "") -> str:
    return check_with(views, PRICED + (", " + extra if extra else ""), body)


def all_costs(w):
    return cost.project_costs(w.tagged_usage(), w.nested_prices(), AS_OF, None)


def usd(name: str, places: int = 4):
    return F.round(name, places).alias(name)


@R.add("project_daily_costs", cost_sql("SELECT project_id, strftime(date, '%Y-%m-%d') AS date, round(total, 4) AS total_cost_usd FROM costs WHERE date >= DATE '2001-08-01' - INTERVAL 1000 DAY"))
def project_daily_costs(w):
    out = cost.project_costs(w.tagged_usage(), w.nested_prices(), AS_OF, 1000)
    return out.select("project_id", F.col("date").cast("string").alias("date"), usd("total_cost_usd"))


@R.add("control_plane_daily_costs", cost_sql("SELECT strftime(usage_date, '%Y-%m-%d') AS date, round(sum(usage_quantity * list_price), 4) AS total_cost_usd FROM priced WHERE component_tag = 'control_plane' AND usage_date >= DATE '2001-08-01' - INTERVAL 365 DAY GROUP BY 1"))
def control_plane_daily_costs(w):
    return cost.control_plane_costs(w.tagged_usage(), w.nested_prices(), AS_OF, 365).select(F.col("date").cast("string").alias("date"), usd("total_cost_usd"))


@R.add("control_plane_budget", cost_sql("""SELECT round(t, 4) AS total_usd, CASE WHEN t >= 3000000 THEN 'critical' WHEN t >= 10000 THEN 'warning' ELSE 'ok' END AS status FROM (
    SELECT coalesce(sum(usage_quantity * list_price), 0) AS t FROM priced WHERE component_tag = 'control_plane' AND usage_date >= DATE '2001-08-01' - INTERVAL 30 DAY) z"""))
def control_plane_budget(w):
    return cost.plane_budget(cost.control_plane_costs(w.tagged_usage(), w.nested_prices(), AS_OF, 30), AS_OF, 10000.0, 3000000.0).select(usd("total_usd"), "status")


@R.add("cost_merge", cost_sql("""SELECT project_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN date >= DATE '2001-08-01' - INTERVAL 1000 DAY THEN total ELSE 1 END, 4) AS total_cost_usd,
    CASE WHEN date < DATE '2001-08-01' - INTERVAL 1000 DAY THEN 'kept' WHEN date < DATE '2000-06-01' THEN 'updated' ELSE 'inserted' END AS merge_action
    FROM costs WHERE date < DATE '2000-06-01' OR date >= DATE '2001-08-01' - INTERVAL 1000 DAY"""))
def cost_merge(w):
    current = all_costs(w).where("date < '2000-06-01'").withColumn("total_cost_usd", F.lit(1.0)).withColumn("compute_cost_usd", F.lit(1.0))
    fresh = cost.project_costs(w.tagged_usage(), w.nested_prices(), AS_OF, 1000)
    out = cost.refresh_costs(current, fresh, action="merge_action")
    return out.select("project_id", F.col("date").cast("string").alias("date"), usd("total_cost_usd"), "merge_action")


@R.add("cost_merge_touched_months", cost_sql("""SELECT project_id, strftime(date, '%Y-%m-%d') AS date, round(CASE WHEN date >= DATE '2001-08-01' - INTERVAL 400 DAY THEN total ELSE 1 END, 4) AS total_cost_usd
    FROM costs WHERE date < DATE '2001-01-01' OR date >= DATE '2001-08-01' - INTERVAL 400 DAY"""))
def cost_merge_touched_months(w):
    path = fresh_folder(w.spark, "cost_tracking")
    old = all_costs(w).where("date < '2001-01-01'").select("project_id", "date", F.lit(1.0).alias("total_cost_usd"), F.date_format("date", "yyyy-MM").alias("month"))
    overwrite_partitions(old, path, ["month"])
    fresh = cost.project_costs(w.tagged_usage(), w.nested_prices(), AS_OF, 400).select("project_id", "date", "total_cost_usd", F.date_format("date", "yyyy-MM").alias("month"))
    held = w.spark.read.schema(old.schema).parquet(path)
    overwrite_partitions(upsert_touched(held, fresh, ["project_id", "date"], ["total_cost_usd"], [F.desc("total_cost_usd")], "month"), path, ["month"])
    return w.spark.read.schema(old.schema).parquet(path).select("project_id", F.col("date").cast("string").alias("date"), usd("total_cost_usd"))


@R.add("cost_by_project", cost_sql("SELECT project_id, round(sum(total), 4) AS total_usd FROM costs WHERE date >= DATE '2001-08-01' - INTERVAL 365 DAY GROUP BY project_id"))
def cost_by_project(w):
    return cost.rollup_by_project(all_costs(w), AS_OF, 365).select("project_id", usd("total_usd"))


@R.add("cost_by_team", cost_sql("SELECT team_name, round(sum(total), 4) AS total_usd FROM costs c JOIN projects p ON p.project_id = c.project_id WHERE date >= DATE '2001-08-01' - INTERVAL 365 DAY GROUP BY team_name", "usage list_prices projects"))
def cost_by_team(w):
    return cost.rollup_by_team(all_costs(w), w.projects, AS_OF, 365).select("team_name", usd("total_usd"))


@R.add("cost_by_deployment_type", cost_sql(
    """SELECT coalesce(inference_type, 'unknown') AS deployment_type, round(sum(total), 4) AS total_usd FROM costs c LEFT JOIN l ON l.project_id = c.project_id
    WHERE date >= DATE '2001-08-01' - INTERVAL 365 DAY GROUP BY 1""", "usage list_prices project_configs",
    "l AS (SELECT project_id, inference_type FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY config_version DESC) AS rn FROM project_configs) z WHERE rn = 1)"))
def cost_by_deployment_type(w):
    return cost.rollup_by_deployment_type(all_costs(w), w.project_configs, AS_OF, 365).select("deployment_type", usd("total_usd"))


BUDGETS = """SELECT concat('b', CAST(s_suppkey AS STRING)) AS budget_id, concat('p', CAST(s_suppkey AS STRING)) AS project_id,
    CASE WHEN s_nationkey < 8 THEN 'monthly' WHEN s_nationkey < 16 THEN 'quarterly' WHEN s_nationkey < 24 THEN 'annual' ELSE 'weekly' END AS budget_period,
    CASE WHEN s_acctbal < 0 THEN 0 ELSE s_acctbal * 60 END AS budget_threshold_usd, CAST(80 AS DOUBLE) AS alert_at_pct, s_acctbal < 9500 AS enabled,
    CASE WHEN s_nationkey < 4 THEN '24354' WHEN s_nationkey < 10 THEN '8118' END AS last_alerted_period FROM supplier"""


def budgets(w):
    return w.spark.sql(BUDGETS.replace("FROM supplier", "FROM {supplier}"), supplier=w.supplier)


BUDGET_SQL = f"""b AS ({BUDGETS}), bd AS (SELECT *, CASE budget_period WHEN 'quarterly' THEN 90 WHEN 'annual' THEN 365 ELSE 30 END AS days FROM b WHERE enabled),
s AS (SELECT bd.budget_id, coalesce(sum(c.total), 0) AS spend FROM bd LEFT JOIN costs c ON c.project_id = bd.project_id AND c.date >= CAST(DATE '2001-08-01' - to_days(bd.days) AS DATE) GROUP BY bd.budget_id),
k AS (SELECT bd.*, s.spend, CAST((date_diff('day', DATE '1970-01-01', DATE '2001-08-01') + 719163) // days AS VARCHAR) AS bucket FROM bd JOIN s ON s.budget_id = bd.budget_id),
o AS (SELECT *, CASE WHEN budget_threshold_usd <= 0 THEN 'skipped' WHEN spend < budget_threshold_usd * 0.8 THEN 'under' WHEN coalesce(last_alerted_period, '') = bucket THEN 'repeated' ELSE 'alert' END AS outcome FROM k)"""


@R.add("budget_checks", cost_sql("SELECT budget_id, project_id, budget_period, round(spend, 4) AS spend_usd, bucket AS period_bucket, outcome FROM o", extra=BUDGET_SQL))
def budget_checks(w):
    return cost.budget_checks(budgets(w), all_costs(w), AS_OF).select("budget_id", "project_id", "budget_period", usd("spend_usd"), "period_bucket", "outcome")


@R.add("budgets_after_pass", cost_sql("""SELECT b.budget_id, CASE WHEN o.outcome = 'alert' THEN o.bucket ELSE b.last_alerted_period END AS last_alerted_period FROM b LEFT JOIN o ON o.budget_id = b.budget_id""", extra=BUDGET_SQL))
def budgets_after_pass(w):
    b = budgets(w)
    return cost.mark_alerted(b, cost.budget_checks(b, all_costs(w), AS_OF)).select("budget_id", "last_alerted_period")


@R.add("cost_rollup", cost_sql("""SELECT team_name, c.project_id, CAST(grouping(team_name, c.project_id) AS INT) AS level, round(sum(total), 3) AS total_usd,
    CASE WHEN sum(total) >= 90000000 THEN 'critical' WHEN sum(total) >= 9000000 THEN 'warning' ELSE 'ok' END AS status
    FROM costs c JOIN projects p ON p.project_id = c.project_id GROUP BY ROLLUP (team_name, c.project_id)""", "usage list_prices projects"))
def cost_rollup(w):
    # summed per project before the merge: a project meets its team once, not once a day
    per_project = all_costs(w).groupBy("project_id").agg(F.sum("total_cost_usd").alias("total_cost_usd"))
    costs = per_project.join(w.projects.select("project_id", "team_name").hint("merge"), "project_id")
    return cost.cost_rollup(costs, ["team_name", "project_id"], 9e6, 9e7).select("team_name", "project_id", "level", usd("total_usd", 3), "status")


@R.add("rising_costs", cost_sql("""SELECT project_id, count(*) AS months, round(regr_slope(t, m), 4) AS usd_per_month, regr_slope(t, m) > 0 AS is_rising FROM (
    SELECT project_id, year(date) * 12 + month(date) AS m, sum(total) AS t FROM costs GROUP BY 1, 2) z GROUP BY project_id"""))
def rising_costs(w):
    return cost.rising_costs(all_costs(w)).select("project_id", "months", usd("usd_per_month"), "is_rising")


@R.add("overlapping_prices", """WITH lp AS (SELECT p_partkey AS sku_name, make_date(1990 + y, 1, 1) AS s, make_date(1990 + y + CASE WHEN p_size > 40 THEN 2 ELSE 1 END, 1, 1) AS e FROM (SELECT *, unnest(generate_series(1, 5)) AS y FROM part) z)
SELECT sku_name, strftime(s, '%Y-%m-%d') AS price_start FROM (SELECT *, max(e) OVER (PARTITION BY sku_name ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM lp) q WHERE s < r""")
def overlapping_prices(w):
    years = w.part.select(F.col("p_partkey").alias("sku_name"), "p_size", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("y"))
    step = F.when(F.col("p_size") > 40, 2).otherwise(1)
    day = lambda y: F.make_date(y, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    prices = years.select("sku_name", day(F.col("y") + 1990).alias("price_start_time"), day(F.col("y") + 1990 + step).alias("price_end_time"))
    return cost.overlapping_prices(prices).select("sku_name", F.date_format("price_start_time", "yyyy-MM-dd").alias("price_start"))
