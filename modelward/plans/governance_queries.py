"""Governance rollups, approvals, reviews and state transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelward.functions.columns import array_text, parse_instant, stamp
from modelward.functions.ordered import exact_quantiles
from modelward.operators import approvals as ap
from modelward.operators import governance as g
from modelward.operators import state as st
from modelward.plans.registry import Registry
from modelward.session import fresh_folder
from modelward.sources.workload import AS_OF, EVENTS_AS_OF, check_sql, check_with

R = Registry()
NOW = "TIMESTAMP '2001-08-01 00:00:00'"


def day(c):
    return stamp(c, "yyyy-MM-dd")


@R.add("delivery_speed", check_sql("approvals deployments", """SELECT count(*) AS promotions, round(avg(CAST(date_sub('hour', a.completed_timestamp, d.created_timestamp) AS DOUBLE)), 4) AS avg_approval_to_deploy_hours
    FROM approvals a JOIN deployments d ON d.plan_hash = a.plan_hash WHERE a.status = 'approved' AND d.status = 'deployed' AND d.created_timestamp >= DATE '2001-08-01' - INTERVAL 700 DAY"""))
def delivery_speed(w):
    return g.speed(w.approvals, w.deployments, AS_OF, 700).withColumn("avg_approval_to_deploy_hours", F.round("avg_approval_to_deploy_hours", 4))


@R.add("delivery_reliability", check_sql("deployments", """SELECT count(*) AS deployments, count(*) FILTER (status IN ('failed', 'verify_failed')) AS failed,
    round(100.0 * count(*) FILTER (status IN ('failed', 'verify_failed')) / CAST(count(*) AS DOUBLE), 2) AS failure_rate_pct FROM deployments WHERE created_timestamp >= DATE '2001-08-01' - INTERVAL 700 DAY"""))
def delivery_reliability(w):
    return g.reliability(w.deployments, AS_OF, 700)


@R.add("deployments_by_status", check_sql("deployments", "SELECT project_id, status, count(*) AS n FROM deployments GROUP BY project_id, status"))
def deployments_by_status(w):
    return g.status_counts(w.deployments, "project_id", "status")


@R.add("approval_summary", check_sql("approvals", "SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected FROM approvals"))
def approval_summary(w):
    return g.approval_summary(w.approvals)


@R.add("projects_by_status", check_sql("projects", "SELECT status, count(*) AS n FROM projects WHERE NOT is_archived GROUP BY status"))
def projects_by_status(w):
    return g.status_counts(g.project_listing(w.projects), "status")


@R.add("approval_listing", check_sql("approvals models projects", """SELECT a.approval_id, a.status, m.project_id, p.project_name FROM approvals a LEFT JOIN models m ON m.model_id = a.model_id
    LEFT JOIN projects p ON p.project_id = m.project_id WHERE a.status IN ('approved', 'rejected')"""))
def approval_listing(w):
    return g.approval_listing(w.approvals, w.models, w.projects, ("approved", "rejected")).select("approval_id", "status", "project_id", "project_name")


IMPACT = """r AS (SELECT project_id, max(CASE WHEN last_reviewed_date >= DATE '2001-08-01' - INTERVAL 365 DAY THEN 1 ELSE 0 END) AS ok FROM business_value_fns GROUP BY project_id),
i AS (SELECT project_id, sum(coalesce(revenue_lift_usd, 0) + coalesce(loss_avoided_usd, 0)) AS usd FROM business_impact WHERE period_end >= DATE '2001-08-01' - INTERVAL 400 DAY GROUP BY project_id)"""


@R.add("business_impact", check_with("business_impact business_value_fns", IMPACT, """SELECT CASE WHEN r.ok = 1 THEN 'high' ELSE 'low' END AS confidence, round(sum(usd), 3) AS impact_usd, count(*) AS projects
    FROM i LEFT JOIN r ON r.project_id = i.project_id GROUP BY 1"""))
def business_impact(w):
    return g.business_impact(w.business_impact, w.business_value_fns, AS_OF, 400).withColumn("impact_usd", F.round("impact_usd", 3))


@R.add("unreviewed_projects", check_with("business_impact business_value_fns", IMPACT, "SELECT i.project_id FROM i LEFT JOIN r ON r.project_id = i.project_id WHERE coalesce(r.ok, 0) = 0"))
def unreviewed_projects(w):
    return g.unreviewed_projects(w.business_impact, w.business_value_fns, AS_OF, 400)


# Requirement rows per pack and tier, as an owner would author them; synced with flags built from the data.
PACKS = """SELECT policy_pack_id, risk_tier, CASE risk_tier WHEN 'high' THEN 'legal_review,1-URGENT,2-HIGH' WHEN 'medium' THEN '1-URGENT,3-MEDIUM' ELSE '5-LOW' END AS gates,
    CASE risk_tier WHEN 'high' THEN 60 WHEN 'medium' THEN 180 ELSE 365 END + CASE WHEN policy_pack_id = 'pack-b' THEN 30 ELSE 0 END AS revalidation_frequency_days,
    CASE WHEN risk_tier = 'high' AND policy_pack_id = 'pack-b' THEN 'block_all_traffic' WHEN risk_tier = 'high' THEN 'block_new_traffic' ELSE 'warn' END AS on_revalidation_due
    FROM (SELECT DISTINCT CASE WHEN s_nationkey < 15 THEN 'pack-a' ELSE 'pack-b' END AS policy_pack_id, CASE WHEN s_acctbal < 2000 THEN 'high' WHEN s_acctbal < 6000 THEN 'medium' ELSE 'low' END AS risk_tier FROM supplier) z"""


def packs(w):
    rows = w.spark.sql(PACKS.replace("FROM supplier", "FROM {supplier}"), supplier=w.supplier)
    return rows.withColumn("required_approval_gates", F.split("gates", ",")).drop("gates")


def packed_projects(w):
    team = F.regexp_extract("team_name", "([0-9]+)", 1).cast("int")
    return w.projects.withColumn("regulatory_frameworks", F.when(team < 12, F.array(F.lit("pack-a"))).when(team < 20, F.array(F.lit("pack-a"), F.lit("pack-b"))).otherwise(F.array(F.lit("pack-b"), F.lit("unknown"))))


TIERS = f"""packs AS ({PACKS}), team AS (SELECT *, CAST(regexp_extract(team_name, '([0-9]+)', 1) AS INT) AS t FROM projects),
pp AS (SELECT project_id, risk_tier, unnest(CASE WHEN t < 12 THEN ['pack-a'] WHEN t < 20 THEN ['pack-a', 'pack-b'] ELSE ['pack-b', 'unknown'] END) AS policy_pack_id FROM team),
tiers AS (SELECT pp.project_id, packs.* FROM pp JOIN packs ON packs.policy_pack_id = pp.policy_pack_id AND packs.risk_tier = pp.risk_tier),
req AS (SELECT DISTINCT project_id, unnest(string_split(gates, ',')) AS approval_gate FROM tiers)"""


def tiers(w):
    return g.project_tiers(packed_projects(w), packs(w))


@R.add("required_gates", check_with("projects", TIERS, "SELECT project_id, approval_gate FROM req"))
def required_gates(w):
    return g.required_gates(tiers(w))


@R.add("unsatisfied_gates", check_with("projects approvals models", TIERS, """SELECT project_id, approval_gate FROM req WHERE NOT EXISTS (SELECT 1 FROM approvals a JOIN models m ON m.model_id = a.model_id
    WHERE a.status = 'approved' AND m.project_id = req.project_id AND a.approval_gate = req.approval_gate)"""))
def unsatisfied_gates(w):
    return g.unsatisfied_gates(g.required_gates(tiers(w)), w.approvals, w.models)


CHAMPIONS = """ch AS (SELECT 'p' || substr(model_id, 2) AS project_id, uc_full_name, uc_version AS champion_version, CASE WHEN uc_version <> 3 THEN promoted_timestamp - to_days(uc_version * 30) END AS promoted
    FROM (SELECT *, row_number() OVER (PARTITION BY uc_full_name ORDER BY promoted_timestamp DESC, uc_version DESC) AS rn FROM model_versions) z WHERE rn = 1)"""


def champions(w):
    top = st.latest_per_key(w.model_versions, ["uc_full_name"], "promoted_timestamp", "uc_version")
    at = F.timestamp_add("DAY", -F.col("uc_version") * 30, F.col("promoted_timestamp"))
    return top.select(
        F.concat(F.lit("p"), F.expr("substr(model_id, 2)")).alias("project_id"), "uc_full_name", F.col("uc_version").alias("champion_version"),
        F.when(F.col("uc_version") != 3, at).alias("promoted_timestamp"),
    )


FLAGS = """SELECT concat('p', CAST(s_suppkey AS STRING)) AS project_id, concat('prod.models.m', CAST(s_suppkey AS STRING)) AS uc_full_name,
    CASE WHEN s_nationkey < 8 THEN 'due' WHEN s_nationkey < 12 THEN 'in_revalidation' ELSE 'cleared' END AS status,
    CASE WHEN s_nationkey < 16 THEN 'warn' WHEN s_nationkey < 20 THEN 'block_new_traffic' ELSE 'block_all_traffic' END AS on_due_action,
    CASE WHEN s_nationkey >= 12 AND s_acctbal > 5000 THEN TIMESTAMP '2001-07-01 00:00:00' END AS cleared_timestamp FROM supplier WHERE s_acctbal > 1000"""


def flags(w):
    return w.spark.sql(FLAGS.replace("FROM supplier", "FROM {supplier}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), supplier=w.supplier)


REVALIDATION = f"""{TIERS}, {CHAMPIONS}, fl AS ({FLAGS}),
j AS (SELECT ch.*, fl.status AS old_status, greatest(ch.promoted, fl.cleared_timestamp) AS clock, tiers.revalidation_frequency_days AS freq, tiers.on_revalidation_due AS act FROM ch
      LEFT JOIN fl ON fl.project_id = ch.project_id AND fl.uc_full_name = ch.uc_full_name JOIN tiers ON tiers.project_id = ch.project_id),
l AS (SELECT *, clock IS NULL OR date_sub('day', clock, {NOW}) >= freq AS lapsed FROM j),
f AS (SELECT project_id, uc_full_name, champion_version, old_status, min(freq) FILTER (lapsed) AS frequency_days,
             max(CASE act WHEN 'warn' THEN 0 WHEN 'block_new_traffic' THEN 1 ELSE 2 END) FILTER (lapsed) AS rk FROM l GROUP BY ALL),
step AS (SELECT *, CASE rk WHEN 0 THEN 'warn' WHEN 1 THEN 'block_new_traffic' WHEN 2 THEN 'block_all_traffic' END AS act,
    CASE WHEN frequency_days IS NOT NULL AND coalesce(old_status, '') IN ('due', 'in_revalidation') THEN 'unchanged' WHEN frequency_days IS NOT NULL THEN 'flagged'
         WHEN old_status = 'due' THEN 'cleared' ELSE 'unchanged' END AS transition FROM f)""".replace("GROUP BY ALL", "GROUP BY project_id, uc_full_name, champion_version, old_status")


@R.add("revalidation_pass", check_with("projects model_versions", REVALIDATION, """SELECT project_id, uc_full_name, champion_version, CAST(frequency_days AS VARCHAR) AS frequency_days, act AS on_due_action,
    CASE transition WHEN 'flagged' THEN 'due' WHEN 'cleared' THEN 'cleared' ELSE old_status END AS status, transition FROM step"""))
def revalidation_pass(w):
    return g.revalidate(champions(w), tiers(w), flags(w), AS_OF).drop("promoted_timestamp").withColumn("frequency_days", F.col("frequency_days").cast("string"))


@R.add("revalidation_flags_after_pass", check_with("projects model_versions", REVALIDATION, """SELECT coalesce(fl.project_id, s.project_id) AS project_id, CASE WHEN s.transition = 'flagged' THEN 'due' WHEN s.transition = 'cleared' THEN 'cleared' ELSE fl.status END AS status,
    CASE WHEN s.transition = 'flagged' THEN s.act ELSE fl.on_due_action END AS on_due_action,
    strftime(CASE WHEN s.transition = 'flagged' THEN NULL WHEN s.transition = 'cleared' THEN TIMESTAMP '2001-08-01 00:00:00' ELSE fl.cleared_timestamp END, '%Y-%m-%d') AS cleared
    FROM fl FULL OUTER JOIN (SELECT * FROM step WHERE transition <> 'unchanged') s ON s.project_id = fl.project_id AND s.uc_full_name = fl.uc_full_name"""))
def revalidation_flags_after_pass(w):
    now = flags(w).select(
        "*", F.lit(None).cast("int").alias("champion_version"), F.lit(None).cast("timestamp_ntz").alias("promoted_timestamp"), F.lit(None).cast("int").alias("frequency_days"),
        F.array().cast("array<string>").alias("revalidation_approval_ids"), F.lit(None).cast("timestamp_ntz").alias("due_since"),
    )
    out = g.apply_revalidation(now, g.revalidate(champions(w), tiers(w), flags(w), AS_OF), AS_OF)
    return out.select("project_id", "status", "on_due_action", day("cleared_timestamp").alias("cleared"))


@R.add("revalidation_debt", f"""WITH fl AS ({FLAGS}) SELECT count(*) FILTER (status = 'due') AS revalidation_due, count(*) FILTER (status = 'in_revalidation') AS in_revalidation,
    count(*) FILTER (on_due_action IN ('block_new_traffic', 'block_all_traffic')) AS promotion_blocked, count(*) AS governance_coverage_penalty FROM fl WHERE status IN ('due', 'in_revalidation')""")
def revalidation_debt(w):
    return g.revalidation_debt(flags(w))


@R.add("revalidation_block", f"WITH fl AS ({FLAGS}) SELECT project_id, on_due_action AS block_action FROM fl WHERE status IN ('due', 'in_revalidation')")
def revalidation_block(w):
    return g.revalidation_block(flags(w))


@R.add("revalidation_complete", check_sql("approvals", """SELECT project_id, bool_and(coalesce(a.status = 'approved', false)) AS is_complete, count(a_id) AS gates FROM (
    SELECT concat('p', c_custkey) AS project_id, 'a' || o_orderkey AS a_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT') z
    LEFT JOIN approvals a ON a.approval_id = z.a_id GROUP BY project_id""").replace("bool_and(", "bool_and("))
def revalidation_complete(w):
    urgent = w.orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.collect_list(F.concat(F.lit("a"), F.col("o_orderkey"))).alias("revalidation_approval_ids"))
    reviewing = w.customer.join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.concat(F.lit("p"), F.col("c_custkey")).alias("project_id"), F.lit("m").alias("uc_full_name"), F.lit("in_revalidation").alias("status"), "revalidation_approval_ids"
    )
    return g.revalidation_complete(reviewing, w.approvals).drop("uc_full_name")


@R.add("revalidation_candidates", check_sql("projects models model_versions", "SELECT DISTINCT p.project_id, v.uc_full_name FROM projects p JOIN models m ON m.project_id = p.project_id JOIN model_versions v ON v.model_id = m.model_id WHERE p.risk_tier IS NOT NULL AND v.uc_full_name IS NOT NULL"))
def revalidation_candidates(w):
    return g.revalidation_candidates(w.projects, w.models, w.model_versions)


OPENED = f"{TIERS}, fl AS ({FLAGS}), op AS (SELECT fl.project_id, fl.uc_full_name, m.model_id, req.approval_gate, sha256(concat('revalidation:', fl.project_id, ':', fl.uc_full_name, ':', approval_gate, ':2001-08-01 00:00:00')) AS approval_id FROM fl JOIN req ON req.project_id = fl.project_id JOIN models m ON m.project_id = fl.project_id WHERE fl.status = 'due')"


def _started(w):
    held = flags(w).withColumn("revalidation_approval_ids", F.array().cast("array<string>"))
    return g.start_revalidation(held, g.required_gates(tiers(w)), w.models, "ops", AS_OF)


@R.add("revalidation_requests", check_with("projects models", OPENED, "SELECT project_id, model_id, approval_gate, approval_id FROM op"))
def revalidation_requests(w):
    return _started(w)[0].select("project_id", "model_id", "approval_gate", "approval_id")


@R.add("revalidation_flags_started", check_with("projects models", OPENED, "SELECT fl.project_id, CASE WHEN count(op.approval_id) > 0 THEN 'in_revalidation' ELSE fl.status END AS status, count(op.approval_id) AS requests FROM fl LEFT JOIN op ON op.project_id = fl.project_id GROUP BY fl.project_id, fl.status"))
def revalidation_flags_started(w):
    return _started(w)[1].select("project_id", "status", F.size("revalidation_approval_ids").alias("requests"))


@R.add("dataset_classification", """SELECT l_suppkey AS dataset, CASE max(CASE l_returnflag WHEN 'R' THEN CASE WHEN l_tax > 0.07 AND l_quantity > 48 THEN 3 ELSE 2 END WHEN 'N' THEN 1 END) WHEN 3 THEN 'restricted' WHEN 2 THEN 'sensitive' WHEN 1 THEN 'internal' END AS classification FROM lineitem GROUP BY 1""")
def dataset_classification(w):
    level = F.when(F.col("l_returnflag") == "R", F.when((F.col("l_tax") > 0.07) & (F.col("l_quantity") > 48), "restricted").otherwise("sensitive")).when(F.col("l_returnflag") == "N", "internal").otherwise("unheard of")
    return g.dataset_classification(w.lineitem.select(F.col("l_suppkey").alias("dataset"), level.alias("classification")), "dataset")


ALERTS = """ev AS (SELECT concat('al', CAST(user_id AS STRING)) AS alert_id, ts AS triggered_timestamp, CASE WHEN value > 150 THEN 'critical' ELSE 'warning' END AS alert_severity,
    value < 80 AS resolved, event_id FROM events WHERE event_type = 'error')"""


def alerts(w):
    return w.events.where("event_type = 'error'").select(
        F.concat(F.lit("al"), F.col("user_id")).alias("alert_id"), F.col("ts").alias("triggered_timestamp"),
        F.when(F.col("value") > 150, "critical").otherwise("warning").alias("alert_severity"), (F.col("value") < 80).alias("resolved"), "event_id",
    )


@R.add("alert_summary", f"WITH {ALERTS} SELECT strftime(triggered_timestamp, '%Y-%m-%d') AS day, count(*) AS alerts, count(*) FILTER (alert_severity = 'critical') AS critical, count(*) FILTER (NOT resolved) AS unresolved FROM ev GROUP BY 1")
def alert_summary(w):
    return g.alert_summary(alerts(w)).withColumn("day", F.col("day").cast("string"))


@R.add("alert_listing", f"WITH {ALERTS} SELECT ev.event_id, ev.alert_id, c_name AS alert_name FROM ev JOIN customer ON concat('al', c_custkey) = ev.alert_id")
def alert_listing(w):
    definitions = w.customer.select(F.concat(F.lit("al"), F.col("c_custkey")).alias("alert_id"), F.col("c_name").alias("alert_name"))
    return g.alert_listing(alerts(w), definitions).select("event_id", "alert_id", "alert_name")


@R.add("monitoring_coverage", check_sql("model_versions", """SELECT uc_version, count(*) AS versions, round(avg(CASE WHEN m.id IS NOT NULL THEN 1.0 ELSE 0.0 END) * 100, 6) AS coverage_pct FROM model_versions v
    LEFT JOIN (SELECT DISTINCT concat('m', s_suppkey) AS id FROM supplier WHERE s_acctbal > 4000) m ON m.id = v.model_id GROUP BY uc_version"""))
def monitoring_coverage(w):
    watched = w.supplier.where("s_acctbal > 4000").select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("model_id"))
    return g.monitoring_coverage(w.model_versions, watched, ["uc_version"]).withColumn("coverage_pct", F.round("coverage_pct", 6))


@R.add("interview_speed", """SELECT o_orderpriority AS version, round(quantile_cont(o_totalprice, 0.5), 6) AS median_seconds, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS default_rate,
    round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END), 6) AS abandon_rate FROM orders GROUP BY 1""")
def interview_speed(w):
    log = w.orders.select(F.col("o_orderpriority").alias("version"), F.col("o_totalprice").alias("seconds"), (F.col("o_orderstatus") == "F").alias("used_default"), (F.col("o_orderstatus") == "P").alias("abandoned"))
    out = g.interview_speed(log, exact_quantiles(log, ["version"], "seconds", {"median_seconds": 0.5}))
    return out.select("version", *[F.round(c, 6).alias(c) for c in ("median_seconds", "default_rate", "abandon_rate")])


@R.add("default_suggestions", """WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL l_suppkey, l_returnflag, l_linestatus),
t AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey, l_returnflag) AS total, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY n DESC, l_linestatus DESC) AS rn FROM c)
SELECT l_suppkey AS team, l_returnflag AS field, l_linestatus AS choice, round(CAST(n AS DOUBLE) / total, 6) AS choice_share FROM t WHERE rn = 1 AND CAST(n AS DOUBLE) / total >= 0.55""".replace("GROUP BY ALL ", "GROUP BY "))
def default_suggestions(w):
    chosen = w.lineitem.select(F.col("l_suppkey").alias("team"), F.col("l_returnflag").alias("field"), F.col("l_linestatus").alias("choice"))
    return g.default_suggestions(chosen, "team", "field", "choice", 0.55).withColumn("choice_share", F.round("choice_share", 6))


@R.add("duty_conflicts", check_with("deployments vote_log approvals", """p AS (SELECT DISTINCT a.plan_hash, v.voter FROM vote_log v JOIN approvals a ON a.approval_id = v.approval_id WHERE v.decision = 'approve'),
n AS (SELECT plan_hash, count(*) AS k FROM p GROUP BY plan_hash), d AS (SELECT DISTINCT plan_hash, author FROM deployments WHERE status = 'deployed'),
o AS (SELECT d.*, EXISTS (SELECT 1 FROM p WHERE p.plan_hash = d.plan_hash AND p.voter = d.author) AS approved_by_author, coalesce(n.k, 0) < 2 AS too_few_approvers FROM d LEFT JOIN n ON n.plan_hash = d.plan_hash)""",
    "SELECT * FROM o WHERE approved_by_author OR too_few_approvers"))
def duty_conflicts(w):
    return g.duty_conflicts(w.deployments, w.vote_log, w.approvals)


@R.add("most_expensive_projects", """SELECT concat('p', l_suppkey) AS project_id, round(sum(l_extendedprice), 2) AS total_usd FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 10""")
def most_expensive_projects(w):
    costs = w.lineitem.select(F.concat(F.lit("p"), F.col("l_suppkey")).alias("project_id"), F.col("l_extendedprice").alias("total_cost_usd"))
    return g.most_expensive(costs, "project_id").withColumn("total_usd", F.round("total_usd", 2))


@R.add("portfolio_risk", """WITH m AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) > 0.34 AS fb, avg(l_discount) > 0.05 AS pd, max(l_shipdate) < DATE '2001-11-01' AS rd FROM lineitem GROUP BY 1)
SELECT CASE WHEN fb THEN 'high' WHEN pd THEN 'medium' ELSE 'low' END AS risk, count(*) AS models, count(*) FILTER (rd) AS due_for_retraining FROM m GROUP BY 1""")
def portfolio_risk(w):
    models = w.lineitem.groupBy("l_suppkey").agg(
        (F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)) > 0.34).alias("fairness_breach"), (F.avg("l_discount") > 0.05).alias("performance_degraded"),
        (F.max("l_shipdate") < F.lit("2001-11-01").cast("timestamp_ntz")).alias("retrain_due"),
    )
    return g.risk_buckets(models)


# ── approval and review logs ──

FIRST = """fv AS (SELECT approval_id, voter, event_time, event_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY approval_id, voter ORDER BY event_time, event_id, decision) AS rn FROM vote_log WHERE voter IS NOT NULL) z WHERE rn = 1),
rj AS (SELECT approval_id, min((event_time, event_id)) AS stop FROM fv WHERE decision = 'reject' GROUP BY approval_id),
ka AS (SELECT r.approval_id, (r.event_time, r.event_id) AS yes FROM (SELECT *, row_number() OVER (PARTITION BY approval_id ORDER BY event_time, event_id) AS rn FROM fv WHERE decision = 'approve') r
       JOIN approvals g ON g.approval_id = r.approval_id AND g.required_count = r.rn),
cl AS (SELECT g.approval_id, g.required_count, CASE WHEN stop IS NULL THEN yes WHEN yes IS NULL THEN stop ELSE least(stop, yes) END AS closed_at,
       CASE WHEN stop IS NULL AND yes IS NULL THEN 'pending' WHEN yes IS NULL OR (stop IS NOT NULL AND stop <= yes) THEN 'rejected' ELSE 'approved' END AS status
       FROM approvals g LEFT JOIN rj ON rj.approval_id = g.approval_id LEFT JOIN ka ON ka.approval_id = g.approval_id)"""


@R.add("vote_outcomes", check_with("vote_log approvals", FIRST, """SELECT v.approval_id, v.voter, v.event_id, v.decision, v.voter IS NOT NULL AND mine AND in_time AS recorded,
    CASE WHEN v.voter IS NULL THEN 'no voter' WHEN mine AND in_time THEN '' WHEN in_time THEN 'already voted' ELSE 'gate already ' || status END AS reason
    FROM (SELECT l.*, cl.status, (l.event_time, l.event_id, l.decision) = (f.event_time, f.event_id, f.decision) AS mine, cl.closed_at IS NULL OR (f.event_time, f.event_id) <= cl.closed_at AS in_time
          FROM (SELECT DISTINCT * FROM vote_log) l JOIN cl ON cl.approval_id = l.approval_id LEFT JOIN fv f ON f.approval_id = l.approval_id AND f.voter = l.voter) v"""))
def vote_outcomes(w):
    return ap.fold_votes(w.vote_log, w.approvals).select("approval_id", "voter", "event_id", "decision", "recorded", "reason")


@R.add("gate_states", check_with("vote_log approvals", FIRST, """SELECT cl.approval_id, cl.required_count, cl.status, strftime(cl.closed_at[1], '%Y-%m-%d') AS completed,
    count(*) FILTER (f.decision = 'approve') AS approved_count, count(*) FILTER (f.decision = 'reject') AS rejected_count, count(f.voter) AS responses
    FROM cl LEFT JOIN fv f ON f.approval_id = cl.approval_id AND (cl.closed_at IS NULL OR (f.event_time, f.event_id) <= cl.closed_at) GROUP BY cl.approval_id, cl.required_count, cl.status, cl.closed_at"""))
def gate_states(w):
    out = ap.gate_state(w.vote_log, w.approvals)
    return out.select("approval_id", "required_count", "status", day("completed_timestamp").alias("completed"), "approved_count", "rejected_count", "responses")


def revocations(w):
    return w.lineitem.where("l_tax > 0.05").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s")).select(
        F.concat(F.lit("rv"), F.col("l_orderkey")).alias("revocation_id"), F.concat(F.lit("a"), F.col("l_orderkey")).alias("approval_id"), F.concat(F.lit("v"), F.col("s")).alias("requested_by")
    )


REVOKE = """rq AS (SELECT concat('rv', l_orderkey) AS revocation_id, concat('a', l_orderkey) AS approval_id, concat('v', min(l_suppkey)) AS requested_by FROM lineitem WHERE l_tax > 0.05 GROUP BY l_orderkey)"""


@R.add("revocation_requests", check_with("approvals", REVOKE, """SELECT rq.revocation_id, CASE WHEN a.status <> 'approved' THEN 'not approved' WHEN a.approval_gate = '5-LOW' THEN 'a revocation cannot be revoked' ELSE '' END AS reason,
    CASE WHEN a.status = 'approved' AND a.approval_gate <> '5-LOW' THEN 'pending' ELSE 'refused' END AS status FROM rq JOIN approvals a ON a.approval_id = rq.approval_id"""))
def revocation_requests(w):
    known = w.approvals.withColumn("approval_type", F.when(F.col("approval_gate") == "5-LOW", "revocation").otherwise("gate"))
    return ap.revocation_requests(revocations(w), known).select("revocation_id", "reason", "status")


@R.add("revocation_decisions", check_with("vote_log", REVOKE + """, de AS (SELECT concat('rv', l_orderkey) AS revocation_id, concat('v', l_partkey) AS decider, CASE l_returnflag WHEN 'N' THEN 'approve' WHEN 'R' THEN 'reject' ELSE 'request_changes' END AS decision,
        l_shipdate AS event_time, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS event_id FROM lineitem),
jd AS (SELECT de.*, CASE WHEN rq.approval_id IS NULL THEN 'unknown revocation' WHEN de.decider = rq.requested_by THEN 'requester may not decide'
        WHEN EXISTS (SELECT 1 FROM vote_log v WHERE v.approval_id = rq.approval_id AND v.voter = de.decider) THEN 'original voter may not decide' ELSE '' END AS why FROM de LEFT JOIN rq ON rq.revocation_id = de.revocation_id),
fi AS (SELECT revocation_id, min((event_time, event_id)) AS first FROM jd WHERE why = '' AND decision <> 'request_changes' GROUP BY revocation_id),
o AS (SELECT jd.revocation_id, jd.decider, jd.event_id, CASE WHEN why <> '' THEN why WHEN (event_time, event_id) > fi.first THEN 'already decided' ELSE '' END AS reason FROM jd LEFT JOIN fi ON fi.revocation_id = jd.revocation_id)""",
    "SELECT *, reason = '' AS recorded FROM o"))
def revocation_decisions(w):
    made = w.lineitem.select(
        F.concat(F.lit("rv"), F.col("l_orderkey")).alias("revocation_id"), F.concat(F.lit("v"), F.col("l_partkey")).alias("decider"),
        F.when(F.col("l_returnflag") == "N", "approve").when(F.col("l_returnflag") == "R", "reject").otherwise("request_changes").alias("decision"),
        F.col("l_shipdate").alias("event_time"), (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey")).alias("event_id"),
    )
    return ap.revocation_decisions(made, revocations(w), w.vote_log).select("revocation_id", "decider", "event_id", "reason", "recorded")


@R.add("review_outcomes", check_with("review_decisions hitl_reviews", """ok AS (SELECT DISTINCT *, decision IN ('approved', 'overridden', 'rejected') AS valid, decision <> 'overridden' OR overridden_value <> '' AS complete FROM review_decisions),
wn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY event_time, event_id, reviewer_email, decision, overridden_value) AS rn FROM ok WHERE valid AND complete) z WHERE rn = 1)""",
    """SELECT o.prediction_id, o.reviewer_email, o.event_id, o.valid AND o.complete AND h.decision IS NULL AND (o.event_time, o.event_id, o.reviewer_email, o.decision, o.overridden_value) = (w.event_time, w.event_id, w.reviewer_email, w.decision, w.overridden_value) AS accepted,
    CASE WHEN NOT o.valid THEN 'invalid decision' WHEN NOT o.complete THEN 'override needs a value' WHEN h.decision IS NOT NULL THEN 'already decided (' || h.decision || ')'
         WHEN (o.event_time, o.event_id, o.reviewer_email, o.decision, o.overridden_value) = (w.event_time, w.event_id, w.reviewer_email, w.decision, w.overridden_value) THEN '' ELSE 'already decided (' || w.decision || ') by ' || w.reviewer_email END AS reason
    FROM ok o JOIN hitl_reviews h ON h.prediction_id = o.prediction_id LEFT JOIN wn w ON w.prediction_id = o.prediction_id""").replace("SELECT o.prediction_id, o.reviewer_email, o.event_id, o.valid", "SELECT o.prediction_id, o.reviewer_email, o.event_id, coalesce(o.valid").replace("(w.event_time, w.event_id, w.reviewer_email, w.decision, w.overridden_value) AS accepted", "(w.event_time, w.event_id, w.reviewer_email, w.decision, w.overridden_value), false) AS accepted"))
def review_outcomes(w):
    return ap.fold_decisions(w.review_decisions, w.hitl_reviews).select("prediction_id", "reviewer_email", "event_id", "accepted", "reason")


@R.add("review_escalation", check_with("hitl_reviews", "s AS (SELECT concat('p', c_custkey) AS project_id, 1440 * (400 + c_nationkey * 40) AS sla FROM customer WHERE c_mktsegment <> 'BUILDING')",
    """SELECT h.prediction_id, h.decision IS NULL AND NOT escalated AND presented_timestamp < TIMESTAMP '2001-08-01 00:00:00' - to_minutes(coalesce(s.sla, 1440)) AS breached,
    escalated OR (h.decision IS NULL AND presented_timestamp < TIMESTAMP '2001-08-01 00:00:00' - to_minutes(coalesce(s.sla, 1440))) AS escalated FROM hitl_reviews h LEFT JOIN s ON s.project_id = h.project_id"""))
def review_escalation(w):
    limits = w.customer.where("c_mktsegment <> 'BUILDING'").select(F.concat(F.lit("p"), F.col("c_custkey")).alias("project_id"), (1440 * (400 + F.col("c_nationkey") * 40)).alias("sla_minutes"))
    return ap.escalate(w.hitl_reviews, AS_OF, 1440, limits).select("prediction_id", "breached", "escalated")


@R.add("review_enqueue", check_sql("hitl_reviews", """SELECT DISTINCT concat('', l_partkey) AS prediction_id, '2001-08-01' AS presented, false AS escalated FROM lineitem WHERE NOT EXISTS (
    SELECT 1 FROM hitl_reviews h WHERE h.prediction_id = concat('', l_partkey) AND h.decision IS NULL)"""))
def review_enqueue(w):
    asked = w.lineitem.select(F.col("l_partkey").cast("string").alias("prediction_id"), F.lit("p").alias("project_id"))
    out = ap.enqueue_reviews(w.hitl_reviews.where("decision IS NULL"), asked, AS_OF)
    return out.select("prediction_id", day("presented_timestamp").alias("presented"), "escalated")


# ── generic state transitions ──


@R.add("latest_config_per_project", check_sql("project_configs", "SELECT project_id, config_version, inference_type FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY config_version DESC) AS rn FROM project_configs) z WHERE rn = 1"))
def latest_config_per_project(w):
    return g.latest_config(w.project_configs).select("project_id", "config_version", "inference_type")


@R.add("newest_deployments", check_sql("deployments", "SELECT plan_hash, project_id, author, status, strftime(created_timestamp, '%Y-%m-%d') AS created FROM deployments ORDER BY created_timestamp DESC, plan_hash, project_id LIMIT 20"))
def newest_deployments(w):
    keyed = w.deployments.withColumn("_tie", F.struct("plan_hash", "project_id"))
    return st.newest(keyed, "created_timestamp", "_tie", 20).select("plan_hash", "project_id", "author", "status", day("created_timestamp").alias("created"))


@R.add("next_versions", """SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + coalesce(top, 0) AS BIGINT) AS version FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') n
    LEFT JOIN (SELECT o_custkey AS k, count(*) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) t ON t.k = n.o_custkey""")
def next_versions(w):
    held = w.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("version"))
    return st.next_versions(held, w.orders.where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey"), "o_custkey", "version", "o_orderkey")


@R.add("supersede_configs", """WITH c AS (SELECT o_custkey, count(*) AS version, true AS is_active, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders WHERE o_orderstatus = 'P')
SELECT c.o_custkey, c.o_orderkey, c.version, NOT EXISTS (SELECT 1 FROM n WHERE n.o_custkey = c.o_custkey) AS is_active FROM c
UNION ALL SELECT n.o_custkey, n.o_orderkey, CAST(coalesce(c.version, 0) + rn AS BIGINT), rn = total FROM n LEFT JOIN c ON c.o_custkey = n.o_custkey""")
def supersede_configs(w):
    held = w.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("version"), F.lit(True).alias("is_active"), F.max("o_orderkey").alias("o_orderkey"))
    return st.supersede(held, w.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), "o_custkey", "version", "o_orderkey")


@R.add("replace_rows", """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
    UNION ALL SELECT o_custkey, concat(o_orderpriority, o_orderkey) FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW'""")
def replace_rows(w):
    fresh = w.orders.where("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'").select(F.col("o_custkey").alias("c_custkey"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("c_mktsegment"))
    return st.replace_rows(w.customer.select("c_custkey", "c_mktsegment"), fresh, ["c_custkey"])


@R.add("alias_refresh", check_with("model_versions", """rg AS (SELECT concat('prod.models.m', l_suppkey) AS uc_full_name, l_linenumber AS uc_version, CASE WHEN l_returnflag = 'R' THEN 'challenger' ELSE 'champion' END AS alias FROM lineitem WHERE l_quantity >= 49 AND l_discount > 0.08)""",
    """SELECT v.version_id, coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias), '') AS aliases FROM model_versions v LEFT JOIN rg ON rg.uc_full_name = v.uc_full_name AND rg.uc_version = v.uc_version GROUP BY v.version_id"""))
def alias_refresh(w):
    registry = w.lineitem.where("l_quantity >= 49 AND l_discount > 0.08").select(
        F.concat(F.lit("prod.models.m"), F.col("l_suppkey")).alias("uc_full_name"), F.col("l_linenumber").alias("uc_version"), F.when(F.col("l_returnflag") == "R", "challenger").otherwise("champion").alias("alias")
    )
    return st.refresh_aliases(w.model_versions, registry).select("version_id", array_text(F.col("current_aliases")).alias("aliases"))


RUNS = "rn AS (SELECT job_name, run_date, rows_examined, CASE WHEN rows_changed < 3 THEN 0 ELSE rows_changed END AS rows_changed, CASE WHEN rows_examined < 55 THEN 'timeout' END AS error FROM runs)"


def run_log(w):
    return w.runs.select(
        "job_name", F.col("run_date").cast("timestamp_ntz").alias("run_timestamp"), F.concat_ws(":", "job_name", F.col("run_date").cast("string")).alias("run_id"), "rows_examined",
        F.when(F.col("rows_changed") < 3, 0).otherwise(F.col("rows_changed")).alias("rows_changed"), F.when(F.col("rows_examined") < 55, "timeout").alias("error"),
    )


@R.add("run_health", check_with("runs", RUNS, """SELECT job_name, strftime(run_date, '%Y-%m-%d') AS day, CAST(rows_changed AS BIGINT) AS rows_changed, CASE WHEN rows_changed = 0 AND coalesce(prev, 0) > 0 THEN 'warning' ELSE 'ok' END AS status FROM (
    SELECT *, lag(rows_changed) OVER (PARTITION BY job_name ORDER BY run_date) AS prev FROM rn WHERE error IS NULL) z UNION ALL SELECT job_name, strftime(run_date, '%Y-%m-%d'), CAST(rows_changed AS BIGINT), 'failed' FROM rn WHERE error IS NOT NULL"""))
def run_health(w):
    return st.run_health(run_log(w)).select("job_name", day("run_timestamp").alias("day"), F.col("rows_changed").cast("long").alias("rows_changed"), "status")


@R.add("stale_passes", check_with("runs", RUNS, """SELECT job_name, strftime(max(run_date), '%Y-%m-%d') AS last_good, date_sub('hour', CAST(max(run_date) AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') AS hours_since,
    date_sub('hour', CAST(max(run_date) AS TIMESTAMP), TIMESTAMP '2024-02-01 00:00:00') > 48 AS is_stale FROM rn WHERE error IS NULL GROUP BY job_name"""))
def stale_passes(w):
    out = st.stale_passes(st.run_health(run_log(w)), F.lit(48), EVENTS_AS_OF)
    return out.select("job_name", day("last_good_run").alias("last_good"), "hours_since", "is_stale")


@R.add("table_fingerprint", """SELECT count(*) AS row_count, CAST(CAST(sum(CAST(concat('0x', substr(md5(concat_ws('|', coalesce('=' || l_orderkey, '!'), coalesce('=' || l_linenumber, '!'), coalesce('=' || l_partkey, '!'), coalesce('=' || l_suppkey, '!'), coalesce('=' || l_returnflag, '!'))), 1, 12)) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS checksum FROM lineitem""")
def table_fingerprint(w):
    return st.text_fingerprint(w.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"])


@R.add("publish_guard", """SELECT l_suppkey AS name, CASE WHEN f <> r THEN 'blocked' WHEN f = p THEN 'unchanged' ELSE 'write' END AS outcome FROM (
    SELECT l_suppkey, CASE WHEN sum(l_quantity) > 15000 THEN 'x' ELSE 'y' END AS r, 'y' AS f, CASE WHEN min(l_linenumber) = 1 AND count(*) > 600 THEN 'z' ELSE 'y' END AS p FROM lineitem GROUP BY 1) q""")
def publish_guard(w):
    marks = w.lineitem.groupBy(F.col("l_suppkey").alias("name")).agg(
        F.when(F.sum("l_quantity") > 15000, "x").otherwise("y").alias("recorded"), F.lit("y").alias("found"), F.when((F.min("l_linenumber") == 1) & (F.count(F.lit(1)) > 600), "z").otherwise("y").alias("proposed")
    )
    return st.publish_decisions(marks).select("name", "outcome")


@R.add("settings_hash", """SELECT o_orderkey, sha256(concat('{"priority":"', o_orderpriority, '","status":"', o_orderstatus, '"}')) AS config_hash FROM orders""")
def settings_hash(w):
    settings = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("config_hash"), F.lit("old"))
    return w.orders.select("o_orderkey", st.settings_hash(F.transform_values(settings, lambda _, v: v)).alias("config_hash"))


# Allowed lifecycle moves.
MOVES = {"signup": ("view", "click"), "view": ("click", "purchase", "view"), "click": ("view", "purchase"), "purchase": ("view",), "error": ("view", "click")}


@R.add("lifecycle_moves", "WITH m AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events) SELECT event_id, from_state, from_state IS NULL OR "
    + " OR ".join(f"(from_state = '{a}' AND event_type IN ({', '.join(repr(x) for x in b)}))" for a, b in MOVES.items()) + " AS is_valid FROM m")
def lifecycle_moves(w):
    return st.lifecycle_moves(w.events.select("event_id", "user_id", "ts", "event_type"), MOVES, "user_id", "event_type", "ts", ["event_id"]).select("event_id", "from_state", "is_valid")


@R.add("retention_purge", """SELECT o_orderpriority AS table_class, count(*) FILTER (o_orderdate < DATE '2001-08-01' - INTERVAL 365 DAY) AS purged, count(*) FILTER (o_orderdate >= DATE '2001-08-01' - INTERVAL 365 DAY) AS kept FROM orders GROUP BY 1""")
def retention_purge(w):
    keep, gone = st.purge(w.orders, "o_orderdate", st.RETENTION_DAYS["metrics"], AS_OF)
    both = keep.withColumn("_k", F.lit(True)).unionByName(gone.withColumn("_k", F.lit(False)))
    return both.groupBy(F.col("o_orderpriority").alias("table_class")).agg(F.count_if(~F.col("_k")).alias("purged"), F.count_if(F.col("_k")).alias("kept"))


_KEPT = {"telemetry": ("lineitem", "l_shipdate"), "predictions": ("orders", "o_orderdate"), "metrics": ("model_performance", "measurement_timestamp"), "audit": ("deployments", "created_timestamp")}


@R.add("retention_classes", check_sql("model_performance deployments", " UNION ALL ".join(
    f"SELECT '{c}' AS table_class, count(*) FILTER ({ts} < DATE '2001-08-01' - INTERVAL {st.RETENTION_DAYS[c]} DAY) AS archived, count(*) FILTER ({ts} >= DATE '2001-08-01' - INTERVAL {st.RETENTION_DAYS[c]} DAY) AS kept, "
    f"strftime(min({ts}) FILTER ({ts} >= DATE '2001-08-01' - INTERVAL {st.RETENTION_DAYS[c]} DAY), '%Y-%m-%d') AS oldest_kept FROM {t}" for c, (t, ts) in _KEPT.items())))
def retention_classes(w):
    root, out = fresh_folder(w.spark, "retention"), None
    for name, (table, ts) in _KEPT.items():
        keep, archived = st.retention_pass(getattr(w, table), ts, st.RETENTION_DAYS[name], AS_OF, f"{root}/{name}")
        row = keep.agg(F.lit(name).alias("table_class"), F.lit(archived).cast("long").alias("archived"), F.count(F.lit(1)).alias("kept"), F.date_format(F.min(ts), "yyyy-MM-dd").alias("oldest_kept"))
        out = row if out is None else out.unionByName(row)
    return out


_MARK = "(SELECT l_suppkey, count(*) || ':' || sum(('0x' || substr(md5(concat('=', l_orderkey, '|=', l_linenumber, '|=', {v})), 1, 12))::HUGEINT) AS f FROM lineitem GROUP BY 1)"


@R.add("publish_guard_contents", f"""SELECT p.l_suppkey AS name, CASE WHEN o.f <> r.f THEN 'blocked' WHEN o.f = p.f THEN 'unchanged' ELSE 'write' END AS outcome FROM {_MARK.format(v='l_partkey + CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE 0 END')} p
    JOIN {_MARK.format(v='l_partkey + CASE WHEN l_suppkey % 5 = 0 AND l_linenumber = 2 THEN 7 ELSE 0 END')} o ON o.l_suppkey = p.l_suppkey JOIN {_MARK.format(v='l_partkey')} r ON r.l_suppkey = p.l_suppkey""")
def publish_guard_contents(w):
    rows = w.lineitem.select(F.col("l_suppkey").alias("name"), "l_orderkey", "l_linenumber", "l_partkey")
    edited = rows.withColumn("l_partkey", F.col("l_partkey") + F.when((F.col("name") % 5 == 0) & (F.col("l_linenumber") == 2), 7).otherwise(0))
    made = rows.withColumn("l_partkey", F.col("l_partkey") + F.when(F.col("name") % 3 == 0, 1).otherwise(0))
    return st.guarded_publish(rows, edited, made, "name", ["l_orderkey", "l_linenumber", "l_partkey"]).select("name", "outcome")


@R.add("merged_audit_events", check_sql("deployments hitl_reviews", """SELECT 'deployments' AS source, strftime(created_timestamp, '%Y-%m-%d') AS day, author AS actor, concat('deploy_', status) AS action, 'deployment' AS resource_type, plan_hash AS resource_id, project_id FROM deployments
    UNION ALL SELECT 'reviews', strftime(presented_timestamp, '%Y-%m-%d'), NULL, concat('review_', coalesce(decision, 'open')), 'prediction', prediction_id, project_id FROM hitl_reviews"""))
def merged_audit_events(w):
    out = st.normalised_audit({
        "deployments": (w.deployments, {"event_timestamp": F.col("created_timestamp"), "actor": F.col("author"), "action": F.concat(F.lit("deploy_"), F.col("status")), "resource_type": F.lit("deployment"), "resource_id": F.col("plan_hash"), "project_id": F.col("project_id")}),
        "reviews": (w.hitl_reviews, {"event_timestamp": F.col("presented_timestamp"), "action": F.concat(F.lit("review_"), F.coalesce("decision", F.lit("open"))), "resource_type": F.lit("prediction"), "resource_id": F.col("prediction_id"), "project_id": F.col("project_id")}),
    })
    return out.select("source", F.date_format("event_timestamp", "yyyy-MM-dd").alias("day"), "actor", "action", "resource_type", "resource_id", "project_id")


@R.add("audit_trail", check_sql("deployments", """SELECT sha256(concat('deploy_', status, ':deployment:', plan_hash, ':2001-08-01 00:00:00')) AS event_id, concat('deploy_', status) AS action_type, author AS actor_email, plan_hash AS resource_id, project_id
    FROM deployments WHERE author = 'v7'"""))
def audit_trail(w):
    rows = st.audit_rows(w.deployments, action=F.concat(F.lit("deploy_"), F.col("status")), actor=F.col("author"), role="release", resource_type="deployment", resource_id="plan_hash", as_of=AS_OF,
                         details=F.to_json(F.struct("status")), project="project_id")
    return g.audit_trail(rows, actor="v7").select("event_id", "action_type", "actor_email", "resource_id", "project_id")


@R.add("merged_audit", check_sql("deployments hitl_reviews", """SELECT source, project_id, count(*) AS events FROM (SELECT 'deployments' AS source, project_id FROM deployments UNION ALL SELECT 'reviews', project_id FROM hitl_reviews) z GROUP BY 1, 2"""))
def merged_audit(w):
    both = st.merged_audit([("deployments", w.deployments.select("project_id", F.col("created_timestamp").alias("event_timestamp"))), ("reviews", w.hitl_reviews.select("project_id", F.col("presented_timestamp").alias("event_timestamp"), "decision"))])
    return both.groupBy("source", "project_id").agg(F.count(F.lit(1)).alias("events"))


@R.add("policy_pack_sync", f"""WITH k AS ({PACKS}) SELECT policy_pack_id, risk_tier, revalidation_frequency_days, on_revalidation_due FROM k""")
def policy_pack_sync(w):
    new = packs(w)
    current = new.where("risk_tier <> 'low'").withColumn("revalidation_frequency_days", F.lit(1))
    return g.sync_packs(current, new).drop("required_approval_gates")


@R.add("parsed_instants", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS parsed FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id, NULL FROM events WHERE event_type = 'error'")
def parsed_instants(w):
    raw = F.when(F.col("event_type") == "error", F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return w.events.select("event_id", F.date_format(parse_instant(raw), "yyyy-MM-dd HH:mm:ss").alias("parsed"))
