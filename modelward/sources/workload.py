"""Governance tables derived, row for row, from the TPC-H-like tables of the test data.

``VIEWS`` holds one SQL text per derived table. Spark runs it over the parquet tables; the check reads the same text as a
common table expression, with ``CHECK_VIEWS`` for the two texts whose functions differ between the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The instant the governance passes look back from.
AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # predictions: one per order; ids are order keys
    "inference_log": """
        SELECT CAST(o_orderkey AS STRING) AS client_request_id, o_orderpriority AS project_id,
               o_orderstatus AS prediction, o_orderdate AS request_time,
               o_totalprice / 500000 AS confidence, o_custkey AS subject
        FROM {orders}""",
    # labels: several may arrive for one prediction
    "label_source": """
        SELECT CAST(l_orderkey AS STRING) AS client_request_id, l_linestatus AS label, l_shipdate AS arrived_timestamp
        FROM {lineitem}""",
    # labelled, scored rows with two sensitive columns
    "evaluation": """
        SELECT d.doc_id AS row_id, l.quality AS y_true, l.toxic AS toxic,
               CASE WHEN d.n_chars >= 1200 THEN 1 ELSE 0 END AS y_pred,
               CAST(d.n_chars AS DOUBLE) / (d.n_chars + 1200) AS score, d.lang AS lang, d.source AS source
        FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    # usage and prices share the part key as SKU
    "usage": """
        SELECT l_partkey AS sku_name, l_shipdate AS usage_start_time, CAST(l_shipdate AS DATE) AS usage_date,
               l_quantity AS usage_quantity,
               CASE WHEN l_returnflag <> 'A' THEN concat('p', CAST(l_suppkey AS STRING)) END AS project_tag,
               CASE WHEN l_returnflag = 'A' THEN 'control_plane' END AS component_tag
        FROM {lineitem}""",
    "list_prices": """
        SELECT p_partkey AS sku_name, make_date(y, 1, 1) AS price_start, 
               CASE WHEN y < 2000 THEN make_date(y + 1, 1, 1) END AS price_end,
               p_retailprice * (100 + y - 1995) / 100 AS list_price
        FROM (SELECT p_partkey, p_retailprice, explode(sequence(1995, 2000)) AS y FROM {part}) s""",
    "projects": """
        SELECT concat('p', CAST(s_suppkey AS STRING)) AS project_id, s_name AS project_name,
               concat('team-', CAST(s_nationkey AS STRING)) AS team_name,
               CASE WHEN s_acctbal < 2000 THEN 'high' WHEN s_acctbal < 6000 THEN 'medium' ELSE 'low' END AS risk_tier,
               CASE WHEN s_nationkey < 8 THEN 'development' WHEN s_nationkey < 20 THEN 'production' ELSE 'retired' END AS status,
               s_acctbal > 9000 AS is_archived, s_acctbal AS balance
        FROM {supplier}""",
    "models": """
        SELECT concat('m', CAST(s_suppkey AS STRING)) AS model_id, concat('p', CAST(s_suppkey AS STRING)) AS project_id
        FROM {supplier}""",
    "model_versions": """
        SELECT concat('m', CAST(l_suppkey AS STRING), '-v', CAST(l_linenumber AS STRING)) AS version_id,
               concat('m', CAST(l_suppkey AS STRING)) AS model_id,
               concat('prod.models.m', CAST(l_suppkey AS STRING)) AS uc_full_name,
               l_linenumber AS uc_version, max(l_shipdate) AS promoted_timestamp
        FROM {lineitem} GROUP BY l_suppkey, l_linenumber""",
    "model_performance": """
        SELECT concat('m', CAST(l_suppkey AS STRING), '-v', CAST(l_linenumber AS STRING)) AS version_id,
               concat('m', CAST(l_suppkey AS STRING)) AS model_id, l_linenumber AS uc_version,
               l_shipdate AS measurement_timestamp, l_returnflag = 'R' AS performance_degraded,
               round(l_discount * 200, 2) AS degradation_pct
        FROM {lineitem}""",
    "project_configs": """
        SELECT concat('p', CAST(o_custkey AS STRING)) AS project_id, o_orderkey AS config_version,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'realtime' WHEN '2-HIGH' THEN 'streaming' ELSE 'batch' END AS inference_type,
               concat('{{"performance_alert_threshold_pct":', CAST(CAST(floor(o_totalprice / 50000) AS INT) AS STRING),
                      CASE WHEN o_orderstatus = 'P' THEN '}}' ELSE ',"alert_destination_configs":["email"]}}' END) AS interview_responses
        FROM {orders}""",
    "approvals": """
        SELECT concat('a', CAST(o_orderkey AS STRING)) AS approval_id, concat('m', CAST(o_custkey AS STRING)) AS model_id,
               o_orderpriority AS approval_gate,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' ELSE 'pending' END AS status,
               concat('plan-', CAST(o_orderkey AS STRING)) AS plan_hash,
               CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS required_count,
               o_orderdate AS requested_timestamp, o_orderdate AS completed_timestamp
        FROM {orders}""",
    "deployments": """
        SELECT concat('p', CAST(l_suppkey AS STRING)) AS project_id, concat('plan-', CAST(l_orderkey AS STRING)) AS plan_hash,
               CASE l_returnflag WHEN 'N' THEN 'deployed' WHEN 'R' THEN 'failed' ELSE 'verify_failed' END AS status,
               l_shipdate AS created_timestamp, concat('v', CAST(l_suppkey AS STRING)) AS author
        FROM {lineitem}""",
    "vote_log": """
        SELECT concat('a', CAST(l_orderkey AS STRING)) AS approval_id, concat('v', CAST(l_suppkey AS STRING)) AS voter,
               CASE l_returnflag WHEN 'N' THEN 'approve' WHEN 'R' THEN CASE WHEN l_tax < 0.03 THEN 'reject' ELSE 'approve' END
                                 ELSE 'request_changes' END AS decision,
               l_shipdate AS event_time, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS event_id
        FROM {lineitem}
        UNION ALL  -- rows delivered again
        SELECT concat('a', CAST(l_orderkey AS STRING)), concat('v', CAST(l_suppkey AS STRING)),
               CASE l_returnflag WHEN 'N' THEN 'approve' WHEN 'R' THEN CASE WHEN l_tax < 0.03 THEN 'reject' ELSE 'approve' END
                                 ELSE 'request_changes' END,
               l_shipdate, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey
        FROM {lineitem} WHERE l_discount > 0.07
        UNION ALL  -- votes without a voter
        SELECT concat('a', CAST(l_orderkey AS STRING)), CAST(NULL AS STRING), 'approve', l_shipdate, CAST(l_partkey AS BIGINT)
        FROM {lineitem} WHERE l_discount < 0.02""",
    "features": """
        SELECT concat('f', CAST(p_partkey AS STRING)) AS feature_id, p_name AS feature_name, p_type AS feature_description,
               p_brand AS owner_team, p_size > 20 AS is_shared, p_retailprice < 1600 AS is_active,
               concat('feat.', lower(p_type)) AS feature_table_name, 'v1' AS feature_version, p_retailprice AS freshness
        FROM {part}""",
    "feature_lineage": """
        SELECT concat('f', CAST(l_partkey AS STRING)) AS feature_id, collect_set(concat('m', CAST(l_suppkey AS STRING))) AS downstream_model_ids
        FROM {lineitem} GROUP BY l_partkey""",
    "hitl_reviews": """
        SELECT CAST(o_orderkey AS STRING) AS prediction_id, concat('p', CAST(o_custkey AS STRING)) AS project_id,
               o_orderdate AS presented_timestamp, CASE WHEN o_orderstatus = 'F' THEN 'approved' END AS decision,
               o_orderpriority = '1-URGENT' AS escalated
        FROM {orders}""",
    "review_decisions": """
        SELECT CAST(l_orderkey AS STRING) AS prediction_id, concat('r', CAST(l_suppkey AS STRING)) AS reviewer_email,
               CASE l_returnflag WHEN 'N' THEN 'approved' WHEN 'R' THEN 'rejected'
                                 ELSE CASE WHEN l_tax < 0.02 THEN 'maybe' ELSE 'overridden' END END AS decision,
               CASE WHEN l_discount > 0.03 THEN CAST(l_linenumber AS STRING) ELSE '' END AS overridden_value,
               l_shipdate AS event_time, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS event_id
        FROM (SELECT * FROM {lineitem} UNION ALL SELECT * FROM {lineitem} WHERE l_discount > 0.07) delivered""",
    "telemetry": """
        SELECT CAST(event_id AS STRING) AS client_request_id, event_type AS resolved_alias,
               CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'medium' ELSE 'high' END AS confidence_bucket
        FROM {events}""",
    "business_impact": """
        SELECT concat('p', CAST(o_custkey AS STRING)) AS project_id, CAST(o_orderdate AS DATE) AS period_end,
               o_totalprice AS revenue_lift_usd, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 4 END AS loss_avoided_usd
        FROM {orders}""",
    "business_value_fns": """
        SELECT concat('p', CAST(c_custkey AS STRING)) AS project_id,
               CASE WHEN c_mktsegment <> 'BUILDING' THEN make_date(2000, CAST(1 + floor(c_nationkey / 3) AS INT), 1) END AS last_reviewed_date
        FROM {customer}""",
    # monitored requests: the event stream with a latency, a status and a prediction
    "requests": """
        SELECT event_id, ts, user_id, event_type AS model_id, value AS latency_ms, event_type = 'error' AS is_error,
               value > 50 AS prediction, value > 120 AS slow
        FROM {events}""",
    "runs": """
        SELECT event_type AS job_name, CAST(ts AS DATE) AS run_date, count(*) AS rows_examined,
               sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) AS rows_changed
        FROM {events} GROUP BY event_type, CAST(ts AS DATE)""",
}

CHECK_VIEWS = {
    "list_prices": VIEWS["list_prices"].replace("explode(sequence(1995, 2000))", "unnest(generate_series(1995, 2000))"),
    "feature_lineage": VIEWS["feature_lineage"].replace("collect_set(", "array_agg(DISTINCT "),
}


class Workload:
    """Base and derived tables of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        return self.spark.sql(text, **{b: self.base(b) for b in BASE if "{" + b + "}" in text})

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    def tagged_usage(self) -> DataFrame:
        """Usage with its tags as a map, as billing tables hold them."""
        tags = F.create_map(F.lit("project_id"), F.col("project_tag"), F.lit("component"), F.col("component_tag"))
        return self.usage.withColumn("custom_tags", F.map_filter(tags, lambda _, v: v.isNotNull()))

    def nested_prices(self) -> DataFrame:
        """Price windows with the price inside a struct and an open end as NULL."""
        return self.list_prices.select(
            "sku_name",
            F.col("price_start").cast("timestamp_ntz").alias("price_start_time"),
            F.col("price_end").cast("timestamp_ntz").alias("price_end_time"),
            F.struct(F.struct(F.col("list_price").alias("default")).alias("effective_list")).alias("pricing"),
        )


def check_sql(views: str, body: str) -> str:
    """``body`` preceded by the named views as common table expressions."""
    names = {b: b for b in BASE}
    parts = [f"{v} AS ({CHECK_VIEWS.get(v, VIEWS[v]).format(**names)})" for v in views.split()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body


def check_with(views: str, extra: str, body: str) -> str:
    """As ``check_sql``, with further common table expressions of the query itself."""
    head = check_sql(views, "") if views else "WITH "
    return head.rstrip() + (", " if views else " ") + extra + " " + body
