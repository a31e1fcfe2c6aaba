"""Column layouts of the governance tables (DDL strings that ``StructType.fromDDL`` reads)."""

from __future__ import annotations

from pyspark.sql.types import StructType

TABLES = {
    "inference_log": "client_request_id STRING, project_id STRING, model_id STRING, request_time TIMESTAMP, "
    "prediction STRING, score DOUBLE, confidence DOUBLE, latency_ms DOUBLE, status STRING",
    "label_source": "client_request_id STRING, label STRING, arrived_timestamp TIMESTAMP",
    "label_feedback": "prediction_id STRING, project_id STRING, model_version_id STRING, predicted_value STRING, "
    "actual_label STRING, label_source_table STRING, prediction_timestamp TIMESTAMP, label_arrived_timestamp TIMESTAMP, "
    "latency_days DOUBLE, correct BOOLEAN, created_timestamp TIMESTAMP",
    "telemetry_enrichment": "client_request_id STRING, project_id STRING, feature_contributions MAP<STRING,DOUBLE>, "
    "confidence_bucket STRING, resolved_alias STRING, computed_timestamp TIMESTAMP",
    "contract_columns": "contract_id STRING, column_order INT, column_name STRING, data_type STRING, is_nullable BOOLEAN, "
    "is_unique BOOLEAN, allowed_values ARRAY<STRING>, min_value DOUBLE, max_value DOUBLE, pattern_regex STRING, "
    "quality_rules STRING, pii_level STRING, data_classification STRING, is_fairness_attribute BOOLEAN, "
    "is_required_for_quality BOOLEAN, monitor_for_drift BOOLEAN, drift_threshold DOUBLE",
    "quality_assessment": "assessment_id STRING, project_id STRING, contract_id STRING, table_name STRING, row_count BIGINT, "
    "quality_score DOUBLE, quality_status STRING, column_quality_scores MAP<STRING,DOUBLE>, "
    "failed_checks ARRAY<STRUCT<column:STRING,check:STRING,detail:STRING>>, null_issues_found INT, range_issues_found INT, "
    "uniqueness_issues_found INT, format_issues_found INT, outlier_issues_found INT, distribution_issues_found INT, "
    "pii_columns_detected ARRAY<STRING>",
    "baseline_stats": "field_name STRING, mean_value DOUBLE, stddev_value DOUBLE, min_value DOUBLE, max_value DOUBLE, "
    "null_pct DOUBLE, unique_count BIGINT, top_values_json STRING",
    "drift_log": "field_name STRING, window_date DATE, mean_value DOUBLE, stddev_value DOUBLE, min_value DOUBLE, "
    "max_value DOUBLE, psi_score DOUBLE, ks_stat DOUBLE, ks_pvalue DOUBLE, null_pct DOUBLE, n_rows BIGINT",
    "usage": "usage_start_time TIMESTAMP, usage_date DATE, sku_name STRING, usage_quantity DOUBLE, custom_tags MAP<STRING,STRING>",
    "list_prices": "sku_name STRING, price_start_time TIMESTAMP, price_end_time TIMESTAMP, "
    "pricing STRUCT<effective_list:STRUCT<default:DOUBLE>>",
    "cost_tracking": "cost_id STRING, project_id STRING, date DATE, compute_cost_usd DOUBLE, total_cost_usd DOUBLE",
    "budgets": "budget_id STRING, project_id STRING, budget_period STRING, budget_threshold_usd DOUBLE, alert_at_pct DOUBLE, "
    "enabled BOOLEAN, last_alerted_period STRING",
    "projects": "project_id STRING, project_name STRING, team_name STRING, status STRING, risk_tier STRING, "
    "regulatory_frameworks ARRAY<STRING>, is_archived BOOLEAN, created_timestamp TIMESTAMP",
    "models": "model_id STRING, project_id STRING",
    "model_versions": "version_id STRING, model_id STRING, uc_full_name STRING, uc_version INT, current_aliases ARRAY<STRING>",
    "model_performance": "performance_id STRING, version_id STRING, model_id STRING, measurement_timestamp TIMESTAMP, "
    "accuracy DOUBLE, live_accuracy DOUBLE, live_accuracy_labels_count BIGINT, performance_degraded BOOLEAN, degradation_pct DOUBLE",
    "project_configs": "project_id STRING, config_version INT, inference_type STRING, interview_responses STRING",
    "approvals": "approval_id STRING, model_id STRING, approval_gate STRING, status STRING, plan_hash STRING, required_count INT, "
    "requested_timestamp TIMESTAMP, completed_timestamp TIMESTAMP",
    "vote_log": "approval_id STRING, voter STRING, decision STRING, comment STRING, event_time TIMESTAMP, event_id BIGINT",
    "deployments": "deployment_id STRING, project_id STRING, plan_hash STRING, status STRING, created_timestamp TIMESTAMP",
    "features": "feature_id STRING, feature_name STRING, feature_description STRING, feature_table_name STRING, owner_team STRING, "
    "feature_version STRING, is_active BOOLEAN, is_shared BOOLEAN",
    "feature_lineage": "feature_id STRING, source_table_name STRING, downstream_model_ids ARRAY<STRING>",
    "policy_packs": "policy_pack_id STRING, risk_tier STRING, required_approval_gates ARRAY<STRING>, "
    "revalidation_frequency_days INT, on_revalidation_due STRING, allows_override BOOLEAN",
    "revalidation_flags": "project_id STRING, uc_full_name STRING, champion_version INT, promoted_timestamp TIMESTAMP, "
    "frequency_days INT, on_due_action STRING, status STRING, revalidation_approval_ids ARRAY<STRING>, due_since TIMESTAMP, "
    "cleared_timestamp TIMESTAMP",
    "hitl_reviews": "prediction_id STRING, project_id STRING, presented_timestamp TIMESTAMP, reviewer_email STRING, "
    "decision STRING, overridden_value STRING, decision_timestamp TIMESTAMP, escalated BOOLEAN",
    "business_impact": "project_id STRING, period_start DATE, period_end DATE, revenue_lift_usd DOUBLE, loss_avoided_usd DOUBLE",
    "business_value_fns": "project_id STRING, definition_json STRING, last_reviewed_date DATE",
    "run_log": "run_id STRING, job_name STRING, rows_examined BIGINT, rows_changed BIGINT, status STRING, detail STRING, "
    "run_timestamp TIMESTAMP",
    "snapshots": "snapshot_id STRING, project_id STRING, source_table STRING, snapshot_table STRING, source_version BIGINT, "
    "row_count BIGINT, created_at TIMESTAMP",
    "audit_log": "event_id STRING, action_type STRING, actor_email STRING, actor_role STRING, resource_type STRING, "
    "resource_id STRING, project_id STRING, change_details STRING, event_timestamp TIMESTAMP",
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
