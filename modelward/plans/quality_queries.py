"""Quality and profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelward.functions.columns import array_text, stamp
from modelward.operators import moments as mo
from modelward.operators import quality as q
from modelward.operators import sketches as sk
from modelward.plans.registry import Registry
from modelward.session import fresh_folder
from modelward.sources.workload import AS_OF, check_sql

R = Registry()

# The contracts the queries assess.
ORDERS_CONTRACT = [
    {"column_name": "o_orderkey", "data_type": "bigint", "is_nullable": False, "quality_rules": '{"uniqueness_check": {"must_be_unique": true}}'},
    {"column_name": "o_custkey", "data_type": "bigint", "is_nullable": False, "pii_level": "low", "quality_rules": '{"uniqueness_check": {"must_be_unique": true}}'},
    {"column_name": "status", "data_type": "string", "is_nullable": True, "quality_rules": '{"null_check": {"max_null_pct": 5.0}}', "allowed_values": ["F", "P"]},
    {"column_name": "o_totalprice", "data_type": "double", "is_nullable": False, "min_value": 1000.0, "max_value": 400000.0,
     "quality_rules": '{"distribution_check": {"expected_mean": 200000, "tolerance_pct": 50}, "outlier_check": {"iqr_factor": 0.2}}'},
    {"column_name": "o_orderpriority", "data_type": "string", "is_nullable": True, "pattern_regex": "^[1-4]-", "quality_rules": "not json"},
    {"column_name": "o_orderdate", "data_type": "timestamp", "is_required_for_quality": False, "pii_level": "medium"},
    {"column_name": "bad name!", "is_nullable": False},
]

ORDERS_TARGET = "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'O') AS status, o_totalprice, o_orderpriority, o_orderdate FROM orders"


def orders_target(w):
    return w.orders.withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("O"))).drop("o_orderstatus")


ASSESS_SQL = f"""
WITH t AS ({ORDERS_TARGET}),
a AS (SELECT count(*) AS n, count(*) - count(o_orderkey) AS n1, count(*) - count(o_custkey) AS n2, count(*) - count(status) AS n3,
             count(*) - count(o_totalprice) AS n4, count(o_orderkey) - count(DISTINCT o_orderkey) AS d1, count(o_custkey) - count(DISTINCT o_custkey) AS d2 FROM t),
c AS (
  SELECT 'o_orderkey' AS col, 'null_check' AS chk, n1 * 100.0 / n > 0 AS failed, printf('%.1f%% null, exceeds max 0.0%%', CAST(n1 * 100.0 / n AS DOUBLE)) AS detail FROM a
  UNION ALL SELECT 'o_custkey', 'null_check', n2 * 100.0 / n > 0, printf('%.1f%% null, exceeds max 0.0%%', CAST(n2 * 100.0 / n AS DOUBLE)) FROM a
  UNION ALL SELECT 'status', 'null_check', n3 * 100.0 / n > 5, printf('%.1f%% null, exceeds max 5.0%%', CAST(n3 * 100.0 / n AS DOUBLE)) FROM a
  UNION ALL SELECT 'o_totalprice', 'null_check', n4 * 100.0 / n > 0, printf('%.1f%% null, exceeds max 0.0%%', CAST(n4 * 100.0 / n AS DOUBLE)) FROM a
  UNION ALL SELECT 'o_orderkey', 'uniqueness_check', d1 > 0, d1 || ' duplicate value(s)' FROM a
  UNION ALL SELECT 'o_custkey', 'uniqueness_check', d2 > 0, d2 || ' duplicate value(s)' FROM a)"""


@R.add(
    "contract_assessment",
    ASSESS_SQL
    + """, s AS (SELECT col, 1.0 - CAST(count(*) FILTER (failed) AS DOUBLE) / count(*) AS score FROM c GROUP BY col)
SELECT (SELECT n FROM a) AS row_count, count(*) AS checks_run, count(*) FILTER (failed) AS issues_found,
       round(1.0 - CAST(count(*) FILTER (failed) AS DOUBLE) / count(*), 6) AS quality_score, 'poor' AS quality_status,
       count(*) FILTER (failed AND chk = 'null_check') AS null_issues, count(*) FILTER (failed AND chk = 'uniqueness_check') AS uniqueness_issues,
       string_agg(col || ':' || chk || ':' || detail, ',' ORDER BY col || ':' || chk || ':' || detail) FILTER (failed) AS failed_checks,
       (SELECT string_agg(col || '=' || CAST(score AS VARCHAR), ',' ORDER BY col) FROM s) AS column_scores, 'o_custkey,o_orderdate' AS pii_columns FROM c""",
)
def contract_assessment(w):
    out = q.assess_contract(orders_target(w), ORDERS_CONTRACT, project_id="p1", contract_id="c1", table_name="sales.orders", as_of=AS_OF)
    pairs = F.transform(F.map_entries("column_quality_scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select(
        "row_count", "checks_run", "issues_found", F.round("quality_score", 6).alias("quality_score"), "quality_status",
        F.col("null_issues_found").alias("null_issues"), F.col("uniqueness_issues_found").alias("uniqueness_issues"),
        q.failed_text().alias("failed_checks"), array_text(pairs).alias("column_scores"), F.array_join("pii_columns_detected", ",").alias("pii_columns"),
    )


@R.add(
    "contract_checks_all_rules",
    f"""WITH t AS ({ORDERS_TARGET}), f AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM t),
a AS (SELECT count(*) AS n, count(*) - count(o_orderkey) AS n1, count(*) - count(o_custkey) AS n2, count(*) - count(status) AS n3,
             count(*) - count(o_totalprice) AS n4, count(o_orderkey) - count(DISTINCT o_orderkey) AS d1, count(o_custkey) - count(DISTINCT o_custkey) AS d2,
             count(*) FILTER (status NOT IN ('F', 'P')) AS av, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) AS rg,
             count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]-')) AS fm, avg(o_totalprice) AS m,
             count(*) FILTER (o_totalprice < (SELECT q1 - 0.2 * (q3 - q1) FROM f) OR o_totalprice > (SELECT q3 + 0.2 * (q3 - q1) FROM f)) AS ol FROM t)
SELECT 'o_orderkey' AS column_name, 'null_check' AS check_name, n1 AS issue_rows, n1 > 0 AS failed FROM a
UNION ALL SELECT 'o_custkey', 'null_check', n2, n2 > 0 FROM a UNION ALL SELECT 'status', 'null_check', n3, n3 * 100.0 / n > 5 FROM a
UNION ALL SELECT 'o_totalprice', 'null_check', n4, n4 > 0 FROM a UNION ALL SELECT 'o_orderkey', 'uniqueness_check', d1, d1 > 0 FROM a
UNION ALL SELECT 'o_custkey', 'uniqueness_check', d2, d2 > 0 FROM a UNION ALL SELECT 'status', 'allowed_values', av, av > 0 FROM a
UNION ALL SELECT 'o_totalprice', 'range_check', rg, rg > 0 FROM a UNION ALL SELECT 'o_orderpriority', 'format_check', fm, fm > 0 FROM a
UNION ALL SELECT 'o_totalprice', 'distribution_check', 0, abs(m - 200000) / 200000 * 100 > 50 FROM a
UNION ALL SELECT 'o_totalprice', 'outlier_check', ol, ol > 0 FROM a""",
)
def contract_checks_all_rules(w):
    out = q.contract_checks(orders_target(w), ORDERS_CONTRACT, all_rules=True)
    return out.select(F.col("column").alias("column_name"), F.col("check").alias("check_name"), "issue_rows", "failed")


NULLED = "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance, c_nationkey, c_name FROM customer"


def nulled(w):
    return w.customer.select(
        "c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), "c_nationkey", "c_name",
    )


_COLS = ("c_custkey", "segment", "balance", "c_nationkey", "c_name")


@R.add(
    "null_and_duplicate_counts",
    f"WITH t AS ({NULLED}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count({c}) - count(DISTINCT {c}) AS duplicate_count FROM t" for c in _COLS),
)
def null_and_duplicate_counts(w):
    df = nulled(w)
    return q.null_counts(df, _COLS).join(q.duplicate_counts(df, list(_COLS)), "column_name")


@R.add(
    "quick_stats",
    f"WITH t AS ({NULLED}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(DISTINCT {c}) AS distinct_count, "
        f"CASE WHEN (count(*) - count({c})) * 100.0 / count(*) > 5 THEN 'acceptable' ELSE 'required' END AS suggested_rule FROM t" for c in _COLS
    ),
)
def quick_stats(w):
    return q.quick_stats(nulled(w), exact=True).withColumn("null_pct", F.round("null_pct", 6))


@R.add(
    "quick_stats_sketch",
    f"WITH t AS ({NULLED}) "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(DISTINCT {c}) AS exact_count, true AS in_bound FROM t" for c in _COLS),
)
def quick_stats_sketch(w):
    return checked_distinct(q.quick_stats(nulled(w)), q.quick_stats(nulled(w), exact=True), 0.05)


def checked_distinct(estimated, exact, error):
    """Estimates beside the exact counts; four times the error passes for chance."""
    near = F.abs(F.col("distinct_count") - F.col("exact_count")) <= 4 * error * F.col("exact_count")
    both = estimated.join(exact.select("column_name", F.col("distinct_count").alias("exact_count")), "column_name")
    return both.select("column_name", "row_count", F.round("null_pct", 6).alias("null_pct"), "exact_count", near.alias("in_bound"))


_STORED = ("l_orderkey", "l_quantity", "l_returnflag", "l_extendedprice", "discount")


@R.add(
    "distinct_sketch_error",
    "WITH t AS (SELECT *, nullif(l_discount, 0) AS discount FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_pct, count(DISTINCT {c}) AS exact_count, true AS in_bound FROM t" for c in _STORED),
)
def distinct_sketch_error(w):
    rows = w.lineitem.withColumn("discount", F.nullif(F.col("l_discount"), F.lit(0.0))).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    folder = fresh_folder(w.spark, "distinct_sketches")
    sk.distinct_sketches(rows, _STORED, ["month"]).write.partitionBy("month").parquet(folder)
    return checked_distinct(sk.united_distinct(w.spark.read.parquet(folder)), q.quick_stats(rows.select(*_STORED), exact=True), sk.distinct_error())


@R.add(
    "latency_sketch_error",
    check_sql("requests", """SELECT model_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS requests, round(avg(CASE WHEN is_error THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
    true AS p50, true AS p95, true AS p99 FROM requests GROUP BY 1, 2"""),
)
def latency_sketch_error(w):
    folder = fresh_folder(w.spark, "latency_sketches")
    sk.latency_sketches(w.requests).write.parquet(folder)
    days = sk.merged_latency(w.spark.read.parquet(folder))
    errors = sk.rank_errors(days, w.requests.withColumn("window_start", F.window("ts", "1 day")["start"]), ["model_id", "window_start"], "latency_ms")
    # twice the error of 99 in 100 passes for chance
    near = errors.groupBy("model_id", "window_start").pivot("quantile", list(sk.QUANTILES)).agg(F.first(F.col("rank_error") <= 2 * sk.rank_error()))
    return days.select("model_id", "window_start", "requests", F.round("error_rate", 6).alias("error_rate")).join(near, ["model_id", "window_start"]).withColumn("day", stamp("window_start", "yyyy-MM-dd")).drop("window_start")


@R.add(
    "profile_summary",
    """WITH t AS (SELECT l_returnflag, l_linestatus, l_quantity, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem),
g AS (SELECT count(*) AS n FROM t GROUP BY ALL l_returnflag, l_linestatus, l_quantity, discount, tax)
SELECT (SELECT count(*) FROM t) AS row_count, 5 AS column_count,
       round((SELECT sum(CASE WHEN discount IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN tax IS NULL THEN 1 ELSE 0 END) FROM t) * 100.0 / ((SELECT count(*) FROM t) * 5), 6) AS missing_cells_pct,
       round((SELECT sum(n - 1) FROM g) * 100.0 / (SELECT count(*) FROM t), 6) AS duplicate_rows_pct""".replace("GROUP BY ALL ", "GROUP BY "),
)
def profile_summary(w):
    zero = F.lit(0.0)
    df = w.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", F.nullif(F.col("l_discount"), zero).alias("discount"), F.nullif(F.col("l_tax"), zero).alias("tax"))
    return q.row_summary(df).select("row_count", "column_count", F.round("missing_cells_pct", 6).alias("missing_cells_pct"), F.round("duplicate_rows_pct", 6).alias("duplicate_rows_pct"))


@R.add(
    "table_limits",
    """WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate),
v AS (SELECT 'q' AS f, l_quantity AS v FROM lineitem UNION ALL SELECT 'e', l_extendedprice FROM lineitem),
b AS (SELECT f, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY f),
o AS (SELECT count(*) FILTER (v < q1 - 3 * (q3 - q1) OR v > q3 + 3 * (q3 - q1)) * 100.0 / count(*) AS p FROM v JOIN b ON v.f = b.f)
SELECT 'row_count' AS limit_name, round(CAST(sum(n) AS DOUBLE), 6) AS observed, CAST(1000 AS DOUBLE) AS bound, sum(n) >= 1000 AS ok FROM g
UNION ALL SELECT 'duplicate_rows_pct', round(CAST(sum(n - 1) * 100.0 / sum(n) AS DOUBLE), 6), CAST(1 AS DOUBLE), sum(n - 1) * 100.0 / sum(n) <= 1 FROM g
UNION ALL SELECT 'outlier_pct', round(CAST(p AS DOUBLE), 6), CAST(0.5 AS DOUBLE), p <= 0.5 FROM o""",
)
def table_limits(w):
    out = q.table_limits(w.lineitem, ["l_quantity", "l_extendedprice"], minimum_rows=1000, max_duplicate_pct=1.0, max_outlier_pct=0.5)
    return out.withColumn("observed", F.round("observed", 6))


@R.add(
    "outlier_counts",
    """WITH v AS (SELECT 'l_quantity' AS f, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
b AS (SELECT f, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY f)
SELECT v.f AS column_name, round(max(q1 - 0.4 * (q3 - q1)), 4) AS low_fence, round(max(q3 + 0.4 * (q3 - q1)), 4) AS high_fence, count(*) AS values_seen,
       count(*) FILTER (v < q1 - 0.4 * (q3 - q1) OR v > q3 + 0.4 * (q3 - q1)) AS outlier_count FROM v JOIN b ON v.f = b.f GROUP BY v.f""",
)
def outlier_counts(w):
    out = q.outlier_counts(w.lineitem, ["l_quantity", "l_extendedprice"], factor=0.4)
    return out.withColumn("low_fence", F.round("low_fence", 4)).withColumn("high_fence", F.round("high_fence", 4))


# Row rules on line items.
LINE_CONTRACT = [
    {"column_name": "l_quantity", "is_nullable": False, "min_value": 2.0, "max_value": 45.0},
    {"column_name": "l_returnflag", "is_nullable": False, "allowed_values": ["N", "R"]},
    {"column_name": "l_discount", "is_nullable": True, "max_value": 0.08, "is_required_for_quality": False},
]


@R.add(
    "row_quality_report",
    """WITH r AS (SELECT CASE WHEN l_quantity < 2 OR l_quantity > 45 THEN 1 ELSE 0 END + CASE WHEN l_returnflag NOT IN ('N', 'R') THEN 1 ELSE 0 END AS bad,
                  CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END AS warned FROM lineitem)
SELECT count(*) FILTER (bad = 0) AS rows_passed, count(*) FILTER (bad > 0) AS rows_held, CAST(sum(warned) AS BIGINT) AS warnings,
       round(avg(1.0 - CAST(bad AS DOUBLE) / 4), 6) AS mean_score FROM r""",
)
def row_quality_report(w):
    held = F.size("failed_checks") > 0
    return q.row_quality(w.lineitem, LINE_CONTRACT).agg(
        F.count_if(~held).alias("rows_passed"), F.count_if(held).alias("rows_held"), F.sum(F.size("warnings")).alias("warnings"), F.round(F.avg("row_score"), 6).alias("mean_score")
    )


@R.add(
    "failures_by_check",
    """SELECT 'l_quantity' AS column_name, 'range_check' AS check_name, count(*) AS failed_rows FROM lineitem WHERE l_quantity < 2 OR l_quantity > 45
UNION ALL SELECT 'l_returnflag', 'allowed_values', count(*) FROM lineitem WHERE l_returnflag NOT IN ('N', 'R')""",
)
def failures_by_check(w):
    return q.failures_by_check(q.row_quality(w.lineitem, LINE_CONTRACT))


@R.add(
    "quarantined_rows",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_quantity < 2 OR l_quantity > 45 THEN 'l_quantity:range_check' ELSE '' END
       || CASE WHEN (l_quantity < 2 OR l_quantity > 45) AND l_returnflag = 'A' THEN ',' ELSE '' END || CASE WHEN l_returnflag = 'A' THEN 'l_returnflag:allowed_values' ELSE '' END AS failed
FROM lineitem WHERE l_quantity < 2 OR l_quantity > 45 OR l_returnflag = 'A'""",
)
def quarantined_rows(w):
    _, held = q.split_quarantine(q.row_quality(w.lineitem, LINE_CONTRACT))
    return held.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", array_text(F.col("failed_checks")).alias("failed"))


@R.add(
    "training_gate",
    ASSESS_SQL
    + """ SELECT round(1.0 - CAST(count(*) FILTER (failed) AS DOUBLE) / count(*), 6) AS quality_score,
          CASE WHEN 1.0 - CAST(count(*) FILTER (failed) AS DOUBLE) / count(*) >= 0.7 THEN 'pass' ELSE 'blocked' END AS gate FROM c""",
)
def training_gate(w):
    out = q.assess_contract(orders_target(w), ORDERS_CONTRACT, project_id="p1", contract_id="c1", table_name="sales.orders", as_of=AS_OF)
    return q.training_gate(out, minimum=0.7).select(F.round("quality_score", 6).alias("quality_score"), "gate")


@R.add(
    "values_outside_reference",
    "SELECT l_suppkey AS value, count(*) AS row_count FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey",
)
def values_outside_reference(w):
    return q.outside_reference(w.lineitem, "l_suppkey", w.supplier.where("s_acctbal > 0"), "s_suppkey")


@R.add(
    "suggested_rules",
    """WITH v AS (SELECT c, regexp_replace(regexp_replace(x, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS shape, count(*) AS n FROM
    (SELECT 'c_name' AS c, c_name AS x FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer) u GROUP BY 1, 2),
s AS (SELECT c, shape FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, shape) AS rn FROM v) z WHERE rn = 1),
b AS (SELECT 'c_custkey' AS c, CAST(min(c_custkey) AS DOUBLE) AS lo, CAST(max(c_custkey) AS DOUBLE) AS hi, count(DISTINCT c_custkey) = count(c_custkey) AS u FROM customer
 UNION ALL SELECT 'c_nationkey', min(c_nationkey), max(c_nationkey), count(DISTINCT c_nationkey) = count(c_nationkey) FROM customer
 UNION ALL SELECT 'c_acctbal', min(c_acctbal), max(c_acctbal), count(DISTINCT c_acctbal) = count(c_acctbal) FROM customer
 UNION ALL SELECT 'c_name', NULL, NULL, count(DISTINCT c_name) = count(c_name) FROM customer
 UNION ALL SELECT 'c_mktsegment', NULL, NULL, count(DISTINCT c_mktsegment) = count(c_mktsegment) FROM customer)
SELECT b.c AS column_name, CAST(5 AS DOUBLE) AS max_null_pct, lo AS min_value, hi AS max_value, u AS must_be_unique, shape AS common_shape FROM b LEFT JOIN s ON s.c = b.c""",
)
def suggested_rules(w):
    return q.suggest_rules(w.customer)


@R.add(
    "contract_conformance",
    f"""WITH t AS ({ORDERS_TARGET}), a AS (SELECT count(*) - count(o_orderkey) AS n1, count(*) - count(status) AS n2, count(*) - count(o_totalprice) AS n3, count(*) - count(o_orderdate) AS n4 FROM t)
SELECT 'o_orderkey' AS column_name, 'bigint' AS declared_type, 'bigint' AS actual_type, n1 AS null_count, 'ok' AS result FROM a
UNION ALL SELECT 'status', 'string', 'string', n2, 'nullability' FROM a UNION ALL SELECT 'o_totalprice', 'int', 'double', n3, 'type' FROM a
UNION ALL SELECT 'o_orderdate', 'timestamp', 'timestamp_ntz', n4, 'ok' FROM a UNION ALL SELECT 'o_comment', 'string', NULL, NULL, 'missing' FROM a""",
)
def contract_conformance(w):
    contract = [
        {"column_name": "o_orderkey", "data_type": "bigint", "is_nullable": False},
        {"column_name": "status", "data_type": "string", "is_nullable": False},
        {"column_name": "o_totalprice", "data_type": "int"},
        {"column_name": "o_orderdate", "data_type": "timestamp"},
        {"column_name": "o_comment", "data_type": "string"},
    ]
    return q.conformance(orders_target(w), contract)


@R.add(
    "table_freshness",
    """SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_row, round(date_sub('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600.0, 6) AS hours_since,
       date_sub('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600.0 > 24.5 AS is_stale FROM events GROUP BY event_type""",
)
def table_freshness(w):
    out = q.freshness(w.events, "ts", "2024-02-01 00:00:00", 24.5, ["event_type"])
    return out.select("event_type", stamp("last_row").alias("last_row"), F.round("hours_since", 6).alias("hours_since"), "is_stale")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@R.add(
    "column_correlations",
    " UNION ALL ".join(f"SELECT '{a}' AS field, '{b}' AS other_field, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]),
)
def column_correlations(w):
    return q.correlations(w.lineitem, _NUM).withColumn("correlation", F.round("correlation", 6))


# numbers with NULLs in different rows, far from 0 or not
_WIDE = {
    "quantity": "l_quantity", "price": "CASE WHEN l_linenumber > 1 THEN l_extendedprice END", "discount": "CASE WHEN l_discount > 0 THEN l_discount END", "tax": "CASE WHEN l_tax < 0.07 THEN l_tax END",
    "unit": "l_extendedprice / l_quantity", "far": "CASE WHEN l_partkey > 5 THEN 1000000 + l_quantity * l_tax END", "supplier": "CAST(l_suppkey AS DOUBLE)", "line": "CAST(l_linenumber AS DOUBLE)", "kept": "CASE WHEN l_returnflag = 'N' THEN l_extendedprice * (1 - l_discount) END",
}


@R.add(
    "pairwise_correlations",
    "WITH t AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _WIDE.items()) + " FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS field, '{b}' AS other_field, count(CASE WHEN {a} IS NOT NULL THEN {b} END) AS n, round(corr({a}, {b}), 6) AS correlation FROM t" for i, a in enumerate(_WIDE) for b in list(_WIDE)[i + 1 :]),
)
def pairwise_correlations(w):
    t = w.lineitem.selectExpr(*[f"{e} AS {c}" for c, e in _WIDE.items()])
    return mo.pair_rows(mo.moment_matrix(t, list(_WIDE)), list(_WIDE)).withColumn("correlation", F.round("correlation", 6))


@R.add(
    "column_histograms",
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, CAST(least(floor(({c} - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS n FROM {t}, (SELECT min({c}) AS lo, max({c}) AS hi FROM {t}) s GROUP BY 2"
        for c, t in (("o_totalprice", "orders"), ("o_custkey", "orders"))
    ),
)
def column_histograms(w):
    return q.histograms(w.orders, ["o_totalprice", "o_custkey"])


_TAGGED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@R.add(
    "pii_column_tags",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, {str('name' in c).lower()} AS looks_pii, CAST(NULL AS VARCHAR) AS proxy_class, "
        f"'{'sensitive' if 'name' in c else 'internal'}' AS classification FROM customer" for c in _TAGGED
    )
    + " UNION ALL SELECT 'r_regionkey', count(*), count(*) - count(r_regionkey), false, 'Race / Ethnicity', 'internal' FROM region UNION ALL SELECT 'r_name', count(*), count(*) - count(r_name), true, NULL, 'sensitive' FROM region) z",
)
def pii_column_tags(w):
    found = q.null_counts(w.customer, w.customer.columns).unionByName(q.null_counts(w.region, w.region.columns))
    return q.tag_columns(found)


# The twin's own patterns: its engine looks neither back nor ahead, so what stands before a number is matched with it, and a
# digit after it too, by which it is then refused.
_LONE = {
    "email": ("([A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}[.][A-Za-z][A-Za-z]+)", "true"),
    "ssn": ("(?:^|[^0-9-]|[^0-9]-)([0-9]{3}-[0-9]{2}-[0-9]{4}(?:-?[0-9])?)", "len(x) = 11 AND x[1:3] NOT IN ('000', '666') AND x[1:1] <> '9' AND x[5:6] <> '00' AND x[8:11] <> '0000'"),
    "phone": ("(?:^|[^0-9])([(]?[0-9]{3}[)]?[ .-][0-9]{3}[ .-][0-9]{4}[0-9]?)", "len(regexp_replace(x, '[^0-9]', '', 'g')) = 10 AND replace(x, '(', '')[1:1] NOT IN ('0', '1')"),
    "card": ("(?:^|[^0-9])((?:[0-9]{4}[ -]?){3}[0-9]{4}[0-9]?)", """len(regexp_replace(x, '[ -]', '', 'g')) = 16 AND list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(regexp_replace(x, '[ -]', '', 'g')[i] AS INT)
        ELSE (2 * CAST(regexp_replace(x, '[ -]', '', 'g')[i] AS INT)) // 10 + (2 * CAST(regexp_replace(x, '[ -]', '', 'g')[i] AS INT)) % 10 END)) % 10 = 0"""),
    "ip": ("(?:^|[^0-9.]|[^0-9][.])([0-9]{1,3}(?:[.][0-9]{1,3}){3}(?:[.]?[0-9])?)", "regexp_full_match(x, '[0-9]{1,3}([.][0-9]{1,3}){3}') AND list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS INT))) < 256"),
}


def _pii_sql(table, col):
    return [
        f"SELECT '{col}' AS column_name, '{kind}' AS kind, CAST(sum(n) AS BIGINT) AS hits, count(*) FILTER (n > 0) AS rows_with_hits, round(count(*) FILTER (n > 0) / CAST(count(*) AS DOUBLE), 6) AS hit_rate "
        f"FROM (SELECT len(list_filter(regexp_extract_all(coalesce({col}, ''), '{p}', 1), lambda x: {ok})) AS n FROM {table}) z"
        for kind, (p, ok) in _LONE.items()
    ]


@R.add("pii_content_scan", " UNION ALL ".join(_pii_sql("documents", "text")))
def pii_content_scan(w):
    return q.scan_pii(w.documents, ["text"]).withColumn("hit_rate", F.round("hit_rate", 6))


@R.add(
    "pii_suppression",
    """SELECT c_custkey, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS c_name,
       sha256(c_mktsegment) AS c_mktsegment, c_nationkey FROM customer""",
)
def pii_suppression(w):
    return q.suppress_pii(w.customer, {"c_name": "mask", "c_mktsegment": "hash", "c_acctbal": "drop"})


@R.add(
    "label_source_quality",
    """WITH t AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, nullif(l_linestatus, 'F') AS label FROM lineitem),
a AS (SELECT count(*) - count(id) AS n1, count(*) - count(label) AS n2, count(id) - count(DISTINCT id) AS d1, count(*) FILTER (label NOT IN ('F')) AS av, count(*) AS n FROM t)
SELECT 'client_request_id' AS column_name, 'null_check' AS check_name, n1 AS issue_rows, n1 > 0 AS failed FROM a
UNION ALL SELECT 'client_request_id', 'uniqueness_check', d1, d1 > 0 FROM a UNION ALL SELECT 'label', 'null_check', n2, n2 * 100.0 / n > 60 FROM a
UNION ALL SELECT 'label', 'allowed_values', av, av > 0 FROM a""",
)
def label_source_quality(w):
    contract = [
        {"column_name": "client_request_id", "is_nullable": False, "quality_rules": {"uniqueness_check": {"must_be_unique": True}}},
        {"column_name": "label", "quality_rules": {"null_check": {"max_null_pct": 60.0}}, "allowed_values": ["F"]},
    ]
    out = q.contract_checks(w.label_source.withColumn("label", F.nullif(F.col("label"), F.lit("F"))), contract, all_rules=True)
    return out.select(F.col("column").alias("column_name"), F.col("check").alias("check_name"), "issue_rows", "failed")
