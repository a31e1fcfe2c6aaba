"""Feature catalogue, lineage, training sets, sources and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from modelward.functions.columns import array_text, stamp
from modelward.operators import lineage as ln
from modelward.operators import state as st
from modelward.operators.quality import null_counts
from modelward.plans.registry import Registry
from modelward.session import fresh_folder
from modelward.sources import snapshots as sn
from modelward.sources import tables as tb
from modelward.sources.workload import AS_OF, check_sql, check_with

R = Registry()

LINKS = "lk AS (SELECT DISTINCT feature_id, model_id FROM (SELECT feature_id, unnest(downstream_model_ids) AS model_id FROM feature_lineage) z), us AS (SELECT feature_id, count(*) AS used FROM lk GROUP BY 1)"


@R.add("catalog_search", check_with("features feature_lineage", LINKS, """SELECT f.feature_id, feature_name, owner_team, is_shared, coalesce(used, 0) AS used_by_models FROM features f LEFT JOIN us ON us.feature_id = f.feature_id
    WHERE is_active AND (contains(feature_name, 'red') OR contains(feature_description, 'red') OR contains(owner_team, 'red'))"""))
def catalog_search(w):
    return ln.search_catalog(w.features, w.feature_lineage, "red").select("feature_id", "feature_name", "owner_team", "is_shared", "used_by_models")


@R.add("feature_reuse", check_with("features feature_lineage", LINKS, """SELECT count(*) AS shared_features, count(*) FILTER (used >= 2) AS multi_consumer_features FROM features f LEFT JOIN us ON us.feature_id = f.feature_id WHERE is_active AND is_shared"""))
def feature_reuse(w):
    return ln.reuse(w.features, w.feature_lineage)


CONSUMERS = LINKS + ", co AS (SELECT DISTINCT feature_id, project_id FROM lk JOIN models m ON m.model_id = lk.model_id)"


@R.add("feature_consumers", check_with("feature_lineage models", CONSUMERS, "SELECT feature_id, project_id FROM co"))
def feature_consumers(w):
    return ln.consumers(w.feature_lineage, w.models)


CHANGES = CONSUMERS + """, pr AS (SELECT concat('ch', p_partkey) AS change_id, concat('f', p_partkey) AS feature_id, 'v2' AS to_version, p_size > 15 AS is_breaking FROM part WHERE p_retailprice < 1300 OR p_size > 48),
nc AS (SELECT feature_id, count(*) AS n FROM co GROUP BY 1), pp AS (SELECT pr.*, f.feature_version AS from_version, CASE WHEN is_breaking THEN coalesce(n, 0) ELSE 0 END AS consumers,
      CASE WHEN is_breaking AND coalesce(n, 0) > 0 THEN 'pending_acks' ELSE 'released' END AS status FROM pr JOIN features f ON f.feature_id = pr.feature_id LEFT JOIN nc ON nc.feature_id = pr.feature_id),
ac AS (SELECT DISTINCT concat('ch', l_partkey) AS change_id, concat('p', l_suppkey) AS project_id FROM lineitem WHERE l_quantity > 2), ms AS (SELECT pp.change_id, pp.feature_id, co.project_id FROM pp JOIN co ON co.feature_id = pp.feature_id
      WHERE status = 'pending_acks' AND NOT EXISTS (SELECT 1 FROM ac WHERE ac.change_id = pp.change_id AND ac.project_id = co.project_id)),
rl AS (SELECT pp.*, CASE WHEN status = 'pending_acks' AND NOT EXISTS (SELECT 1 FROM ms WHERE ms.change_id = pp.change_id) THEN 'released' ELSE status END AS final FROM pp)"""
_CV = "features feature_lineage models"


def changes(w):
    proposed = w.part.where("p_retailprice < 1300 OR p_size > 48").select(F.concat(F.lit("ch"), F.col("p_partkey")).alias("change_id"), F.concat(F.lit("f"), F.col("p_partkey")).alias("feature_id"), F.lit("v2").alias("to_version"), (F.col("p_size") > 15).alias("is_breaking"))
    return ln.propose_changes(proposed, w.features, ln.consumers(w.feature_lineage, w.models))


def missing(w):
    acks = w.lineitem.where("l_quantity > 2").select(F.concat(F.lit("ch"), F.col("l_partkey")).alias("change_id"), F.concat(F.lit("p"), F.col("l_suppkey")).alias("project_id")).distinct()
    return ln.pending_acks(changes(w), ln.consumers(w.feature_lineage, w.models), acks)


@R.add("proposed_changes", check_with(_CV, CHANGES, "SELECT change_id, feature_id, from_version, to_version, is_breaking, consumers, status FROM pp"))
def proposed_changes(w):
    return changes(w)


@R.add("pending_acks", check_with(_CV, CHANGES, "SELECT change_id, feature_id, project_id FROM ms"))
def pending_acks(w):
    return missing(w)


@R.add("released_changes", check_with(_CV, CHANGES, "SELECT change_id, final AS status FROM rl"))
def released_changes(w):
    return ln.release_changes(changes(w), missing(w)).select("change_id", "status")


@R.add("feature_versions_after_release", check_with(_CV, CHANGES, "SELECT f.feature_id, coalesce(max(rl.to_version), max(f.feature_version)) AS feature_version FROM features f LEFT JOIN rl ON rl.feature_id = f.feature_id AND rl.final = 'released' GROUP BY f.feature_id"))
def feature_versions_after_release(w):
    return ln.bump_versions(w.features, ln.release_changes(changes(w), missing(w)).withColumn("number", F.lit(1)), "number").select("feature_id", "feature_version")


# A contract per brand: a column per product name, typed by the largest and smallest size seen.
OLD = "SELECT p_brand AS contract_id, p_name AS column_name, CASE WHEN max(p_size) > 45 THEN 'bigint' ELSE 'int' END AS data_type, min(p_size) < 10 AS is_nullable FROM part WHERE p_retailprice < 1700 GROUP BY 1, 2"
NEW = "SELECT p_brand AS contract_id, p_name AS column_name, CASE WHEN max(p_size) > 46 THEN 'bigint' ELSE 'int' END AS data_type, min(p_size) < 10 AS is_nullable FROM part WHERE p_retailprice > 1100 GROUP BY 1, 2"
DIFF = f"""o AS ({OLD}), n AS ({NEW}), df AS (SELECT coalesce(o.contract_id, n.contract_id) AS contract_id, coalesce(o.column_name, n.column_name) AS column_name,
    CASE WHEN o.contract_id IS NULL THEN 'added' WHEN n.contract_id IS NULL THEN 'removed' WHEN o.data_type <> n.data_type OR o.is_nullable <> n.is_nullable THEN 'modified' ELSE 'unchanged' END AS change,
    o.contract_id IS NOT NULL AND (n.contract_id IS NULL OR o.data_type <> n.data_type) AS is_breaking FROM o FULL OUTER JOIN n ON n.contract_id = o.contract_id AND n.column_name = o.column_name)"""


def contracts(w):
    return tuple(w.spark.sql(t.replace("FROM part", "FROM {part}"), part=w.part) for t in (OLD, NEW))


@R.add("contract_diff", f"WITH {DIFF} SELECT contract_id, column_name, change, is_breaking FROM df")
def contract_diff(w):
    return ln.column_diff(*contracts(w)).select("contract_id", "column_name", "change", "is_breaking")


@R.add("contract_history", f"""WITH {DIFF}, s AS (SELECT contract_id, '[' || string_agg('{{"column_name":"' || column_name || '","data_type":"' || data_type || '","is_nullable":' || CAST(is_nullable AS VARCHAR) || '}}', ',' ORDER BY column_name) || ']' AS snapshot FROM n GROUP BY 1)
SELECT df.contract_id, 4 AS version, CASE WHEN bool_or(is_breaking) THEN 'breaking' ELSE 'compatible' END AS change_type, max(snapshot) AS snapshot FROM df LEFT JOIN s ON s.contract_id = df.contract_id GROUP BY df.contract_id HAVING bool_or(change <> 'unchanged')""")
def contract_history(w):
    old, new = contracts(w)
    return st.contract_history(ln.column_diff(old, new), new, old.select("contract_id").distinct().withColumn("version", F.lit(3)))


@R.add("reusable_features", check_sql("features", """SELECT feature_table_name, count(DISTINCT lower(feature_name)) AS matches, string_agg(DISTINCT lower(feature_name), ',' ORDER BY lower(feature_name)) AS feature_names FROM features
    WHERE is_active AND is_shared AND lower(feature_name) IN (SELECT DISTINCT lower(p_name) FROM part WHERE p_brand = 'Brand#7') GROUP BY 1"""))
def reusable_features(w):
    wanted = w.part.where("p_brand = 'Brand#7'").select(F.upper("p_name").alias("column_name"))
    return ln.reusable_features(wanted, w.features).withColumn("feature_names", array_text(F.col("feature_names")))


@R.add("training_set", """SELECT o_orderkey, o_orderstatus AS label, c_acctbal, c_nationkey, n AS order_lines, q AS max_quantity FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey""")
def training_set(w):
    lines = w.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("order_lines"), F.max("l_quantity").alias("max_quantity"))
    people = w.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey")
    base = w.orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("label"))
    return ln.training_set(base, [(people, ["o_custkey"], ["c_acctbal", "c_nationkey"], None), (lines, ["o_orderkey"], ["order_lines", "max_quantity"], None)], exclude=["o_custkey"])


@R.add("feature_versions_by_time", """WITH ch AS (SELECT concat('f', l_partkey) AS feature_id, concat('v', l_linenumber, '.', l_suppkey) AS to_version, concat('ch', l_orderkey, '-', l_linenumber) AS change_id, l_shipdate,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, concat('ch', l_orderkey, '-', l_linenumber) DESC) AS rn FROM lineitem WHERE l_returnflag <> 'A')
    SELECT concat('f', p_partkey) AS feature_id, coalesce(to_version, 'v1') AS feature_version FROM part LEFT JOIN ch ON feature_id = concat('f', p_partkey) AND rn = 1""")
def feature_versions_by_time(w):
    done = w.lineitem.select(
        F.concat(F.lit("f"), F.col("l_partkey")).alias("feature_id"), F.concat(F.lit("v"), F.col("l_linenumber"), F.lit("."), F.col("l_suppkey")).alias("to_version"),
        F.concat(F.lit("ch"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("change_id"), F.when(F.col("l_returnflag") == "A", "pending_acks").otherwise("released").alias("status"), "l_shipdate",
    )
    return ln.bump_versions(w.features, done, "l_shipdate").select("feature_id", "feature_version")


@R.add("training_set_latest", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem)
    SELECT o_orderkey, o_orderstatus AS label, l_quantity AS last_quantity, l_extendedprice AS last_price FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND rn = 1""")
def training_set_latest(w):
    history = w.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("last_quantity"), F.col("l_extendedprice").alias("last_price"), "l_shipdate")
    return ln.training_set(w.orders.select("o_orderkey", F.col("o_orderstatus").alias("label")), [(history, ["o_orderkey"], ["last_quantity", "last_price"], "l_shipdate")])


def _pit(extra=""):
    return f"""SELECT l.event_id, l.user_id, f.value AS feature_value, strftime(f.ts, '%Y-%m-%d %H:%M:%S') AS feature_at FROM (SELECT * FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type <> 'purchase') f ON f.user_id = l.user_id AND f.ts <= l.ts{extra}"""


def _pit_query(w, lookback=None):
    labels = w.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    rows = w.events.where("event_type <> 'purchase'").select("user_id", F.col("ts").alias("feature_ts"), F.col("event_id").alias("tie"), F.col("value").alias("feature_value"))
    out = ln.point_in_time_set(labels, rows, ["user_id"], "ts", "feature_ts", "tie", ["feature_value"], lookback)
    return out.select("event_id", "user_id", "feature_value", stamp("matched_ts").alias("feature_at"))


@R.add("point_in_time_training_set", _pit())
def point_in_time_training_set(w):
    return _pit_query(w)


@R.add("point_in_time_lookback", f"SELECT event_id, user_id, CASE WHEN ok THEN feature_value END AS feature_value, CASE WHEN ok THEN feature_at END AS feature_at FROM (SELECT z.*, f_ts >= l_ts - INTERVAL 1 DAY AS ok FROM ({_pit().replace('SELECT l.event_id', 'SELECT f.ts AS f_ts, l.ts AS l_ts, l.event_id')}) z) y")
def point_in_time_lookback(w):
    return _pit_query(w, 1)


@R.add("pinned_features", """WITH f AS (SELECT concat('f', l_partkey) AS feature_id, l_linenumber AS feature_version, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2),
pn AS (SELECT DISTINCT concat('p', l_suppkey) AS project_id, concat('f', l_partkey) AS feature_id, CASE WHEN l_suppkey < 40 THEN 2 END AS pin FROM lineitem), nw AS (SELECT feature_id, max(feature_version) AS top FROM f GROUP BY 1)
SELECT pn.project_id, pn.feature_id, f.feature_version, f.v AS feature_value FROM pn JOIN nw ON nw.feature_id = pn.feature_id JOIN f ON f.feature_id = pn.feature_id AND f.feature_version = coalesce(pin, top)""")
def pinned_features(w):
    rows = w.lineitem.groupBy(F.concat(F.lit("f"), F.col("l_partkey")).alias("feature_id"), F.col("l_linenumber").alias("feature_version")).agg(F.round(F.avg("l_quantity"), 6).alias("feature_value"))
    pins = w.lineitem.select(F.concat(F.lit("p"), F.col("l_suppkey")).alias("project_id"), F.concat(F.lit("f"), F.col("l_partkey")).alias("feature_id"), F.when(F.col("l_suppkey") < 40, 2).alias("pinned_version")).distinct()
    return ln.pinned_features(rows, pins).select("project_id", "feature_id", "feature_version", "feature_value")


@R.add("entity_features", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS s, count(value) AS n FROM events GROUP BY 1, 2)
SELECT user_id, strftime(day, '%Y-%m-%d') AS feature_date, round(sum(s) OVER l, 8) AS lifetime_sum, CAST(sum(n) OVER l AS BIGINT) AS lifetime_count, CAST(day - lag(day) OVER (PARTITION BY user_id ORDER BY day) AS VARCHAR) AS days_since_last,
  round(sum(s) OVER w7, 8) AS sum_7d, CAST(sum(n) OVER w7 AS BIGINT) AS count_7d, round(sum(s) OVER w7 / sum(n) OVER w7, 8) AS mean_7d, round(sum(s) OVER w30, 8) AS sum_30d, CAST(sum(n) OVER w30 AS BIGINT) AS count_30d, round(sum(s) OVER w30 / sum(n) OVER w30, 8) AS mean_30d
FROM d WINDOW l AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), w7 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""")
def entity_features(w):
    out = ln.entity_features(w.events, "user_id", "ts", "value", {"7d": 7, "30d": 30})
    out = out.withColumn("feature_date", F.col("feature_date").cast("string")).withColumn("days_since_last", F.col("days_since_last").cast("string"))
    return out.select(*[F.round(c, 8).alias(c) if c.startswith(("sum", "mean", "lifetime_sum")) else F.col(c) for c in out.columns])


EDGES = """e AS (SELECT DISTINCT concat('c', o_custkey) AS parent, concat('o', o_orderkey) AS child FROM orders UNION SELECT DISTINCT concat('o', l_orderkey), concat('s', l_suppkey) FROM lineitem
    UNION SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier UNION SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation)"""


@R.add("downstream_lineage", f"""WITH RECURSIVE {EDGES}, src AS (SELECT concat('c', c_custkey) AS source FROM customer WHERE c_acctbal < -900),
w AS (SELECT source, child AS node, 1 AS hops FROM src JOIN e ON e.parent = source UNION SELECT w.source, e.child, w.hops + 1 FROM w JOIN e ON e.parent = w.node)
SELECT source, node, min(hops) AS hops FROM w GROUP BY source, node""")
def downstream_lineage(w):
    def edge(df, a, ac, b, bc):
        return df.select(F.concat(F.lit(a), F.col(ac)).alias("parent"), F.concat(F.lit(b), F.col(bc)).alias("child"))

    edges = edge(w.orders, "c", "o_custkey", "o", "o_orderkey").unionByName(edge(w.lineitem, "o", "l_orderkey", "s", "l_suppkey"))
    edges = edges.unionByName(edge(w.supplier, "s", "s_suppkey", "n", "s_nationkey")).unionByName(edge(w.nation, "n", "n_nationkey", "r", "n_regionkey"))
    return ln.downstream(edges, w.customer.where("c_acctbal < -900").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("source")))


WEIGHTS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
# line items have no key of their own, so the twin numbers them
_ROWS = "li AS (SELECT row_number() OVER () AS rid, * FROM lineitem)"
_CELLS = " UNION ALL ".join(f"SELECT rid, '{c}' AS feature, CAST({e} AS DOUBLE) AS weight FROM li" for c, e in zip(WEIGHTS, ("25 - l_quantity", "l_discount * 100", "l_tax * 300", "l_linenumber")))


def contributions(w):
    values = (25 - F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 300, F.col("l_linenumber").cast("double"))
    cells = [x for pair in zip([F.lit(c) for c in WEIGHTS], values) for x in pair]
    return w.lineitem.select(F.struct("l_orderkey", "l_partkey", "l_suppkey").alias("row"), F.create_map(*cells).alias("weights"))


_TOP = f"{_ROWS}, x AS ({_CELLS}), t AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(weight) DESC, feature) AS rn FROM x)"


@R.add("top_features_per_prediction", f"WITH {_TOP} SELECT feature, CAST(rn AS INT) AS \"rank\", count(*) AS n, round(sum(weight), 3) AS weight FROM t WHERE rn <= 2 GROUP BY 1, 2")
def top_features_per_prediction(w):
    return ln.top_contributions(contributions(w), "row", "weights", 2).groupBy("feature", "rank").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight"))


@R.add("top_features_overall", f"WITH {_ROWS}, x AS ({_CELLS}) SELECT feature, round(avg(abs(weight)), 6) AS mean_abs_weight FROM x GROUP BY 1 ORDER BY avg(abs(weight)) DESC, feature LIMIT 3")
def top_features_overall(w):
    return ln.mean_contributions(contributions(w), "weights", 3).withColumn("mean_abs_weight", F.round("mean_abs_weight", 6))


@R.add("sensitive_features_in_top", f"WITH {_TOP} SELECT feature, count(*) AS n FROM t WHERE rn <= 2 AND feature IN ('l_tax', 'l_discount') GROUP BY 1")
def sensitive_features_in_top(w):
    hits = ln.sensitive_in_top(ln.top_contributions(contributions(w), "row", "weights", 2), ["L_TAX", "l_discount"])
    return hits.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


# ── sources and snapshots ──

_TYPES = (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string"))


@R.add("described_columns", " UNION ALL ".join(f"SELECT {i} AS column_order, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count(*) - count({c}) AS null_count FROM customer" for i, (c, t) in enumerate(_TYPES)))
def described_columns(w):
    return tb.infer_schema(w.customer).drop("comment").join(null_counts(w.customer, w.customer.columns), "column_name")


@R.add("sampled_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 5000")
def sampled_rows(w):
    return tb.sample_rows(w.orders.select("o_orderkey", "o_custkey"), key="o_orderkey")


@R.add("sql_with_parameters", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1")
def sql_with_parameters(w):
    return tb.run_sql(w.spark, "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_totalprice > :floor AND o_orderstatus = :status GROUP BY 1", {"floor": 100000.0, "status": "F"}, orders=w.orders)


@R.add("csv_contract_import", " UNION ALL ".join(f"SELECT 'c1' AS contract_id, {i} AS column_order, '{c}' AS column_name, '{'int' if t == 'bigint' else t}' AS data_type, count(*) AS row_count FROM customer" for i, (c, t) in enumerate(_TYPES)))
def csv_contract_import(w):
    path = fresh_folder(w.spark, "csv")
    w.customer.write.csv(path, header=True)
    rows, columns = tb.import_csv(w.spark, path, "c1")
    return columns.drop("is_nullable").join(null_counts(rows, rows.columns).select("column_name", "row_count"), "column_name")


@R.add("appended_predictions", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity * 2), 2) AS total FROM lineitem GROUP BY 1")
def appended_predictions(w):
    path = fresh_folder(w.spark, "predictions")
    tb.append(w.lineitem.select("l_orderkey", "l_returnflag", (F.col("l_quantity") * 2).alias("prediction")), path, ["l_returnflag"])
    return w.spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prediction"), 2).alias("total"))


@R.add("snapshot_manifest", """SELECT 'p1' AS project_id, 'sales.orders' AS source_table, 'snapshot_orders_20010801_000000' AS snapshot_table, count(*) AS row_count FROM orders
    UNION ALL SELECT 'p1', 'sales.customer', 'snapshot_customer_20010801_000000', count(*) FROM customer""")
def snapshot_manifest(w):
    root = fresh_folder(w.spark, "snapshots")
    for _ in range(2):  # the second pass finds both copies and adds nothing
        sn.snapshot_all(w.spark, root, {"sales.orders": w.orders, "sales.customer": w.customer}, project_id="p1", as_of=AS_OF)
    return sn.manifest(w.spark, root).select("project_id", "source_table", "snapshot_table", "row_count")


@R.add("published_versions", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def published_versions(w):
    root = fresh_folder(w.spark, "tables")
    sn.publish(w.spark, root, "orders", w.orders, AS_OF)
    now = sn.read_current(w.spark, root, "orders")
    sn.publish(w.spark, root, "orders", now.where("o_orderstatus <> 'P'"), AS_OF)
    return sn.read_current(w.spark, root, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@R.add("data_version_manifest", """SELECT concat('p', l_suppkey) AS project_id, count(*) AS total_rows, 7 AS sources, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY 1""")
def data_version_manifest(w):
    rows = w.lineitem.groupBy(F.concat(F.lit("p"), F.col("l_suppkey")).alias("project_id"), F.concat(F.lit("lines_"), F.col("l_linenumber")).alias("source_table")).agg(F.count(F.lit(1)).alias("row_count"), F.lit(1).cast("long").alias("source_version"))
    parts = w.lineitem.select(F.concat(F.lit("p"), F.col("l_suppkey")).alias("project_id"), "l_partkey").distinct().groupBy("project_id").agg(F.count(F.lit(1)).alias("parts"))
    quality = w.projects.select("project_id", F.lit("good").alias("quality_status"))
    return sn.version_manifest(rows, parts, quality, "c0de").select("project_id", "total_rows", F.size("sources").alias("sources"), "parts")


@R.add("data_versions", """WITH src AS (SELECT concat('p', l_suppkey) AS project_id, concat('lines_', l_linenumber) AS source_table, count(*) AS row_count FROM lineitem GROUP BY 1, 2),
js AS (SELECT project_id, '[' || string_agg('{"source_table":"' || source_table || '","source_version":1,"row_count":' || row_count || '}', ',' ORDER BY source_table) || ']' AS sources, CAST(sum(row_count) AS BIGINT) AS total_rows FROM src GROUP BY 1),
pa AS (SELECT project_id, '[' || string_agg('"' || d || '"', ',' ORDER BY d) || ']' AS parents FROM (SELECT DISTINCT concat('p', l_suppkey) AS project_id, l_returnflag AS d FROM lineitem WHERE l_tax > 0.07) z GROUP BY 1)
SELECT js.project_id, sources, total_rows, CASE WHEN s_acctbal < 2000 THEN 'poor' ELSE 'good' END AS quality_status, 'c0de' AS code_hash, coalesce(parents, '[]') AS parent_datasets, sha256(concat(js.project_id, ':', sources, ':c0de:', coalesce(parents, '[]'))) AS data_version_id
FROM js LEFT JOIN pa ON pa.project_id = js.project_id LEFT JOIN supplier ON concat('p', s_suppkey) = js.project_id""")
def data_versions(w):
    project = F.concat(F.lit("p"), F.col("l_suppkey")).alias("project_id")
    rows = w.lineitem.groupBy(project, F.concat(F.lit("lines_"), F.col("l_linenumber")).alias("source_table")).agg(F.count(F.lit(1)).alias("row_count"), F.lit(1).cast("long").alias("source_version"))
    quality = w.projects.select("project_id", F.when(F.col("balance") < 2000, "poor").otherwise("good").alias("quality_status"))
    parents = w.lineitem.where("l_tax > 0.07").select(project, F.col("l_returnflag").alias("parent_dataset"))
    out = sn.version_manifest(rows, w.projects.select("project_id"), quality, "c0de", parents)
    return out.select("project_id", F.to_json("sources").alias("sources"), "total_rows", "quality_status", "code_hash", F.to_json("parent_datasets").alias("parent_datasets"), "data_version_id")


@R.add("scanned_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def scanned_table(w):
    w.orders.createOrReplaceTempView("modelward_scanned_orders")
    return tb.scan(w.spark, "modelward_scanned_orders").select("o_orderkey", "o_orderstatus")


@R.add("recorded_pass", "SELECT 'score' AS job_name, count(*) AS rows_examined, count(*) FILTER (o_orderstatus = 'P') AS rows_changed, 'ok' AS status FROM orders")
def recorded_pass(w):
    root = fresh_folder(w.spark, "passes")
    tb.record_pass("score", w.orders, lambda df: df.where("o_orderstatus = 'P'").select("o_orderkey"), f"{root}/out", f"{root}/log", AS_OF)
    return st.run_health(w.spark.read.parquet(f"{root}/log")).select("job_name", "rows_examined", "rows_changed", "status")
