import random

import pytest
from pyspark.sql import functions as F

from modelward.functions import bloom
from modelward.operators import approvals as ap
from modelward.operators import cost
from modelward.operators import governance as g
from modelward.operators import lineage as ln
from modelward.operators import state as st

NOW = "2024-06-30 12:00:00"
TIERS = "project_id STRING, revalidation_frequency_days INT, on_revalidation_due STRING"
FLAGS = "project_id STRING, uc_full_name STRING, status STRING, cleared_timestamp STRING"


def revalidate(spark, promoted, tiers, flag=None):
    champ = spark.createDataFrame([("p", "m", 3, promoted)], "project_id STRING, uc_full_name STRING, champion_version INT, promoted_timestamp STRING")
    champ = champ.withColumn("promoted_timestamp", F.col("promoted_timestamp").cast("timestamp_ntz"))
    held = spark.createDataFrame([("p", "m", *flag)] if flag else [], FLAGS).withColumn("cleared_timestamp", F.col("cleared_timestamp").cast("timestamp_ntz"))
    return g.revalidate(champ, spark.createDataFrame([("p", *t) for t in tiers], TIERS), held, NOW).first()


def test_revalidation_cases(spark):
    tiers = [(90, "warn"), (30, "block_new_traffic")]
    out = revalidate(spark, "2024-01-01 00:00:00", tiers)
    assert (out.transition, out.status, out.on_due_action, out.frequency_days) == ("flagged", "due", "block_new_traffic", 30)
    assert revalidate(spark, "2024-06-20 00:00:00", tiers).transition == "unchanged"
    unknown = revalidate(spark, None, [(365, "warn")])
    assert (unknown.transition, unknown.frequency_days) == ("flagged", 365)
    assert revalidate(spark, "2024-01-01 00:00:00", tiers, ("due", None)).transition == "unchanged"
    assert revalidate(spark, "2024-01-01 00:00:00", tiers, ("in_revalidation", None)).status == "in_revalidation"
    assert revalidate(spark, "2024-06-20 00:00:00", tiers, ("due", None)).transition == "cleared"
    assert revalidate(spark, "2024-01-01 00:00:00", tiers, ("cleared", "2024-06-25 00:00:00")).transition == "unchanged"
    partly = revalidate(spark, "2024-05-01 00:00:00", tiers)
    assert (partly.on_due_action, partly.frequency_days) == ("block_new_traffic", 30)
    assert revalidate(spark, "2024-05-31 13:00:00", [(30, "warn")]).transition == "unchanged"  # 29 whole days
    assert revalidate(spark, None, [(30, "shout")]).on_due_action == "warn"


def budget(spark, spend, threshold=1000.0, last=None):
    b = spark.createDataFrame([("b", "p", "monthly", threshold, 80.0, True, last)], "budget_id STRING, project_id STRING, budget_period STRING, budget_threshold_usd DOUBLE, alert_at_pct DOUBLE, enabled BOOLEAN, last_alerted_period STRING")
    c = spark.sql(f"SELECT 'p' AS project_id, DATE '2024-06-20' AS date, CAST({spend} AS DOUBLE) AS total_cost_usd")
    return b, cost.budget_checks(b, c, NOW)


def test_budget_cases(spark):
    from datetime import date

    bucket = str(date(2024, 6, 30).toordinal() // 30)
    assert budget(spark, 100)[1].first().outcome == "under"
    b, out = budget(spark, 900)
    assert (out.first().outcome, out.first().period_bucket) == ("alert", bucket)
    assert cost.mark_alerted(b, out).first().last_alerted_period == bucket
    assert budget(spark, 900, last=bucket)[1].first().outcome == "repeated"
    assert budget(spark, 900, threshold=0.0)[1].first().outcome == "skipped"
    assert budget(spark, 800)[1].first().outcome == "alert"  # the limit itself alerts


def test_control_plane_budget(spark):
    rows = lambda usd: spark.sql(f"SELECT DATE '2024-06-20' AS date, CAST({usd} AS DOUBLE) AS total_cost_usd")
    status = lambda df: cost.plane_budget(df, NOW, 50.0, 100.0).first()
    assert [status(rows(u)).status for u in (10, 50, 100)] == ["ok", "warning", "critical"]
    empty = status(rows(1).where("false"))
    assert (empty.total_usd, empty.status) == (0.0, "ok")


def test_prices_in_force(spark):
    usage = spark.sql("SELECT 's' AS sku_name, t AS usage_start_time, CAST(t AS DATE) AS usage_date, 2.0D AS usage_quantity, map('project_id', 'p') AS custom_tags FROM VALUES (TIMESTAMP_NTZ '2023-12-31 23:59:59'), (TIMESTAMP_NTZ '2024-01-01 00:00:00'), (TIMESTAMP_NTZ '2030-05-05 00:00:00'), (TIMESTAMP_NTZ '2019-01-01 00:00:00') AS v(t)")
    prices = spark.sql("SELECT 's' AS sku_name, a AS price_start_time, b AS price_end_time, named_struct('effective_list', named_struct('default', p)) AS pricing FROM VALUES (TIMESTAMP_NTZ '2020-01-01 00:00:00', TIMESTAMP_NTZ '2024-01-01 00:00:00', 1.0D), (TIMESTAMP_NTZ '2024-01-01 00:00:00', NULL, 3.0D) AS v(a, b, p)")
    for days, salts in ((7, 1), (365, 5), (4000, 1)):
        rows = cost.price_in_force(usage, prices, days, salts).collect()
        assert sorted((r.usage_start_time.year, r.unit_price) for r in rows) == [(2023, 1.0), (2024, 3.0), (2030, 3.0)]
    assert cost.overlapping_prices(prices).count() == 0
    wide = prices.withColumn("price_end_time", F.lit(None).cast("timestamp_ntz"))
    assert cost.overlapping_prices(wide).first().price_start_time.year == 2024


def test_a_price_list_is_not_broadcast(spark, tmp_path):
    spark.sql("SELECT id AS sku_name, named_struct('effective_list', named_struct('default', 2.0D)) AS pricing FROM range(300)").write.parquet(f"{tmp_path}/skus")
    # a small file of SKUs makes many windows, each cut into many buckets
    windows = "explode(sequence(timestamp_ntz'2000-01-01', timestamp_ntz'2009-01-01', interval 1 year)) AS price_start_time"
    prices = spark.read.parquet(f"{tmp_path}/skus").selectExpr("*", windows).withColumn("price_end_time", F.col("price_start_time") + F.expr("INTERVAL 1 YEAR"))
    usage = spark.sql("SELECT id % 300 AS sku_name, timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS usage_start_time, date'2001-01-01' AS usage_date, 1.0D AS usage_quantity FROM range(900)")
    for salts in (1, 3):
        priced = cost.price_in_force(usage, prices, 7, salts)
        assert "Broadcast" not in priced._jdf.queryExecution().executedPlan().toString()
        assert priced.count() == 900


def test_reliability_and_speed_when_empty(spark):
    d = spark.sql("SELECT 'deployed' AS status, TIMESTAMP_NTZ '2024-06-01 00:00:00' AS created_timestamp, 'h' AS plan_hash FROM range(8) UNION ALL SELECT 'failed', TIMESTAMP_NTZ '2024-06-01 00:00:00', 'h' UNION ALL SELECT 'verify_failed', TIMESTAMP_NTZ '2024-06-01 00:00:00', 'h'")
    out = g.reliability(d, NOW).first()
    assert (out.deployments, out.failed, out.failure_rate_pct) == (10, 2, 20.0)
    assert g.reliability(d.where("false"), NOW).first().failure_rate_pct is None
    a = spark.sql("SELECT 'approved' AS status, 'h' AS plan_hash, TIMESTAMP_NTZ '2024-05-31 22:30:00' AS completed_timestamp")
    assert g.speed(a, d.limit(1), NOW).first().avg_approval_to_deploy_hours == 1.0  # 1.5 h counts as one whole hour
    assert g.speed(a, d.where("false"), NOW).first().promotions == 0


def test_impact_split(spark):
    impact = spark.sql("SELECT p AS project_id, DATE '2024-06-01' AS period_end, u AS revenue_lift_usd, CAST(NULL AS DOUBLE) AS loss_avoided_usd FROM VALUES ('p1', 10000D), ('p2', 5000D), ('p3', 2500D) AS v(p, u)")
    fns = spark.sql("SELECT 'p1' AS project_id, DATE '2024-01-01' AS last_reviewed_date UNION ALL SELECT 'p2', DATE '2020-01-01'")
    out = {r.confidence: (r.impact_usd, r.projects) for r in g.business_impact(impact, fns, NOW).collect()}
    assert out == {"high": (10000.0, 1), "low": (7500.0, 2)}
    assert sorted(r.project_id for r in g.unreviewed_projects(impact, fns, NOW).collect()) == ["p2", "p3"]


def test_run_health(spark):
    rows = [("j", 1, 5, None), ("j", 2, 0, "boom"), ("j", 3, 0, None), ("j", 4, 0, None), ("k", 1, 0, None)]
    df = spark.createDataFrame(rows, "job_name STRING, d INT, rows_changed BIGINT, error STRING")
    df = df.withColumn("run_timestamp", F.timestamp_add("DAY", F.col("d") * 20, F.lit("2024-01-01").cast("timestamp_ntz"))).withColumn("run_id", F.concat("job_name", F.col("d").cast("string")))
    assert {r.run_id: r.status for r in st.run_health(df).collect()} == {"j1": "ok", "j2": "failed", "j3": "warning", "j4": "ok", "k1": "ok"}


def test_revalidation_complete(spark):
    flags = spark.sql("SELECT 'p' AS project_id, u AS uc_full_name, 'in_revalidation' AS status, ids AS revalidation_approval_ids FROM VALUES ('all', array('1', '2')), ('pending', array('1', '3')), ('missing', array('1', '9')), ('none', array()) AS v(u, ids)")
    done = spark.createDataFrame([("1", "approved"), ("2", "approved"), ("3", "pending")], "approval_id STRING, status STRING")
    assert {r.uc_full_name: r.is_complete for r in g.revalidation_complete(flags, done).collect()} == {"all": True, "pending": False, "missing": False, "none": False}


def test_starting_and_clearing_a_revalidation(spark):
    flags = spark.sql("SELECT p AS project_id, 'm' AS uc_full_name, s AS status, CAST(array() AS ARRAY<STRING>) AS revalidation_approval_ids, CAST(NULL AS TIMESTAMP_NTZ) AS cleared_timestamp FROM VALUES ('p', 'due'), ('q', 'due'), ('r', 'cleared') AS v(p, s)")
    gates = spark.createDataFrame([("p", "legal"), ("p", "risk"), ("r", "legal")], "project_id STRING, approval_gate STRING")
    models = spark.createDataFrame([("m1", "p"), ("m3", "r")], "model_id STRING, project_id STRING")
    opened, moved = g.start_revalidation(flags, gates, models, "ann", NOW)
    assert sorted(r.approval_gate for r in opened.collect()) == ["legal", "risk"]
    assert {r.project_id: (r.status, len(r.revalidation_approval_ids)) for r in moved.collect()} == {"p": ("in_revalidation", 2), "q": ("due", 0), "r": ("cleared", 0)}
    voted = opened.withColumn("status", F.lit("approved"))
    out = {r.project_id: r.status for r in g.clear_completed(moved, g.revalidation_complete(moved, voted), NOW).collect()}
    assert out == {"p": "cleared", "q": "due", "r": "cleared"}
    assert {r.project_id: r.status for r in g.clear_completed(moved, g.revalidation_complete(moved, opened), NOW).collect()}["p"] == "in_revalidation"


# ── votes ──

VOTES = "approval_id STRING, voter STRING, decision STRING, event_id BIGINT"


def vote_frame(spark, rows):
    return spark.createDataFrame(rows, VOTES).withColumn("event_time", F.timestamp_seconds(F.col("event_id") / 3).cast("timestamp_ntz"))


def plain_fold(rows, need):
    out, gates = {}, {}
    for a, voter, decision, i in sorted(rows, key=lambda r: r[3]):
        if a not in need:
            out[i] = (False, "unknown gate")
            continue
        s = gates.setdefault(a, {"status": "pending", "seen": set(), "yes": 0})
        if decision not in ap.GATE_DECISIONS:
            out[i] = (False, "invalid decision")
        elif voter in s["seen"]:
            out[i] = (False, "already voted")
        elif s["status"] != "pending":
            out[i] = (False, f"gate already {s['status']}")
        else:
            out[i] = (True, "")
            s["seen"].add(voter)
            s["yes"] += decision == "approve"
            if decision == "reject":
                s["status"] = "rejected"
            elif decision == "approve" and s["yes"] >= need[a]:
                s["status"] = "approved"
    return out, {a: s["status"] for a, s in gates.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_votes_fold_like_one_at_a_time(spark, seed):
    rnd = random.Random(seed)
    need = {f"g{i}": 1 + i % 4 for i in range(8)}
    rows = [("g1" if rnd.random() < 0.4 else f"g{rnd.randrange(9)}", f"v{rnd.randrange(7)}", rnd.choice(["approve"] * 4 + ["reject", "request_changes", "maybe"]), i) for i in range(250)]
    want, states = plain_fold(rows, need)
    rnd.shuffle(rows)  # the order of the log must not matter
    gates = spark.createDataFrame(list(need.items()), "approval_id STRING, required_count INT")
    got = {r.event_id: (r.recorded, r.reason) for r in ap.fold_votes(vote_frame(spark, rows), gates).collect()}
    assert got == want
    final = {r.approval_id: r.status for r in ap.gate_state(vote_frame(spark, rows), gates).collect()}
    assert {a: final[a] for a in states} == states


def test_revocations(spark):
    gates = spark.createDataFrame([("a", "approved", "gate"), ("b", "pending", "gate"), ("c", "approved", "revocation")], "approval_id STRING, status STRING, approval_type STRING")
    asked = spark.createDataFrame([("r1", "a", "ann"), ("r2", "b", "ann"), ("r3", "c", "ann"), ("r4", "x", "ann")], "revocation_id STRING, approval_id STRING, requested_by STRING")
    assert {r.revocation_id: r.status for r in ap.revocation_requests(asked, gates).collect()} == {"r1": "pending", "r2": "refused", "r3": "refused", "r4": "refused"}
    votes = vote_frame(spark, [("a", "bob", "approve", 1)])
    made = vote_frame(spark, [("r1", "ann", "approve", 1), ("r1", "bob", "approve", 2), ("r1", "cy", "request_changes", 3), ("r1", "dee", "reject", 4), ("r1", "eve", "approve", 5)])
    made = made.withColumnsRenamed({"approval_id": "revocation_id", "voter": "decider"})
    got = {r.decider: r.reason for r in ap.revocation_decisions(made, asked, votes).collect()}
    assert got == {"ann": "requester may not decide", "bob": "original voter may not decide", "cy": "", "dee": "", "eve": "already decided"}


def test_first_review_decision_wins(spark):
    queue = spark.createDataFrame([("1", None), ("2", "approved")], "prediction_id STRING, decision STRING")
    rows = [("1", "a", "overridden", "", 1), ("1", "b", "rejected", "", 2), ("1", "c", "approved", "", 3), ("2", "a", "approved", "", 1), ("3", "a", "approved", "", 1), ("1", "d", "maybe", "", 0)]
    made = spark.createDataFrame(rows, "prediction_id STRING, reviewer_email STRING, decision STRING, overridden_value STRING, event_id BIGINT").withColumn("event_time", F.timestamp_seconds("event_id"))
    got = {(r.prediction_id, r.reviewer_email): r.reason for r in ap.fold_decisions(made, queue).collect()}
    assert got == {("1", "a"): "override needs a value", ("1", "b"): "", ("1", "c"): "already decided (rejected) by b", ("2", "a"): "already decided (approved)", ("3", "a"): "not in the review queue", ("1", "d"): "invalid decision"}


def test_escalation_never_decides(spark):
    queue = spark.sql("SELECT id AS prediction_id, 'p' AS project_id, ts AS presented_timestamp, d AS decision, false AS escalated FROM VALUES ('late', TIMESTAMP_NTZ '2024-06-30 11:29:59', NULL), ('edge', TIMESTAMP_NTZ '2024-06-30 11:30:00', NULL), ('done', TIMESTAMP_NTZ '2024-06-01 00:00:00', 'approved') AS v(id, ts, d)")
    out = {r.prediction_id: (r.breached, r.decision) for r in ap.escalate(queue, NOW, 30).collect()}
    assert out == {"late": (True, None), "edge": (False, None), "done": (False, "approved")}


# ── generic transitions ──


def test_upsert_is_idempotent_and_takes_one_change_per_key(spark):
    cur = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k STRING, v INT, w STRING")
    chg = spark.createDataFrame([("b", 20, "z"), ("b", 21, "q"), ("c", 30, "n")], "k STRING, v INT, w STRING")
    once = st.merge_upsert(cur, chg, ["k"], ["v"], [F.asc("v")], "what")
    assert {tuple(r) for r in once.collect()} == {("a", 1, "x", "kept"), ("b", 20, "y", "updated"), ("c", 30, "n", "inserted")}
    twice = st.merge_upsert(once.drop("what"), chg, ["k"], ["v"], [F.asc("v")])
    assert {tuple(r) for r in twice.collect()} == {tuple(r)[:3] for r in once.collect()}
    assert {tuple(r) for r in st.upsert_touched(cur, chg.where("k = 'b'"), ["k"], ["v"], [F.asc("v")], "k").collect()} == {("b", 20, "y")}


def test_update_can_set_null(spark):
    cur = spark.createDataFrame([("a", 1)], "k STRING, v INT")
    assert st.merge_upsert(cur, spark.createDataFrame([("a", None)], "k STRING, v INT"), ["k"], ["v"], [F.asc("v")]).first().v is None


def test_insert_replace_and_versions(spark):
    cur = spark.createDataFrame([("a", 1)], "k STRING, version INT")
    new = spark.createDataFrame([("a", 5), ("a", 4), ("b", 1), ("b", 2)], "k STRING, o INT")
    assert sorted(tuple(r) for r in st.next_versions(cur, new, "k", "version", "o").collect()) == [("a", 4, 2), ("a", 5, 3), ("b", 1, 1), ("b", 2, 2)]
    ins = st.insert_if_absent(cur, new, ["k"], [F.asc("o")])
    assert [tuple(r) for r in ins.collect()] == [("b", 1)]
    assert sorted(tuple(r) for r in st.replace_rows(new, spark.createDataFrame([("a", 9)], "k STRING, o INT"), ["k"]).collect()) == [("a", 9), ("b", 1), ("b", 2)]


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    one = st.fingerprint(df).first()
    assert one == st.fingerprint(df.orderBy(F.desc("id"))).first() and one != st.fingerprint(df.withColumn("v", F.col("v") + 1)).first()
    tables = spark.createDataFrame([("x", "y", "z"), ("x", "x", "x"), ("x", "x", "z"), (None, "y", "z")], "recorded STRING, found STRING, proposed STRING")
    assert [r.outcome for r in st.publish_decisions(tables).collect()] == ["blocked", "unchanged", "write", "write"]
    assert [r.outcome for r in st.publish_decisions(tables, force=True).collect()] == ["write", "unchanged", "write", "write"]


def test_settings_hash_ignores_order_and_itself(spark):
    h = lambda *kv: spark.range(1).select(st.settings_hash(F.create_map(*[F.lit(x) for x in kv])).alias("h")).first().h
    assert h("a", "1", "b", "2") == h("b", "2", "config_hash", "old", "a", "1") != h("a", "1", "b", "3")


def test_feature_changes(spark):
    feats = spark.createDataFrame([("f", "v1"), ("g", "v1")], "feature_id STRING, feature_version STRING")
    lineage = spark.sql("SELECT 'f' AS feature_id, array('m1', 'm2') AS downstream_model_ids")
    models = spark.createDataFrame([("m1", "p1"), ("m2", "p2")], "model_id STRING, project_id STRING")
    uses = ln.consumers(lineage, models)
    asked = spark.createDataFrame([("c1", "f", "v2", True), ("c2", "f", "v3", False), ("c3", "g", "v2", True)], "change_id STRING, feature_id STRING, to_version STRING, is_breaking BOOLEAN")
    made = ln.propose_changes(asked, feats, uses)
    assert {r.change_id: r.status for r in made.collect()} == {"c1": "pending_acks", "c2": "released", "c3": "released"}
    acks = spark.createDataFrame([("c1", "p1")], "change_id STRING, project_id STRING")
    missing = ln.pending_acks(made, uses, acks)
    assert [r.project_id for r in missing.collect()] == ["p2"]
    assert {r.change_id: r.status for r in ln.release_changes(made, missing).collect()}["c1"] == "pending_acks"
    full = ln.pending_acks(made, uses, acks.unionByName(spark.createDataFrame([("c1", "p2")], acks.schema)))
    assert {r.change_id: r.status for r in ln.release_changes(made, full).collect()}["c1"] == "released"


def test_training_set_takes_the_latest_row_of_a_key(spark):
    base = spark.createDataFrame([(i, i % 2) for i in range(4)], "entity_id INT, label INT")
    feats = spark.createDataFrame([(0, 1.5, 0.0, "2024-01-01"), (0, 1.0, 2.0, "2024-02-01"), (0, 0.5, 9.0, "2024-02-01"), (1, 3.0, 4.0, None)], "entity_id INT, a DOUBLE, b DOUBLE, at STRING")
    rows = ln.training_set(base, [(feats, ["entity_id"], ["a", "b"], "at")]).orderBy("entity_id").collect()
    assert [(r.a, r.b) for r in rows] == [(1.0, 2.0), (3.0, 4.0), (None, None), (None, None)]
    with pytest.raises(Exception, match="several rows of one key"):
        ln.training_set(base, [(feats, ["entity_id"], ["a", "b"], None)]).collect()


def test_versions_go_by_time_and_not_by_text(spark):
    feats = spark.createDataFrame([("f", "v1"), ("g", "v1")], "feature_id STRING, feature_version STRING")
    done = spark.createDataFrame([("c9", "f", "v2", "released", 9), ("c10", "f", "v3", "released", 10), ("c11", "f", "v4", "pending_acks", 11)], "change_id STRING, feature_id STRING, to_version STRING, status STRING, number INT")
    assert {r.feature_id: r.feature_version for r in ln.bump_versions(feats, done, "number").collect()} == {"f": "v3", "g": "v1"}


def test_lineage_stops_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent STRING, child STRING")
    out = {r.node: r.hops for r in ln.downstream(edges, spark.createDataFrame([("a",)], "source STRING")).collect()}
    assert out == {"b": 1, "c": 2, "d": 3}
    assert ln.downstream(edges, spark.createDataFrame([], "source STRING")).count() == 0


def test_lineage_of_any_depth_and_many_sources(spark):
    chain = [(i, i + 1) for i in range(30)]
    edges = spark.createDataFrame(chain, "parent INT, child INT")
    far = ln.downstream(edges, spark.createDataFrame([(0,)], "source INT")).collect()
    assert {(r.node, r.hops) for r in far} == {(i, i) for i in range(1, 31)}
    rnd = random.Random(4)
    pairs = {(rnd.randrange(90), rnd.randrange(90)) for _ in range(160)}
    got = {(r.source, r.node): r.hops for r in ln.downstream(spark.createDataFrame([*pairs, (None, 1), (1, None)], "parent INT, child INT").repartition(3), spark.range(90).select(F.col("id").cast("int").alias("source")).repartition(4)).collect()}
    want = {}
    for source in range(90):
        front, seen, hop = {source}, {source}, 0
        while front:
            hop += 1
            front = {b for a, b in pairs if a in front} - seen
            seen |= front
            want |= {(source, n): hop for n in front}
    assert got == want


def test_new_rows_meet_few_rows_of_a_large_target(spark):
    current = spark.range(200_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("p"))
    new = spark.createDataFrame([("5", 1), ("199999", 2), ("x", 3), (None, 4)], "k STRING, v INT")
    found = st.insert_if_absent(current, new, ["k"])
    assert sorted(r.v for r in found.collect()) == [3, 4]
    words = bloom.bloom_filter(new, ["k"])
    assert 2 <= current.where(bloom.may_hold(words, [F.col("k")])).count() < 20
    # full or empty, the filter never changes the result
    assert sorted(r.v for r in st.insert_if_absent(current, new, ["k"], bits=64).collect()) == [3, 4]
    assert st.insert_if_absent(current, new.where("false"), ["k"]).count() == 0
    two = new.select(F.col("k"), (F.col("v") % 2).alias("p"), "v")
    assert sorted(r.v for r in st.insert_if_absent(current, two, ["k", "p"]).collect()) == [2, 3, 4]


def test_repeated_rows_missing_voters_and_a_large_gate(spark):
    rows = [("big", f"v{i}", "approve", i) for i in range(1, 5)] + [("big", "v1", "approve", 1), ("one", None, "approve", 1), ("one", "x", "approve", 2), ("one", "x", "approve", 2), ("one", "y", "reject", 3)]
    gates = spark.createDataFrame([("big", 5), ("one", 1)], "approval_id STRING, required_count INT")
    got = sorted((r.approval_id, r.voter or "", r.recorded, r.reason) for r in ap.fold_votes(vote_frame(spark, rows), gates).collect())
    assert got == [("big", f"v{i}", True, "") for i in range(1, 5)] + [("one", "", False, "no voter"), ("one", "x", True, ""), ("one", "y", False, "gate already approved")]
    states = {r.approval_id: (r.status, r.approved_count, r.responses) for r in ap.gate_state(vote_frame(spark, rows), gates).collect()}
    assert states == {"big": ("pending", 4, 4), "one": ("approved", 1, 1)}


def test_repeated_review_decisions_count_once(spark):
    queue = spark.createDataFrame([("1", None)], "prediction_id STRING, decision STRING")
    rows = [("1", "a", "approved", "", 1)] * 2 + [("1", "b", None, "", 0), ("1", "c", "overridden", "x", 2)]
    made = spark.createDataFrame(rows, "prediction_id STRING, reviewer_email STRING, decision STRING, overridden_value STRING, event_id BIGINT").withColumn("event_time", F.timestamp_seconds("event_id"))
    got = sorted((r.reviewer_email, r.accepted, r.reason) for r in ap.fold_decisions(made, queue).collect())
    assert got == [("a", True, ""), ("b", False, "invalid decision"), ("c", False, "already decided (approved) by a")]


def test_open_price_reaches_past_the_last_bucket(spark):
    from modelward.operators import cost

    usage = spark.sql("SELECT 's' AS sku_name, timestamp_ntz'2001-01-01' + make_interval(0, 6 * id) AS usage_start_time, 1.0D AS usage_quantity, date'2001-01-01' AS usage_date FROM range(40)")
    prices = spark.sql("SELECT 's' AS sku_name, timestamp_ntz'2002-01-01' AS price_start_time, cast(NULL AS TIMESTAMP_NTZ) AS price_end_time, named_struct('effective_list', named_struct('default', 2.0D)) AS pricing")
    for until in (None, "1999-01-01", "2003-05-05", "2100-01-01"):
        for salts in (1, 3):
            assert cost.price_in_force(usage, prices, salts=salts, until=until).count() == 38


def test_projects_are_listed_newest_first(spark):
    rows = spark.createDataFrame([("a", False, 1), ("b", None, 3), ("c", True, 9), ("d", False, None), ("e", False, 3)], "project_id STRING, is_archived BOOLEAN, created INT")
    assert [r.project_id for r in g.project_listing(rows, newest_by="created").collect()] == ["b", "e", "a", "d"]
    assert [r.project_id for r in g.project_listing(rows, True, "created").collect()] == ["c", "b", "e", "a", "d"]


@pytest.fixture(scope="module")
def priced_folder(spark, tmp_path_factory):
    """Two projects of one team, one of another, a usage row a day of each, and one price list of 50 parts."""
    d = tmp_path_factory.mktemp("priced")
    spark.sql("SELECT id AS p_partkey, 2.0D AS p_retailprice FROM range(50)").write.parquet(f"{d}/part.parquet")
    spark.sql("SELECT id AS s_suppkey, concat('s', id) AS s_name, CAST(id DIV 2 AS INT) AS s_nationkey, 10.0D AS s_acctbal FROM range(3)").write.parquet(f"{d}/supplier.parquet")
    spark.sql("SELECT id AS o_orderkey, id % 2 AS o_custkey, 'F' AS o_orderstatus, 1.0D AS o_totalprice, timestamp_ntz'2000-01-01' AS o_orderdate, CASE WHEN id < 2 THEN '1-URGENT' ELSE '2-HIGH' END AS o_orderpriority FROM range(3)").write.parquet(f"{d}/orders.parquet")
    spark.sql("SELECT id % 50 AS l_partkey, id % 3 AS l_suppkey, 1.0D AS l_quantity, CASE WHEN id % 10 = 9 THEN 'A' ELSE 'N' END AS l_returnflag, timestamp_ntz'2001-07-31' - make_interval(0, 0, 0, CAST(id AS INT)) AS l_shipdate FROM range(300)").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


COST_QUERIES = "budget_checks budgets_after_pass control_plane_budget control_plane_daily_costs cost_by_deployment_type cost_by_project cost_by_team cost_merge cost_rollup project_daily_costs rising_costs"


@pytest.mark.parametrize("name", COST_QUERIES.split())
def test_queries_merge_prices_and_attributes(spark, priced_folder, name):
    from modelward.plans.cost_queries import R

    # the files are small, so Spark would broadcast whatever it may
    plan = R.queries[name](spark, priced_folder)._jdf.queryExecution().executedPlan().toString()
    joins = [line.partition("Join [")[0].split()[-1] + " " + line.partition("Join [")[2] for line in plan.split("\n") if "Join [" in line]
    assert joins
    assert {x.split()[0] for x in joins if "sku_name" in x} == {"SortMerge"}
    if name in ("cost_by_deployment_type", "cost_by_team", "cost_rollup"):
        assert "Broadcast" not in plan


def test_costs_by_attribute_of_merged_rows(spark, priced_folder):
    from modelward.plans.cost_queries import R

    got = lambda name: [tuple(r) for r in R.queries[name](spark, priced_folder).collect()]
    # 90 rows of each project have its tag; one unit costs 2 * 105 / 100 = 2.1 in 2000 and later
    assert got("cost_by_project") == [("p0", 189.0), ("p1", 189.0), ("p2", 189.0)]
    assert got("cost_by_team") == [("team-0", 378.0), ("team-1", 189.0)]
    assert got("cost_by_deployment_type") == [("realtime", 189.0), ("streaming", 189.0), ("unknown", 189.0)]
    assert sorted(got("cost_rollup"), key=str) == sorted(
        [("team-0", "p0", 0, 189.0, "ok"), ("team-0", "p1", 0, 189.0, "ok"), ("team-1", "p2", 0, 189.0, "ok"), ("team-0", None, 1, 378.0, "ok"), ("team-1", None, 1, 189.0, "ok"), (None, None, 3, 567.0, "ok")], key=str)


def test_attributes_that_repeat_count_each_time(spark):
    costs = spark.sql("SELECT p AS project_id, DATE '2024-06-20' AS date, u AS total_cost_usd FROM VALUES ('a', 1D), ('a', 2D), ('b', 5D), ('c', 7D) AS v(p, u)")
    teams = spark.sql("SELECT p AS project_id, t AS team_name FROM VALUES ('a', 'x'), ('a', 'x'), ('a', 'y'), ('b', NULL), (NULL, 'z') AS v(p, t)")
    assert [tuple(r) for r in cost.rollup_by_team(costs, teams, NOW).collect()] == [("x", 6.0), (None, 5.0), ("y", 3.0)]
