import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from modelward.functions.identifiers import UnsafeName
from modelward.operators import approvals as ap
from modelward.schemas import TABLES, schema_of
from modelward.session import shared_root
from modelward.sources import snapshots as sn
from modelward.sources import tables as tb
from modelward.sources.ticks import replayed
from modelward.streaming import jobs, keyed


def test_every_schema_parses(spark):
    assert all(len(schema_of(t)) > 0 for t in TABLES)


def test_shared_root_comes_from_the_session(monkeypatch, tmp_path):
    from types import SimpleNamespace

    def session(folder, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"app-{tmp_path}"))

    assert shared_root(session("hdfs://x/y/", "yarn")) == "hdfs://x/y"
    with pytest.raises(RuntimeError):
        shared_root(session(None, "yarn"))
    assert shared_root(session(None, "local[2]")) == shared_root(session(None, "local[2]"))


def test_scan_and_parameters(spark):
    with pytest.raises(UnsafeName):
        tb.scan(spark, "a; drop table b")
    types = tb.run_sql(spark, "SELECT typeof(:a) AS a, typeof(:b) AS b, typeof(:c) AS c, typeof(:d) AS d, :e AS e", {"a": True, "b": 2**40, "c": 1.5, "d": "x' OR 1=1", "e": None}).first()
    assert tuple(types) == ("boolean", "bigint", "double", "string", None)


def test_samples_repeat(spark):
    df = spark.range(1000)
    one = {r.id for r in tb.sample_rows(df, 50, "id").collect()}
    assert one == {r.id for r in tb.sample_rows(df.repartition(7), 50, "id").collect()} and len(one) == 50
    assert tb.sample_rows(df, 50).count() == 50


def test_append_counts_and_csv_types(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert tb.append(spark.range(5), path) == 5 and tb.append(spark.range(3), path) == 3 and spark.read.parquet(path).count() == 8
    spark.sql("SELECT 1 AS a, 'x' AS b, 2.5D AS c").write.csv(f"{tmp_path}/csv", header=True)
    _, cols = tb.import_csv(spark, f"{tmp_path}/csv", "k")
    assert [(r.column_name, r.data_type) for r in cols.orderBy("column_order").collect()] == [("a", "int"), ("b", "string"), ("c", "double")]


def test_overwrite_swaps_only_its_partitions(spark, tmp_path):
    path = f"{tmp_path}/t"
    tb.overwrite_partitions(spark.range(6).withColumn("p", F.col("id") % 3), path, ["p"])
    tb.overwrite_partitions(spark.sql("SELECT 100L AS id, 1L AS p"), path, ["p"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 3, 5, 100]


def test_passes_are_logged_also_when_they_fail(spark, tmp_path):
    from modelward.operators.state import run_health

    out, log = f"{tmp_path}/o", f"{tmp_path}/l"
    tb.record_pass("j", spark.range(9), lambda df: df.where("id < 4"), out, log, "2024-01-01")
    with pytest.raises(Exception, match="boom"):
        tb.record_pass("j", spark.range(9), lambda df: df.select(F.raise_error(F.lit("boom"))), out, log, "2024-01-02")
    tb.record_pass("j", spark.range(9), lambda df: df.where("id < 0"), out, log, "2024-01-03")
    rows = run_health(spark.read.parquet(log)).orderBy("run_timestamp").collect()
    assert [(r.status, r.rows_examined, r.rows_changed) for r in rows] == [("ok", 9, 4), ("failed", 0, 0), ("warning", 9, 0)]
    # a pass that is run again replaces its rows and its log row
    tb.record_pass("j", spark.range(9), lambda df: df.where("id < 5"), out, log, "2024-01-01")
    assert spark.read.parquet(out).count() == 5 and spark.read.parquet(log).count() == 3


def test_generated_rows_repeat(spark):
    df = tb.generated_rows(spark, 500, {"age": 10})
    assert df.collect() == tb.generated_rows(spark, 500, {"age": 10}).collect()
    assert 20 < df.where("age IS NULL").count() < 90


def test_snapshots(spark, tmp_path):
    root = f"{tmp_path}/s"
    broken = spark.range(3).select(F.raise_error(F.lit("boom")).alias("x"))
    tables = {"a.good": spark.range(4), "a.broken": broken, "a.more": spark.range(2)}
    first = sn.snapshot_all(spark, root, tables, project_id="p", as_of="2024-01-02 03:04:05")
    assert [r["status"] for r in first] == ["copied", "failed", "copied"]
    again = sn.snapshot_all(spark, root, {"a.good": spark.range(9)}, project_id="p", as_of="2024-01-03")
    assert again[0]["status"] == "skipped"
    rows = {r.source_table: r for r in sn.manifest(spark, root).collect()}
    assert rows["a.good"].row_count == 4 and rows["a.good"].snapshot_table == "snapshot_good_20240102_030405" and "a.broken" not in rows
    assert sn.snapshot_all(spark, root, {"a b": spark.range(1)}, project_id="p", as_of="2024-01-03")[0]["status"] == "failed"


def test_published_versions(spark, tmp_path):
    root = f"{tmp_path}/v"
    assert sn.current_version(spark, root, "t") is None
    with pytest.raises(ValueError):
        sn.read_current(spark, root, "t")
    assert sn.publish(spark, root, "t", spark.range(3), "2024-01-01") == 1
    assert sn.publish(spark, root, "t", spark.range(5), "2024-01-02") == 2
    assert sn.read_current(spark, root, "t").count() == 5 and sn.current_version(spark, root, "t") == 2


def test_scratch_tables(spark):
    assert tb.scratch_tables(spark, "default").count() == 0


# ── streams ──


def ticks(spark, path, parts):
    """Write each part as its own file, oldest first."""
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(path)


def test_missing_source_fails_before_the_start(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.read_stream(spark, f"{tmp_path}/nothing")


@pytest.mark.parametrize("name", ["plain", "odd né me=1"])
def test_streams_read_files_folders_and_tables(spark, tmp_path, name):
    folder = f"{tmp_path}/{name}"
    spark.range(5).coalesce(1).write.json(folder)
    assert jobs.drain(jobs.read_stream(spark, folder, form="json")).count() == 5
    one = next(p for p in (tmp_path / name).iterdir() if p.suffix == ".json")
    copy = tmp_path / f"one {name}"
    copy.write_bytes(one.read_bytes())
    assert jobs.drain(jobs.read_stream(spark, str(copy), form="json")).count() == 5


def test_streams_read_tables(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS streamed_rows")
    spark.range(7).write.option("path", f"{tmp_path}/rows").saveAsTable("streamed_rows")
    try:
        assert jobs.drain(jobs.read_stream_table(spark, "streamed_rows")).count() == 7
    finally:
        spark.sql("DROP TABLE streamed_rows")
    with pytest.raises(UnsafeName):
        jobs.read_stream_table(spark, "a; drop")


def test_windows_over_several_batches(spark, tmp_path):
    path = f"{tmp_path}/ev"
    rows = spark.range(60).select(F.timestamp_seconds(1704067200 + F.col("id") * 37).alias("ts"), F.lit("m").alias("k"), (F.col("id") % 4 == 0).alias("bad"), F.col("id").cast("double").alias("v"))
    ticks(spark, path, [rows.where("v < 25"), rows.where("v >= 25 AND v < 40"), rows.where("v >= 40")])
    stream = jobs.read_stream(spark, path, files_per_batch=1)
    got = jobs.drain(jobs.metric_windows(stream, "ts", "5 minutes", "k", "v", "bad", "1 hour"), "update", ["window_start", "k"])
    want = rows.groupBy(F.window("ts", "5 minutes")["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    assert {(r.window_start, r.n) for r in got.collect()} == {(r.window_start, r.n) for r in want.collect()}
    trig = jobs.drain(jobs.rollback_triggers(stream, "ts", "k", "bad", "1 hour", max_errors=3, max_rate=0.9), "update", ["window_start", "k"])
    batch = rows.groupBy(F.window("ts", "5 minutes", "1 minute")["start"].alias("w")).agg(F.count_if("bad").alias("e"), F.count(F.lit(1)).alias("n")).where("e >= 3 OR e / n > 0.9")
    assert {r.window_start for r in trig.collect()} == {r.w for r in batch.collect()}


def test_repeated_ids_are_taken_once(spark, tmp_path):
    path = f"{tmp_path}/ids"
    rows = spark.range(30).select((F.col("id") % 10).alias("k"), F.timestamp_seconds(1704067200 + F.col("id")).alias("ts"))
    ticks(spark, path, [rows.limit(15), rows])
    assert jobs.drain(jobs.once_per_id(jobs.read_stream(spark, path, 1), "k", "ts", "1 hour")).count() == 10


def test_late_rows_are_counted(spark, tmp_path):
    path, out = f"{tmp_path}/late", f"{tmp_path}/out"
    at = lambda s: spark.sql(f"SELECT 'm' AS k, timestamp_seconds({s}) AS ts, 1.0D AS v, false AS bad")
    ticks(spark, path, [at(1704067200), at(1704090000), at(1704093600), at(1704067300)])
    query = jobs.start(jobs.metric_windows(jobs.read_stream(spark, path, 1), "ts", "5 minutes", "k", "v", "bad", "1 minute"), out, "update", once=True)
    query.awaitTermination()
    assert jobs.late_rows(query) == 1


def test_stream_join_and_timer_match_batch(spark, tmp_path):
    asked = spark.range(20).select(F.col("id").cast("string").alias("prediction_id"), F.timestamp_seconds(1704067200 + F.col("id") * 60).alias("predicted_at"), F.lit("a").alias("predicted_value"))
    labels = spark.range(0, 20, 2).select(F.col("id").cast("string").alias("label_id"), F.timestamp_seconds(1704067200 + F.col("id") * 90).alias("arrived_at"), F.lit("a").alias("actual_label"))
    ticks(spark, f"{tmp_path}/p", [asked.where("CAST(prediction_id AS INT) < 9"), asked.where("CAST(prediction_id AS INT) >= 9")])
    ticks(spark, f"{tmp_path}/l", [labels])
    got = jobs.drain(jobs.feedback_stream(jobs.read_stream(spark, f"{tmp_path}/p", 1), jobs.read_stream(spark, f"{tmp_path}/l", 1), latency="5 MINUTES", prediction_delay="1 hour", label_delay="1 hour"))
    assert sorted(int(r.prediction_id) for r in got.collect()) == [0, 2, 4, 6, 8, 10]  # 30 s a step, 300 s at most
    p = jobs.read_stream(spark, f"{tmp_path}/p", 1).select("prediction_id", F.col("predicted_at").alias("presented_at"))
    dec = jobs.read_stream(spark, f"{tmp_path}/l", 1).select(F.col("label_id").alias("decided_id"), F.col("arrived_at").alias("decided_at"))
    late = jobs.drain(jobs.sla_breaches(p, dec, sla="5 MINUTES", delay="0 seconds"))
    end = min(19 * 60, 18 * 90)  # the watermark follows the slower side
    assert sorted(int(r.prediction_id) for r in late.collect()) == [i for i in range(20) if (i % 2 or i * 90 > i * 60 + 300) and i * 60 + 300 < end]


def test_vote_stream_in_event_order_matches_batch(spark, tmp_path):
    rows = spark.range(400).select(
        F.concat(F.lit("g"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).cast("string")).alias("approval_id"), F.concat(F.lit("v"), (F.col("id") * 7 % 11).cast("string")).alias("voter"),
        F.when(F.pmod(F.xxhash64("id"), F.lit(9)) == 0, "reject").when(F.pmod(F.xxhash64("id"), F.lit(9)) < 3, "request_changes").otherwise("approve").alias("decision"),
        F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id")).alias("event_time"),
    )
    gates = spark.range(40).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("approval_id"), (F.col("id") % 4 + 1).cast("int").alias("required_count"))
    ticks(spark, f"{tmp_path}/v", [rows.where("event_id < 90"), rows.where("event_id >= 90 AND event_id < 200"), rows.where("event_id >= 200")])
    own, folder, columns = jobs.stream_session(spark, 3), f"{tmp_path}/out", ["approval_id", "status", "approved_count", "rejected_count", "responses", "completed_timestamp"]
    voted = lambda seen: {tuple(r) for r in ap.gate_state(seen, gates).join(seen.select("approval_id").distinct(), "approval_id").select(*columns).collect()}

    def run():
        stream = keyed.gate_votes(jobs.read_stream(own, f"{tmp_path}/v", 1), own.createDataFrame(gates.collect(), gates.schema))
        return {tuple(r) for r in jobs.drain(stream, "update", ["approval_id"], folder, spark).select(*columns).collect()}

    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert run() == voted(rows)
    # another run of the same query goes on from its state
    more = rows.where("event_id < 60").withColumn("event_id", F.col("event_id") + 1000).withColumn("event_time", F.col("event_time") + F.expr("INTERVAL 1 HOUR")).withColumn("voter", F.concat("voter", F.lit("x")))
    ticks(spark, f"{tmp_path}/v", [more])
    assert run() == voted(rows.union(more.select(rows.columns)))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    # a batch writes the gates that it changed, and no others
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "data").iterdir())
    assert spark.read.parquet(f"{folder}/data/batch_id={last}").count() <= more.select("approval_id").distinct().count()


def test_votes_that_do_not_count(spark, tmp_path):
    rows = [("a", None, "approve", 1), ("a", "v", "maybe", 2), ("a", "v", "approve", 3), ("a", "v", "reject", 4), ("b", "v", "approve", 5), (None, "v", "approve", 6), ("a", "w", "approve", 7), ("a", "x", "reject", 8)]
    votes = spark.createDataFrame(rows, "approval_id string, voter string, decision string, event_id long").withColumn("event_time", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id")))
    ticks(spark, f"{tmp_path}/v", [votes.where("event_id < 5"), votes.where("event_id >= 5")])
    own = jobs.stream_session(spark, 2)
    gates = own.createDataFrame([("a", 2), ("c", 1)], "approval_id string, required_count int")
    got = jobs.drain(keyed.gate_votes(jobs.read_stream(own, f"{tmp_path}/v", 1), gates), "update", ["approval_id"], spark=spark).collect()
    assert [(r.approval_id, r.status, r.approved_count, r.rejected_count, r.responses) for r in got] == [("a", "approved", 2, 0, 2)]


def test_a_gate_of_many_voters(spark, tmp_path):
    voter = F.concat(F.lit("v"), (F.col("id") % 150).cast("string"))
    votes = spark.range(400).select(F.lit("g").alias("approval_id"), voter.alias("voter"), F.when(F.col("id") == 399, "reject").otherwise("request_changes").alias("decision"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("event_time"))
    votes = votes.withColumn("voter", F.when(F.col("event_id") == 399, "last").otherwise(F.col("voter")))
    ticks(spark, f"{tmp_path}/v", [votes.where(f"event_id >= {a} AND event_id < {b}") for a, b in ((0, 50), (50, 100), (100, 140), (140, 399), (399, 400))])
    own = jobs.stream_session(spark, 2)
    folder = f"{tmp_path}/out"
    jobs.drain(keyed.gate_votes(jobs.read_stream(own, f"{tmp_path}/v", 1), own.createDataFrame([("g", 2)], "approval_id string, required_count int")), "update", ["approval_id"], folder, spark)
    rows = spark.read.parquet(f"{folder}/data").orderBy("batch_id").collect()
    assert [(r.status, r.responses) for r in rows] == [("pending", 50), ("pending", 100), ("pending", 140), ("pending", 150), ("rejected", 151)]


def fired_by_hand(times, silence):
    last, out = None, []
    for t in sorted(times):
        if last is None or t - last >= silence:
            out.append(t)
            last = t
    return out


def test_alerts_are_silent_from_their_last_firing(spark, tmp_path):
    day, noon = 86400, 1704067200
    times = {"a": [noon + day - 60, noon + day + 60, noon + 2 * day - 61, noon + 2 * day - 60, noon + 5 * day], "b": [noon + k * 3600 for k in range(200)], "c": [noon, noon, noon]}
    rows = [(k, t) for k, ts in times.items() for t in ts] + [(None, noon), ("d", None)]
    events = spark.createDataFrame(rows, "k string, t long").select("k", F.timestamp_seconds("t").alias("ts"))
    cut = noon + 2 * day
    ticks(spark, f"{tmp_path}/e", [events.where(F.unix_seconds("ts") < cut), events.where(F.coalesce(F.unix_seconds("ts") >= cut, F.lit(True)))])
    own = jobs.stream_session(spark, 2)
    fired = keyed.firings(jobs.read_stream(own, f"{tmp_path}/e", 1), "k", "ts", day, "1 hour")
    got = sorted((r.k, r.t) for r in jobs.drain(fired, spark=spark).select("k", F.unix_seconds("ts").alias("t")).collect())
    assert got == sorted((k, t) for k, ts in times.items() for t in fired_by_hand(ts, day))


def test_late_rows_are_kept_and_counted_once(spark, tmp_path):
    start = 1704067200
    parts = [[(1, start, 2**53 + 1), (2, start + 7200, None)], [(3, start + 7000, 5), (4, start + 100, 2**53 + 3), (5, start + 9000, None)], [(6, start + 3601, 1), (7, start + 5400, 2), (8, None, 3)]]
    frames = [spark.createDataFrame(p, "id long, t long, v long").select("id", F.timestamp_seconds("t").alias("ts"), "v") for p in parts]
    ticks(spark, f"{tmp_path}/e", frames[:2])
    own, folder, listener = jobs.stream_session(spark, 2), f"{tmp_path}/out", keyed.LateRows()
    own.streams.addListener(listener)
    try:
        for _ in range(2):
            came = keyed.with_lateness(jobs.read_stream(own, f"{tmp_path}/e", 1), "ts", "1 hour", slots=4)
            query = keyed.start_split(came, folder, once=True)
            query.awaitTermination()
            total = listener.settled(str(query.id), query.lastProgress["batchId"])
            ticks(spark, f"{tmp_path}/e", frames[2:])
    finally:
        own.streams.removeListener(listener)
    rows = {r.id: (r.late, r.v) for r in jobs.results(spark, folder, came.schema).collect()}
    # the watermark stands at 1 h after the second batch's first row, then at 1.5 h
    assert rows == {1: (False, 2**53 + 1), 2: (False, None), 3: (False, 5), 4: (True, 2**53 + 3), 5: (False, None), 6: (True, 1), 7: (False, 2), 8: (True, 3)}
    assert total == 3


def test_ticks_go_on_after_a_restart(spark, tmp_path):
    own, folder, since = jobs.stream_session(spark, 2), f"{tmp_path}/out", time.time()
    table = own.range(40).select(F.col("id").alias("n"), (F.col("id") * 3).alias("v"))

    def run(seconds):
        query = jobs.start(replayed(table, "n", since, every=1.0, seed=10, tick=2), folder)
        end = time.time() + seconds
        while time.time() < end and (query.lastProgress is None or "40" not in str(query.lastProgress["sources"][0]["endOffset"])):
            time.sleep(0.2)
        query.stop()

    run(8)
    run(60)
    rows = [(r.n, r.v, r.tick) for r in spark.read.parquet(f"{folder}/data").collect()]
    assert sorted(rows) == [(n, 3 * n, 0 if n < 10 else 1 + (n - 10) // 2) for n in range(40)]
    assert len(list((tmp_path / "out" / "data").iterdir())) > 1


def test_period_samples_come_when_the_period_is_over(spark, tmp_path):
    start, hour = 1704067200, 3600
    rows = spark.range(3000).select(F.concat(F.lit("r"), F.col("id") % 900).alias("k"), F.timestamp_seconds(F.lit(start) + F.col("id") * 5).alias("ts"))
    rows = rows.union(spark.sql("SELECT NULL, timestamp_seconds(1704067200) UNION ALL SELECT 'x', NULL"))
    cut = F.coalesce(F.unix_seconds("ts") < start + 2 * hour, F.lit(True))
    ticks(spark, f"{tmp_path}/e", [rows.where(cut), rows.where(~cut)])
    own = jobs.stream_session(spark, 2)
    got = jobs.drain(keyed.period_samples(jobs.read_stream(own, f"{tmp_path}/e", 1), "k", "ts", hour, 4, "10 minutes"), spark=spark)
    best = Window.partitionBy("p").orderBy("d")
    want = rows.where("k IS NOT NULL AND ts IS NOT NULL").select("k", F.date_trunc("hour", "ts").alias("p"), F.md5("k").alias("d")).distinct().withColumn("n", F.row_number().over(best))
    # the watermark ends 10 minutes before the last row: four hours are over, the last one is not
    want = want.where(f"n <= 4 AND unix_seconds(p) + {hour} <= {start + 2999 * 5 - 600}")
    assert sorted((r.period, r.k) for r in got.collect()) == sorted((r.p, r.k) for r in want.collect()) and want.count() == 12


def test_gates_share_slots(spark, tmp_path):
    """Many gates are one key of the state; large ones, ties and votes without an event id among them."""
    at = lambda c: F.timestamp_seconds(F.lit(1704067200) + F.col(c))
    votes = spark.range(600).select(F.concat(F.lit("g"), (F.col("id") % 6).cast("string")).alias("approval_id"), F.concat(F.lit("v"), (F.col("id") % 450).cast("string")).alias("voter"), F.lit("approve").alias("decision"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("event_id"), at("id").alias("event_time"))
    gates = spark.sql("SELECT concat('g', id) AS approval_id, CAST(CASE WHEN id < 3 THEN 70 + id ELSE id END AS INT) AS required_count FROM range(6)")
    ticks(spark, f"{tmp_path}/v", [votes.where("unix_seconds(event_time) - 1704067200 < 200"), votes.where("unix_seconds(event_time) - 1704067200 >= 200")])
    own = jobs.stream_session(spark, 2)
    stream = keyed.gate_votes(jobs.read_stream(own, f"{tmp_path}/v", 1), own.createDataFrame(gates.collect(), gates.schema), slots=2)
    got = {r.approval_id: (r.status, r.approved_count, r.responses) for r in jobs.drain(stream, "update", ["approval_id"], f"{tmp_path}/out", spark).collect()}
    assert got == {f"g{k}": ("approved", n, n) for k, n in enumerate((70, 71, 72, 3, 4, 5))}


def test_arrivals_are_written_by_all_tasks(spark, tmp_path):
    """A batch holds one part whatever the number of its files, also an empty part."""
    from modelward.plans import stream_queries
    from modelward.sources.workload import Workload

    rows = spark.range(0, 90, 1, 3).withColumn("part", F.when(F.col("id") < 45, 0).otherwise(2))
    stream = stream_queries.arrivals(Workload(spark, str(tmp_path)), rows, F.col("part"))
    seen = []
    query = stream.writeStream.foreachBatch(lambda b, i: seen.append((b.select(F.input_file_name()).distinct().count(), b.count(), [r.part for r in b.select("part").distinct().collect()]))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen == [(2, 45, [0]), (0, 0, []), (2, 45, [2])]
