"""Moment matrices against Spark's own correlations, and sketches against exact counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modelward.operators import moments as mo
from modelward.operators import quality
from modelward.operators import sketches as sk


def wide(spark, rows, width):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(rows, width)) * 10.0 ** rnd.integers(-3, 4, width) + 10.0 ** rnd.integers(0, 6, width)
    x[:, 1] = x[:, 0] * -2 + 1
    x[:, 2] = 7.1
    there = rnd.random((rows, width)) > 0.2
    there[:, 3] = False
    names = [f"c{i}" for i in range(width)]
    data = [[float(v) if ok else None for v, ok in zip(r, t)] for r, t in zip(x, there)]
    return spark.createDataFrame(data, ", ".join(f"{n} DOUBLE" for n in names)).repartition(7), names


def test_a_hundred_columns_in_one_scan(spark):
    df, names = wide(spark, 400, 100)
    found = quality.correlations(df, names)
    got = {(r.field, r.other_field): r.correlation for r in found.collect()}
    assert len(got) == 100 * 99 // 2
    # Spark's own form fails on the columns without spread
    flat = {p for p in got if {"c2", "c3"} & set(p)}
    assert len(flat) == 197 and {got[p] for p in flat} == {None}
    pairs = [p for p in got if p not in flat][::7] + [("c0", "c1")]
    want = df.agg(*[F.corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    for i, pair in enumerate(pairs):
        assert got[pair] == pytest.approx(want[i], abs=1e-7)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Scan ExistingRDD") == 1


def test_merged_moments_do_not_depend_on_the_cut():
    rnd = np.random.default_rng(2)
    x, there = rnd.normal(size=(300, 4)) + 1e9, rnd.random((300, 4)) > 0.3
    whole = mo.Moments.of(x, there)
    parts = mo.Moments.empty(4)
    for at in np.split(np.arange(300), [1, 2, 50, 51, 200]):
        parts = parts.merged(mo.Moments.of(x[at], there[at]))
    for name in ("n", "mean", "square", "cross"):
        assert getattr(parts, name) == pytest.approx(getattr(whole, name), rel=1e-6, abs=1e-6)


def test_correlations_of_odd_columns(spark):
    rows = [(1.0, 2.0, None, 5.0, 1), (2.0, float("nan"), None, 5.0, 2), (3.0, 1.0, 4.0, 5.0, 4), (4.0, float("inf"), 3.0, 5.0, 8)]
    df = spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, e INT")
    pair = lambda frame: {(r.field, r.other_field): (r.n, r.correlation) for r in mo.pair_rows(mo.moment_matrix(frame, list("abcde")), list("abcde")).collect()}
    got = pair(df)
    assert got["a", "c"] == (2, pytest.approx(-1)) and got["a", "d"] == (4, None) and got["a", "e"] == (4, pytest.approx(df.agg(F.corr("a", "e")).first()[0]))
    assert np.isnan(got["a", "b"][1]) and got["a", "b"][0] == 4 and np.isnan(got["b", "c"][1])
    assert set(pair(df.where("a > 9")).values()) == {(0, None)}


def test_latency_sketches_merge_within_their_error(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("model_id"), F.timestamp_seconds(1704067200 + F.col("id") * 7).alias("ts"),
        F.when(F.col("id") % 11 > 0, F.pow(F.pmod(F.xxhash64("id"), F.lit(10_000)), 2)).alias("latency_ms"), (F.col("id") % 5 == 0).alias("is_error"),
    )
    hours = sk.latency_sketches(rows)
    days = sk.merged_latency(hours)
    keys = ["model_id", "window_start"]
    tagged = rows.withColumn("window_start", F.window("ts", "1 day")["start"])
    assert sk.rank_errors(days, tagged, keys, "latency_ms").agg(F.max("rank_error")).first()[0] <= 2 * sk.rank_error()
    exact = tagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.avg(F.col("is_error").cast("int")).alias("error_rate"))
    assert sorted(map(tuple, days.select(*keys, "requests", "error_rate").collect())) == sorted(map(tuple, exact.collect()))
    assert hours._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    none = sk.merged_latency(sk.latency_sketches(rows.withColumn("latency_ms", F.lit(None).cast("double")))).first()
    assert none.p50 is None and none.requests > 0


def test_distinct_sketches_unite(spark):
    rows = spark.range(60_000).select((F.col("id") % 4).alias("part"), (F.col("id") % 9_000).alias("n"), F.when(F.col("id") % 2 == 0, F.col("id") % 50).cast("double").alias("v"), F.lit(None).cast("string").alias("none"))
    rows = rows.union(spark.sql("SELECT 9L, 1L, 0.0D, NULL UNION ALL SELECT 9L, 1L, -0.0D, NULL"))
    parts = sk.distinct_sketches(rows, ["n", "v", "none"], ["part"])
    got = {r.column_name: r for r in sk.united_distinct(parts).collect()}
    assert got["n"].distinct_count == pytest.approx(9_000, rel=4 * sk.distinct_error()) and got["v"].distinct_count == 25 and got["none"].distinct_count == 0
    assert got["none"].null_pct == 100.0 and got["n"].row_count == 60_002
    assert {r.part: r.distinct_count for r in sk.united_distinct(parts, ["part"]).where("column_name = 'v'").collect()}[9] == 1
