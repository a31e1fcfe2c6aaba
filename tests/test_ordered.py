"""The split computations against brute force, with one key that holds a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from modelward.functions import ordered as o


def skewed(n, seed):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(5)}", rnd.randrange(40) / 4.0, i) for i in range(n)]


def test_running_totals(spark):
    rows = skewed(600, 1)
    got = o.running_totals(spark.createDataFrame([(k, v, 1) for k, v, _ in rows], "k STRING, v DOUBLE, w INT"), ["k"], "v", ["w"]).collect()
    assert len(got) == len({(k, v) for k, v, _ in rows})
    for r in got:
        mine = [v for k, v, _ in rows if k == r.k]
        assert (r.w, r.w_below, r.w_total) == (mine.count(r.v), sum(v < r.v for v in mine), len(mine))


def test_running_totals_without_keys(spark):
    rows = skewed(200, 2)
    got = o.running_totals(spark.createDataFrame([(v, 2) for _, v, _ in rows], "v DOUBLE, w INT"), [], "v", ["w"]).collect()
    for r in got:
        assert r.w_below == 2 * sum(v < r.v for _, v, _ in rows)


@pytest.mark.parametrize("kind,values", [
    ("BIGINT", [2**53, 2**53 + 1, 2**53 + 2, -(2**63), 2**63 - 1, 0, -1, 1, 1 << 16, (1 << 16) - 1, 1 << 36, -(1 << 36) - 1]),
    ("DOUBLE", [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0000000000000002, 0.9999999999999999, -1.0, 1024.0, 1023.9999999999999, float("nan")]),
    ("DECIMAL(30,2)", ["123456789012345678901234567.01", "123456789012345678901234567.02", "-1.00", "0.00", "0.01"]),
    ("TIMESTAMP", [f"{y}-01-01 00:00:00.{m:06}" for y in (1800, 1970, 2024) for m in (0, 1, 999999)]),
    ("DATE", ["1800-01-01", "1969-12-31", "1970-01-01", "2024-02-29"]),
])
def test_running_totals_keep_the_type_and_order(spark, kind, values):
    rows = [(None if i % 2 else "a", str(v), 1) for i, v in enumerate(values * 3)] + [("a", None, 1)]
    df = spark.createDataFrame(rows, "k STRING, v STRING, w INT").withColumn("v", F.col("v").cast(kind))
    got = o.running_totals(df, ["k"], "v", ["w"])
    assert got.schema["v"].dataType.simpleString() == kind.lower()
    plain = F.sum("w").over(Window.partitionBy("k").orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("w").over(Window.partitionBy("k", "v"))
    want = df.where("v IS NOT NULL").select("k", "v", plain.alias("w_below")).distinct()
    columns = ["k", F.col("v").cast("string").alias("v"), "w_below"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_a_hot_key_lies_in_many_cells(spark):
    coarse, fine = o._cells("v", DoubleType())
    cells = spark.range(200_000).select(((F.col("id") + 1) / 200_000).alias("v")).select(coarse.alias("c"), fine.alias("f"))
    assert cells.distinct().count() > 100_000 and 1_000 < cells.select("c").distinct().count() < 20_000
    coarse, fine = o._cells("v", LongType())
    cells = spark.range(0, 1 << 34, 1 << 14).select(F.col("id").alias("v")).select(coarse.alias("c"), fine.alias("f"))
    assert cells.groupBy("c", "f").count().agg(F.max("count")).first()[0] == 4


@pytest.mark.parametrize("values", [[5.0], [1.0, 1.0, 1.0], [1.0, 2.0], list(np.random.default_rng(3).normal(size=501))])
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None)], "k STRING, v DOUBLE")
    got = o.exact_quantiles(df, ["k"], "v", {"q25": 0.25, "q50": 0.5, "q99": 0.99}).first()
    assert [got.q25, got.q50, got.q99] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.99])))


def events(n, seed):
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(3)}", 1704067200 + rnd.randrange(0, 40000), i, rnd.random() < 0.6) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k STRING, s BIGINT, id BIGINT, f BOOLEAN").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))


def test_previous_and_largest_before(spark):
    rows = events(300, 4)
    df = frame(spark, rows)
    prev = {r.id: r.was for r in o.with_previous(df, ["k"], "ts", ["id"], {"id": "was"}, 1000).collect()}
    top = {r.id: r.m for r in o.max_before(df, ["k"], "ts", ["id"], "id", "m", 1000).collect()}
    for k, s, i, _ in rows:
        before = sorted((t, j) for kk, t, j, _ in rows if kk == k and (t, j) < (s, i))
        assert prev[i] == (before[-1][1] if before else None)
        assert top[i] == (max(j for _, j in before) if before else None)


def test_islands(spark):
    rows = events(300, 5)
    got = {(r.k, r.run_no): r.rows_in_run for r in o.islands(frame(spark, rows), "k", "ts", "id", "f", 900).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        run, was = 0, False
        for _, _, _, flag in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            run += flag and not was
            was = flag
            if flag:
                want[(key, run)] = want.get((key, run), 0) + 1
    assert got == want


def test_trailing_counts(spark):
    rows = events(300, 6)
    got = {r.id: r.c for r in o.count_in_trailing(frame(spark, rows), ["k"], "ts", 600, "c").collect()}
    assert got == {i: sum(kk == k and s - 600 <= t <= s for kk, t, _, _ in rows) for k, s, i, _ in rows}


def test_trailing_counts_of_a_hot_key_are_summed_over_parts(spark):
    start = 1_704_067_200
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("k"), "id", F.when(F.col("id") % 500 > 0, F.timestamp_micros(F.lit(start * 10**6) + F.col("id") * 137_000)).alias("ts"))
    got = o.count_in_trailing(rows, ["k"], "ts", 3600, "c")
    plain = Window.partitionBy("k").orderBy(F.unix_micros("ts")).rangeBetween(-3600 * 10**6, 0)
    want = rows.withColumn("c", F.when(F.col("ts").isNull(), 0).otherwise(F.count("ts").over(plain)))
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == 40_000
    # the sort that counts exactly is by key and part
    assert "_part" in got._jdf.queryExecution().executedPlan().toString()
    none = o.count_in_trailing(rows.withColumn("k", F.lit(None).cast("string")), ["k"], "ts", 60, "c")
    assert none.agg(F.max("c")).first()[0] == 438


@pytest.mark.parametrize("lookback", [None, 1500])
def test_latest_before(spark, lookback):
    right, left = events(250, 7), events(120, 8)
    left.append((None, 1704067300, 9999, True))
    got = o.latest_before(
        frame(spark, left), frame(spark, right).select("k", F.col("ts").alias("rts"), "id", F.col("id").alias("val")), ["k"], "ts", "rts", "id", ["val"], 700, lookback
    ).collect()
    assert len(got) == len(left)
    for r in got:
        fits = [(t, i) for k, t, i, _ in right if k == r.k and t <= r.s and (lookback is None or r.s - t <= lookback)]
        assert r.val == (max((t, str(i), i) for t, i in fits)[2] if fits else None)
