"""Order-dependent computations without sending a whole group to one task.

A plain window per key sorts the key's rows in one task. Here each key is cut into value or time buckets; the work runs
per (key, bucket), and only one small row per bucket takes part in the pass along the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, IntegralType, LongType, TimestampNTZType, TimestampType

from modelward.functions.relational import null_safe_join


#: Cells of a doubling of a number: coarse ones, and as a power of two the fine ones in each.
_COARSE, _FINE = 1024, 20
#: Bits of a whole number below a fine and below a coarse cell.
_LOW, _HIGH = 16, 36


def _cells(value: str, kind: DataType) -> tuple[Column, Column]:
    """Two whole numbers in the order of the values: a coarse cell, and a fine one inside it. Equal values share both."""
    v = F.col(value)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        v, kind = F.unix_micros(v.cast("timestamp")), LongType()
    elif isinstance(kind, DateType):
        v, kind = F.unix_date(v), LongType()
    if isinstance(kind, (IntegralType, BooleanType)):
        v = v.cast("long")
        return F.shiftright(v, _HIGH), F.shiftright(v, _LOW).bitwiseAND(F.lit((1 << (_HIGH - _LOW)) - 1))
    v = v.cast("double")
    # the logarithm keeps the order, and numbers of any size spread over its cells
    place = F.coalesce(F.signum(v) * (F.log2(F.abs(v)) + 1100) * _COARSE, F.lit(0.0))
    place = F.when(F.isnan(v), F.lit(4e6)).otherwise(F.greatest(F.least(place, F.lit(3e6)), F.lit(-3e6)))
    coarse = F.floor(place)
    return coarse, F.floor((place - coarse) * (1 << _FINE))


def running_totals(df: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """Per key and distinct value: each weight ``w`` summed, ``w_below`` over smaller values and ``w_total`` over the key.

    Values keep their own type. Rows shrink to (key, value) counts first. The values of a key are cut into coarse cells and
    these into fine ones, by the value alone, so a retried task puts rows where it put them before and no edges have to be
    found; totals run over the coarse cells of a key, over the fine cells of a coarse one, and over the values of a fine one.
    A key with very many values lies in as many tasks as it has cells, and none of the three passes sees more than the
    cells of one level. NULL values are left out.
    """
    keys, kind = list(keys), df.schema[value].dataType
    coarse, fine = _cells("_value", kind)
    # one struct for all keys, in which NULLs meet each other; names of the caller's stay out of the way
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    sums = [F.sum(f"_w{i}").alias(f"_w{i}") for i in range(len(weights))]
    rows = df.where(F.col(value).isNotNull()).select(key.alias("_k"), F.col(value).alias("_value"), *[F.col(w).alias(f"_w{i}") for i, w in enumerate(weights)])
    # never NULL, and marked so: no level adds a filter of its own, and all of them read one shuffle of the counts
    place = [F.coalesce(c, F.lit(0)).cast("long").alias(n) for c, n in ((coarse, "_c"), (fine, "_f"))]
    counts = rows.groupBy("_k", "_value").agg(*sums).select("_k", *place, "_value", *[f"_w{i}" for i in range(len(weights))])
    cells = counts.groupBy("_k", "_c", "_f").agg(*sums)
    tops = cells.groupBy("_k", "_c").agg(*sums)

    def before(level: DataFrame, inside: Sequence[str], order: str, *more: Column) -> DataFrame:
        """Adds to a level's sums what lies before each of its rows, and drops the sums."""
        along = Window.partitionBy(*inside).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        start = [F.coalesce(F.sum(f"_w{i}").over(along), F.lit(0)) + (F.col(f"_b{i}") if f"_b{i}" in level.columns else F.lit(0)) for i in range(len(weights))]
        return level.select(*inside, order, *[b.alias(f"_b{i}") for i, b in enumerate(start)], *more)

    totals = [f"_t{i}" for i in range(len(weights))]
    whole = [F.sum(f"_w{i}").over(Window.partitionBy("_k")).alias(t) for i, t in enumerate(totals)]
    over_tops = before(tops, ["_k"], "_c", *whole)
    over_cells = before(cells.join(over_tops, ["_k", "_c"]), ["_k", "_c"], "_f", *totals)
    found = before(counts.join(over_cells, ["_k", "_c", "_f"]), ["_k", "_c", "_f"], "_value", *totals, *[f"_w{i}" for i in range(len(weights))])
    return found.select(
        *[F.col("_k")[k].alias(k) for k in keys], F.col("_value").alias(value), *[F.col(f"_w{i}").alias(w) for i, w in enumerate(weights)],
        *[F.col(f"_b{i}").alias(f"{w}_below") for i, w in enumerate(weights)], *[F.col(t).alias(f"{w}_total") for t, w in zip(totals, weights)],
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Interpolated quantiles per key, spread over cells of values. One output column per entry of ``probs``.

    Position ``p * (n - 1)`` falls on or between two neighbouring values; each is found by its count range.
    """
    src = df.select(*keys, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_n"))
    return quantiles_of(running_totals(src, keys, "_v", ["_n"]), keys, "_v", "_n", probs)


def quantiles_of(runs: DataFrame, keys: Sequence[str], value: str, count: str, probs: dict[str, float]) -> DataFrame:
    """The same from running totals of counts that are there already."""
    picks, v, n, below, total = [], F.col(value), F.col(count), F.col(f"{count}_below"), F.col(f"{count}_total")
    for name, p in probs.items():
        pos = F.lit(float(p)) * (total - 1)
        for side, k in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            picks.append(F.max(F.when((below <= k) & (k < below + n), v)).alias(f"_{name}_{side}"))
    found = runs.groupBy(*keys).agg(F.max(total).alias("_n_total"), *picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n_total") - 1)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*keys, *out)


def _time_bucket(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(seconds)).cast("long")


#: Parts of a trailing interval.
PARTS = 64


def count_in_trailing(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str) -> DataFrame:
    """For each row, the rows of its key in the closed interval [ts - seconds, ts].

    Time is cut so that an interval has PARTS parts. Whole parts are counted once and summed along the key; exact counts are
    only taken in the two parts in which an interval begins and ends, by a window over each part. So a hot key lies in as
    many tasks as it has parts, and a row is not compared with the rows between. Rows without a time count 0.
    """
    keys = list(keys)
    width = seconds * 1_000_000 // PARTS  # whole, as 64 divides a million
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.struct(*keys) if keys else F.lit(0)
    rows = df.select(key.alias("_k"), micros.alias("_us"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    timed = rows.where(F.col("_us").isNotNull()).withColumn("_part", F.floor(F.col("_us") / width).cast("long"))
    # rows before each part of the key, also for the parts in which an interval begins but no row lies
    counted = timed.groupBy("_k", "_part").agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.select("_k", F.explode(F.array(F.struct("_part", "_n"), F.struct((F.col("_part") - PARTS).alias("_part"), F.lit(0).cast("long").alias("_n")))).alias("_c")).select("_k", "_c.*")
    before = running_totals(counted, ["_k"], "_part", ["_n"]).select("_k", "_part", F.col("_n_below").alias("_before"))
    # where the interval begins: rows of that part that are earlier
    marks = timed.select("_k", (F.col("_part") - PARTS).alias("_part"), (F.col("_us") - seconds * 1_000_000).alias("_us"), "_row")
    both = marks.unionByName(timed.select("_k", "_part", "_us"), allowMissingColumns=True)
    inside = Window.partitionBy("_k", "_part").orderBy("_us")
    real = F.col("_row").isNull().cast("long")
    earlier = F.coalesce(F.sum(real).over(inside.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = both.withColumn("_early", earlier).where(F.col("_row").isNotNull())
    begun = begun.join(before, ["_k", "_part"]).select("_k", (F.col("_part") + PARTS).alias("_part"), (F.col("_us") + seconds * 1_000_000).alias("_us"), "_row", (F.col("_before") + F.col("_early")).alias("_gone"))
    # where it ends: rows of that part up to and with this time
    upto = F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, 0))
    done = begun.withColumn("_upto", upto).join(before, ["_k", "_part"])
    found = done.select("_row.*", (F.col("_before") + F.col("_upto") - F.col("_gone")).alias(out))
    return found.unionByName(rows.where(F.col("_us").isNull()).select("_row.*", F.lit(0).cast("long").alias(out)))


def with_previous(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], columns: dict[str, str], bucket_seconds: int = 3600) -> DataFrame:
    """Add, under the names in ``columns``, each column's value in the key's previous row by (ts, tie)."""
    keys = list(keys)
    rows = df.withColumn("_b", _time_bucket(ts, bucket_seconds)).withColumn("_now", F.struct(*columns))
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, *tie)
    along = Window.partitionBy(*keys).orderBy("_b")
    carried = (
        rows.groupBy(*keys, "_b")
        .agg(F.max_by("_now", F.struct(ts, *tie)).alias("_last"))
        .select(*keys, "_b", F.lag("_last").over(along).alias("_carry"))
    )
    found = null_safe_join(rows.withColumn("_prev", F.lag("_now").over(inside)), carried, [*keys, "_b"])
    was = F.coalesce("_prev", "_carry")
    return found.select(*df.columns, *[was[c].alias(name) for c, name in columns.items()])


def max_before(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str], value: str, out: str, bucket_seconds: int = 3600) -> DataFrame:
    """Add the largest ``value`` among the key's earlier rows by (ts, tie)."""
    keys = list(keys)
    rows = df.withColumn("_b", _time_bucket(ts, bucket_seconds))
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_b").orderBy(ts, *tie).rowsBetween(*earlier)
    along = Window.partitionBy(*keys).orderBy("_b").rowsBetween(*earlier)
    carried = rows.groupBy(*keys, "_b").agg(F.max(value).alias("_m")).select(*keys, "_b", F.max("_m").over(along).alias("_carry"))
    found = null_safe_join(rows.withColumn("_in", F.max(value).over(inside)), carried, [*keys, "_b"])
    return found.select(*df.columns, F.greatest("_in", "_carry").alias(out))


def islands(df: DataFrame, key: str, ts: str, tie: str, flag: str, bucket_seconds: int = 3600) -> DataFrame:
    """Runs of consecutive rows with ``flag`` set, per key in time order: first and last time and row count.

    A run may span buckets. Rows are shuffled once, by key and bucket; a bucket's summary has its first and last flag and the
    runs that begin inside it, from which the pass along the key tells each bucket what it continues and how many runs began
    before. Rows without a time come first.
    """
    bucket = F.coalesce(_time_bucket(ts, bucket_seconds), F.lit(-(1 << 62)))
    set_ = F.coalesce(F.col(flag), F.lit(False)).alias("_f")
    rows = df.select(F.struct(F.col(key).alias("key")).alias("_k"), bucket.alias("_b"), F.col(ts).alias("_ts"), F.col(tie).alias("_tie"), set_).repartition("_k", "_b")
    inside = Window.partitionBy("_k", "_b").orderBy("_ts", "_tie")
    # whether the first row of a bucket begins a run is open until the bucket before is known
    rows = rows.withColumn("_was", F.lag("_f").over(inside)).withColumn("_start", (F.col("_f") & ~F.coalesce("_was", F.lit(True))).cast("long"))
    at = F.struct("_ts", "_tie")
    parts = rows.groupBy("_k", "_b").agg(F.min_by("_f", at).alias("_first"), F.max_by("_f", at).alias("_last"), F.sum("_start").alias("_inner"))
    along = Window.partitionBy("_k").orderBy("_b")
    parts = parts.withColumn("_on", F.coalesce(F.lag("_last").over(along), F.lit(False)))
    begun = F.sum(F.col("_inner") + (F.col("_first") & ~F.col("_on")).cast("long")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_k", "_b", "_on", F.coalesce(begun, F.lit(0)).alias("_before"))
    start = F.when(F.col("_was").isNull(), (F.col("_f") & ~F.col("_on")).cast("long")).otherwise(F.col("_start"))
    return (
        rows.join(parts, ["_k", "_b"])
        .withColumn("_start", start)
        .withColumn("run_no", F.col("_before") + F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .where("_f")
        .groupBy("_k", "run_no")
        .agg(F.min("_ts").alias("run_start"), F.max("_ts").alias("run_end"), F.count(F.lit(1)).alias("rows_in_run"))
        .select(F.col("_k.key").alias(key), "run_no", "run_start", "run_end", "rows_in_run")
    )


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    right_tie: str,
    take: Sequence[str],
    bucket_seconds: int = 3600,
    lookback_seconds: int | None = None,
) -> DataFrame:
    """As-of left join: each left row gets the ``take`` columns of the latest right row at or before its time.

    Inside a (key, time bucket) a window finds the match; the last right row of earlier buckets is carried forward over
    one summary row per bucket. Rows with a NULL key or time match nothing but are kept.
    """
    keys = list(keys)
    payload = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in take])
    usable = right.where(F.col(right_ts).isNotNull())
    for k in keys:
        usable = usable.where(F.col(k).isNotNull())
    hist = usable.select(
        *keys, F.col(right_ts).alias("_ts"), F.col(right_tie).cast("string").alias("_tie"), _time_bucket(right_ts, bucket_seconds).alias("_b"), payload.alias("_p")
    )
    asks = left.select(
        *keys, F.col(left_ts).alias("_ts"), _time_bucket(left_ts, bucket_seconds).alias("_b"), F.struct(*[F.col(c) for c in left.columns]).alias("_row")
    )
    last_in = hist.groupBy(*keys, "_b").agg(F.max_by("_p", F.struct("_ts", "_tie")).alias("_p"))
    ask_buckets = asks.select(*keys, "_b").distinct()
    marks = last_in.unionByName(ask_buckets, allowMissingColumns=True).groupBy(*keys, "_b").agg(F.first("_p", ignorenulls=True).alias("_p"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*keys, "_b", F.last("_p", ignorenulls=True).over(before).alias("_carry"))
    # right rows sort ahead of left rows at the same time
    merged = hist.withColumn("_side", F.lit(0)).unionByName(asks.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_b").orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    asked = merged.withColumn("_in", F.last("_p", ignorenulls=True).over(inside)).where("_side = 1")
    found = null_safe_join(asked.select(*keys, "_b", "_ts", "_row", "_in"), carried, [*keys, "_b"], "left").withColumn("_m", F.coalesce("_in", "_carry"))
    valid = F.col("_ts").isNotNull()
    for k in keys:
        valid = valid & F.col(k).isNotNull()
    if lookback_seconds is not None:
        gap = F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("_m._at").cast("timestamp"))
        valid = valid & (gap <= lookback_seconds * 1_000_000)
    return found.select(
        "_row.*", *[F.when(valid, F.col(f"_m.{c}")).alias(c) for c in take], F.when(valid, F.col("_m._at")).alias("matched_ts")
    )
