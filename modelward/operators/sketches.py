"""Sketches that are stored per part of a table and merged later, without another look at its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelward.functions.columns import count_where, ratio, ratio_or_zero
from modelward.functions.relational import wide_to_rows

#: Size of a quantile sketch, and as a power of two the size of a distinct sketch.
KLL_SIZE, HLL_SIZE = 800, 14
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def rank_error(size: int = KLL_SIZE) -> float:
    """Largest error of a quantile's rank, as a share of the rows, in 99 of 100 sketches; merging does not add to it."""
    return 2.296 / size**0.9021


def distinct_error(size: int = HLL_SIZE) -> float:
    """Standard error of a united distinct count, as a share of it."""
    return 1.04 / 2 ** (size / 2)


def latency_sketches(requests: DataFrame, size: str = "1 hour", ts: str = "ts", key: str = "model_id", value: str = "latency_ms", is_error: str = "is_error", k: int = KLL_SIZE) -> DataFrame:
    """One row per model and window: requests, errors, and a sketch of the latencies; to be stored.

    Tasks send one sketch per model and window, however many requests they have read.
    """
    window = F.window(ts, size)["start"].alias("window_start")
    return requests.groupBy(key, window).agg(
        F.count(F.lit(1)).alias("requests"), count_where(F.col(is_error)).alias("errors"), F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("latency_sketch")
    )


def merged_latency(sketches: DataFrame, size: str = "1 day", key: str = "model_id", k: int = KLL_SIZE, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """Stored sketches merged to longer windows: requests, error rate and latency quantiles, each an observed value.

    A quantile's rank is off by `rank_error` at most, in 99 of 100 cases; windows of up to ``k`` requests are nearly exact.
    """
    window = F.window("window_start", size)["start"].alias("window_start")
    merged = sketches.groupBy(key, window).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("latency_sketch", k).alias("latency_sketch"))
    found = [F.kll_sketch_get_quantile_double("latency_sketch", F.lit(float(p))).alias(name) for name, p in quantiles.items()]
    return merged.select(key, "window_start", "requests", ratio(F.col("errors"), F.col("requests")).alias("error_rate"), *[F.when(F.kll_sketch_get_n_double("latency_sketch") > 0, f).alias(n) for n, f in zip(quantiles, found)])


def rank_errors(estimates: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """How far the rank of each estimated quantile is from the asked one, by counting the rows below it and up to it.

    Rows are summed per key and value before they meet the estimates.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    met = counts.join(estimates.select(*keys, *quantiles), list(keys))
    sums = [F.sum("_n").alias("_all")]
    for name in quantiles:
        sums += [F.sum(F.when(F.col(value) < F.col(name), F.col("_n")).otherwise(0)).alias(f"_below_{name}"), F.sum(F.when(F.col(value) <= F.col(name), F.col("_n")).otherwise(0)).alias(f"_to_{name}")]
    wide = met.groupBy(*keys).agg(*sums)
    asked = lambda p: F.lit(float(p))
    gap = lambda name, p: F.greatest(F.lit(0.0), ratio(F.col(f"_below_{name}"), F.col("_all")) - asked(p), asked(p) - ratio(F.col(f"_to_{name}"), F.col("_all")))
    return wide_to_rows(wide, [(name, {"requests": F.col("_all"), "rank_error": gap(name, p)}) for name, p in quantiles.items()], list(keys), "quantile")


def _text(c: str, kind: str) -> Column:
    """A value as text, so that equal values of any type are one; the two zeros are equal."""
    return (F.col(c) + 0.0 if kind in ("double", "float") else F.col(c)).cast("string")


def distinct_sketches(df: DataFrame, columns: Sequence[str], part: Sequence[str], size: int = HLL_SIZE) -> DataFrame:
    """One row per part of the table and column: rows, NULLs, and a sketch of the distinct values; to be stored.

    All columns are read in one pass, and a part can be done again by itself.
    """
    kinds = dict(df.dtypes)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs += [count_where(F.col(c).isNull()).alias(f"_null_{c}"), F.hll_sketch_agg(_text(c, kinds[c]), size).alias(f"_sketch_{c}")]
    wide = df.groupBy(*part).agg(*aggs)
    return wide_to_rows(wide, [(c, {"row_count": F.col("_rows"), "null_count": F.col(f"_null_{c}"), "distinct_sketch": F.col(f"_sketch_{c}")}) for c in columns], list(part), "column_name")


def united_distinct(sketches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, NULL share and distinct count per column over all stored parts, or per ``keys``; off by `distinct_error`."""
    united = sketches.groupBy(*keys, "column_name").agg(F.sum("row_count").alias("row_count"), F.sum("null_count").alias("_nulls"), F.hll_union_agg("distinct_sketch").alias("_sketch"))
    return united.select(*keys, "column_name", "row_count", ratio_or_zero(F.col("_nulls") * 100.0, F.col("row_count")).alias("null_pct"), F.hll_sketch_estimate("_sketch").alias("distinct_count"))
