"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, datetime
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered vocabularies, least to most severe.
CLASSIFICATIONS = ("public", "internal", "sensitive", "restricted")
ON_DUE_ACTIONS = ("warn", "block_new_traffic", "block_all_traffic")
SEVERITIES = ("none", "low", "medium", "high", "critical")

# Lower bound of each quality status, best first.
QUALITY_STATUS = ((0.95, "excellent"), (0.85, "good"), (0.70, "acceptable"), (0.50, "poor"))
QUALITY_STATUS_ELSE = "critical"

# Upper bound of each PSI band.
PSI_BANDS = ((0.1, "none"), (0.2, "moderate"))
PSI_BAND_ELSE = "significant"


def instant(as_of: str | date | datetime | Column) -> Column:
    """``as_of`` as a zone-free timestamp, so results do not hang on the session time zone."""
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("timestamp_ntz")


def within_days(ts: str | Column, as_of, days: int | Column) -> Column:
    """``ts`` falls in the last ``days`` days; the edge is midnight, as a DATE is compared."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return col >= F.date_sub(F.to_date(instant(as_of)), days)


def whole_seconds(ts: str | Column) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_seconds(col.cast("timestamp"))


def days_between(start, end) -> Column:
    """Difference of whole seconds, in days."""
    return (whole_seconds(end) - whole_seconds(start)) / F.lit(86400.0)


def ratio(num: Column, den: Column) -> Column:
    """NULL instead of an error when the denominator is 0."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(ratio(num, den), F.lit(0.0))


def share(flag: Column) -> Column:
    """Share of rows where ``flag`` holds; NULL counts as not holding."""
    return F.avg(F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_where(flag: Column) -> Column:
    return F.count(F.when(flag, F.lit(1)))


def bucket_at_least(value: Column, bounds=QUALITY_STATUS, otherwise: str = QUALITY_STATUS_ELSE) -> Column:
    """First name whose lower bound ``value`` reaches; bounds run from high to low."""
    out = F
    for low, name in bounds:
        out = out.when(value >= F.lit(float(low)), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def bucket_below(value: Column, bounds=PSI_BANDS, otherwise: str = PSI_BAND_ELSE) -> Column:
    """First name whose upper bound ``value`` stays under; NULL stays NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for high, name in bounds:
        out = out.when(value < F.lit(float(high)), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def budget_status(total: Column, warn: float | Column, crit: float | Column) -> Column:
    total = F.coalesce(total, F.lit(0.0))
    return F.when(total >= crit, "critical").when(total >= warn, "warning").otherwise("ok")


def level_rank(level: Column, ladder: tuple[str, ...]) -> Column:
    """Position of ``level`` on ``ladder``; NULL for unknown levels."""
    return F.try_element_at(F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(ladder))), level)


def strictest(level: Column, ladder: tuple[str, ...]) -> Column:
    """Aggregate: the highest known level; NULL when none is known."""
    return F.max_by(level, level_rank(level, ladder))


def ladder_level(rank: Column, ladder: tuple[str, ...]) -> Column:
    return F.try_element_at(F.array(*[F.lit(v) for v in ladder]), rank + 1)


def drift_severity(score: Column, threshold: Column) -> Column:
    """Severity by how many times the score exceeds its threshold."""
    times = score / F.nullif(threshold, F.lit(0.0))
    return (
        F.when(times.isNull(), F.lit(None).cast("string"))
        .when(times < 1.0, "none")
        .when(times < 1.5, "low")
        .when(times < 2.0, "medium")
        .when(times < 3.0, "high")
        .otherwise("critical")
    )


def contains_any(query: str, *cols: str) -> Column:
    """Literal substring match over several columns."""
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).contains(query), F.lit(False))
    return hit


def stamp(ts: str | Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(col, pattern)


def row_id(*cols: str | Column) -> Column:
    """Repeatable id from the key columns, so a re-run yields the same rows."""
    return F.sha2(F.concat_ws(":", *cols), 256)


def parse_instant(raw: Column) -> Column:
    """ISO-8601 text to a timestamp; text without a zone is UTC, unreadable text is NULL."""
    return F.try_to_timestamp(raw)


def array_text(arr: Column) -> Column:
    """A sorted array as comma-separated text."""
    return F.array_join(F.sort_array(arr), ",")


def in_period(ts: str | Column, days: int) -> Column:
    """Number of the ``days``-long period a date falls in, counting days from year 1."""
    col = F.col(ts) if isinstance(ts, str) else ts
    # 719163 = ordinal of 1970-01-01 in the proleptic calendar
    return F.floor((F.datediff(F.to_date(col), F.lit("1970-01-01").cast("date")) + 719163) / F.lit(days)).cast("long")


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov p-value: 2 * sum (-1)^(k-1) exp(-2 k^2 lambda^2)."""
    lam = d * F.sqrt(n.cast("double") * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))


def psi_term(cur: Column, base: Column, eps: float = 1e-4) -> Column:
    """One bin's share of the population stability index; shares are floored at ``eps``."""
    c = F.greatest(F.coalesce(cur, F.lit(0.0)), F.lit(eps))
    b = F.greatest(F.coalesce(base, F.lit(0.0)), F.lit(eps))
    return (c - b) * F.log(c / b)
