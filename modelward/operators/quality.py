"""Contract-driven data quality: one pass over the table for all column rules, one more for uniqueness."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelward.functions.columns import array_text, bucket_at_least, count_where, instant, ratio_or_zero, row_id
from modelward.functions.identifiers import check_column, check_table, usable_columns
from modelward.functions.ordered import quantiles_of, running_totals
from modelward.functions.relational import long_form, numeric_columns, top_per_key, wide_to_rows
from modelward.operators.moments import moment_matrix, pair_rows

Contract = Sequence[Mapping]

CHECKS = ("null_check", "uniqueness_check", "range_check", "allowed_values", "format_check", "distribution_check", "outlier_check")


def _rules(col: Mapping) -> dict:
    raw = col.get("quality_rules")
    if isinstance(raw, Mapping):
        return dict(raw)
    try:
        parsed = json.loads(raw or "{}")
    except (TypeError, ValueError):
        return {}
    return parsed if isinstance(parsed, dict) else {}


def _max_null_pct(col: Mapping) -> float | None:
    rule = _rules(col).get("null_check")
    if rule is None and col.get("is_nullable") is not False:
        return None
    return float((rule or {}).get("max_null_pct", 0.0))


def _must_be_unique(col: Mapping) -> bool:
    rule = _rules(col).get("uniqueness_check")
    return bool(rule and rule.get("must_be_unique"))


def gated(contract: Contract) -> list[Mapping]:
    """Columns that count for the score and whose name may enter a query."""
    return [c for c in contract if c.get("is_required_for_quality", True) and usable_columns([c.get("column_name") or ""])]


def value_rules(col: Mapping) -> dict[str, Column]:
    """Row conditions that mean a broken value; NULL values break none of them."""
    c = F.col(col["column_name"])
    rules = {}
    low, high = col.get("min_value"), col.get("max_value")
    if low is not None or high is not None:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (c < F.lit(low))
        if high is not None:
            bad = bad | (c > F.lit(high))
        rules["range_check"] = F.coalesce(bad, F.lit(False))
    if col.get("allowed_values"):
        rules["allowed_values"] = F.coalesce(~c.cast("string").isin(list(col["allowed_values"])), F.lit(False))
    if col.get("pattern_regex"):
        rules["format_check"] = F.coalesce(~c.cast("string").rlike(col["pattern_regex"]), F.lit(False))
    return rules


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and NULL count per column, one pass."""
    cols = usable_columns(list(columns))
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[count_where(F.col(c).isNull()).alias(f"_null_{c}") for c in cols])
    return wide_to_rows(wide, [(c, {"row_count": F.col("_n"), "null_count": F.col(f"_null_{c}")}) for c in cols], name="column_name")


def value_counts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each non-NULL value per column: counting distinct values needs no row copies per column."""
    cells = long_form(df, columns, keep).where(F.col("value").isNotNull())
    return cells.groupBy(*keep, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def duplicate_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``count(c) - count(distinct c)`` of every column in one job.

    Whole numbers stay numbers in the (column, value) count; all else is compared as text.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    whole = {c for c, kind in kinds.items() if kind in ("tinyint", "smallint", "int", "bigint")}
    # Adding zero makes -0.0 the same text as 0.0.
    plain = lambda c: (F.col(c) + F.lit(0.0)).cast(kinds[c]) if kinds[c] in ("float", "double") else F.col(c)

    def cell(i, c):
        number, text = (F.col(c).cast("bigint"), F.lit(None).cast("string")) if c in whole else (F.lit(None).cast("bigint"), plain(c).cast("string"))
        return F.struct(F.lit(i).alias("at"), number.alias("number"), text.alias("text"))

    cells = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("_c")).where("_c.number IS NOT NULL OR _c.text IS NOT NULL")
    counts = cells.groupBy("_c.at", "_c.number", "_c.text").agg((F.count(F.lit(1)) - 1).alias("n"))
    wide = counts.agg(*[F.sum(F.when(F.col("at") == i, F.col("n"))).alias(f"_dup_{c}") for i, c in enumerate(columns)])
    return wide_to_rows(wide, [(c, {"duplicate_count": F.coalesce(F.col(f"_dup_{c}"), F.lit(0).cast("long"))}) for c in columns], name="column_name")


def outlier_counts(df: DataFrame, columns: Sequence[str], factor: float = 3.0) -> DataFrame:
    """Values outside [Q1 - factor*IQR, Q3 + factor*IQR] per column, with exact quartiles.

    Quartiles and counts both come from the running totals of (column, value), so the table is read once.
    """
    cells = long_form(df, columns, as_type="double").select("field", "value", F.lit(1).alias("n"))
    runs = running_totals(cells, ["field"], "value", ["n"])
    fences = quantiles_of(runs, ["field"], "value", "n", {"q1": 0.25, "q3": 0.75}).select(
        "field", (F.col("q1") - factor * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + factor * (F.col("q3") - F.col("q1"))).alias("high")
    )
    outside = (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))
    # one row per column of the schema: small by construction
    return (
        runs.join(F.broadcast(fences), "field")
        .groupBy("field")
        .agg(
            F.first("low").alias("low_fence"),
            F.first("high").alias("high_fence"),
            F.sum("n").alias("values_seen"),
            F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count"),
        )
        .withColumnRenamed("field", "column_name")
    )


def _one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct, computed beside the pass that uses it."""
    return df.select(F.struct(*df.columns)).scalar()


def _checked(df: DataFrame, contract: Contract, all_rules: bool) -> tuple[DataFrame, list[str]]:
    """One row with the row count and the array of checks, and the column each check belongs to.

    One pass serves all column rules; uniqueness and outliers are one further job each, read as scalars.
    """
    cols = gated(contract)
    aggs, checks, owners = [F.count(F.lit(1)).alias("row_count")], [], []

    def check(col, name, bad, failed, detail):
        owners.append(col)
        checks.append(F.struct(F.lit(col).alias("column"), F.lit(name).alias("check"), bad.cast("long").alias("issue_rows"), failed.alias("failed"), detail.alias("detail")))

    unique = [c["column_name"] for c in cols if _must_be_unique(c)]
    fences = {c["column_name"]: float(_rules(c)["outlier_check"].get("iqr_factor", 3.0)) for c in cols if all_rules and _rules(c).get("outlier_check")}
    if unique:
        rows = duplicate_counts(df, unique)
        dup = _one_row(rows.agg(*[F.max(F.when(F.col("column_name") == c, F.col("duplicate_count"))).alias(c) for c in unique]))
    outliers = {}
    for factor in sorted(set(fences.values())):
        names = [c for c, f in fences.items() if f == factor]
        rows = outlier_counts(df, names, factor)
        found = _one_row(rows.agg(*[F.max(F.when(F.col("column_name") == c, F.col("outlier_count"))).alias(c) for c in names]))
        outliers.update({c: F.coalesce(found[c], F.lit(0)) for c in names})

    for col in cols:
        name = col["column_name"]
        limit = _max_null_pct(col)
        if limit is not None:
            nulls = F.col(f"_null_{name}")
            aggs.append(count_where(F.col(name).isNull()).alias(f"_null_{name}"))
            pct = ratio_or_zero(nulls * 100, F.col("row_count"))
            check(name, "null_check", nulls, pct > limit, F.format_string("%.1f%% null, exceeds max " + f"{limit:.1f}%%", pct))
        if name in unique:
            check(name, "uniqueness_check", dup[name], dup[name] > 0, F.concat(dup[name].cast("string"), F.lit(" duplicate value(s)")))
        if not all_rules:
            continue
        for rule, bad in value_rules(col).items():
            hits = F.col(f"_{rule}_{name}")
            aggs.append(count_where(bad).alias(f"_{rule}_{name}"))
            check(name, rule, hits, hits > 0, F.concat(hits.cast("string"), F.lit(" value(s) break the rule")))
        dist = _rules(col).get("distribution_check")
        if dist and dist.get("expected_mean"):
            aggs.append(F.avg(name).alias(f"_mean_{name}"))
            want = float(dist["expected_mean"])
            off = F.abs(F.col(f"_mean_{name}") - want) / abs(want) * 100
            far = F.coalesce(off > float(dist.get("tolerance_pct", 10.0)), F.lit(False))
            check(name, "distribution_check", F.lit(0), far, F.concat(F.lit("mean is off by "), F.round(off, 1).cast("string"), F.lit("%")))
        if name in outliers:
            check(name, "outlier_check", outliers[name], outliers[name] > 0, F.concat(outliers[name].cast("string"), F.lit(" outlier(s)")))
    empty = F.array().cast("array<struct<column:string,check:string,issue_rows:bigint,failed:boolean,detail:string>>")
    return df.agg(*aggs).select("row_count", (F.array(*checks) if checks else empty).alias("checks")), owners


def contract_checks(df: DataFrame, contract: Contract, all_rules: bool = False) -> DataFrame:
    """One row per check run: column, check, broken rows, verdict and explanation.

    Null and uniqueness checks always run; ``all_rules`` adds range, allowed values, format, mean and outlier checks.
    """
    one, _ = _checked(df, contract, all_rules)
    return one.select("row_count", F.explode("checks").alias("_c")).select("row_count", "_c.*")


def assess_contract(
    df: DataFrame, contract: Contract, *, project_id: str, contract_id: str, table_name: str, as_of, all_rules: bool = False
) -> DataFrame:
    """Score a table against its contract: one row, ready to append to the assessment log.

    The score is the share of passed checks, 1.0 when none ran; ``checks_run`` tells the two apart.
    """
    check_table(table_name)
    one, owners = _checked(df, contract, all_rules)
    failed = lambda *names: F.filter("checks", lambda c: c["failed"] & c["check"].isin(*names))
    of = lambda col: F.size(F.filter("checks", lambda c: c["failed"] & (c["column"] == col)))
    scores = [x for col in sorted(set(owners)) for x in (F.lit(col), 1.0 - of(col) / F.lit(float(owners.count(col))))]
    pii = [c["column_name"] for c in contract if c.get("pii_level") and c["pii_level"] != "none"]
    found = F.col("issues_found")
    issues = {"null": ["null_check"], "uniqueness": ["uniqueness_check"], "format": ["format_check"], "outlier": ["outlier_check"], "distribution": ["distribution_check"], "range": ["range_check", "allowed_values"]}
    return (
        one.withColumn("checks_run", F.size("checks"))
        .withColumn("issues_found", F.size(failed(*CHECKS)))
        .withColumn("quality_score", F.when(F.col("checks_run") > 0, 1.0 - found / F.col("checks_run")).otherwise(F.lit(1.0)))
        .select(
            row_id(F.lit(project_id), F.lit(contract_id), F.lit(table_name), F.lit(str(as_of))).alias("assessment_id"),
            F.lit(project_id).alias("project_id"),
            F.lit(contract_id).alias("contract_id"),
            F.lit(table_name).alias("table_name"),
            instant(as_of).alias("assessment_timestamp"),
            "row_count",
            "checks_run",
            "issues_found",
            "quality_score",
            bucket_at_least(F.col("quality_score")).alias("quality_status"),
            (F.create_map(*scores) if scores else F.create_map()).cast("map<string,double>").alias("column_quality_scores"),
            F.sort_array(F.transform(failed(*CHECKS), lambda c: F.struct(c["column"].alias("column"), c["check"].alias("check"), c["detail"].alias("detail")))).alias("failed_checks"),
            *[F.size(failed(*names)).alias(f"{kind}_issues_found") for kind, names in issues.items()],
            F.array(*[F.lit(c) for c in pii]).cast("array<string>").alias("pii_columns_detected"),
        )
    )


def training_gate(assessment: DataFrame, minimum: float = 0.5, overridden: bool = False) -> DataFrame:
    """Whether training may go on; a low score passes only with an override."""
    ok = F.col("quality_score") >= minimum
    return assessment.withColumn("gate", F.when(ok, "pass").when(F.lit(overridden), "overridden").otherwise("blocked"))


def table_limits(df: DataFrame, columns: Sequence[str], *, minimum_rows: int, max_duplicate_pct: float, max_outlier_pct: float) -> DataFrame:
    """Table-level limits: row count, duplicate rows and outlier share, one verdict row each."""
    summary = row_summary(df)
    rows = wide_to_rows(
        summary,
        [
            ("row_count", {"observed": F.col("row_count").cast("double"), "bound": F.lit(float(minimum_rows)), "ok": F.col("row_count") >= minimum_rows}),
            ("duplicate_rows_pct", {"observed": F.col("duplicate_rows_pct"), "bound": F.lit(float(max_duplicate_pct)), "ok": F.col("duplicate_rows_pct") <= max_duplicate_pct}),
        ],
        name="limit_name",
    )
    pct = ratio_or_zero(F.sum("outlier_count") * 100, F.sum("values_seen"))
    outliers = outlier_counts(df, columns).agg(pct.alias("observed")).select(
        F.lit("outlier_pct").alias("limit_name"), "observed", F.lit(float(max_outlier_pct)).alias("bound"), (F.col("observed") <= max_outlier_pct).alias("ok")
    )
    return rows.unionByName(outliers)


def row_quality(df: DataFrame, contract: Contract) -> DataFrame:
    """Each row with its broken checks, its warnings and its score.

    Columns marked as required break a row; the others only warn.
    """
    fatal, soft = [], []
    for col in contract:
        name = col.get("column_name") or ""
        if not usable_columns([name]):
            continue
        tests = dict(value_rules(col))
        if _max_null_pct(col) is not None:
            tests["null_check"] = F.col(name).isNull()
        target = fatal if col.get("is_required_for_quality", True) else soft
        target += [F.when(bad, F.lit(f"{name}:{check}")) for check, bad in tests.items()]

    def found(tests):
        return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")

    scored = df.withColumn("failed_checks", found(fatal)).withColumn("warnings", found(soft))
    return scored.withColumn("row_score", 1.0 - F.size("failed_checks") / F.lit(float(max(1, len(fatal)))))


def split_quarantine(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that passed, rows to hold back), two filters over the row checks."""
    return scored.where(F.size("failed_checks") == 0), scored.where(F.size("failed_checks") > 0)


def failures_by_check(scored: DataFrame) -> DataFrame:
    """Broken rows per column and check."""
    parts = F.split("item", ":")
    return (
        scored.select(F.explode("failed_checks").alias("item"))
        .groupBy("item")
        .agg(F.count(F.lit(1)).alias("failed_rows"))
        .select(parts[0].alias("column_name"), parts[1].alias("check_name"), "failed_rows")
    )


def outside_reference(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Allowed values as a table: values of ``column`` missing from ``reference``, with their row counts."""
    seen = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    return seen.join(reference.select(F.col(ref_column).alias("value")), "value", "left_anti")


def row_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, share of missing cells and share of rows that repeat an earlier one.

    Rows are grouped by two independent 64-bit hashes, so the shuffle carries 16 bytes a row instead of the row.
    """
    # a map is hashed by its entries in order, as maps themselves can't be
    cols = [F.array_sort(F.map_entries(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema.fields]
    missing = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    # a NULL does not change a running hash, so its position is hashed as well
    marks = [c.isNull() for c in cols]
    groups = df.groupBy(F.xxhash64(*cols, *marks).alias("_h1"), F.xxhash64(F.lit("second"), *marks, *cols).alias("_h2"), missing.alias("_gaps")).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        (ratio_or_zero(F.sum(F.col("_gaps") * F.col("_n")), F.sum("_n")) / len(df.columns) * 100.0).alias("missing_cells_pct"),
        (ratio_or_zero(F.sum(F.col("_n") - 1), F.sum("_n")) * 100.0).alias("duplicate_rows_pct"),
    )


def quick_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False, acceptable_above: float = 5.0) -> DataFrame:
    """Null share and distinct count of every column in one pass, with the suggested rule class.

    Distinct counts are sketches unless ``exact``, which takes a second job over (column, value).
    """
    cols = usable_columns(list(columns or df.columns))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        aggs.append(count_where(F.col(c).isNull()).alias(f"_null_{c}"))
        if not exact:
            aggs.append(F.approx_count_distinct(c).alias(f"_dist_{c}"))
    rows = wide_to_rows(
        df.agg(*aggs),
        [
            (c, {"row_count": F.col("_n"), "null_pct": ratio_or_zero(F.col(f"_null_{c}") * 100.0, F.col("_n")), **({} if exact else {"distinct_count": F.col(f"_dist_{c}")})})
            for c in cols
        ],
        name="column_name",
    )
    if exact:
        distinct = value_counts(df, cols).groupBy(F.col("field").alias("column_name")).agg(F.count(F.lit(1)).alias("distinct_count"))
        rows = rows.join(distinct, "column_name", "left").fillna(0, ["distinct_count"])
    return rows.withColumn("suggested_rule", F.when(F.col("null_pct") > acceptable_above, "acceptable").otherwise("required"))


def suggest_rules(df: DataFrame, columns: Sequence[str] | None = None, max_null_pct: float = 5.0) -> DataFrame:
    """Contract rules read off the data: null limit, value range, uniqueness and the commonest shape of the text."""
    cols = usable_columns(list(columns or df.columns))
    numeric = set(numeric_columns(df, cols))
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"_cnt_{c}")]
        if c in numeric:
            aggs += [F.min(c).cast("double").alias(f"_min_{c}"), F.max(c).cast("double").alias(f"_max_{c}")]
    none = F.lit(None).cast("double")
    base = wide_to_rows(
        df.agg(*aggs),
        [(c, {"values_seen": F.col(f"_cnt_{c}"), "min_value": F.col(f"_min_{c}") if c in numeric else none, "max_value": F.col(f"_max_{c}") if c in numeric else none}) for c in cols],
        name="column_name",
    )
    counted = value_counts(df, cols)
    distinct = counted.groupBy("field").agg(F.count(F.lit(1)).alias("distinct_count"))
    texts = [c for c in cols if c not in numeric]
    shaped = F.regexp_replace(F.regexp_replace(F.col("value"), "[A-Za-z]+", "A"), "[0-9]+", "9")
    shapes = top_per_key(
        counted.where(F.col("field").isin(texts)).groupBy("field", shaped.alias("shape")).agg(F.sum("n").alias("n")), ["field"], [F.desc("n"), F.asc("shape")]
    ).select("field", F.col("shape").alias("common_shape"))
    return (
        base.join(distinct.withColumnRenamed("field", "column_name"), "column_name", "left")
        .join(shapes.withColumnRenamed("field", "column_name"), "column_name", "left")
        .select(
            "column_name",
            F.lit(float(max_null_pct)).alias("max_null_pct"),
            "min_value",
            "max_value",
            ((F.col("values_seen") > 0) & (F.coalesce("distinct_count", F.lit(0)) == F.col("values_seen"))).alias("must_be_unique"),
            "common_shape",
        )
    )


def conformance(df: DataFrame, contract: Contract) -> DataFrame:
    """Contract against table: missing columns, wrong types, and NULLs where none are allowed (counted over all rows)."""
    actual = {f.name.lower(): f for f in df.schema.fields}
    names = [check_column(c["column_name"]) for c in contract]
    present = [c for c in contract if c["column_name"].lower() in actual]
    aggs = [F.count(F.lit(1)).alias("_n")] + [count_where(F.col(c["column_name"]).isNull()).alias(f"_null_{c['column_name']}") for c in present]
    entries = []
    for name, col in zip(names, contract):
        field = actual.get(name.lower())
        want = (col.get("data_type") or "").lower()
        have = field.dataType.simpleString() if field else None
        type_ok = bool(field) and (not want or have == want or (want == "struct" and have.startswith("struct")) or (want == "timestamp" and have == "timestamp_ntz"))
        nulls = F.col(f"_null_{name}") if field else F.lit(None).cast("long")
        null_ok = F.lit(True) if col.get("is_nullable", True) else F.coalesce(nulls == 0, F.lit(False))
        issue = F.when(F.lit(field is None), "missing").when(F.lit(not type_ok), "type").when(~null_ok, "nullability").otherwise("ok")
        entries.append((name, {"declared_type": F.lit(want), "actual_type": F.lit(have).cast("string"), "null_count": nulls, "result": issue}))
    return wide_to_rows(df.agg(*aggs), entries, name="column_name")


def freshness(df: DataFrame, ts: str, as_of, freshness_hours: float, keys: Sequence[str] = ()) -> DataFrame:
    """Hours since the newest row against the declared limit; no rows at all is stale."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("last_row"))
    hours = F.timestamp_diff("SECOND", F.col("last_row"), instant(as_of)) / 3600.0
    return last.withColumn("hours_since", hours).withColumn("is_stale", F.coalesce(F.col("hours_since") > freshness_hours, F.lit(True)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, each over the rows in which both have a value; one pass."""
    return pair_rows(moment_matrix(df, columns), columns).drop("n")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram per column between its smallest and largest value."""
    spans = wide_to_rows(
        df.agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]),
        [(c, {"low": F.col(f"_min_{c}"), "high": F.col(f"_max_{c}")}) for c in columns],
    )
    at = F.when(F.col("high") > F.col("low"), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).otherwise(F.lit(0))
    # one row per column of the schema: small by construction
    return (
        long_form(df, columns, as_type="double")
        .where(F.col("value").isNotNull())
        .join(F.broadcast(spans), "field")
        .groupBy("field", F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Words in a column name that point at personal data.
PII_WORDS = ("email", "ssn", "social_security", "phone", "address", "dob", "birth", "zip", "postal", "name", "passport", "license")

# Words in a column name that point at a proxy for a protected class; the first hit counts.
PROXY_WORDS = {
    "zip": "Race / Ethnicity",
    "postal": "Race / Ethnicity",
    "region": "Race / Ethnicity",
    "neighborhood": "Race / Ethnicity",
    "school": "Race / Ethnicity",
    "age": "Age",
    "birth": "Age",
}

# Personal data in free text: what may be one, and a substring without which none is there. Whole texts are
# searched. Lengths are bounded (as in addresses themselves), so that a long run of letters costs a fixed number of steps per
# character; numbers may not go on in digits on either side.
PII_PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}\.[A-Za-z]{2,}", "@"),
    "ssn": (r"(?<![0-9]|[0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])", "-"),
    "phone": (r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", None),
    "card": (r"(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])", None),
    "ip": (r"(?<![0-9]|[0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])", "."),
}


def _check_digit(number: Column) -> Column:
    """Whether the last digit of a card number fits the others: every second one counts twice, its digits added."""
    digits = F.transform(F.split(F.regexp_replace(number, "[^0-9]", ""), ""), lambda d: d.cast("int"))
    doubled = F.transform(F.reverse(digits), lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


# Numbers that are never given out, and numbers out of their range.
PII_CHECKS = {
    "ssn": lambda x: ~x.rlike("^(000|666|9..)-|-00-|-0000$"),
    "phone": lambda x: ~x.rlike(r"^\(?[01]"),
    "card": _check_digit,
    "ip": lambda x: F.forall(F.split(x, "[.]"), lambda part: part.cast("int") <= 255),
}


def tag_columns(catalog: DataFrame, name: str = "column_name") -> DataFrame:
    """Mark column names that suggest personal data or a proxy for a protected class."""
    low = F.lower(F.col(name))
    pii = F.lit(False)
    for word in PII_WORDS:
        pii = pii | low.contains(word)
    proxy = F
    for word, group in PROXY_WORDS.items():
        proxy = proxy.when(low.contains(word), F.lit(group))
    return (
        catalog.withColumn("looks_pii", pii)
        .withColumn("proxy_class", proxy.otherwise(F.lit(None).cast("string")))
        .withColumn("classification", F.when(F.col("looks_pii"), "sensitive").otherwise("internal"))
    )


def scan_pii(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hits of each kind of personal data per text column, all in one pass over whole texts.

    Numbers count if they stand alone and can be what they look like: by the ranges of their parts, or their check digit.
    """
    aggs, entries = [F.count(F.lit(1)).alias("_n")], []
    for c in columns:
        for kind, (pattern, guard) in PII_PATTERNS.items():
            # a cheap substring test spares most rows the pattern
            if kind in PII_CHECKS:
                hits = F.size(F.filter(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(0)), PII_CHECKS[kind]))
            else:
                hits = F.regexp_count(F.col(c), F.lit(pattern))
            hits = F.when(F.col(c).contains(guard), hits) if guard else hits
            hits = F.coalesce(hits, F.lit(0))
            aggs += [F.sum(hits).alias(f"_h_{c}_{kind}"), count_where(hits > 0).alias(f"_r_{c}_{kind}")]
            entries.append(
                (c, {"kind": F.lit(kind), "hits": F.coalesce(F.col(f"_h_{c}_{kind}"), F.lit(0)), "rows_with_hits": F.col(f"_r_{c}_{kind}"),
                     "hit_rate": ratio_or_zero(F.col(f"_r_{c}_{kind}"), F.col("_n"))})
            )
    return wide_to_rows(df.agg(*aggs), entries, name="column_name")


def suppress_pii(df: DataFrame, methods: Mapping[str, str]) -> DataFrame:
    """Apply ``mask``, ``hash`` or ``drop`` to the named columns."""
    out = df
    for name, how in methods.items():
        check_column(name)
        if how == "drop":
            out = out.drop(name)
        elif how == "mask":
            out = out.withColumn(name, F.mask(F.col(name).cast("string")))
        elif how == "hash":
            out = out.withColumn(name, F.sha2(F.col(name).cast("string"), 256))
        else:
            raise ValueError(f"unknown suppression method: {how!r}")
    return out


def failed_text(col: str = "failed_checks") -> Column:
    """Failed checks of an assessment as sorted text."""
    return array_text(F.transform(F.col(col), lambda f: F.concat_ws(":", f["column"], f["check"], f["detail"])))
