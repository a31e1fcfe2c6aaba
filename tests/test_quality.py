import pytest
from pyspark.sql import functions as F

from modelward.functions.columns import bucket_at_least
from modelward.functions.identifiers import UnsafeName, check_column, check_table
from modelward.operators import quality as q

NULL_RULE = '{"null_check": {"max_null_pct": 5.0}}'
UNIQUE_RULE = '{"uniqueness_check": {"must_be_unique": true}}'


def assess(df, contract, **kw):
    return q.assess_contract(df, contract, project_id="p", contract_id="c", table_name="a.b", as_of="2024-01-01", **kw).first()


def hundred(spark, nulls):
    return spark.range(100).select(F.when(F.col("id") >= nulls, F.col("id")).alias("age"), (F.col("id") % 99).alias("code"))


def col(name="age", **kw):
    return {"column_name": name, "is_nullable": True, "is_required_for_quality": True, "pii_level": "none", **kw}


def test_null_share_within_and_over_the_limit(spark):
    ok = assess(hundred(spark, 5), [col(quality_rules=NULL_RULE)])
    assert (ok.quality_score, ok.quality_status, ok.checks_run, ok.issues_found, ok.row_count) == (1.0, "excellent", 1, 0, 100)
    bad = assess(hundred(spark, 6), [col(quality_rules=NULL_RULE)])
    assert (bad.quality_score, bad.quality_status, bad.null_issues_found) == (0.0, "critical", 1)
    assert [tuple(f) for f in bad.failed_checks] == [("age", "null_check", "6.0% null, exceeds max 5.0%")]


def test_not_nullable_needs_no_rule(spark):
    assert assess(hundred(spark, 1), [col(is_nullable=False)]).issues_found == 1


def test_duplicates_break_uniqueness(spark):
    out = assess(hundred(spark, 0), [col(quality_rules=UNIQUE_RULE), col("code", quality_rules=UNIQUE_RULE)])
    assert out.uniqueness_issues_found == 1 and out.quality_score == 0.5 and out.quality_status == "poor"
    assert out.failed_checks[0].detail == "1 duplicate value(s)"
    assert out.column_quality_scores == {"age": 1.0, "code": 0.0}


def test_skipped_columns_and_pii(spark):
    contract = [col("bad name!", is_nullable=False), col(is_nullable=False, is_required_for_quality=False, pii_level="high"), col("code", quality_rules="{broken")]
    out = assess(hundred(spark, 50), contract)
    assert out.checks_run == 0 and out.quality_score == 1.0 and out.pii_columns_detected == ["age"] and out.row_count == 100


def test_empty_table_has_no_null_share(spark):
    out = assess(hundred(spark, 0).where("false"), [col(is_nullable=False, quality_rules=UNIQUE_RULE)])
    assert out.quality_score == 1.0 and out.row_count == 0 and out.checks_run == 2


@pytest.mark.parametrize("score,status", [(0.95, "excellent"), (0.9499, "good"), (0.85, "good"), (0.70, "acceptable"), (0.50, "poor"), (0.49, "critical")])
def test_status_bounds(spark, score, status):
    assert spark.range(1).select(bucket_at_least(F.lit(score)).alias("s")).first().s == status


def test_quick_stats(spark):
    rows = {r.column_name: r for r in q.quick_stats(hundred(spark, 10), exact=True).collect()}
    assert rows["age"].null_pct == 10.0 and rows["age"].suggested_rule == "acceptable" and rows["age"].distinct_count == 90
    assert q.quick_stats(hundred(spark, 1), ["age", "no good"]).first().suggested_rule == "required"


def test_profile_of_three_rows(spark):
    out = q.row_summary(spark.createDataFrame([(1, 2), (1, 2), (3, None)], "a INT, b INT")).first()
    assert out.row_count == 3 and out.column_count == 2
    assert out.duplicate_rows_pct == pytest.approx(100 / 3) and out.missing_cells_pct == pytest.approx(100 / 6)


def test_null_position_matters_for_duplicates(spark):
    out = q.row_summary(spark.createDataFrame([(1, None), (None, 1), (None, None)], "a INT, b INT")).first()
    assert out.duplicate_rows_pct == 0.0


def test_row_rules_and_quarantine(spark):
    df = spark.createDataFrame([(1, "a", 5), (-1, "x", 5), (None, "a", 50)], "n INT, s STRING, w INT")
    contract = [col("n", min_value=0, is_nullable=False), col("s", allowed_values=["a"]), col("w", max_value=10, is_required_for_quality=False)]
    scored = q.row_quality(df, contract)
    kept, held = q.split_quarantine(scored)
    assert kept.count() == 1 and held.count() == 2
    rows = {r.s + str(r.w): r for r in scored.collect()}
    assert rows["x5"].failed_checks == ["n:range_check", "s:allowed_values"] and rows["a50"].warnings == ["w:range_check"]
    assert {(r.column_name, r.check_name, r.failed_rows) for r in q.failures_by_check(scored).collect()} == {("n", "range_check", 1), ("n", "null_check", 1), ("s", "allowed_values", 1)}


def test_outliers_and_constant_columns(spark):
    df = spark.createDataFrame([(float(v), 7.0) for v in [1, 2, 3, 4, 100]], "v DOUBLE, k DOUBLE")
    out = {r.column_name: r.outlier_count for r in q.outlier_counts(df, ["v", "k"]).collect()}
    assert out == {"v": 1, "k": 0}


def test_column_words(spark):
    df = spark.createDataFrame([("zip_code",), ("Customer_Email",), ("mileage",), ("total",)], "column_name STRING")
    rows = {r.column_name: (r.looks_pii, r.proxy_class) for r in q.tag_columns(df).collect()}
    assert rows == {"zip_code": (True, "Race / Ethnicity"), "Customer_Email": (True, None), "mileage": (False, "Age"), "total": (False, None)}


def test_pii_in_whole_texts(spark):
    text = "x" * 200000 + " mail a.b@example.org and c@d.io, 123-45-6789, 10.0.0.1, 4111 1111 1111 1111"
    rows = {r.kind: r.hits for r in q.scan_pii(spark.createDataFrame([(text,), (None,)], "t STRING"), ["t"]).collect()}
    assert rows["email"] == 2 and rows["ssn"] == 1 and rows["ip"] == 1 and rows["card"] == 1


@pytest.mark.parametrize("kind, good, bad", [
    ("ssn", "123-45-6789. 001-01-0001", "000-12-3456 666-12-3456 912-12-3456 123-00-4567 123-45-0000 1123-45-6789 123-45-67890 12-123-45-6789 123-45-6789-1"),
    ("ip", "0.0.0.0, 255.255.255.255. (10.0.0.1) v1.2.3.4", "256.1.1.1 1.2.3.400 1.2.3.4.5 1.2.3 1999.1.1.1"),
    ("card", "4111111111111111 (5500-0000-0000-0004) 4111 1111 1111 1111", "4111111111111112 41111111111111111 94111111111111111 411111111111111"),
    ("phone", "+1 (743) 555-3824, 743.555.3824 743-555-3824", "043-555-3824 143 555 3824 7743-555-3824 743-555-38245"),
    ("email", "a.b@example.org c@d.io", "a@b @example.org a@b.c"),
])
def test_numbers_that_cannot_be_personal_data(spark, kind, good, bad):
    df = spark.createDataFrame([(1, good), (2, bad)], "id INT, t STRING")
    count = lambda i: {r.kind: r.hits for r in q.scan_pii(df.where(f"id = {i}"), ["t"]).collect()}[kind]
    assert count(1) == {"ssn": 2, "ip": 4, "card": 3, "phone": 3, "email": 2}[kind] and count(2) == 0


def test_suppression(spark):
    out = q.suppress_pii(spark.createDataFrame([("Ab1", "x", 3)], "a STRING, b STRING, c INT"), {"a": "mask", "b": "hash", "c": "drop"}).first()
    assert out.a == "Xxn" and len(out.b) == 64 and len(out) == 2
    with pytest.raises(ValueError):
        q.suppress_pii(spark.range(1), {"id": "burn"})


def test_names():
    assert check_table("a.b.c") == "a.b.c" and check_column("x_1") == "x_1"
    for bad in ("a.b.c.d", "a;b", "", "a b"):
        with pytest.raises(UnsafeName):
            check_table(bad)
    with pytest.raises(UnsafeName):
        check_column("a.b")


def test_training_gate(spark):
    low = spark.createDataFrame([(0.4,), (0.5,)], "quality_score DOUBLE")
    assert [r.gate for r in q.training_gate(low).orderBy("quality_score").collect()] == ["blocked", "pass"]
    assert q.training_gate(low, overridden=True).orderBy("quality_score").first().gate == "overridden"


def test_conformance_and_freshness(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 1) AS s, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS t")
    contract = [{"column_name": "a", "data_type": "int"}, {"column_name": "s", "data_type": "struct"}, {"column_name": "z", "data_type": "int"}, {"column_name": "t", "data_type": "date"}]
    assert {r.column_name: r.result for r in q.conformance(df, contract).collect()} == {"a": "ok", "s": "ok", "z": "missing", "t": "type"}
    assert q.freshness(df, "t", "2024-01-02", 23.0).first().is_stale and not q.freshness(df, "t", "2024-01-02", 24.0).first().is_stale
    assert q.freshness(df.where("false"), "t", "2024-01-02", 24.0).first().is_stale
