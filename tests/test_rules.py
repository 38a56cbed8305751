import pytest
from pyspark.sql import functions as F

from plumbline.operators import rules as R


@pytest.fixture(scope="module")
def frame(spark):
    """Parcels: two without a contact, one with a broken one, weights in grams, days they were seen last."""
    rows = [
        (11, "depot@north.example", 12.5, "stored", "2023-05-01"),
        (12, None, 0.25, "moving", "2023-05-06"),
        (13, "no contact", 40.0, "moving", "2023-05-07"),
        (14, "hub@south.example", 7.75, "lost", "2023-05-08"),
        (15, None, 3.0, "moving", "2023-05-08"),
        (16, "hub@south.example", 18.0, "stored", "2023-05-09"),
    ]
    return spark.createDataFrame(rows, "id long, email string, amount double, status string, date string")


def one(df, rule, **kw):
    row = R.evaluate(df, [{"id": "r", **rule}], "t", **kw)[0]
    return dict(zip(("id", "type", "table", "field", "severity", "status", "failed", "total", "samples"), row))


def test_each_kind_of_rule(spark, frame):
    assert one(frame, {"type": "null_check", "field": "email"})["failed"] == 2
    email = one(frame, {"type": "regex_match", "field": "email", "pattern": "[a-z]+@.+"}, samples=True)
    assert (email["failed"], email["total"], email["samples"]) == (1, 4, ["no contact"])
    assert one(frame, {"type": "range_check", "field": "amount", "min": 1, "max": 20})["failed"] == 2
    assert one(frame, {"type": "range_check", "field": "amount", "min": 0.25})["failed"] == 0
    assert one(frame, {"type": "range_check", "field": "amount"})["status"] == "passed"
    marks = spark.createDataFrame([(k,) for k in "a b b b c d d".split()] + [(None,), (None,)], "k string")
    assert one(marks, {"type": "uniqueness", "field": "k"})["failed"] == 2
    assert one(marks, {"type": "uniqueness", "field": "k"}, unique_rows=True)["failed"] == 5
    assert one(frame, {"type": "enum_check", "field": "status", "allowed_values": ["stored", "moving"]})["failed"] == 1
    assert one(frame, {"type": "enum_check", "field": "status", "allowed_values": []})["status"] == "passed"


def test_pattern_matches_as_prefix(spark):
    df = spark.createDataFrame([("abc",), ("xab",)], "s string")
    assert one(df, {"type": "regex_match", "field": "s", "pattern": "ab"})["failed"] == 1
    assert one(df, {"type": "regex_match", "field": "s", "pattern": "ab|x"})["failed"] == 0


def test_length_counts_characters(spark):
    df = spark.createDataFrame([("产品1",), ("",), (None,)], "s string")
    assert one(df, {"type": "length_check", "field": "s", "min_len": 1, "max_len": 3})["failed"] == 1


def test_types(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    assert one(df, {"type": "datatype_check", "field": "s", "expected_dtype": "integer"})["failed"] == 2
    assert one(df, {"type": "datatype_check", "field": "s", "expected_dtype": "string"})["failed"] == 0
    assert one(df, {"type": "datatype_check", "field": "s", "expected_dtype": "odd"})["status"] == "passed"


def test_freshness(frame):
    rule = {"type": "freshness_check", "timestamp_field": "date", "max_age_minutes": 1440, "as_of": "2023-05-08 12:00:00"}
    assert one(frame, rule)["failed"] == 3


def test_absent_column_unknown_type_and_unfit_rule(frame):
    assert one(frame, {"type": "null_check", "field": "nope"})["status"] == "skipped"
    assert one(frame, {"type": "odd", "field": "id"})["status"] == "skipped"
    good = {"id": "g", "type": "null_check", "field": "email"}
    unfit = {"id": "b", "type": "range_check", "field": "id", "min": [1], "max": 3}
    breaks = {"id": "x", "type": "range_check", "field": "id", "min": "x1"}
    rows = R.evaluate(frame, [good, unfit, breaks, good], "t")
    assert [r[5] for r in rows] == ["failed", "error", "error", "failed"]
    assert one(frame, {"type": "regex_match", "field": "email", "pattern": "("})["status"] == "passed"


def test_user_rule_type(frame):
    @R.row_rule("even")
    def even(rule, schema):
        return R.Check(F.col(rule["field"]) % 2 != 0, F.col(rule["field"]).isNotNull())

    try:
        assert one(frame, {"type": "even", "field": "id"})["failed"] == 3  # 11, 13, 15
    finally:
        R.ROW_RULES.pop("even")


def test_absent_table_scores_zero(spark, frame):
    rules = [{"id": "a", "type": "null_check", "field": "id"}]
    found = {r["table"]: r for r in R.table_results(R.violations(spark, {"t": frame, "gone": None}, rules)).collect()}
    assert (found["gone"]["quality_score"], found["gone"]["passed"]) == (0.0, 0)
    assert found["t"]["quality_score"] == 100.0


def test_resolution_order_and_disabled():
    config = {
        "defaults": [{"id": "d"}],
        "table_rules": {"*": [{"id": "w"}], "t": [{"id": "s"}, {"id": "off", "enabled": False}]},
    }
    assert [r["id"] for r in R.resolve_rules(config, "t")] == ["w", "s", "d"]
    assert [r["id"] for r in R.resolve_rules(config, "u")] == ["w", "d"]


def test_many_rules_and_partitions(spark):
    df = spark.range(500).select((F.col("id") % 50).alias("v"))
    rules = [{"id": f"r{i}", "type": "range_check", "field": "v", "min": i} for i in range(90)]
    one_part = R.evaluate(df.repartition(1), rules, "t", samples=True)
    assert R.evaluate(df.repartition(7), rules, "t", samples=True) == one_part
    assert one_part[10][6] == 100 and one_part[10][8] == ["0", "0", "0", "0", "0"]


def test_fused_rules_are_one_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rules = [{"id": f"r{i}", "type": "range_check", "field": "o_totalprice", "min": i} for i in range(30)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fused", "fused")
    R.evaluate(df, rules, "t")
    stages = {s for j in tracker.getJobIdsForGroup("fused") for s in tracker.getJobInfo(j).stageIds}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) <= 3


def test_inline_score(spark, frame):
    rows = R.violations(spark, {"t": frame}, [{"id": "a", "type": "null_check", "field": "email"}])
    assert R.inline_score(rows, 8).first()["quality_score"] == 75.0
    assert R.inline_score(rows, 0).first()["quality_score"] == 100.0
