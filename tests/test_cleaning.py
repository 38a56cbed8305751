import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning as C
from plumbline.plans import cleaning_jobs as J


@pytest.fixture(scope="module")
def frame(spark):
    """Meter readings: two rooms unnamed, one reading far off."""
    rows = [(21, "hall", 4.0), (22, None, 5.0), (23, "attic", 6.0), (24, "hall", 7.0), (25, None, 8.0), (26, "cellar", 90.0), (27, "shed", 9.0)]
    return spark.createDataFrame(rows, "id long, name string, amount double")


def test_rows_and_texts(spark, frame):
    assert sorted(r["id"] for r in C.clean(frame, ["drop_nulls"]).df.collect()) == [21, 23, 24, 26, 27]
    moves = spark.createDataFrame([(7, "out"), (5, "in"), (7, "in"), (7, "late"), (5, "out")], "unit int, move string")
    kept = C.clean(moves, ["deduplicate"])
    assert sorted(tuple(r) for r in kept.df.collect()) == [(5, "in"), (7, "in")] and kept.modified == 3
    labels = spark.createDataFrame([("\troof",), ("floor",), (" wall \n",), (None,)], "label string")
    trimmed = C.clean(labels, ["trim_strings"])
    assert [r[0] for r in trimmed.df.collect()] == ["roof", "floor", "wall", None] and trimmed.modified == 2


def test_outliers(frame):
    # Quartiles 5.5 and 8.5, so the fences are 1 and 13.
    found = C.clean(frame, ["outlier_flag"]).df
    assert [r["id"] for r in found.where("amount_is_outlier").collect()] == [26]
    clipped = C.clean(frame, ["outlier_clip"])
    assert clipped.modified == 1 and clipped.df.agg(F.max("amount")).first()[0] == 13.0
    assert C.clean(frame, ["outlier_drop"]).df.count() == 6


def test_steps_see_the_result_of_earlier_steps(frame):
    done = C.clean(frame, ["outlier_drop", "fill_null_text", "no_such"])
    assert done.df.where("name = 'UNKNOWN'").count() == 2
    assert done.log[-1] == "unknown_strategy: no_such skipped"


def test_nulls_survive_clipping(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (1000.0,), (None,)], "v double")
    assert C.clean(df, ["outlier_clip"]).df.where("v is null").count() == 1


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a double, s string")
    names = [n for n in C.strategy_list() if not n.startswith(("aggregate", "fill_null_forward"))]
    assert C.clean(empty, names).df.count() == 0
    blank = spark.createDataFrame([(None, None)] * 3, "a double, s string")
    assert C.clean(blank, ["fill_null_median", "outlier_clip", "cast_numeric", "cast_datetime"]).df.count() == 3


def test_casts_lose_nothing(spark):
    df = spark.createDataFrame([("1", "1", "2024-01-01"), (None, "x", "2024-01-02 10:00:00")], "a string, b string, c string")
    assert dict(C.clean(df, ["cast_numeric", "cast_datetime"]).df.dtypes) == {"a": "double", "b": "string", "c": "timestamp"}


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("chunks", [1, 8, 40])
def test_forward_fill_in_chunks(spark, chunks, text):
    # One key holds more than a third of the rows, and one has a null key.
    df = spark.range(300).select(
        F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 5).alias("k"),
        F.col("id").alias("t"),
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"),
    )
    if text:  # an order column of any type will do
        df = df.withColumn("t", F.format_string("day %04d", "t"))
    options = C.Options(key=["k"], order=["t"], measures=["v"], chunks=chunks)
    got = {r["t"]: r["v"] for r in C.clean(df.repartition(5), ["fill_null_forward"], options).df.collect()}
    last, want = {}, {}
    for r in df.orderBy("t").collect():
        if r["v"] is not None:
            last[r["k"]] = r["v"]
        want[r["t"]] = last.get(r["k"])
    assert got == want


def test_first_row_limit_acts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = C.first_rows(df, ["k"], ["id"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_multi_target(spark, frame):
    job = J.clean_to_targets(
        spark, frame, "ods", [{"name": "a", "rules": ["drop_nulls"], "quality_threshold": 99.0}, {"name": "b", "rules": []}]
    )
    rows = {r["target"]: r for r in job.metrics.collect()}
    assert (rows["a"]["removed_count"], rows["b"]["removed_count"]) == (2, 0)
    assert rows["b"]["improvement"] == 0 and rows["a"]["improvement"] > 0
    assert job.overall_score == pytest.approx((rows["a"]["score_after"] + rows["b"]["score_after"]) / 2)
    assert job.lineage.count() == 6


def test_rule_clean_keeps_rows_without_value(spark):
    df = spark.createDataFrame([(1, "a@x"), (2, None), (3, "bad"), (4, "a@x"), (5, None)], "id int, email string")
    rules = [{"id": "e", "type": "regex_match", "field": "email", "pattern": ".+@"}, {"id": "u", "type": "uniqueness", "field": "email"}]
    job = J.clean_by_rules(df, rules, apply_fixes=True, order=["id"])
    assert sorted(r["id"] for r in job.df.collect()) == [1, 2, 5]
    assert job.removed_rows == 2 and [v[6] for v in job.violations] == [1, 2]
    dry = J.clean_by_rules(df, rules)
    assert dry.cleaned_rows == 5 and dry.quality_score == pytest.approx(100 - 3 / 5 * 100)
