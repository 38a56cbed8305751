import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import load_profiles as LP
from plumbline.operators import profile as P
from plumbline.operators import quantiles as Q
from plumbline.operators import scoring as S


def numbers(spark, values, parts=3):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(parts)


def expected(values):
    present = np.array([v for v in values if v is not None and not math.isnan(v)])
    q1, q2, q3 = np.quantile(present, [0.25, 0.5, 0.75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    nan = sum(1 for v in values if v is not None and math.isnan(v))
    return q1, q2, q3, int(((present < lo) | (present > hi)).sum()) + nan


rng = np.random.default_rng(7)
CASES = {
    "small": [1.0, 2.0, 3.0, 4.0, 5.0, 100.0],
    "constant": [5.0] * 50,
    "hot value": [3.0] * 400 + list(rng.normal(0, 50, 800)),
    "nulls and nan": [None, 1.0, float("nan"), 2.0, 3.0, None, 4.0],
    "tails": list(np.concatenate([rng.normal(0, 1, 2000), rng.normal(0, 40, 100)])),
    "two values": [0.0] * 30 + [1.0] * 70,
    "one": [7.0],
    "two hills": list(np.concatenate([rng.uniform(0, 1, 3000), rng.uniform(100, 100.5, 1000)])),
    "hot ends": [0.0] * 500 + list(rng.uniform(0, 1, 900)) + [1.0] * 600,
    "infinite": [float("inf"), float("-inf")] + [float(x) for x in rng.integers(0, 50, 60)],
    "ties": [float(x) for x in rng.integers(0, 6, 3000)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("settings", [{}, {"accuracy": 20}, {"accuracy": 50, "bracket_limit": 20}], ids=["default", "coarse", "narrowed"])
def test_exact_spreads(spark, name, settings):
    values = CASES[name]
    got = Q.spreads(numbers(spark, values), ["v"], **settings)["v"]
    q1, q2, q3, outliers = expected(values)
    assert (got.q25, got.q50, got.q75) == pytest.approx((q1, q2, q3))
    assert got.outliers == outliers


def test_no_more_values_are_picked_than_allowed(spark, monkeypatch):
    """Three quarters of the values lie in a narrow hill: what a bracket holds is counted, not guessed."""
    held = []
    pick = Q._pick

    def counted(df, values, brackets, ranks, narrow):
        for (c, j), _ in narrow:
            lo, hi = brackets[c, j]
            held.append(df.where((values[c] > lo) & (values[c] < hi)).count())
        return pick(df, values, brackets, ranks, narrow)

    monkeypatch.setattr(Q, "_pick", counted)
    df = spark.range(40_001).select(F.when(F.col("id") % 4 == 0, 100 + F.rand(1)).otherwise(F.rand(2)).alias("v")).cache()
    got = Q.spreads(df, ["v"], accuracy=50, bracket_limit=100)["v"]
    want = np.quantile([r["v"] for r in df.collect()], [0.25, 0.5, 0.75])
    assert (got.q25, got.q50, got.q75) == pytest.approx(tuple(want)) and max(held) <= 100


def test_spreads_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert not Q.spreads(df, ["v"])["v"].known
    nan = Q.spreads(spark.createDataFrame([(float("nan"),)], "v double"), ["v"])["v"]
    assert not nan.known and nan.outliers == 1


def test_many_columns_take_several_scans(spark):
    names = [f"c{i}" for i in range(60)]
    df = spark.range(101).select(*[(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)])
    got = Q.spreads(df, names)
    assert [got[n].q50 for n in names] == [50.0 * (i + 1) for i in range(60)]
    assert len(P.profile_rows(df, "wide")) == 60


def test_profile_of_one_column(spark):
    df = spark.createDataFrame([(8,), (None,), (6,), (6,), (None,), (13,)], "v int")
    row = P.profile(spark, {"t": df}).first()
    assert (row["null_count"], row["distinct_count"], row["row_count"]) == (2, 3, 6)
    assert row["min"] == "6" and row["max"] == "13" and row["mean"] == 8.25


def test_profile_of_empty_and_nested(spark):
    empty = spark.createDataFrame([], "a int, b string")
    rows = P.profile(spark, {"e": empty}).collect()
    assert [r["row_count"] for r in rows] == [0, 0] and rows[0]["null_pct"] == 0
    assert S.quick_scores(P.profile(spark, {"e": empty})).first()["score"] == 0.0
    nested = spark.createDataFrame([([1],), (None,)], "a array<int>")
    assert P.profile(spark, {"n": nested}).first()["null_count"] == 1


def test_partitions_do_not_matter(spark):
    df = spark.range(1000).select(
        (F.col("id") % 37).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("b")
    )

    def found(parts):
        return P.profile(spark, {"t": df.repartition(parts)}).withColumn("std", F.round("std", 9)).collect()

    assert found(7) == found(1)


def test_score_of_a_half_empty_column(spark):
    rows = [("t", "c", "string", 100, 60, 0.6, 40, 0.4, None, None, None, None, None, None, 0, 0.0)]
    scored = S.column_scores(spark.createDataFrame(rows, P.PROFILE_SCHEMA)).first()
    assert scored["score"] == 50 and scored["issues"] == ["critical_null_rate"]


def test_audit_of_two_tables(spark):
    full = spark.range(70).select(F.col("id").alias("seat"), (F.col("id") * 7 % 11).alias("row"))
    holes = spark.range(24).select("id", F.when(F.col("id") % 4 == 0, "door").alias("near"), F.lit(None).cast("int").alias("price"))
    tables = S.audit_tables(S.column_scores(P.audit_profile(spark, {"full": full, "holes": holes})), ["never"])
    found = {r["table"]: r for r in tables.collect()}
    assert found["full"]["score"] > found["holes"]["score"] and found["never"]["grade"] == "F"
    whole = S.audit_warehouse(tables).first()
    assert (whole["table_count"], whole["total_rows"]) == (3, 94)


def test_clean_column(spark):
    df = spark.createDataFrame([(10, "oak"), (None, None), (2, "elm"), (None, "fir"), (4, None), (30, "ash")], "n int, s string")
    assert [r[0] for r in P.clean_column(df, "n").select("n").collect()] == [10, 7, 2, 7, 4, 30]
    assert [r[0] for r in P.clean_column(df, "n", "zero").select("n").collect()] == [10, 0, 2, 0, 4, 30]
    assert P.clean_column(df, "s").where("s = 'UNKNOWN'").count() == 2


def test_inference_statistics_skip_blank(spark):
    df = spark.createDataFrame([("1",), (" ",), (None,), ("x",), ("3",)], "v string")
    row = P.column_statistics(spark, {"t": df}).first()
    assert (row["count"], row["null_count"], row["unique_ratio"], row["mean"], row["stdev"]) == (3, 2, 1.0, 2.0, 1.0)


def test_infinite_values_count_as_missing(spark):
    from plumbline.operators import association as A

    rows = [(float(i % 7), float("inf") if i == 3 else float(i % 5), str(i) if i else "inf") for i in range(40)]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    found = {(r["x"], r["y"]): r["n"] for r in A.chi_squares(df, ["a", "b", "c"]).collect()}
    assert found[("a", "b")] == 39 and found[("a", "c")] in (39, 40)
    r, n = A.correlations(df, {"a": F.col("a"), "b": F.col("b")}, [("a", "b")])[("a", "b")]
    plain = np.array([x[:2] for x in rows if math.isfinite(x[1])])
    assert n == 39 and r == pytest.approx(np.corrcoef(plain.T)[0, 1])


def test_distinct_counts_agree(spark):
    rows = [(i % 7, float("nan") if i % 5 == 0 else (-0.0 if i % 5 == 1 else 0.0), None if i % 3 else f"é{i % 4}", i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, `b.c` double, d string, e boolean").repartition(4)
    want = {"a": 7, "b.c": 2, "d": 4, "e": 2}
    assert P.distinct_counts(df, df.columns) == P.distinct_counts(df, df.columns, one_pass=True) == want
    assert P.distinct_counts(df.limit(0), df.columns, one_pass=True) == dict.fromkeys(want, 0)


def test_merged_loads_equal_one_profile(spark, tmp_path):
    df = spark.range(5000).selectExpr(
        "id", "case when id % 10 > 0 then cast(id * 7 % 1000 as double) end AS v", "concat('n', id % 300) AS s", "cast(null as int) AS none", "date_add(date'2020-01-01', cast(id % 40 as int)) AS day"
    )
    path = str(tmp_path / "loads")
    for load, part in (("a", "id < 100"), ("b", "id between 100 and 2999"), ("c", "id > 2999"), ("d", "id < 0")):
        LP.store_load(df.where(part), "t", load, path)
    LP.store_load(df.where("id > 2999"), "t", "c", path)  # again: replaces its own rows
    merged = {r["column"]: r for r in LP.merged_profile(LP.stored_loads(spark, path)).collect()}
    for r in P.profile(spark, {"t": df}).collect():
        m = merged[r["column"]]
        assert (m["row_count"], m["null_count"], m["null_pct"]) == (r["row_count"], r["null_count"], r["null_pct"])
        assert (m["min"], m["max"]) == (r["min"], r["max"])
        assert abs(m["distinct_count"] - r["distinct_count"]) <= 0.05 * r["distinct_count"]
        for c in ("mean", "std"):
            assert m[c] == r[c] or abs(m[c] - r[c]) < 1e-6 * abs(r[c])
    assert LP.merged_profile(LP.stored_loads(spark, path).limit(0)).count() == 0
