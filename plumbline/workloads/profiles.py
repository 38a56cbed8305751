"""Profiles, audits and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import load_profiles as LP
from plumbline.operators import profile as P
from plumbline.operators import scoring as S
from plumbline.session import scratch_path, small_frame
from plumbline.workloads.registry import joined, profile_sql, query, rounded, table, tables, view, with_views

PROFILE_COLUMNS = (
    '"table", "column", row_count, null_count, round(null_pct, 6) AS null_pct, distinct_count, '
    "round(distinct_pct, 6) AS distinct_pct, round(mean, 6) AS mean, round(std, 6) AS std, "
    "round(q25, 6) AS q25, round(q75, 6) AS q75, outlier_count, round(outlier_pct, 6) AS outlier_pct"
)


def _shown(prof):
    return rounded(prof.drop("dtype", "min", "max"), 6)


@query("ag01_profile_orders", with_views("dirty_orders", profile_sql("dirty_orders") + f" SELECT {PROFILE_COLUMNS} FROM prof"))
def ag01(spark, sf):
    return _shown(P.profile(spark, tables(spark, sf, "dirty_orders")))


@query(
    "ag01_profile_lineitem",
    with_views("", profile_sql("lineitem") + f" SELECT {PROFILE_COLUMNS.replace('(mean, 6)', '(mean, 4)')} FROM prof"),
)
def ag01_lineitem(spark, sf):
    found = P.profile(spark, tables(spark, sf, "lineitem"))
    return _shown(found.withColumn("mean", F.round("mean", 4)))


@query(
    "ag01_extremes",
    "SELECT 'o_totalprice' AS \"column\", min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders "
    "UNION ALL SELECT 'o_custkey', min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE FROM orders "
    "UNION ALL SELECT 'o_orderkey', min(o_orderkey)::DOUBLE, max(o_orderkey)::DOUBLE FROM orders",
)
def ag01_extremes(spark, sf):
    prof = P.profile(spark, tables(spark, sf, "orders")).where("q25 is not null")
    return prof.select("column", F.col("min").cast("double").alias("low"), F.col("max").cast("double").alias("high"))


MERGED = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
MERGED_NUMBERS = MERGED[:3]


@query(
    "ag01_merged_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, "
        + (f"min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, " if c in MERGED_NUMBERS
           else "NULL::DOUBLE AS low, NULL::DOUBLE AS high, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, ")
        + f"true AS distinct_close, count(DISTINCT {c}) AS exact FROM lineitem"
        for c in MERGED
    ),
)
def ag01_merged(spark, sf):
    """Profiles of the loads of seven years, kept apart and then merged; distinct values within 5 % of the exact ones."""
    lineitem = table(spark, sf, "lineitem")
    path = scratch_path(spark, "loads")
    year = F.coalesce(F.year(F.col("l_shipdate").cast("date")), F.lit(0))
    for load in [r[0] for r in lineitem.select(year).distinct().collect()]:
        LP.store_load(lineitem.where(year == load), "lineitem", str(load), path)
    merged = LP.merged_profile(LP.stored_loads(spark, path)).where(F.col("column").isin(MERGED))
    exact = [(c, n) for c, n in P.distinct_counts(lineitem, MERGED).items()]
    both = merged.join(small_frame(spark, exact, "`column` string, exact long"), "column")
    number = lambda c: F.when(F.col("column").isin(MERGED_NUMBERS), F.col(c).cast("double"))
    return both.select(
        "column", "row_count", "null_count", number("min").alias("low"), number("max").alias("high"), F.round("mean", 4).alias("mean"),
        F.round("std", 4).alias("std"), (F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(0.05 * F.col("exact"), F.lit(1))).alias("distinct_close"), "exact",
    )


TABLE_SCORE = """
parts AS (
  SELECT "table", max(row_count) AS row_count, count(*) AS column_count, avg(null_pct) AS null_rate,
         sum(null_count)::BIGINT AS nulls, sum(outlier_count)::BIGINT AS outliers,
         coalesce(avg(CASE WHEN distinct_pct < 1 THEN distinct_pct * 100 END), 100.0) AS uniqueness_score
  FROM prof GROUP BY "table"),
scored AS (
  SELECT *, greatest(100 - null_rate * 100, 0) AS null_score,
         greatest(100 - outliers / greatest(nulls + outliers, 1)::DOUBLE * 100, 0) AS outlier_score FROM parts),
scores AS (
  SELECT *, 0.40 * null_score + 0.35 * outlier_score + 0.25 * uniqueness_score AS score FROM scored)
"""
SCORED = ["dirty_orders", "dirty_customer", "dirty_events"]
SCORED_NAMES = " ".join(SCORED)
SCORES_SQL = profile_sql(*SCORED) + ", " + TABLE_SCORE


@query(
    "ag02_table_score",
    with_views(
        SCORED_NAMES,
        SCORES_SQL
        + 'SELECT "table", row_count, column_count, round(null_score, 4) AS null_score, round(outlier_score, 4) AS outlier_score, '
        "round(uniqueness_score, 4) AS uniqueness_score, round(score, 4) AS score, 'ods' AS layer FROM scores",
    ),
)
def ag02(spark, sf):
    scores = S.table_scores(P.profile(spark, tables(spark, sf, *SCORED)))
    names = ["table", "row_count", "column_count", "null_score", "outlier_score", "uniqueness_score", "score", "layer"]
    return rounded(scores.select(*names))


@query(
    "ag03_issues",
    with_views(
        SCORED_NAMES,
        profile_sql(*SCORED)
        + ' SELECT "table", "column", "column" || \':null_rate\' AS issue FROM prof WHERE null_pct > 0.05 '
        'UNION ALL SELECT "table", "column", "column" || \':outliers\' FROM prof WHERE outlier_count > 0',
    ),
)
def ag03(spark, sf):
    limits = dict.fromkeys(SCORED, 0.05)
    return S.issue_rows(P.profile(spark, tables(spark, sf, *SCORED)), limits)


@query(
    "ag04_quick_score",
    with_views(
        SCORED_NAMES,
        profile_sql(*SCORED)
        + ' SELECT "table", max(row_count) AS row_count, round((sum(100 - null_pct * 100) + sum(100 - outlier_pct * 100)) / (2 * count(*)), 4) AS score '
        'FROM prof GROUP BY "table"',
    ),
)
def ag04(spark, sf):
    return rounded(S.quick_scores(P.quick_profile(spark, tables(spark, sf, *SCORED))))


AUDIT = """
audit AS (
  SELECT "table", "column", row_count, null_count, round(null_pct, 4) AS null_pct, distinct_count,
         round(distinct_pct, 4) AS distinct_pct, outlier_count, round(outlier_pct, 4) AS outlier_pct FROM prof),
scored AS (
  SELECT *, greatest(100
    - CASE WHEN null_pct > 0.5 THEN 50 WHEN null_pct > 0.1 THEN 25 WHEN null_pct > 0.01 THEN 10 ELSE 0 END
    - CASE WHEN row_count > 100 AND distinct_pct < 0.005 AND null_count < row_count THEN 15 ELSE 0 END
    - CASE WHEN outlier_pct > 0.1 AND row_count > 0 THEN 20 ELSE 0 END, 0) AS score,
    concat_ws('|',
      CASE WHEN null_pct > 0.5 THEN 'critical_null_rate' WHEN null_pct > 0.1 THEN 'high_null_rate' WHEN null_pct > 0.01 THEN 'minor_null_rate' END,
      CASE WHEN row_count > 100 AND distinct_pct < 0.005 AND null_count < row_count THEN 'near_constant' END,
      CASE WHEN outlier_pct > 0.1 AND row_count > 0 THEN 'high_outlier_rate' END) AS issues
  FROM audit),
audited AS (
  SELECT "table", max(row_count) AS row_count, count(*) AS column_count, round(avg(score), 2) AS score,
    CASE WHEN avg(score) >= 90 THEN 'A' WHEN avg(score) >= 80 THEN 'B' WHEN avg(score) >= 70 THEN 'C' WHEN avg(score) >= 60 THEN 'D' ELSE 'F' END AS grade
  FROM scored GROUP BY "table")
"""
AUDIT_SQL = profile_sql(*SCORED, min_values=4) + ", " + AUDIT


def _audit(spark, sf):
    return P.audit_profile(spark, tables(spark, sf, *SCORED))


@query(
    "ag05_audit_profile",
    with_views(
        SCORED_NAMES,
        AUDIT_SQL + 'SELECT "table", "column", row_count, null_count, null_pct, distinct_count, distinct_pct, outlier_count, outlier_pct FROM audit',
    ),
)
def ag05(spark, sf):
    names = ["table", "column", "row_count", "null_count", "null_pct", "distinct_count", "distinct_pct", "outlier_count", "outlier_pct"]
    return _audit(spark, sf).select(*names)


@query("ag06_audit_score", with_views(SCORED_NAMES, AUDIT_SQL + 'SELECT "table", "column", score, issues FROM scored'))
def ag06(spark, sf):
    return S.column_scores(_audit(spark, sf)).select("table", "column", "score", joined("issues"))


@query("ag07_audit_tables", with_views(SCORED_NAMES, AUDIT_SQL + "SELECT * FROM audited"))
def ag07_tables(spark, sf):
    return S.audit_tables(S.column_scores(_audit(spark, sf)))


@query(
    "ag07_audit_warehouse",
    with_views(
        SCORED_NAMES,
        AUDIT_SQL
        + "SELECT count(*) AS table_count, sum(row_count)::BIGINT AS total_rows, round(avg(score), 2) AS overall_score, "
        "CASE WHEN avg(score) >= 90 THEN 'A' WHEN avg(score) >= 80 THEN 'B' WHEN avg(score) >= 70 THEN 'C' "
        "WHEN avg(score) >= 60 THEN 'D' ELSE 'F' END AS overall_grade FROM audited",
    ),
)
def ag07(spark, sf):
    return S.audit_warehouse(S.audit_tables(S.column_scores(_audit(spark, sf))))


@query(
    "tk01_worst_columns",
    with_views(
        SCORED_NAMES,
        AUDIT_SQL
        + 'SELECT "table", "column", score, issues FROM (SELECT * FROM scored ORDER BY score, "table", "column" LIMIT 5) WHERE issues <> \'\'',
    ),
)
def tk01(spark, sf):
    return S.worst_columns(S.column_scores(_audit(spark, sf))).select("table", "column", "score", joined("issues"))


ALERTS = """
alerts AS (
  SELECT "table", 'quality_score' AS type, score AS value, 70.0::DOUBLE AS threshold, CASE WHEN score < 50 THEN 'high' ELSE 'medium' END AS severity FROM scores WHERE score < 70
  UNION ALL SELECT "table", 'null_rate', round(null_rate, 2), 0.05::DOUBLE, 'medium' FROM scores WHERE null_rate > 0.05
  UNION ALL SELECT "table", 'anomaly_count', outliers::DOUBLE, 10.0::DOUBLE, CASE WHEN outliers > 20 THEN 'high' ELSE 'medium' END FROM scores WHERE outliers > 10)
"""


@query(
    "al01_alerts",
    with_views(
        SCORED_NAMES,
        SCORES_SQL + "," + ALERTS + 'SELECT "table", type, round(value, 4) AS value, threshold, severity FROM alerts',
    ),
)
def al01(spark, sf):
    scores = S.table_scores(P.profile(spark, tables(spark, sf, *SCORED)))
    return rounded(S.alerts(scores).drop("ts"))


@query(
    "ag19_report_rows",
    with_views(
        SCORED_NAMES,
        SCORES_SQL
        + 'SELECT "table", row_count, round(score, 4) AS score, CASE WHEN score >= 90 THEN \'green\' WHEN score >= 70 THEN \'yellow\' ELSE \'red\' END AS badge, '
        "round(null_rate, 4) AS mean_null_pct, outliers FROM scores",
    ),
)
def ag19(spark, sf):
    prof = P.profile(spark, tables(spark, sf, *SCORED))
    return rounded(S.report_rows(prof, S.table_scores(prof)))


@query(
    "ag20_fleet_summary",
    with_views(
        SCORED_NAMES,
        SCORES_SQL
        + ","
        + ALERTS
        + "SELECT count(*) AS tables, sum(row_count)::BIGINT AS rows, round(avg(score), 4) AS mean_score, "
        "(SELECT max(CAST(ts AS DATE)) FROM events) AS latest_run, (SELECT count(*) FROM alerts) AS alerts FROM scores",
    ),
)
def ag20(spark, sf):
    scores = S.table_scores(P.profile(spark, tables(spark, sf, *SCORED)))
    history = table(spark, sf, "events").select(F.to_date("ts").alias("run_ts"))
    return rounded(S.fleet_summary(scores, history, S.alerts(scores)))


@query(
    "ag14_column_statistics",
    with_views(
        "text_orders",
        ", ".join(
            [
                "stats AS ("
                + " UNION ALL ".join(
                    f"SELECT '{c}' AS \"column\", count(v) AS \"count\", count(*) - count(v) AS null_count, "
                    f"(count(*) - count(v)) / count(*)::DOUBLE AS null_pct, count(DISTINCT v) AS unique_count, "
                    f"count(DISTINCT v) / count(v)::DOUBLE AS unique_ratio, min(n) AS min, max(n) AS max, avg(n) AS mean, stddev_pop(n) AS stdev "
                    f"FROM (SELECT CASE WHEN trim(x) <> '' THEN x END AS v, TRY_CAST(CASE WHEN trim(x) <> '' THEN x END AS DOUBLE) AS n FROM (SELECT cast({c} AS string) AS x FROM text_orders))"
                    for c in ("o_orderkey", "cust_text", "mixed_text", "date_text", "o_orderstatus")
                )
                + ")"
            ]
        )
        + ' SELECT "column", "count", null_count, null_pct, unique_count, round(unique_ratio, 6) AS unique_ratio, '
        "round(min, 4) AS min, round(max, 4) AS max, round(mean, 4) AS mean, round(stdev, 4) AS stdev FROM stats",
    ),
)
def ag14(spark, sf):
    stats = P.column_statistics(spark, tables(spark, sf, "text_orders")).drop("table")
    return rounded(stats.withColumn("unique_ratio", F.round("unique_ratio", 6)), 6).withColumns(
        {c: F.round(c, 4) for c in ("min", "max", "mean", "stdev")}
    )


@query(
    "ag15_table_summary",
    "SELECT 'orders' AS \"table\", 6::BIGINT AS columns, (count(*) * 6) AS present, 0::BIGINT AS missing FROM orders "
    "UNION ALL SELECT 'customer', 5, count(*) * 5, 0 FROM customer UNION ALL SELECT 'part', 6, count(*) * 6, 0 FROM part",
)
def ag15(spark, sf):
    stats = P.column_statistics(spark, tables(spark, sf, "orders", "customer", "part"))
    return stats.groupBy("table").agg(
        F.count("*").alias("columns"), F.sum("count").alias("present"), F.sum("null_count").alias("missing")
    )


@query(
    "cl14_inlier_mask",
    "WITH q AS (SELECT a - 3 * (b - a) AS lo, b + 3 * (b - a) AS hi FROM (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)) "
    "SELECT event_id, value BETWEEN lo AND hi AS in_bounds FROM events, q",
)
def cl14(spark, sf):
    from plumbline.operators.cleaning import inlier_mask

    df = table(spark, sf, "events")
    return df.select("event_id", inlier_mask(df, "value", k=3.0).alias("in_bounds"))


@query(
    "io08_row_sample",
    with_views(
        "dirty_orders",
        f"SELECT * FROM dirty_orders WHERE ('0x' || substr(md5(concat_ws('|', '42', o_orderkey)), 1, 8))::BIGINT < {int(0.1 * 2**32)}",
    ),
)
def io08(spark, sf):
    from plumbline.sources.tables import sample_rows

    return sample_rows(view(spark, sf, "dirty_orders"), 0.1, ["o_orderkey"])
