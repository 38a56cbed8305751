"""Drift between snapshots, score history, and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.operators import history as H
from plumbline.operators import logs as L
from plumbline.operators.scoring import lineage_listing
from plumbline.session import scratch_path, small_frame
from plumbline.sources import files
from plumbline.sources import tables as T
from plumbline.workloads.registry import COLUMNS, joined, query, rounded, table, tables, with_views

# ---- drift: the old state is the given tables, the new one a changed warehouse over the same rows

OLD = ["orders", "customer", "region", "nation"]


def _old(spark, sf):
    return D.snapshot(spark, tables(spark, sf, *OLD), "old")


def _new(spark, sf):
    now = tables(spark, sf, *OLD, "part")
    now["orders"] = now["orders"].select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.col("o_totalprice").cast("float").alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
        F.lit("web").alias("o_channel"),
    )
    now["customer"] = now["customer"].withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))
    now["supplier_copy"] = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    del now["nation"]
    del now["part"]
    return D.snapshot(spark, now, "new")


CHANGES = """
changes AS (SELECT * FROM (VALUES
  ('column_removed', 'orders', 'o_orderstatus', 'string', NULL, 'breaking'),
  ('column_added', 'orders', 'o_channel', NULL, 'string', 'info'),
  ('dtype_changed', 'orders', 'o_custkey', 'bigint', 'string', 'breaking'),
  ('dtype_changed', 'orders', 'o_totalprice', 'double', 'float', 'breaking'),
  ('dtype_changed', 'customer', 'c_nationkey', 'int', 'bigint', 'warning'),
  ('removed', 'nation', 'n_nationkey', 'int', NULL, 'breaking'),
  ('removed', 'nation', 'n_name', 'string', NULL, 'breaking'),
  ('removed', 'nation', 'n_regionkey', 'int', NULL, 'breaking'),
  ('added', 'supplier_copy', 's_suppkey', NULL, 'bigint', 'info'),
  ('added', 'supplier_copy', 's_name', NULL, 'string', 'info')) v(change_type, "table", field, old_dtype, new_dtype, severity)),
rows AS (SELECT 'orders' AS "table", count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer
  UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'supplier_copy', count(*) FROM supplier)
"""


def _changes(spark, sf):
    """Changes with the row count of the table they touch."""
    old, new = _old(spark, sf), _new(spark, sf)
    counts = old.unionByName(new).groupBy("table").agg(F.max("row_count").alias("row_count"))
    at = F.lit("2024-05-01 00:00:00").cast("timestamp")
    return D.changes(old, new, at).join(counts, "table")


@query("sc02_drift", with_views("", CHANGES + ' SELECT c.*, row_count FROM changes c JOIN rows USING ("table")'))
def sc02(spark, sf):
    return _changes(spark, sf).drop("ts")


@query(
    "jo03_snapshot_diff",
    with_views("", CHANGES + ' SELECT "table", change_type, count(*) AS changes, max(row_count) AS row_count FROM changes JOIN rows USING ("table") GROUP BY 1, 2'),
)
def jo03(spark, sf):
    return _changes(spark, sf).groupBy("table", "change_type").agg(F.count("*").alias("changes"), F.max("row_count").alias("row_count"))


@query(
    "sc01_snapshot",
    " UNION ALL ".join(
        f"SELECT 'old' AS snapshot_id, '{t}' AS \"table\", {i}::INTEGER AS ordinal, '{c}' AS \"column\", count(*) AS row_count FROM {t}"
        for t in OLD
        for i, c in enumerate(COLUMNS[t])
    ),
)
def sc01(spark, sf):
    return _old(spark, sf).drop("ddl_hash", "dtype")


@query(
    "sc03_name_diff",
    "SELECT 'orders' AS \"table\", 'o_channel' AS added, 'o_orderstatus' AS removed, count(*) AS row_count FROM orders",
)
def sc03(spark, sf):
    old = _old(spark, sf)
    counts = old.select("table", "row_count").distinct()
    return D.name_changes(old, _new(spark, sf)).select("table", joined("added"), joined("removed")).join(counts, "table")


@query(
    "se02_name_difference",
    with_views("", CHANGES + " SELECT change_type, count(*) AS names, sum(row_count)::BIGINT AS touched FROM changes JOIN rows USING (\"table\") WHERE change_type <> 'dtype_changed' GROUP BY 1"),
)
def se02(spark, sf):
    found = _changes(spark, sf).where("change_type <> 'dtype_changed'")
    return found.groupBy("change_type").agg(F.count("*").alias("names"), F.sum("row_count").alias("touched"))


@query(
    "se03_common_columns",
    "SELECT 'orders' AS \"table\", 5::BIGINT AS common, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', 5, count(*) FROM customer UNION ALL SELECT 'region', 2, count(*) FROM region",
)
def se03(spark, sf):
    common = _old(spark, sf).select("table", "column", "row_count").join(_new(spark, sf).select("table", "column"), ["table", "column"])
    return common.groupBy("table").agg(F.count("*").alias("common"), F.max("row_count").alias("row_count"))


EVENT_LOG = "(SELECT ts, event_type AS change_type, concat('t', user_id) AS \"table\", concat('c', event_id) AS field, CASE event_type WHEN 'error' THEN 'breaking' WHEN 'click' THEN 'warning' ELSE 'info' END AS severity FROM events)"


def _event_log(spark, sf):
    severity = F.when(F.col("event_type") == "error", "breaking").when(F.col("event_type") == "click", "warning").otherwise("info")
    return table(spark, sf, "events").select(
        "ts",
        F.col("event_type").alias("change_type"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("table"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("field"),
        severity.alias("severity"),
    )


@query(
    "sc04_timeline",
    f"SELECT CAST(ts AS DATE) AS day, count(*) AS count, string_agg(field, '|' ORDER BY ts, field) AS fields FROM (SELECT * FROM {EVENT_LOG} ORDER BY ts DESC, \"table\", field, change_type LIMIT 20) GROUP BY 1",
)
def sc04(spark, sf):
    days = D.timeline(_event_log(spark, sf))
    return days.select("day", "count", F.array_join(F.transform("changes", lambda c: c["field"]), "|").alias("fields"))


@query("tk05_recent_changes", f'SELECT * FROM {EVENT_LOG} ORDER BY ts DESC, "table", field, change_type LIMIT 50')
def tk05(spark, sf):
    return D.recent_changes(_event_log(spark, sf))


@query(
    "se06_change_history",
    f"SELECT * FROM {EVENT_LOG} UNION ALL SELECT TIMESTAMP '2024-05-01 00:00:00', 'snapshot', 'orders', 'o_orderkey', 'info' FROM (SELECT 1 FROM orders LIMIT 1)",
)
def se06(spark, sf):
    new = _event_log(spark, sf)
    row = new.limit(0).schema
    extra = table(spark, sf, "orders").limit(1).select(
        F.lit("2024-05-01 00:00:00").cast(row["ts"].dataType).alias("ts"),
        F.lit("snapshot").alias("change_type"),
        F.lit("orders").alias("table"),
        F.lit("o_orderkey").alias("field"),
        F.lit("info").alias("severity"),
    )
    return D.with_history(extra, new)


@query(
    "sc05_cast_survival",
    "SELECT 'source' AS \"column\", 'bigint' AS new_dtype, count(source) AS \"values\", count(*) FILTER (WHERE source IS NOT NULL AND TRY_CAST(source AS BIGINT) IS NULL) AS lost FROM documents "
    "UNION ALL SELECT 'n_chars', 'smallint', count(n_chars), count(*) FILTER (WHERE n_chars > 32767) FROM documents "
    "UNION ALL SELECT 'lang', 'string', count(lang), 0 FROM documents",
)
def sc05(spark, sf):
    found = D.cast_survival(table(spark, sf, "documents"), {"source": "bigint", "n_chars": "smallint", "lang": "string"})
    return found.drop("old_dtype")


# ---- score history: the mean value of each event type per day

HISTORY = 'h AS (SELECT event_type AS "table", CAST(ts AS DATE) AS run_ts, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)'


def _history(spark, sf):
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("table"), F.to_date("ts").alias("run_ts"))
        .agg(F.round(F.avg("value"), 6).alias("score"))
    )


def back_sql(n: int) -> str:
    return f'(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY run_ts DESC) AS back FROM h) WHERE back <= {n})'


TREND = (
    HISTORY
    + f""", p AS (SELECT *, (count(*) OVER (PARTITION BY "table") - back)::DOUBLE AS x FROM {back_sql(5)}),
fit AS (SELECT "table", count(*) AS runs, arg_max(score, run_ts) AS current, regr_slope(score, x) AS a, regr_intercept(score, x) AS b FROM p GROUP BY 1),
t AS (SELECT "table", runs, current, CASE WHEN runs >= 3 THEN a ELSE 0.0 END AS slope,
  CASE WHEN runs >= 3 THEN least(100.0, greatest(0.0, a * runs + b)) ELSE current END AS predicted,
  CASE WHEN runs < 3 THEN 'insufficient_data' WHEN a > 0.1 THEN 'improving' WHEN a < -0.1 THEN 'declining' ELSE 'stable' END AS direction FROM fit)"""
)
ANOMALIES = f"""
s AS (SELECT "table", list_sort(list(score)) AS v, count(*) AS n FROM {back_sql(6)} GROUP BY 1),
q AS (SELECT "table", v[(n // 4 + 1)] AS q1, v[(3 * n // 4 + 1)] AS q3 FROM s WHERE n >= 4),
an AS (SELECT b."table", b.run_ts, b.score, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper,
  CASE WHEN score < q1 - 1.5 * (q3 - q1) THEN 'low' ELSE 'high' END AS type,
  CASE WHEN abs(score - (q1 + q3) / 2) > 2 * (q3 - q1) THEN 'critical' ELSE 'warning' END AS severity
  FROM {back_sql(6)} b JOIN q USING ("table") WHERE score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1))
"""


@query(
    "wi03_trend",
    with_views("", TREND + ' SELECT "table", runs, current, round(slope, 4) AS slope, round(predicted, 4) AS predicted, direction FROM t'),
)
def wi03(spark, sf):
    return H.trend(_history(spark, sf)).withColumns({c: F.round(c, 4) for c in ("slope", "predicted")})


def _user_history(spark, sf):
    """One series per user; many short series, some with odd runs."""
    return (
        table(spark, sf, "events")
        .groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("table"), F.to_date("ts").alias("run_ts"))
        .agg(F.round(F.avg("value"), 6).alias("score"))
    )


USER_HISTORY = "h AS (SELECT concat('u', user_id) AS \"table\", CAST(ts AS DATE) AS run_ts, round(avg(value), 6) AS score FROM events GROUP BY 1, 2)"


@query(
    "wi04_anomaly",
    with_views(
        "",
        USER_HISTORY
        + ","
        + ANOMALIES
        + 'SELECT "table", run_ts, score, round(lower, 4) AS lower, round(upper, 4) AS upper, type, severity FROM an',
    ),
)
def wi04(spark, sf):
    return H.run_anomalies(_user_history(spark, sf)).withColumns({c: F.round(c, 4) for c in ("lower", "upper")})


@query(
    "wi05_forecast",
    with_views(
        "",
        TREND
        + ' SELECT "table", o::INTEGER AS run_offset, round(predicted, 1) AS predicted_score, round(greatest(50.0, 95 - 10 * o - 5 * abs(slope)), 1) AS confidence '
        "FROM t, (SELECT unnest([1, 2, 3]) AS o) WHERE direction <> 'insufficient_data'",
    ),
)
def wi05(spark, sf):
    return H.forecast(H.trend(_history(spark, sf)))


@query(
    "wi06_delta",
    with_views(
        "",
        HISTORY
        + f""", p AS (SELECT "table", max(score) FILTER (WHERE back = 1) AS latest, max(score) FILTER (WHERE back = 2) AS before, avg(score) AS mean_last_7 FROM {back_sql(7)} GROUP BY 1)
SELECT "table", latest, round(latest - coalesce(before, latest), 4) AS delta, CASE WHEN latest > before THEN 'up' WHEN latest < before THEN 'down' ELSE 'same' END AS arrow, round(mean_last_7, 4) AS mean_last_7 FROM p""",
    ),
)
def wi06(spark, sf):
    return H.run_deltas(_history(spark, sf)).withColumns({c: F.round(c, 4) for c in ("delta", "mean_last_7")})


@query("wi07_display_runs", with_views("", HISTORY + f' SELECT "table", run_ts, score FROM {back_sql(10)}'))
def wi07(spark, sf):
    return H.display_runs(_history(spark, sf)).drop("back")


@query(
    "al02_pipeline_health",
    with_views(
        "",
        TREND
        + ","
        + ANOMALIES
        + """, c AS (SELECT t.*, (SELECT count(*) FROM an WHERE an."table" = t."table") AS anomalies FROM t)
SELECT "table", direction, anomalies, CASE WHEN direction IN ('improving', 'stable') AND anomalies = 0 THEN 'healthy' ELSE 'degraded' END AS health,
  CASE WHEN direction = 'declining' OR anomalies > 0 OR current < 90 OR predicted < current - 5 THEN
  concat_ws('|', CASE WHEN direction = 'declining' THEN 'check_sources' END, CASE WHEN anomalies > 0 THEN 'check_anomalies' END,
    CASE WHEN current < 90 THEN 'add_validation_rules' END, CASE WHEN predicted < current - 5 THEN 'expect_decline' END) ELSE 'keep_monitoring' END AS recommendations FROM c""",
    ),
)
def al02(spark, sf):
    history = _history(spark, sf)
    return H.pipeline_health(H.trend(history), H.run_anomalies(history)).withColumn(
        "recommendations", F.array_join("recommendations", "|")
    )


@query("io16_last_runs", with_views("", HISTORY + f' SELECT "table", run_ts, score FROM {back_sql(20)}'))
def io16(spark, sf):
    path = scratch_path(spark, "quality_history")
    history = _history(spark, sf)
    T.append_rows(history.where("run_ts < date'2024-01-15'"), path)
    T.append_rows(history.where("run_ts >= date'2024-01-15'"), path)
    return T.last_runs(spark.read.parquet(path))


# ---- lineage log, listing and request logs


def _lineage(spark, sf):
    found = tables(spark, sf, "dirty_orders", "dirty_customer", "region", "nation", "part", "supplier")
    rows = [row for n, df in found.items() for row in files.lineage_rows(df, n, f"{n}.parquet")]
    return small_frame(spark, rows, files.LINEAGE_SCHEMA)


NULL_SHARE = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{t}.parquet' AS source_file, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_pct FROM {t}"
    for t in ("dirty_orders", "dirty_customer", "region", "nation", "part", "supplier")
    for c in COLUMNS[t]
)


@query("io14_lineage_log", with_views("dirty_orders dirty_customer", f"l AS ({NULL_SHARE}) SELECT * FROM l"))
def io14(spark, sf):
    path = scratch_path(spark, "lineage")
    T.append_rows(_lineage(spark, sf), path)
    return rounded(spark.read.parquet(path).drop("dtype"), 6)


@query(
    "tk06_lineage_listing",
    with_views("dirty_orders dirty_customer", f"l AS ({NULL_SHARE}) SELECT \"table\", count(*) AS columns FROM l GROUP BY 1 ORDER BY 1 LIMIT 5"),
)
def tk06(spark, sf):
    return lineage_listing(_lineage(spark, sf))


PATH = "concat('/api/', event_type, '/', user_id, '/v', event_id % 3, '/report.html')"
BUCKETS_SQL = ", ".join(f"count(*) FILTER (WHERE seconds <= {b}) AS le_{i + 1}" for i, b in enumerate(L.LATENCY_BOUNDS))


def _requests(spark, sf):
    return table(spark, sf, "events").select(
        "ts",
        F.when(F.col("event_id") % 4 == 0, "POST").otherwise("GET").alias("method"),
        L.endpoint_template(F.expr(PATH)).alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"),
        (F.col("value") / 10).alias("seconds"),
    )


@query(
    "ag21_request_log",
    "SELECT CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, concat('/api/', event_type, '/{id}/{id}/report.html') AS endpoint, "
    f"CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, count(*) AS requests, {BUCKETS_SQL}, round(sum(seconds), 4) AS total "
    "FROM (SELECT *, value / 10 AS seconds FROM events) GROUP BY 1, 2, 3",
)
def ag21(spark, sf):
    return rounded(L.latency_histogram(_requests(spark, sf), ["method", "endpoint", "status"], "seconds"))


@query(
    "ag22_freshness_minutes",
    "SELECT event_type, round((epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(max(ts))) / 60000000.0, 4) AS lag_minutes FROM events GROUP BY 1",
)
def ag22(spark, sf):
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return rounded(L.freshness_minutes(table(spark, sf, "events"), "event_type", "ts", as_of))
