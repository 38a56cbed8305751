"""Cleaning strategies and cleaning jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cleaning as C
from plumbline.operators import profile as P
from plumbline.plans import cleaning_jobs as J
from plumbline.session import small_frame
from plumbline.workloads.registry import COLUMNS, profile_sql, query, rounded, spread_sql, table, view, with_views

ORDERS = "dirty_orders"
NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
REST = "o_orderstatus, o_orderdate, o_orderpriority"


def _cleaned(spark, sf, names, options=None, source=ORDERS):
    return C.clean(view(spark, sf, source), names, options).df


def fill_sql(aggregate: str) -> str:
    filled = ", ".join(f"round(coalesce({c}::DOUBLE, (SELECT {aggregate.format(c=c)} FROM {ORDERS})), 4) AS {c}" for c in NUMBERS)
    return with_views(ORDERS, f"SELECT {filled}, {REST} FROM {ORDERS}")


@query("cl01_median", fill_sql("quantile_cont({c}::DOUBLE, 0.5)"))
def cl01(spark, sf):
    return rounded(_cleaned(spark, sf, ["fill_null_median"]))


@query("cl02_mean", fill_sql("avg({c})"))
def cl02(spark, sf):
    return rounded(_cleaned(spark, sf, ["fill_null_mean"]))


@query(
    "cl03_zero",
    with_views(ORDERS, f"SELECT o_orderkey, o_custkey, coalesce(o_totalprice, 0) AS o_totalprice, {REST} FROM {ORDERS}"),
)
def cl03(spark, sf):
    return _cleaned(spark, sf, ["fill_null_zero"])


LOCF = with_views(
    "dirty_events",
    "SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM dirty_events",
)


def _forward(spark, sf, chunks=None):
    options = C.Options(key=["user_id"], order=["ts", "event_id"], measures=["value"], chunks=chunks)
    return _cleaned(spark, sf, ["fill_null_forward"], options, "dirty_events").select("event_id", "user_id", "value")


@query("cl04_locf", LOCF)
def cl04(spark, sf):
    return _forward(spark, sf)


@query("wi09_running_last", LOCF)
def wi09(spark, sf):
    return _forward(spark, sf, 60)


@query(
    "cl05_unknown",
    with_views(ORDERS, f"SELECT o_orderkey, o_totalprice, o_orderstatus, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM {ORDERS}"),
)
def cl05(spark, sf):
    return _cleaned(spark, sf, ["fill_null_text"]).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


@query(
    "cl06_clean_column",
    with_views(
        ORDERS,
        f"SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {ORDERS})), 4) AS o_totalprice, "
        f"coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM {ORDERS}",
    ),
)
def cl06(spark, sf):
    df = view(spark, sf, ORDERS).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return rounded(P.clean_column(P.clean_column(df, "o_totalprice", "mean"), "o_orderpriority"))


@query(
    "cl07_flag_nulls",
    with_views(ORDERS, f"SELECT *, o_totalprice IS NULL AS o_totalprice_is_null, o_orderpriority IS NULL AS o_orderpriority_is_null FROM {ORDERS}"),
)
def cl07(spark, sf):
    return _cleaned(spark, sf, ["flag_nulls"])


PRICE = spread_sql(ORDERS, "o_totalprice")


@query(
    "cl08_clip",
    with_views(
        ORDERS,
        f"SELECT o_orderkey, round(CASE WHEN o_totalprice IS NOT NULL THEN greatest(least(o_totalprice, hi), lo) END, 4) AS o_totalprice FROM {ORDERS}, {PRICE}",
    ),
)
def cl08(spark, sf):
    df = view(spark, sf, ORDERS).select("o_orderkey", "o_totalprice")
    return rounded(C.clean(df, ["outlier_clip"]).df)


@query(
    "cl09_winsorize",
    with_views(
        ORDERS,
        ", ".join(f"s_{c} AS (SELECT lo AS lo_{c}, hi AS hi_{c} FROM {spread_sql(ORDERS, c)})" for c in NUMBERS)
        + " SELECT "
        + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN greatest(least({c}::DOUBLE, hi_{c}), lo_{c}) END, 4) AS {c}" for c in NUMBERS)
        + f" FROM {ORDERS}, "
        + ", ".join(f"s_{c}" for c in NUMBERS),
    ),
)
def cl09(spark, sf):
    return rounded(_cleaned(spark, sf, ["outlier_winsorize"]).select(*NUMBERS))


@query(
    "cl10_flag_outliers",
    with_views(ORDERS, f"SELECT o_orderkey, NOT (o_totalprice BETWEEN lo AND hi) AS o_totalprice_is_outlier FROM {ORDERS}, {PRICE}"),
)
def cl10(spark, sf):
    return _cleaned(spark, sf, ["outlier_flag"]).select("o_orderkey", "o_totalprice_is_outlier")


@query(
    "cl11_trim",
    with_views(ORDERS, f"SELECT o_orderkey, trim(o_orderstatus, ' ' || chr(9)) AS o_orderstatus, o_orderpriority FROM {ORDERS}"),
)
def cl11(spark, sf):
    return _cleaned(spark, sf, ["trim_strings"]).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    "cl12_datetime",
    with_views("text_orders", "SELECT o_orderkey, cust_text, date_text::TIMESTAMP AS date_text FROM text_orders"),
)
def cl12(spark, sf):
    return _cleaned(spark, sf, ["cast_datetime"], source="text_orders").select("o_orderkey", "cust_text", "date_text")


@query(
    "cl13_numeric",
    with_views("text_orders", "SELECT o_orderkey, cust_text::DOUBLE AS cust_text, mixed_text, date_text FROM text_orders"),
)
def cl13(spark, sf):
    return _cleaned(spark, sf, ["cast_numeric"], source="text_orders").select("o_orderkey", "cust_text", "mixed_text", "date_text")


@query(
    "cl15_unknown_strategy",
    with_views(ORDERS, f"SELECT count(*) AS row_count, 'unknown_strategy: polish skipped|fill_null_zero' AS log FROM {ORDERS}"),
)
def cl15(spark, sf):
    done = C.clean(view(spark, sf, ORDERS), ["polish", "fill_null_zero"])
    return done.df.agg(F.count("*").alias("row_count"), F.lit("|".join(done.log)).alias("log"))


@query(
    "cl16_user_strategy",
    with_views(ORDERS, f"SELECT o_orderkey, round(o_totalprice / 100, 4) AS o_totalprice FROM {ORDERS}"),
)
def cl16(spark, sf):
    @C.strategy("to_hundreds", "prices in hundreds")
    def to_hundreds(df, options):
        return C.Step(df.withColumn("o_totalprice", F.col("o_totalprice") / 100))

    try:
        return rounded(_cleaned(spark, sf, ["to_hundreds"]).select("o_orderkey", "o_totalprice"))
    finally:
        C.STRATEGIES.pop("to_hundreds")


@query(
    "fi01_drop_nulls",
    with_views(ORDERS, f"SELECT * FROM {ORDERS} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL"),
)
def fi01(spark, sf):
    return _cleaned(spark, sf, ["drop_nulls"])


@query(
    "fi02_outlier_drop",
    with_views(
        "dirty_events",
        f"SELECT e.* EXCLUDE (props) FROM dirty_events e, {spread_sql('dirty_events', 'event_id')} x, {spread_sql('dirty_events', 'user_id')} y, "
        f"{spread_sql('dirty_events', 'value')} z WHERE event_id BETWEEN x.lo AND x.hi AND user_id BETWEEN y.lo AND y.hi AND value BETWEEN z.lo AND z.hi",
    ),
)
def fi02(spark, sf):
    return _cleaned(spark, sf, ["outlier_drop"], source="dirty_events").drop("props")


@query(
    "wi01_dedup",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY "
    + ", ".join(c for c in COLUMNS["lineitem"] if c not in ("l_orderkey", "l_linenumber"))
    + ") AS rn FROM lineitem) WHERE rn = 1",
)
def wi01(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    options = C.Options(key=keys, order=[c for c in COLUMNS["lineitem"] if c not in keys])
    return C.clean(table(spark, sf, "lineitem"), ["deduplicate"], options).df


@query(
    "wi02_unique_fix",
    with_views(
        "contacts",
        "SELECT email, id FROM (SELECT email, id, row_number() OVER (PARTITION BY email ORDER BY id) AS rn FROM contacts) WHERE rn = 1 OR email IS NULL",
    ),
)
def wi02(spark, sf):
    df = view(spark, sf, "contacts").select("email", "id")
    return J.clean_by_rules(df, [{"id": "u", "type": "uniqueness", "field": "email"}], apply_fixes=True, order=["id"]).df


@query("se01_distinct", "SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)")
def se01(spark, sf):
    df = table(spark, sf, "lineitem")
    return C.clean(df.unionByName(df.where("l_linenumber = 1")), ["deduplicate_all"]).df


ROLLUP = C.Options(dims=["l_returnflag", "l_linestatus"], measures=["l_quantity", "l_extendedprice"])


@query(
    "ag13_rollup_sum",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1, 2",
)
def ag13_sum(spark, sf):
    return rounded(C.clean(table(spark, sf, "lineitem"), ["aggregate_sum"], ROLLUP).df, 2)


@query(
    "ag13_rollup_avg",
    "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2",
)
def ag13_avg(spark, sf):
    return rounded(C.clean(table(spark, sf, "lineitem"), ["aggregate_avg"], ROLLUP).df)


@query("ag13_rollup_count", "SELECT l_returnflag, l_linestatus, count(*) AS row_count FROM lineitem GROUP BY 1, 2")
def ag13_count(spark, sf):
    return C.clean(table(spark, sf, "lineitem"), ["aggregate_count"], ROLLUP).df


TARGETS = [
    {"name": "dwd_full", "rules": ["drop_nulls"], "quality_threshold": 99.0},
    {"name": "dwd_filled", "rules": ["trim_strings", "fill_null_zero", "fill_null_text"]},
    {"name": "ads_flagged", "rules": ["flag_nulls", "no_such_strategy"], "quality_threshold": 100.0},
]
COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CLEAN_VIEWS = {
    "dwd_full": "SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
    "dwd_filled": "SELECT o_orderkey, o_custkey, trim(o_orderstatus, ' ' || chr(9)) AS o_orderstatus, coalesce(o_totalprice, 0) AS o_totalprice, "
    "o_orderdate, coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM dirty_orders",
    "ads_flagged": "SELECT *, o_totalprice IS NULL AS o_totalprice_is_null, o_orderpriority IS NULL AS o_orderpriority_is_null FROM dirty_orders",
}
CLEAN_COLUMNS = {
    "dirty_orders": COLS,
    "dwd_full": COLS,
    "dwd_filled": COLS,
    "ads_flagged": [*COLS, "o_totalprice_is_null", "o_orderpriority_is_null"],
}
METRIC_SQL = (
    ", ".join(f"{n} AS ({q})" for n, q in CLEAN_VIEWS.items())
    + ", "
    + profile_sql(*CLEAN_COLUMNS, columns=CLEAN_COLUMNS)
    + ', quick AS (SELECT "table", max(row_count) AS n, (sum(100 - null_pct * 100) + sum(100 - outlier_pct * 100)) / (2 * count(*)) AS score FROM prof GROUP BY "table")'
)
MODIFIED = {
    "dwd_full": "(SELECT count(*) FROM dirty_orders WHERE o_totalprice IS NULL OR o_orderpriority IS NULL)",
    "dwd_filled": "(SELECT count(*) FILTER (WHERE trim(o_orderstatus, ' ' || chr(9)) <> o_orderstatus) + count(*) FILTER (WHERE o_totalprice IS NULL) "
    "+ count(*) FILTER (WHERE o_orderpriority IS NULL) FROM dirty_orders)",
    "ads_flagged": "0::BIGINT",
}
THRESHOLDS = {"dwd_full": 99.0, "dwd_filled": 0.0, "ads_flagged": 100.0}


def metrics_sql(names) -> str:
    return with_views(
        "dirty_orders",
        METRIC_SQL
        + " "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS target, b.n AS before_count, a.n AS after_count, b.n - a.n AS removed_count, {MODIFIED[n]} AS modified_count, "
            f"round(b.score, 4) AS score_before, round(a.score, 4) AS score_after, round(a.score - b.score, 4) AS improvement, a.score >= {THRESHOLDS[n]} AS meets_threshold "
            f"FROM quick a, quick b WHERE a.\"table\" = '{n}' AND b.\"table\" = 'dirty_orders'"
            for n in names
        ),
    )


def _metrics(job):
    return rounded(job.metrics.drop("source", "log"))


@query("cl17_multi_target", metrics_sql(CLEAN_VIEWS))
def cl17(spark, sf):
    return _metrics(J.clean_to_targets(spark, view(spark, sf, ORDERS), "ods_orders", TARGETS))


@query("cl18_single_target", metrics_sql(["dwd_filled"]))
def cl18(spark, sf):
    return _metrics(J.clean_one(spark, view(spark, sf, ORDERS), "ods_orders", "dwd_filled", TARGETS[1]["rules"]))


@query(
    "io15_clean_lineage",
    "SELECT 'ods_orders' AS source_table, c AS source_column, 'dwd_full' AS target_table, c AS target_column, 'ETL_clean:dwd_full' AS operation, 'drop_nulls' AS transformations "
    "FROM (SELECT unnest(['" + "', '".join(COLS) + "']) AS c)",
)
def io15(spark, sf):
    job = J.clean_to_targets(spark, view(spark, sf, ORDERS), "ods_orders", TARGETS[:1])
    return job.lineage.drop("ts").withColumn("transformations", F.array_join("transformations", "|"))


FIX_RULES = [
    {"id": "price_null", "type": "null_check", "field": "o_totalprice", "severity": "critical"},
    {"id": "price_range", "type": "range_check", "field": "o_totalprice", "min": 1000, "max": 500000, "severity": "critical"},
    {"id": "status", "type": "regex_match", "field": "o_orderstatus", "pattern": "[FO]", "severity": "warning"},
    {"id": "priority", "type": "enum_check", "field": "o_orderpriority", "allowed_values": ["1-URGENT", "2-HIGH", "5-LOW"]},
    {"id": "customer", "type": "uniqueness", "field": "o_custkey", "severity": "critical"},
    {"id": "fresh", "type": "freshness_check", "timestamp_field": "o_orderdate", "max_age_minutes": 60, "as_of": "1996-01-01 00:00:00"},
]
FIXED_SQL = """
s1 AS (SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL),
s2 AS (SELECT * FROM s1 WHERE o_totalprice BETWEEN 1000 AND 500000),
s3 AS (SELECT * FROM s2 WHERE regexp_matches(o_orderstatus, '^(?:[FO])')),
s4 AS (SELECT * FROM s3 WHERE o_orderpriority IS NULL OR o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')),
s5 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM s4) WHERE rn = 1),
s6 AS (SELECT * FROM s5 WHERE NOT (o_orderdate < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 60 MINUTE))
"""


@query("cl19_rule_clean", with_views(ORDERS, FIXED_SQL + "SELECT * FROM s6"))
def cl19(spark, sf):
    return J.clean_by_rules(view(spark, sf, ORDERS), FIX_RULES, "orders", True, ["o_orderkey"]).df


@query(
    "cl19_rule_clean_counts",
    with_views(
        ORDERS,
        FIXED_SQL
        + "SELECT 'price_null' AS rule_id, (SELECT count(*) FROM dirty_orders) - (SELECT count(*) FROM s1) AS failed_count "
        "UNION ALL SELECT 'price_range', (SELECT count(*) FROM s1) - (SELECT count(*) FROM s2) "
        "UNION ALL SELECT 'status', (SELECT count(*) FROM s2) - (SELECT count(*) FROM s3) "
        "UNION ALL SELECT 'priority', (SELECT count(*) FROM s3) - (SELECT count(*) FROM s4) "
        "UNION ALL SELECT 'customer', (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM s4 GROUP BY o_custkey HAVING count(*) > 1)) "
        "UNION ALL SELECT 'fresh', (SELECT count(*) FROM s5) - (SELECT count(*) FROM s6)",
    ),
)
def cl19_counts(spark, sf):
    job = J.clean_by_rules(view(spark, sf, ORDERS), FIX_RULES, "orders", True, ["o_orderkey"])
    return small_frame(spark, [(v[0], v[6]) for v in job.violations], "rule_id string, failed_count long")


@query(
    "cl20_rule_score",
    with_views(
        ORDERS,
        "f AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_totalprice IS NULL) + count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 500000) AS bad FROM dirty_orders) "
        "SELECT n AS total_rows, 0::BIGINT AS removed_rows, round(greatest(100 - bad / n::DOUBLE * 100, 0), 1) AS quality_score FROM f",
    ),
)
def cl20(spark, sf):
    job = J.clean_by_rules(view(spark, sf, ORDERS), FIX_RULES[:2], "orders")
    return small_frame(
        spark,
        [(job.total_rows, job.removed_rows, round(job.quality_score, 1))],
        "total_rows long, removed_rows long, quality_score double",
    )

