"""Rules, predicates, uniqueness and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.names import matching_columns
from plumbline.operators import rules as R
from plumbline.operators.drift import severity_summary
from plumbline.operators.scoring import top_violations
from plumbline.session import small_frame
from plumbline.sources.payloads import parse_payloads
from plumbline.workloads.registry import joined, query, rounded, table, tables, view, with_views

AS_OF = "1998-09-02 00:00:00"


def _outcome(spark, df, name, rule, unique_rows=False):
    rows = R.violations(spark, {name: df}, [{"id": "r", "severity": "critical", **rule}], unique_rows=unique_rows)
    return rows.select("field", "status", "failed_count", "total_count")


def outcome_sql(field: str, fails: str, total: str, source: str = "dirty_orders") -> str:
    return with_views(
        source,
        f"SELECT '{field}' AS field, CASE WHEN f > 0 THEN 'failed' ELSE 'passed' END AS status, f AS failed_count, t AS total_count "
        f"FROM (SELECT count(*) FILTER (WHERE {fails}) AS f, {total} AS t FROM {source})",
    )


PRIORITY_PATTERN = "[1-3]-[A-Z]+"
ROW_RULES = {
    "fi03_null": ({"type": "null_check", "field": "o_totalprice"}, "o_totalprice IS NULL", "count(*)"),
    "fi04_regex": (
        {"type": "regex_match", "field": "o_orderpriority", "pattern": PRIORITY_PATTERN},
        f"NOT regexp_matches(o_orderpriority, '^(?:{PRIORITY_PATTERN})')",
        "count(o_orderpriority)",
    ),
    "fi05_range": (
        {"type": "range_check", "field": "o_totalprice", "min": 1000, "max": 400000},
        "o_totalprice < 1000 OR o_totalprice > 400000",
        "count(o_totalprice)",
    ),
    "fi06_length": (
        {"type": "length_check", "field": "o_orderstatus", "min_len": 1, "max_len": 1},
        "NOT (length(o_orderstatus) BETWEEN 1 AND 1)",
        "count(o_orderstatus)",
    ),
    "fi07_enum": (
        {"type": "enum_check", "field": "o_orderpriority", "allowed_values": ["1-URGENT", "2-HIGH", "5-LOW"]},
        "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')",
        "count(o_orderpriority)",
    ),
    "fi08_datatype": (
        {"type": "datatype_check", "field": "o_orderpriority", "expected_dtype": "integer"},
        "TRY_CAST(o_orderpriority AS BIGINT) IS NULL",
        "count(*)",
    ),
    "fi09_fresh": (
        {"type": "freshness_check", "timestamp_field": "o_orderdate", "max_age_minutes": 1440, "as_of": AS_OF},
        f"o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 1440 MINUTE",
        "count(o_orderdate)",
    ),
}


def _register(key, rule, fails, total):
    field = R.field_of(rule)

    @query(key, outcome_sql(field, fails, total))
    def run(spark, sf):
        return _outcome(spark, view(spark, sf, "dirty_orders"), "orders", rule)


for _key, (_rule, _fails, _total) in ROW_RULES.items():
    _register(_key, _rule, _fails, _total)


@query(
    "fi08_datatype_text",
    outcome_sql("mixed_text", "TRY_CAST(mixed_text AS DOUBLE) IS NULL", "count(*)", "text_orders"),
)
def fi08_text(spark, sf):
    rule = {"type": "datatype_check", "field": "mixed_text", "expected_dtype": "float"}
    return _outcome(spark, view(spark, sf, "text_orders"), "orders", rule)


@query(
    "fi09_fresh_text",
    outcome_sql(
        "date_text",
        "strptime(date_text, '%Y-%m-%d %H:%M:%S') < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 60 MINUTE",
        "count(date_text)",
        "text_orders",
    ),
)
def fi09_text(spark, sf):
    rule = {"type": "freshness_check", "timestamp_field": "date_text", "max_age_minutes": 60, "as_of": "1998-01-01 00:00:00"}
    return _outcome(spark, view(spark, sf, "text_orders"), "orders", rule)


@query(
    "ag10_unique_values",
    "SELECT count(*) AS duplicated_values FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
)
def ag10(spark, sf):
    return R.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("duplicated_values")


@query(
    "ag11_unique_rows",
    "SELECT sum(n)::BIGINT AS duplicated_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
)
def ag11(spark, sf):
    return R.uniqueness(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("duplicated_rows")


@query(
    "ag11_unique_rule",
    "SELECT 'o_custkey' AS field, 'failed' AS status, (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS failed_count, "
    "(SELECT count(o_custkey) FROM orders) AS total_count",
)
def ag11_rule(spark, sf):
    rule = {"type": "uniqueness", "field": "o_custkey"}
    return _outcome(spark, table(spark, sf, "orders"), "orders", rule, unique_rows=True)


CONFIG = {
    "defaults": [
        {"id": "d_not_null", "type": "null_check", "severity": "critical"},
        {"id": "d_email", "type": "regex_match", "field": "email", "pattern": ".+@.+", "severity": "critical"},
        {"id": "d_off", "type": "null_check", "field": "o_orderkey", "enabled": False},
    ],
    "table_rules": {
        "*": [{"id": "g_unique", "type": "uniqueness", "field": "o_orderkey", "severity": "critical"}],
        "dirty_orders": [
            {"id": "o_price", "type": "range_check", "field": "o_totalprice", "min": 0, "max": 500000, "severity": "critical"},
            {"id": "o_price_null", "type": "null_check", "field": "o_totalprice", "severity": "critical"},
            {"id": "o_priority", "type": "enum_check", "field": "o_orderpriority", "allowed_values": ["1-URGENT", "2-HIGH"], "severity": "warning"},
            {"id": "o_status", "type": "length_check", "field": "o_orderstatus", "min_len": 1, "max_len": 1, "severity": "info"},
            {"id": "o_odd", "type": "no_such_rule", "field": "o_orderkey", "severity": "info"},
        ],
        "dirty_customer": [
            {"id": "c_name", "type": "regex_match", "field": "c_name", "pattern": "Customer#[0-9]+", "severity": "critical"},
            {"id": "c_segment", "type": "null_check", "field": "c_mktsegment", "severity": "warning"},
            {"id": "c_nation", "type": "uniqueness", "field": "c_nationkey", "severity": "warning"},
            {"id": "c_missing", "type": "null_check", "field": "no_such_column", "severity": "critical"},
        ],
        "part": [{"id": "p_price", "type": "range_check", "field": "p_retailprice", "min": 0.01, "max": 100000, "severity": "critical"}],
    },
}
RULED = ["dirty_orders", "dirty_customer", "part"]

# rule id, type, table, field, severity, failing rows, counted rows
OUTCOMES = [
    ("g_unique", "uniqueness", "dirty_orders", "o_orderkey", "critical", "SELECT count(*) FROM (SELECT 1 FROM dirty_orders GROUP BY o_orderkey HAVING count(*) > 1)", "SELECT count(o_orderkey) FROM dirty_orders"),
    ("o_price", "range_check", "dirty_orders", "o_totalprice", "critical", "SELECT count(*) FROM dirty_orders WHERE o_totalprice < 0 OR o_totalprice > 500000", "SELECT count(o_totalprice) FROM dirty_orders"),
    ("o_price_null", "null_check", "dirty_orders", "o_totalprice", "critical", "SELECT count(*) FROM dirty_orders WHERE o_totalprice IS NULL", "SELECT count(*) FROM dirty_orders"),
    ("o_priority", "enum_check", "dirty_orders", "o_orderpriority", "warning", "SELECT count(*) FROM dirty_orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "SELECT count(o_orderpriority) FROM dirty_orders"),
    ("o_status", "length_check", "dirty_orders", "o_orderstatus", "info", "SELECT count(*) FROM dirty_orders WHERE length(o_orderstatus) <> 1", "SELECT count(o_orderstatus) FROM dirty_orders"),
    ("o_odd", "no_such_rule", "dirty_orders", "o_orderkey", "info", None, None),
    ("d_not_null", "null_check", "dirty_orders", "", "critical", None, None),
    ("d_email", "regex_match", "dirty_orders", "email", "critical", None, None),
    ("g_unique", "uniqueness", "dirty_customer", "o_orderkey", "critical", None, None),
    ("c_name", "regex_match", "dirty_customer", "c_name", "critical", "SELECT count(*) FROM dirty_customer WHERE NOT regexp_matches(c_name, '^(?:Customer#[0-9]+)')", "SELECT count(c_name) FROM dirty_customer"),
    ("c_segment", "null_check", "dirty_customer", "c_mktsegment", "warning", "SELECT count(*) FROM dirty_customer WHERE c_mktsegment IS NULL", "SELECT count(*) FROM dirty_customer"),
    ("c_nation", "uniqueness", "dirty_customer", "c_nationkey", "warning", "SELECT count(*) FROM (SELECT 1 FROM dirty_customer GROUP BY c_nationkey HAVING count(*) > 1)", "SELECT count(c_nationkey) FROM dirty_customer"),
    ("c_missing", "null_check", "dirty_customer", "no_such_column", "critical", None, None),
    ("d_not_null", "null_check", "dirty_customer", "", "critical", None, None),
    ("d_email", "regex_match", "dirty_customer", "email", "critical", None, None),
    ("g_unique", "uniqueness", "part", "o_orderkey", "critical", None, None),
    ("p_price", "range_check", "part", "p_retailprice", "critical", "SELECT count(*) FROM part WHERE p_retailprice < 0.01 OR p_retailprice > 100000", "SELECT count(p_retailprice) FROM part"),
    ("d_not_null", "null_check", "part", "", "critical", None, None),
    ("d_email", "regex_match", "part", "email", "critical", None, None),
]
OUTCOME_SQL = (
    "outcomes AS ("
    + " UNION ALL ".join(
        f"SELECT '{i}' AS rule_id, '{k}' AS rule_type, '{t}' AS \"table\", '{f}' AS field, '{s}' AS severity, "
        + (
            "'skipped' AS status, 0::BIGINT AS failed_count, 0::BIGINT AS total_count"
            if fails is None
            else f"CASE WHEN ({fails}) > 0 THEN 'failed' ELSE 'passed' END AS status, ({fails})::BIGINT AS failed_count, ({total})::BIGINT AS total_count"
        )
        for i, k, t, f, s, fails, total in OUTCOMES
    )
    + ")"
)
RULED_VIEWS = "dirty_orders dirty_customer"
PASSED = "status IN ('passed', 'skipped')"


def _outcomes(spark, sf, samples=False):
    return R.violations(spark, tables(spark, sf, *RULED), CONFIG, samples)


@query("ag08_rule_outcomes", with_views(RULED_VIEWS, OUTCOME_SQL + " SELECT * FROM outcomes"))
def ag08_outcomes(spark, sf):
    return _outcomes(spark, sf).drop("sample_values")


@query(
    "ag08_validate_table",
    with_views(
        RULED_VIEWS,
        OUTCOME_SQL
        + f' SELECT "table", count(*) AS total_rules, count(*) FILTER (WHERE {PASSED}) AS passed, count(*) FILTER (WHERE NOT {PASSED}) AS failed, '
        f"round(count(*) FILTER (WHERE {PASSED}) / count(*)::DOUBLE * 100, 4) AS quality_score, "
        f"coalesce(string_agg(rule_id, '|' ORDER BY rule_id) FILTER (WHERE {PASSED}), '') AS passed_rules, "
        f"coalesce(string_agg(rule_id, '|' ORDER BY rule_id) FILTER (WHERE NOT {PASSED}), '') AS failed_rules "
        'FROM outcomes GROUP BY "table" UNION ALL SELECT \'no_such_table\', 3, 0, 3, 0.0, \'\', \'d_email|d_not_null|g_unique\'',
    ),
)
def ag08(spark, sf):
    everything = {**tables(spark, sf, *RULED), "no_such_table": None}
    found = R.table_results(R.violations(spark, everything, CONFIG))
    return rounded(found.withColumns({c: F.array_join(c, "|") for c in ("passed_rules", "failed_rules")}))


BAD = "status IN ('failed', 'error')"


@query(
    "ag09_validate_all",
    with_views(
        RULED_VIEWS,
        OUTCOME_SQL
        + f' SELECT count(DISTINCT "table") AS total_tables, count(*) AS total_rules, count(*) FILTER (WHERE {PASSED}) AS total_passed, '
        f"count(*) FILTER (WHERE NOT {PASSED}) AS total_failed, round(count(*) FILTER (WHERE {PASSED}) / count(*)::DOUBLE * 100, 4) AS overall_score, "
        + ", ".join(f"count(*) FILTER (WHERE {BAD} AND severity = '{s}') AS {s}" for s in ("critical", "warning", "info"))
        + " FROM outcomes",
    ),
)
def ag09(spark, sf):
    return rounded(R.warehouse_result(_outcomes(spark, sf)))


@query(
    "tk02_critical",
    with_views(
        RULED_VIEWS,
        OUTCOME_SQL
        + f" SELECT rule_id, \"table\", field, failed_count FROM outcomes WHERE {BAD} AND severity = 'critical' ORDER BY \"table\", rule_id, field LIMIT 20",
    ),
)
def tk02(spark, sf):
    return R.critical_violations(_outcomes(spark, sf)).select("rule_id", "table", "field", "failed_count")


@query(
    "tk03_top_violations",
    with_views(
        RULED_VIEWS,
        OUTCOME_SQL
        + ' SELECT "table", rule_id, failed_count, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY failed_count DESC, rule_id, field) AS rank '
        f"FROM outcomes WHERE {BAD}) WHERE rank <= 5",
    ),
)
def tk03(spark, sf):
    bad = _outcomes(spark, sf).where(F.col("status").isin("failed", "error"))
    return top_violations(bad, "table").select("table", "rule_id", "failed_count", "rank")


@query(
    "ag16_severity_summary",
    with_views(
        RULED_VIEWS,
        OUTCOME_SQL
        + " SELECT count(*) AS total, "
        + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("breaking", "critical", "warning", "info"))
        + f", count(*) FILTER (WHERE severity = 'breaking') > 0 AS has_breaking FROM outcomes WHERE {BAD}",
    ),
)
def ag16(spark, sf):
    return severity_summary(_outcomes(spark, sf).where(F.col("status").isin("failed", "error")))


def samples_sql(rule: str, view_name: str, column: str, fails: str, order: str) -> str:
    return (
        f"SELECT '{rule}' AS rule_id, string_agg(cast({column} AS string), '|' ORDER BY rn) AS sample_values FROM "
        f"(SELECT {column}, row_number() OVER (ORDER BY {order}) AS rn FROM {view_name} WHERE {fails}) WHERE rn <= 5"
    )


@query(
    "wi08_samples",
    with_views(
        RULED_VIEWS,
        samples_sql("o_priority", "dirty_orders", "o_orderpriority", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", "o_orderpriority")
        + " UNION ALL "
        + samples_sql("c_nation", "(SELECT c_nationkey FROM dirty_customer GROUP BY 1 HAVING count(*) > 1)", "c_nationkey", "true", "c_nationkey")
        + " UNION ALL SELECT 'o_status', string_agg(o_orderstatus, '|' ORDER BY rn) FROM (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS rn "
        "FROM dirty_orders WHERE length(o_orderstatus) <> 1) WHERE rn <= 5",
    ),
)
def wi08(spark, sf):
    rows = _outcomes(spark, sf, samples=True)
    wanted = rows.where(F.col("rule_id").isin("o_priority", "c_nation", "o_status"))
    return wanted.select("rule_id", joined("sample_values"))


INLINE_RULES = [
    {"id": "k_range", "type": "range_check", "field": "k", "min": 10, "max": 90, "severity": "critical"},
    {"id": "k_null", "type": "null_check", "field": "k", "severity": "warning"},
]


@query(
    "ag12_inline_check",
    "SELECT n AS total_rows, (f > 0)::BIGINT AS violations, round(greatest(100 - f / n::DOUBLE * 100, 0), 4) AS quality_score FROM "
    "(SELECT count(*) AS n, count(*) FILTER (WHERE k < 10 OR k > 90) AS f FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))",
)
def ag12(spark, sf):
    good, _ = parse_payloads(table(spark, sf, "events"), "props", ["k"])
    typed = good.select(F.col("k").cast("long").alias("k"))
    rows = R.evaluate(typed, INLINE_RULES, "payload")
    return rounded(R.inline_score(small_frame(spark, rows, R.VIOLATION_SCHEMA), typed.count()))


@query(
    "fi10_enabled_rules",
    "SELECT t.name AS \"table\", r.scope, r.id FROM (SELECT DISTINCT 'orders_' || lower(o_orderstatus) AS name FROM orders) t, "
    "(SELECT * FROM (VALUES ('*', 'g1', true), ('defaults', 'd1', true), ('defaults', 'd2', false), ('orders_f', 's1', true), ('orders_o', 's2', false)) v(scope, id, enabled)) r "
    "WHERE r.enabled AND (r.scope IN ('*', 'defaults') OR r.scope = t.name)",
)
def fi10(spark, sf):
    return _resolved(spark, sf).select("table", "scope", "id")


def _resolved(spark, sf):
    names = table(spark, sf, "orders").select(F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("table")).distinct()
    scopes = [("*", "g1", True), ("defaults", "d1", True), ("defaults", "d2", False), ("orders_f", "s1", True), ("orders_o", "s2", False)]
    return R.resolve_rule_rows(names, small_frame(spark, scopes, "scope string, id string, enabled boolean"))


@query(
    "jo02_rule_resolution",
    "SELECT t.name AS \"table\", string_agg(r.id, '|' ORDER BY r.pos) AS rules FROM (SELECT DISTINCT 'orders_' || lower(o_orderstatus) AS name FROM orders) t, "
    "(SELECT * FROM (VALUES ('*', 'g1', true, 0), ('defaults', 'd1', true, 2), ('defaults', 'd2', false, 2), ('orders_f', 's1', true, 1), ('orders_o', 's2', false, 1)) v(scope, id, enabled, pos)) r "
    "WHERE r.enabled AND (r.scope IN ('*', 'defaults') OR r.scope = t.name) GROUP BY t.name",
)
def jo02(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("priority", "id")))
    rules = F.array_join(F.transform(ordered, lambda r: r["id"]), "|")
    return _resolved(spark, sf).groupBy("table").agg(rules.alias("rules"))


@query(
    "se07_rule_union",
    "SELECT id, count(*) AS tables FROM (SELECT DISTINCT 'orders_' || lower(o_orderstatus) AS name FROM orders) t, "
    "(SELECT * FROM (VALUES ('*', 'g1', true), ('defaults', 'd1', true), ('defaults', 'd2', false), ('orders_f', 's1', true), ('orders_o', 's2', false)) v(scope, id, enabled)) r "
    "WHERE r.enabled AND (r.scope IN ('*', 'defaults') OR r.scope = t.name) GROUP BY id",
)
def se07(spark, sf):
    return _resolved(spark, sf).groupBy("id").agg(F.count("*").alias("tables"))


@query(
    "fi11_column_match",
    with_views(
        "contacts",
        "SELECT 'email' AS field, count(email) AS present FROM contacts UNION ALL SELECT 'phone', count(phone) FROM contacts "
        "UNION ALL SELECT 'home_address', count(home_address) FROM contacts",
    ),
)
def fi11(spark, sf):
    df = view(spark, sf, "contacts")
    named = matching_columns(["EMAIL", "pho", "home_.*"], df.columns)
    counts = df.agg(*[F.count(c).alias(c) for c in named])
    return counts.unpivot([], named, "field", "present")
