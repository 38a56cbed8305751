"""Compliance checks, the preset library, personal data in text, and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import compliance as C
from plumbline.operators import integrity as I
from plumbline.session import small_frame
from plumbline.workloads.registry import joined, query, rounded, table, tables, view, with_views

AS_OF = "2024-06-01 00:00:00"
CONFIG = {
    "gdpr": [
        {"id": "mail_held", "fields": ["e_mail", "email"], "enabled": True, "severity": "critical"},
        {"id": "phone_held", "fields": ["phone"], "enabled": True, "severity": "warning"},
        {"id": "home_held", "fields": ["home_address", "city"], "enabled": True, "severity": "info"},
        {"id": "account_held", "fields": ["bank_account"], "enabled": False, "severity": "critical"},
    ],
    "datatype_validation": [
        {"id": "birth_is_a_day", "field": "birth_date", "expected_dtype": "date", "enabled": True, "severity": "warning"},
        {"id": "quantity_is_whole", "field": "quantity", "expected_dtype": "integer", "enabled": True, "severity": "critical"},
        {"id": "price_is_a_number", "field": "o_totalprice", "expected_dtype": "float", "enabled": True, "severity": "info"},
    ],
    "freshness": [
        {"id": "seen_in_two_days", "timestamp_field": "updated_at", "max_age_minutes": 2880, "enabled": True, "severity": "info"},
    ],
    "referential_integrity": [
        {"id": "order_has_customer", "source_field": "o_custkey", "target_table": "customer", "target_field": "c_custkey", "enabled": True, "severity": "critical"},
    ],
}
CHECKED = ["contacts", "dirty_orders", "customer"]
VIEWS = "contacts dirty_orders"
STALE = "strptime(updated_at, '%Y-%m-%d %H:%M:%S') < TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 2880 MINUTE"


def example_sql(column: str, source: str, condition: str, n: int = 3) -> str:
    return (
        f"(SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT cast({column} AS string) AS v FROM {source} WHERE {condition} ORDER BY v LIMIT {n}))"
    )


def violation_sql(rule, standard, name, field, severity, condition, source=None, n=3) -> str:
    source = source or name
    return (
        f"SELECT '{rule}' AS rule_id, '{standard}' AS standard, '{name}' AS \"table\", '{field}' AS field, '{severity}' AS severity, "
        f"(SELECT count(*) FROM {source} WHERE {condition}) AS affected_rows, {example_sql(field, source, condition, n)} AS examples"
    )


GDPR = [
    violation_sql("mail_held", "GDPR", "contacts", "email", "critical", "email IS NOT NULL"),
    violation_sql("phone_held", "GDPR", "contacts", "phone", "warning", "phone IS NOT NULL"),
    violation_sql("home_held", "GDPR", "contacts", "home_address", "info", "home_address IS NOT NULL"),
]
DATATYPE = [
    violation_sql("birth_is_a_day", "DataTypeValidation", "contacts", "birth_date", "warning", "NOT regexp_matches(birth_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')"),
    violation_sql("quantity_is_whole", "DataTypeValidation", "contacts", "quantity", "critical", "TRY_CAST(quantity AS BIGINT) IS NULL"),
]
FRESH = [violation_sql("seen_in_two_days", "DataFreshness", "contacts", "updated_at", "info", STALE)]
ORPHANS = "(SELECT DISTINCT o_custkey FROM dirty_orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"
REFERENCE = [
    "SELECT 'order_has_customer' AS rule_id, 'ReferentialIntegrity' AS standard, 'dirty_orders' AS \"table\", 'o_custkey' AS field, 'critical' AS severity, "
    f"(SELECT count(*) FROM {ORPHANS}) AS affected_rows, (SELECT string_agg(cast(o_custkey AS string), '|' ORDER BY o_custkey) FROM (SELECT * FROM {ORPHANS} ORDER BY 1 LIMIT 5)) AS examples"
]
ALL = GDPR + DATATYPE + FRESH + REFERENCE


def _check(spark, sf, standard):
    found = C.check_tables(spark, tables(spark, sf, *CHECKED), CONFIG, standard, F.lit(AS_OF).cast("timestamp"))
    return found


def check_query(key, standard, parts):
    @query(key, with_views(VIEWS, " UNION ALL ".join(parts)))
    def run(spark, sf):
        return _check(spark, sf, standard).select("*").withColumn("examples", F.array_join("examples", "|"))


check_query("co01_columns", "gdpr", GDPR)
check_query("co02_datatypes", "datatype_validation", DATATYPE)
check_query("co03_freshness", "freshness", FRESH)
check_query("co04_references", "referential_integrity", REFERENCE)

FIELDS = 11 + 6 + 5
REPORT = (
    "v AS (" + " UNION ALL ".join(ALL) + "), "
    "s AS (SELECT * FROM (VALUES ('GDPR'), ('DataTypeValidation'), ('DataFreshness'), ('ReferentialIntegrity')) t(standard)), "
    f"r AS (SELECT s.standard, 3::BIGINT AS tables, {FIELDS}::BIGINT AS fields, {FIELDS} - count(v.rule_id) AS passed, count(v.rule_id) AS failed, "
    f"count(*) FILTER (WHERE v.severity = 'critical') AS critical, round(({FIELDS} - count(v.rule_id)) / {FIELDS}::DOUBLE * 100, 4) AS score "
    "FROM s LEFT JOIN v USING (standard) GROUP BY s.standard) "
)


def _reports(spark, sf):
    return C.reports(spark, tables(spark, sf, *CHECKED), _check(spark, sf, "all"))


@query("co05_report", with_views(VIEWS, REPORT + "SELECT * FROM r"))
def co05(spark, sf):
    return rounded(_reports(spark, sf))


@query(
    "ag17_compliance_score",
    with_views(
        VIEWS,
        REPORT
        + "SELECT round(avg(score), 1) AS overall_score, sum(failed)::BIGINT AS violations, sum(critical)::BIGINT AS critical_violations FROM r",
    ),
)
def ag17(spark, sf):
    return C.report_summary(_reports(spark, sf))


@query(
    "tk03_top_per_standard",
    with_views(
        VIEWS,
        "v AS (" + " UNION ALL ".join(ALL) + ") "
        "SELECT standard, rule_id, affected_rows, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY standard ORDER BY affected_rows DESC, rule_id, field) AS rank FROM v) WHERE rank <= 5",
    ),
)
def tk03_standard(spark, sf):
    from plumbline.operators.scoring import top_violations

    rows = _check(spark, sf, "all").withColumnRenamed("affected_rows", "failed_count")
    return top_violations(rows, "standard").select("standard", "rule_id", F.col("failed_count").alias("affected_rows"), "rank")


PRESET_COLUMNS = {
    "gdpr_email_mask": ["email"],
    "gdpr_phone_mask": ["phone"],
    "gdpr_id_card_mask": ["id_card"],
    "gdpr_bank_account_mask": ["bank_account"],
    "gdpr_address_mask": ["home_address"],
    "gdpr_name_mask": ["customer_name"],
}


@query(
    "co06_presets",
    with_views(
        "contacts",
        " UNION ALL ".join(
            f"SELECT '{rule}' AS rule_id, '{c}' AS field, count({c}) AS present FROM contacts" for rule, cs in PRESET_COLUMNS.items() for c in cs
        ),
    ),
)
def co06(spark, sf):
    from plumbline.functions.names import matching_columns

    df = view(spark, sf, "contacts")
    named = [(r["id"], c) for r in C.list_presets("GDPR") for c in matching_columns(r["fields"], df.columns)]
    counts = df.agg(*[F.count(c).alias(c) for c in dict.fromkeys(c for _, c in named)])
    present = counts.unpivot([], list(counts.columns), "field", "present")
    return small_frame(spark, named, "rule_id string, field string").join(F.broadcast(present), "field")


LAST4 = "CASE WHEN length(trim({c}, ' ' || chr(9))) >= 4 THEN '****' || right(trim({c}, ' ' || chr(9)), 4) ELSE '****' END"


@query(
    "co07_apply",
    with_views(
        "contacts",
        "SELECT id, left(customer_name, 1) || '**' AS customer_name, "
        "CASE WHEN email IS NULL THEN NULL WHEN contains(email, '@') THEN left(email, 1) || '****@' || split_part(email, '@', 2) ELSE '****' END AS email, "
        + ", ".join(f"{LAST4.format(c=c)} AS {c}" for c in ("phone", "bank_account", "home_address"))
        + ", left(id_card, 3) || '********' || right(id_card, 4) AS id_card FROM contacts",
    ),
)
def co07(spark, sf):
    masked = C.apply_presets(view(spark, sf, "contacts"), as_of=F.lit(AS_OF).cast("timestamp")).masked
    return masked.select("id", "customer_name", "email", "phone", "bank_account", "home_address", "id_card")


@query(
    "co07_dry_run",
    with_views(
        "contacts",
        " UNION ALL ".join(
            [
                *[f"SELECT '{rule}' AS rule_id, '{c}' AS field, count({c}) AS affected_rows FROM contacts" for rule, cs in PRESET_COLUMNS.items() for c in cs],
                "SELECT 'dt_date_iso', 'birth_date', count(*) FROM contacts WHERE NOT regexp_matches(birth_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')",
                "SELECT 'dt_email_format', 'email', count(*) FROM contacts WHERE NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')",
                "SELECT 'dt_phone_format', 'phone', count(*) FROM contacts WHERE NOT regexp_matches(phone, '^1[3-9][0-9]{9}$')",
                "SELECT 'freshness_realtime', 'updated_at', count(*) FROM contacts WHERE strptime(updated_at, '%Y-%m-%d %H:%M:%S') < TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 5 MINUTE",
            ]
        ),
    ),
)
def co07_dry(spark, sf):
    done = C.apply_presets(view(spark, sf, "contacts"), dry_run=True, as_of=F.lit(AS_OF).cast("timestamp"))
    return small_frame(spark, done.violations, C.VIOLATION_SCHEMA).select("rule_id", "field", "affected_rows")


def hits_sql(shape: str) -> str:
    return f"len(regexp_extract_all(text, '{shape}'))::BIGINT"


@query(
    "co08_pii_text",
    "SELECT * FROM (SELECT doc_id, "
    + ", ".join(f"{hits_sql(shape)} AS {kind}_hits" for kind, shape in C.TEXT_SHAPES.items())
    + " FROM documents) WHERE email_hits > 0 OR phone_hits > 0 OR id_card_hits > 0 OR bank_account_hits > 0",
)
def co08(spark, sf):
    return C.text_findings(table(spark, sf, "documents"), "text", ["doc_id"])


@query(
    "jo01_orphans",
    with_views("dirty_orders", "SELECT DISTINCT o_custkey AS value FROM dirty_orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
)
def jo01(spark, sf):
    return I.orphans(view(spark, sf, "dirty_orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey")


@query(
    "jo01_orphan_summary",
    with_views(
        "dirty_orders",
        f"SELECT count(*) AS orphans, (SELECT string_agg(cast(o_custkey AS string), '|' ORDER BY o_custkey) FROM (SELECT * FROM {ORPHANS} ORDER BY 1 LIMIT 5)) AS examples FROM {ORPHANS}",
    ),
)
def jo01_summary(spark, sf):
    found = I.orphan_summary(view(spark, sf, "dirty_orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey")
    return found.select("orphans", joined("examples"))
