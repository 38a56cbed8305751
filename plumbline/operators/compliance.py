"""Compliance: find and mask sensitive columns, check formats, freshness and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.masking import PRESET_MASKS
from plumbline.functions.names import matching_columns
from plumbline.functions.parsing import is_iso_date, parse_integer, parse_number, parse_time
from plumbline.operators.integrity import orphan_summary
from plumbline.operators.rules import same_prefix
from plumbline.session import small_frame

VIOLATION_SCHEMA = (
    "rule_id string, standard string, `table` string, field string, severity string, "
    "affected_rows long, examples array<string>"
)
EXAMPLES = 3
STANDARDS = ["gdpr", "datatype_validation", "freshness", "referential_integrity"]

# Formats of values.
EMAIL_FORMAT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_FORMAT = r"^1[3-9]\d{9}$"

# The preset rules.
PRESETS = [
    {
        "id": "gdpr_email_mask",
        "standard": "GDPR",
        "fields": ["email", "Email", "EMAIL", "user_email", "contact_email"],
        "action": "mask",
        "severity": "critical",
        "mask_type": "email",
    },
    {
        "id": "gdpr_phone_mask",
        "standard": "GDPR",
        "fields": ["phone", "mobile", "tel", "telephone", "手机号"],
        "action": "mask",
        "severity": "critical",
        "mask_type": "phone",
    },
    {
        "id": "gdpr_id_card_mask",
        "standard": "GDPR",
        "fields": ["id_card", "idcard", "identity_card", "身份证", "证件号"],
        "action": "mask",
        "severity": "critical",
        "mask_type": "id_card",
    },
    {
        "id": "gdpr_bank_account_mask",
        "standard": "GDPR",
        "fields": ["bank_account", "bank_account_no", "bank_no", "银行卡号", "账户"],
        "action": "mask",
        "severity": "critical",
        "mask_type": "bank_account",
    },
    {
        "id": "gdpr_address_mask",
        "standard": "GDPR",
        "fields": ["address", "home_address", "address_detail", "地址", "收货地址"],
        "action": "mask",
        "severity": "warning",
        "mask_type": "address",
    },
    {
        "id": "gdpr_name_mask",
        "standard": "GDPR",
        "fields": ["name", "customer_name", "user_name", "姓名", "客户姓名"],
        "action": "mask",
        "severity": "warning",
        "mask_type": "name",
    },
    {
        "id": "dt_date_iso",
        "standard": "DataTypeValidation",
        "fields": ["date", "created_date", "updated_date", "birth_date"],
        "action": "validate",
        "severity": "critical",
        "expected_dtype": "date",
    },
    {
        "id": "dt_email_format",
        "standard": "DataTypeValidation",
        "fields": ["email", "Email", "EMAIL"],
        "action": "validate",
        "severity": "critical",
        "pattern": EMAIL_FORMAT,
    },
    {
        "id": "dt_phone_format",
        "standard": "DataTypeValidation",
        "fields": ["phone", "mobile", "tel"],
        "action": "validate",
        "severity": "warning",
        "pattern": PHONE_FORMAT,
    },
    {
        "id": "freshness_realtime",
        "standard": "DataFreshness",
        "fields": ["timestamp", "updated_at", "created_at", "sync_time"],
        "action": "check_freshness",
        "severity": "warning",
        "max_age_minutes": 5,
    },
    {
        "id": "freshness_batch",
        "standard": "DataFreshness",
        "fields": ["date", "update_date", "batch_date"],
        "action": "check_freshness",
        "severity": "info",
        "max_age_minutes": 1440,
    },
]


def list_presets(standard: str | None = None) -> list[dict]:
    return [r for r in PRESETS if standard is None or r["standard"] == standard]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Finding:
    """One rule on one column: which rows break it."""

    rule: dict
    column: str
    breaks: Column


def count_findings(df: DataFrame, table: str, findings: list[Finding]) -> list[tuple]:
    """Affected rows of every finding in one scan; three smallest values as examples where there are any."""
    if not findings:
        return []
    row = df.agg(*[F.count_if(F.coalesce(f.breaks, F.lit(False))) for f in findings]).first()
    hit = [i for i, n in enumerate(row) if n]
    examples = smallest(df, {i: (_q(findings[i].column), findings[i].breaks) for i in hit})
    return [
        (
            findings[i].rule["id"],
            findings[i].rule["standard"],
            table,
            findings[i].column,
            findings[i].rule.get("severity", "critical"),
            row[i],
            examples.get(i, []),
        )
        for i in hit
    ]


def smallest(df: DataFrame, wanted: dict[int, tuple[Column, Column]], n: int = EXAMPLES) -> dict[int, list[str]]:
    """The n smallest distinct values in text order per key: a scan for each, with one value per key in memory."""
    found: dict[int, list[str]] = {}
    left = dict(wanted)
    for _ in range(n):
        least = []
        for k, (c, cond) in left.items():
            v = c.cast("string")
            least.append(F.min(F.when(cond & (v > found[k][-1]) if k in found else cond, v)))
        row = df.agg(*least).first() if least else ()
        left = {k: w for (k, w), v in zip(left.items(), row) if v is not None}
        for k, v in zip(left, [v for v in row if v is not None]):
            found.setdefault(k, []).append(v)
    return found


# ---- checks of configured standards


def sensitive_findings(df: DataFrame, rules: list[dict]) -> list[Finding]:
    """Columns that a masking rule names and that hold data; each (rule, column) once."""
    return [
        Finding({"standard": "GDPR", **rule}, c, _q(c).isNotNull())
        for rule in rules
        if rule.get("enabled", False)
        for c in matching_columns(rule.get("fields", []), df.columns)
    ]


def datatype_findings(df: DataFrame, rules: list[dict]) -> list[Finding]:
    """Values that are not ISO dates, whole numbers or numbers where they should be."""
    found = []
    for rule in rules:
        c = rule.get("field", "")
        if not rule.get("enabled", False) or c not in df.columns:
            continue
        v, kind = _q(c), rule.get("expected_dtype")
        dtype = df.schema[c].dataType
        if kind == "date":
            good = F.lit(True) if isinstance(dtype, T.DateType) else is_iso_date(v)
        elif kind == "integer":
            good = F.lit(True) if isinstance(dtype, T.IntegralType) else parse_integer(v).isNotNull()
        elif kind == "float":
            good = F.lit(True) if isinstance(dtype, T.NumericType) else parse_number(v).isNotNull()
        else:
            continue
        found.append(Finding({"standard": "DataTypeValidation", **rule}, c, v.isNotNull() & ~good))
    return found


def freshness_findings(df: DataFrame, rules: list[dict], as_of: Column | None = None) -> list[Finding]:
    now = F.current_timestamp() if as_of is None else as_of
    found = []
    for rule in rules:
        c = rule.get("timestamp_field", "date")
        if not rule.get("enabled", False) or c not in df.columns:
            continue
        ts = parse_time(_q(c), df.schema[c].dataType)
        cutoff = now - F.make_dt_interval(mins=F.lit(rule.get("max_age_minutes", 5)))
        found.append(Finding({"standard": "DataFreshness", "severity": "warning", **rule}, c, ts < cutoff))
    return found


def reference_rows(df: DataFrame, table: str, tables: dict[str, DataFrame], rules: list[dict]) -> list[tuple]:
    rows = []
    for rule in rules:
        target = tables.get(rule.get("target_table", ""))
        field, key = rule.get("source_field", ""), rule.get("target_field", "")
        if not rule.get("enabled", False) or field not in df.columns or target is None or key not in target.columns:
            continue
        found = orphan_summary(df, field, target, key).first()
        if found["orphans"]:
            severity = rule.get("severity", "critical")
            rows.append(
                (rule["id"], "ReferentialIntegrity", table, field, severity, found["orphans"], found["examples"])
            )
    return rows


def check_tables(
    spark: SparkSession, tables: dict[str, DataFrame], config: dict, standard: str = "all", as_of: Column | None = None
) -> DataFrame:
    """Violations of one standard, or of all, over all tables; one scan per table for all its value checks."""
    rows: list[tuple] = []
    wanted = STANDARDS if standard == "all" else [standard]
    for t, df in tables.items():
        findings: list[Finding] = []
        if "gdpr" in wanted:
            findings += sensitive_findings(df, config.get("gdpr", []))
        if "datatype_validation" in wanted:
            findings += datatype_findings(df, config.get("datatype_validation", []))
        if "freshness" in wanted:
            findings += freshness_findings(df, config.get("freshness", []), as_of)
        rows += count_findings(df, t, findings)
        if "referential_integrity" in wanted:
            rows += reference_rows(df, t, tables, config.get("referential_integrity", []))
    return small_frame(spark, rows, VIOLATION_SCHEMA)


# Report name of each standard.
REPORT_NAMES = {
    "gdpr": "GDPR",
    "datatype_validation": "DataTypeValidation",
    "freshness": "DataFreshness",
    "referential_integrity": "ReferentialIntegrity",
}


def reports(spark: SparkSession, tables: dict[str, DataFrame], violations: DataFrame) -> DataFrame:
    """One row per standard: fields checked, failed, passed, score."""
    fields = sum(len(df.columns) for df in tables.values())
    names = small_frame(spark, [(n,) for n in REPORT_NAMES.values()], "standard string")
    counts = violations.groupBy("standard").agg(
        F.count("*").alias("failed"), F.count_if(F.col("severity") == "critical").alias("critical")
    )
    passed = F.greatest(F.lit(fields) - F.col("failed"), F.lit(0))
    return (
        names.join(counts, "standard", "left")
        .fillna({"failed": 0, "critical": 0})
        .select(
            "standard",
            F.lit(len(tables)).cast("long").alias("tables"),
            F.lit(fields).cast("long").alias("fields"),
            passed.cast("long").alias("passed"),
            "failed",
            "critical",
            (passed / max(fields, 1) * 100).alias("score"),
        )
    )


def report_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.round(F.avg("score"), 1).alias("overall_score"),
        F.sum("failed").alias("violations"),
        F.sum("critical").alias("critical_violations"),
    )


# ---- the preset library


@dataclass
class Applied:
    success: bool
    rule_ids: list[str]
    violations: list[tuple]
    masked: DataFrame | None
    records: int


def apply_presets(
    df: DataFrame,
    rule_ids: list[str] | None = None,
    dry_run: bool = False,
    as_of: Column | None = None,
    table: str = "input",
) -> Applied:
    """Check all matching columns in one scan; unless dry, mask them in one projection."""
    selected = [r for r in PRESETS if rule_ids is None or r["id"] in rule_ids]
    now = F.current_timestamp() if as_of is None else as_of
    findings, masks = [], {}
    for rule in selected:
        for c in matching_columns(rule["fields"], df.columns):
            v = _q(c)
            if rule["action"] == "mask":
                findings.append(Finding(rule, c, v.isNotNull()))
                masks.setdefault(c, []).append(PRESET_MASKS[rule["mask_type"]])
            elif rule["action"] == "validate":
                good = is_iso_date(v) if rule.get("expected_dtype") == "date" else same_prefix(v.cast("string"), rule["pattern"])
                findings.append(Finding(rule, c, v.isNotNull() & ~good))
            else:
                cutoff = now - F.make_dt_interval(mins=F.lit(rule["max_age_minutes"]))
                findings.append(Finding(rule, c, parse_time(v, df.schema[c].dataType) < cutoff))
    records = df.count()
    if not records:
        return Applied(False, [], [], None, 0)
    violations = count_findings(df, table, findings)
    masked = None
    if not dry_run:
        done = {}
        for c, fns in masks.items():
            v = _q(c)
            for fn in fns:
                v = fn(v)
            done[c] = v
        masked = df.withColumns(done)
    return Applied(True, [r["id"] for r in selected], violations, masked, records)


# ---- personal data inside text

# Shapes of personal data in running text.
TEXT_SHAPES = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"\b1[3-9][0-9]{9}\b",
    "id_card": r"\b[0-9]{17}[0-9Xx]\b",
    "bank_account": r"\b[0-9]{16,19}\b",
}


def text_findings(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Rows whose text holds personal data, with the number of hits of each kind; whole texts, one scan."""
    hits = {f"{kind}_hits": F.regexp_count(F.col(text), F.lit(shape)) for kind, shape in TEXT_SHAPES.items()}
    # Behind ``inline`` the filter cannot be pushed into the patterns, so each runs once per text.
    found = df.select(*keys, F.inline(F.array(F.struct(*[c.cast("long").alias(n) for n, c in hits.items()]))))
    some = F.lit(False)
    for n in hits:
        some = some | (F.col(n) > 0)
    return found.where(some)
