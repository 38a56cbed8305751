"""Declarative quality rules, fused so that any number of them costs one scan.

A rule is a dict: ``id, type, field, severity, enabled`` and the parameters of its
type. Row rules become ``count_if`` columns of a single aggregate. Uniqueness needs
the values themselves and runs as one grouped count per field.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.parsing import parse_time
from plumbline.operators.profile import chunks
from plumbline.session import at_once, small_frame

VIOLATION_SCHEMA = (
    "rule_id string, rule_type string, `table` string, field string, severity string, status string, "
    "failed_count long, total_count long, sample_values array<string>"
)
SAMPLES = 5

# Rule type names and the Spark types they accept; the first one is the cast target.
TYPE_NAMES = {
    "integer": ["bigint", "int"],
    "float": ["double", "float"],
    "string": ["string"],
    "date": ["date"],
    "datetime": ["timestamp", "timestamp_ntz"],
    "boolean": ["boolean"],
}


@dataclass(frozen=True)
class Check:
    """Failure test of a row and the rows it is counted over (all rows when ``over`` is None)."""

    fails: Column
    over: Column | None


RowRule = Callable[[dict, T.StructType], Check | None]
ROW_RULES: dict[str, RowRule] = {}


def row_rule(name: str) -> Callable[[RowRule], RowRule]:
    """Register a rule type: ``(rule, schema) -> Check``, or None when the rule cannot fail."""

    def add(fn: RowRule) -> RowRule:
        ROW_RULES[name] = fn
        return fn

    return add


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def field_of(rule: dict) -> str:
    if rule.get("type") == "freshness_check":
        return rule.get("timestamp_field") or rule.get("field") or "date"
    return rule.get("field") or ""


def same_prefix(value: Column, pattern: str) -> Column:
    """Match from the first character on, as a prefix."""
    return value.rlike(f"^(?:{pattern})")


@row_rule("null_check")
def _null_check(rule, schema):
    return Check(_q(rule["field"]).isNull(), None)


@row_rule("regex_match")
def _regex_match(rule, schema):
    c = _q(rule["field"])
    pattern = rule.get("pattern", "")
    try:
        re.compile(pattern)
    except re.error:
        return None
    return Check(~same_prefix(c.cast("string"), pattern), c.isNotNull())


@row_rule("range_check")
def _range_check(rule, schema):
    if not isinstance(schema[rule["field"]].dataType, T.NumericType):
        return None
    c = _q(rule["field"])
    tests = [c < rule["min"]] if rule.get("min") is not None else []
    tests += [c > rule["max"]] if rule.get("max") is not None else []
    if not tests:
        return None
    return Check(tests[0] | tests[1] if len(tests) == 2 else tests[0], c.isNotNull())


@row_rule("length_check")
def _length_check(rule, schema):
    c = _q(rule["field"])
    length = F.char_length(c.cast("string"))
    return Check(~length.between(rule.get("min_len", 0), rule.get("max_len", 9999)), c.isNotNull())


@row_rule("enum_check")
def _enum_check(rule, schema):
    allowed = rule.get("allowed_values") or []
    if not allowed:
        return None
    c = _q(rule["field"])
    return Check(~c.cast("string").isin([str(v) for v in allowed]), c.isNotNull())


@row_rule("datatype_check")
def _datatype_check(rule, schema):
    accepted = TYPE_NAMES.get(rule.get("expected_dtype", ""))
    if accepted is None or schema[rule["field"]].dataType.simpleString() in accepted:
        return None
    return Check(_q(rule["field"]).cast("string").try_cast(accepted[0]).isNull(), None)


@row_rule("freshness_check")
def _freshness_check(rule, schema):
    field = field_of(rule)
    at = rule.get("as_of")
    now = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    cutoff = now - F.make_dt_interval(mins=F.lit(rule.get("max_age_minutes", 5)))
    ts = parse_time(_q(field), schema[field].dataType)
    return Check(ts < cutoff, _q(field).isNotNull())


def resolve_rules(config: dict, table: str) -> list[dict]:
    """Rules of a table: wildcard ones, then its own, then the defaults; disabled ones left out."""
    own = config.get("table_rules", {})
    scopes = [("*", own.get("*", [])), (table, own.get(table, [])), ("defaults", config.get("defaults", []))]
    return [{**r, "applies_to": scope} for scope, rules in scopes for r in rules if r.get("enabled", True)]


def resolve_rule_rows(tables: DataFrame, rules: DataFrame) -> DataFrame:
    """The same resolution for rule and table catalogues held as DataFrames.

    ``rules(scope, position, id, enabled, ...)`` joins on its scope, so that the three
    kinds of scope are three equi-joins in one and no pair is compared needlessly.
    """
    scoped = tables.select(
        "table",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("priority"), F.lit("*").alias("scope")),
                F.struct(F.lit(1).alias("priority"), F.col("table").alias("scope")),
                F.struct(F.lit(2).alias("priority"), F.lit("defaults").alias("scope")),
            )
        ),
    )
    return scoped.join(rules.where(F.coalesce("enabled", F.lit(True))), "scope")


def _row(rule: dict, table: str, status: str, failed: int, total: int, samples=None) -> tuple:
    return (
        rule.get("id"),
        rule.get("type"),
        table,
        field_of(rule),
        rule.get("severity", "warning"),
        status,
        failed,
        total,
        samples or [],
    )


def duplicate_counts(df: DataFrame, field: str | list[str]) -> DataFrame:
    """Values held by more than one row; counted per task first, so a hot value stays cheap."""
    keys = [field] if isinstance(field, str) else field
    present = F.lit(True)
    for k in keys:
        present = present & _q(k).isNotNull()
    return df.where(present).groupBy(*[_q(k) for k in keys]).agg(F.count("*").alias("rows")).where("rows > 1")


def uniqueness(df: DataFrame, field: str | list[str]) -> DataFrame:
    """Both readings in one job: duplicated values, and rows that hold one."""
    return duplicate_counts(df, field).agg(
        F.count("*").alias("duplicated_values"), F.coalesce(F.sum("rows"), F.lit(0)).alias("duplicated_rows")
    )


def evaluate(df: DataFrame, rules: list[dict], table: str, samples: bool = False, unique_rows: bool = False) -> list[tuple]:
    """Outcome of each rule as driver rows, in rule order.

    ``unique_rows`` counts every row that holds a duplicated value instead of the values.
    """
    schema = df.schema
    names = set(df.columns)
    found: dict[int, tuple] = {}
    checks: dict[int, Check] = {}
    unique: list[int] = []
    for i, rule in enumerate(rules):
        kind, field = rule.get("type", ""), field_of(rule)
        if not field or field not in names or kind not in (*ROW_RULES, "uniqueness"):
            found[i] = _row(rule, table, "skipped", 0, 0)
        elif kind == "uniqueness":
            unique.append(i)
        else:
            try:
                check = ROW_RULES[kind](rule, schema)
                if check is not None:
                    df.select(check.fails)  # an unfit rule fails here, alone, and not the fused scan
            except (PySparkException, KeyError, TypeError, ValueError):
                found[i] = _row(rule, table, "error", 0, 0)
                continue
            if check is None:
                found[i] = _row(rule, table, "passed", 0, 0)
            else:
                checks[i] = check
    for part in chunks(list(checks), 40):
        counted = _count_checks(df, {i: checks[i] for i in part})
        for i in part:
            if i not in counted:
                found[i] = _row(rules[i], table, "error", 0, 0)
                checks.pop(i)
            else:
                failed, total = counted[i]
                found[i] = _row(rules[i], table, "failed" if failed else "passed", failed, total)
    for i, row in zip(unique, at_once([lambda f=field_of(rules[i]): _duplicates(df, f) for i in unique])):
        failed = row["r"] if unique_rows else row["v"]
        found[i] = _row(rules[i], table, "failed" if failed else "passed", failed, row["n"])
    if samples:
        failed_rules = [i for i, r in found.items() if r[5] == "failed"]
        for i, values in _samples(df, rules, checks, failed_rules).items():
            found[i] = (*found[i][:-1], values)
    return [found[i] for i in range(len(rules))]


def _duplicates(df: DataFrame, field: str) -> Row:
    """Duplicated values, rows that hold one, and all rows with a value."""
    repeated = F.col("rows") > 1
    return (
        df.where(_q(field).isNotNull())
        .groupBy(_q(field))
        .agg(F.count("*").alias("rows"))
        .agg(
            F.count_if(repeated).alias("v"),
            F.coalesce(F.sum(F.when(repeated, F.col("rows"))), F.lit(0)).alias("r"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("n"),
        )
        .first()
    )


def drop_failing(df: DataFrame, rules: list[dict], table: str) -> tuple[DataFrame, list[tuple]]:
    """Apply row rules one after another, each on the rows the ones before it left, in one scan.

    Returns the remaining rows and the outcome of every rule that removed some. Should a rule
    break on the data, the rules are applied singly and that one removes nothing.
    """
    names = set(df.columns)
    steps = []
    for rule in rules:
        if field_of(rule) in names and rule.get("type") in ROW_RULES:
            check = ROW_RULES[rule["type"]](rule, df.schema)
            if check is not None:
                steps.append((rule, check, F.coalesce(check.fails, F.lit(False))))
    if not steps:
        return df, []
    alive = F.lit(True)
    aggs = []
    for i, (_, check, fails) in enumerate(steps):
        over = alive if check.over is None else alive & check.over
        aggs += [F.count_if(alive & fails).alias(f"f{i}"), F.count_if(over).alias(f"t{i}")]
        alive = alive & ~fails
    try:
        row = df.agg(*aggs).first()
    except PySparkException:
        if len(steps) == 1:
            df.agg(F.count(F.lit(1))).first()  # the data itself must be readable
            return df, [_row(steps[0][0], table, "error", 0, 0)]
        outcomes = []
        for rule, *_ in steps:
            df, found = drop_failing(df, [rule], table)
            outcomes += found
        return df, outcomes
    outcomes = [
        _row(rule, table, "failed", row[f"f{i}"], row[f"t{i}"]) for i, (rule, *_) in enumerate(steps) if row[f"f{i}"]
    ]
    return df.where(alive), outcomes


def _count_checks(df: DataFrame, checks: dict[int, Check]) -> dict[int, tuple[int, int]]:
    """Failed and counted rows of each check in one scan. When a check breaks on the data, the
    checks are halved until it stands alone, and it is left out."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, check in checks.items():
        aggs.append(F.count_if(check.fails).alias(f"f{i}"))
        if check.over is not None:
            aggs.append(F.count_if(check.over).alias(f"t{i}"))
    try:
        row = df.agg(*aggs).first().asDict()
    except PySparkException:
        if len(checks) == 1:
            df.agg(F.count(F.lit(1))).first()  # the data itself must be readable
            return {}
        items = list(checks.items())
        middle = len(items) // 2
        return _count_checks(df, dict(items[:middle])) | _count_checks(df, dict(items[middle:]))
    return {i: (row[f"f{i}"], row.get(f"t{i}", row["rows"])) for i in checks}


def _samples(df: DataFrame, rules: list[dict], checks: dict[int, Check], failed: list[int]) -> dict[int, list]:
    """Five smallest failing values per rule: the limit is applied in every task before the shuffle."""

    def entry(i: int, value: Column, numeric: bool) -> list[Column]:
        number = value.cast("double") if numeric else F.lit(None).cast("double")
        return [F.lit(i).alias("rule"), number.alias("number"), value.cast("string").alias("value")]

    parts = []
    by_row = [i for i in failed if i in checks]
    if by_row:
        structs = [
            F.when(
                checks[i].fails,
                F.struct(*entry(i, _q(field_of(rules[i])), _is_number(df, field_of(rules[i])))),
            )
            for i in by_row
        ]
        hits = F.filter(F.array(*structs), lambda x: x.isNotNull())
        parts.append(df.select(F.inline(hits)))
    for i in failed:
        if i not in checks:
            field = field_of(rules[i])
            parts.append(duplicate_counts(df, field).select(*entry(i, _q(field), _is_number(df, field))))
    if not parts:
        return {}
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = Window.partitionBy("rule").orderBy("number", "value")
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLES).collect()
    values: dict[int, list] = {}
    for r in sorted(kept, key=lambda r: (r["rule"], r["rank"])):
        values.setdefault(r["rule"], []).append(r["value"])
    return values


def _is_number(df: DataFrame, field: str) -> bool:
    return isinstance(df.schema[field].dataType, T.NumericType)


def violations(
    spark: SparkSession, tables: dict[str, DataFrame], config: dict | list, samples: bool = False, unique_rows: bool = False
) -> DataFrame:
    """Outcome rows of all rules over all tables; ``config`` is a rule list or a scoped rule config."""
    rows = []
    for name, df in tables.items():
        rules = config if isinstance(config, list) else resolve_rules(config, name)
        if df is None:
            rows += [_row(r, name, "missing_table", 0, 0) for r in rules]
        else:
            rows += evaluate(df, rules, name, samples, unique_rows)
    return small_frame(spark, rows, VIOLATION_SCHEMA)


def _passed() -> Column:
    return F.col("status").isin("passed", "skipped")


def table_results(outcomes: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Passed and failed rules and the score of each table; a table without rules scores 0."""
    passed = F.count_if(_passed())
    result = outcomes.groupBy("table").agg(
        F.count("*").alias("total_rules"),
        passed.alias("passed"),
        F.count_if(~_passed()).alias("failed"),
        (passed / F.greatest(F.count("*"), F.lit(1)) * 100).alias("quality_score"),
        F.array_sort(F.collect_list(F.when(_passed(), F.col("rule_id")))).alias("passed_rules"),
        F.array_sort(F.collect_list(F.when(~_passed(), F.col("rule_id")))).alias("failed_rules"),
    )
    if tables is not None:
        zero = {"total_rules": 0, "passed": 0, "failed": 0, "quality_score": 0.0}
        result = tables.select("table").join(result, "table", "left").fillna(zero)
    return result


def warehouse_result(outcomes: DataFrame) -> DataFrame:
    """Totals over all tables with violation counts by severity."""
    bad = F.col("status").isin("failed", "error")

    def of(severity: str) -> Column:
        return F.count_if(bad & (F.col("severity") == severity)).alias(severity)

    passed = F.count_if(_passed())
    return outcomes.agg(
        F.count_distinct("table").alias("total_tables"),
        F.count("*").alias("total_rules"),
        passed.alias("total_passed"),
        F.count_if(~_passed()).alias("total_failed"),
        (passed / F.greatest(F.count("*"), F.lit(1)) * 100).alias("overall_score"),
        of("critical"),
        of("warning"),
        of("info"),
    )


def critical_violations(outcomes: DataFrame, n: int = 20) -> DataFrame:
    bad = F.col("status").isin("failed", "error") & (F.col("severity") == "critical")
    return outcomes.where(bad).orderBy("table", "rule_id", "field").limit(n)


def inline_score(outcomes: DataFrame, row_count: int) -> DataFrame:
    """100 less the failed share of rows, not below 0; 100 for no rows."""
    share = F.coalesce(F.sum("failed_count"), F.lit(0)) / max(row_count, 1) * 100
    score = F.greatest(100 - share, F.lit(0.0)) if row_count else F.lit(100.0)
    bad = F.count_if(F.col("failed_count") > 0)
    return outcomes.agg(F.lit(row_count).cast("long").alias("total_rows"), bad.alias("violations"), score.alias("quality_score"))


def failing_rows(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows with the ids of the row rules they break; a lazy projection without any shuffle."""
    names = set(df.columns)
    marks = []
    for rule in rules:
        field = field_of(rule)
        if field in names and rule.get("type") in ROW_RULES:
            check = ROW_RULES[rule["type"]](rule, df.schema)
            if check is not None:
                marks.append(F.when(check.fails, F.lit(rule.get("id"))))
    broken = F.filter(F.array(*marks), lambda x: x.isNotNull()) if marks else F.array().cast("array<string>")
    return df.withColumn("broken_rules", broken)
