"""Grades and fixed weight tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of each grade.
LETTER_BOUNDS = [(90, "A"), (80, "B"), (70, "C"), (60, "D")]
WORD_BOUNDS = [(90, "excellent"), (75, "good"), (60, "fair")]
BADGE_BOUNDS = [(90, "green"), (70, "yellow")]


def _ladder(score: Column, bounds: list[tuple[int, str]], last: str) -> Column:
    steps = F
    for low, name in bounds:
        steps = steps.when(score >= low, name)
    return steps.otherwise(last)


def letter_grade(score: Column) -> Column:
    return _ladder(score, LETTER_BOUNDS, "F")


def word_grade(score: Column) -> Column:
    return _ladder(score, WORD_BOUNDS, "poor")


def badge(score: Column) -> Column:
    return _ladder(score, BADGE_BOUNDS, "red")


# How strongly each kind of change carries over an edge path.
OP_MULTIPLIERS = {
    "drop_column": 0.95,
    "truncate_table": 0.99,
    "rename_column": 0.6,
    "dtype_change": 0.8,
    "add_column": 0.1,
}
OTHER_OP_MULTIPLIER = 0.5
DESTRUCTIVE_OPS = ["drop_column", "truncate_table", "dtype_change"]


def op_multiplier(op_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in OP_MULTIPLIERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, op_type), F.lit(OTHER_OP_MULTIPLIER))


def is_destructive(op_type: Column) -> Column:
    return op_type.isin(DESTRUCTIVE_OPS)


def op_label(op_type: Column, table: Column, column: Column, new_name: Column, new_dtype: Column) -> Column:
    """Readable form of a change, such as ``do(drop_column(t.c))``."""
    node = F.concat_ws(".", table, column)
    inner = (
        F.when(op_type == "drop_column", node)
        .when(op_type == "rename_column", F.concat(node, F.lit(" → "), new_name))
        .when(op_type == "dtype_change", F.concat(node, F.lit(" → "), new_dtype))
        .when(op_type == "add_column", F.concat(node, F.lit(":"), new_dtype))
        .when(op_type == "truncate_table", table)
    )
    call = F.when(inner.isNotNull(), F.concat(op_type, F.lit("("), inner, F.lit(")"))).otherwise(op_type)
    return F.concat(F.lit("do("), call, F.lit(")"))


# Name parts that decide the kind of an effect, first match wins.
EFFECT_WORDS = [
    ("etl_failure", "ETL|job|transform|aggregate"),
    ("quality_degradation", "quality|score|null|anomaly"),
    ("metric_error", "total|sum|revenue"),
]


def effect_type(node: Column) -> Column:
    steps = F
    for kind, words in EFFECT_WORDS:
        steps = steps.when(node.rlike(words), kind)
    return steps.otherwise("cascading")


# Types a column type may not narrow to without risk of loss.
NARROWING = {
    "DOUBLE": ["REAL", "INTEGER", "TEXT"],
    "REAL": ["INTEGER", "TEXT"],
    "INTEGER": ["TEXT"],
    "TEXT": [],
}
# Spark type names on the left, the names above on the right.
WAREHOUSE_TYPES = {
    "double": "DOUBLE",
    "decimal": "DOUBLE",
    "float": "REAL",
    "real": "REAL",
    "bigint": "INTEGER",
    "int": "INTEGER",
    "smallint": "INTEGER",
    "tinyint": "INTEGER",
    "integer": "INTEGER",
    "string": "TEXT",
    "varchar": "TEXT",
    "char": "TEXT",
    "text": "TEXT",
}


def is_breaking_type_change(old: Column, new: Column) -> Column:
    """True when values of ``old`` may be lost in ``new``; a size suffix such as ``(10)`` is ignored."""

    def family(c: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in WAREHOUSE_TYPES.items() for x in pair])
        return F.try_element_at(names, F.lower(F.split_part(c, F.lit("("), F.lit(1))))

    pairs = [f"{a}>{b}" for a, lost in NARROWING.items() for b in lost]
    return F.coalesce(F.concat_ws(">", family(old), family(new)).isin(pairs), F.lit(False))
