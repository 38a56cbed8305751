"""Functions of table and column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_LENGTH = 50


def clean_name(c: Column) -> Column:
    """Lower case, anything but letters, digits and ``_`` becomes ``_``, cut to 50 characters."""
    return F.substring(F.regexp_replace(F.lower(c), r"(?U)[^\w]", "_"), 1, NAME_LENGTH)


def clean_name_text(name: str) -> str:
    """The same rule for a name held by the driver."""
    return re.sub(r"[^\w]", "_", name.lower())[:NAME_LENGTH]


def node_id(table: Column, column: Column) -> Column:
    """``table.column``, or the table alone when there is no column."""
    return F.concat_ws(".", table, column)


# Name parts of sensitive columns, one list per kind.
SENSITIVE_NAMES = {
    "email": ["email", "mail", "e_mail"],
    "phone": ["phone", "mobile", "tel", "telephone", "手机"],
    "id_card": ["id_card", "idcard", "identity_card", "身份证"],
    "bank_account": ["bank_account", "bank_no", "银行卡", "bankaccount"],
    "name": ["name", "username", "user_name", "姓名", "customer_name"],
    "address": ["address", "home_address", "地址", "收货地址"],
    "credit_card": ["credit_card", "cc_no", "card_no", "信用卡"],
}


def sensitive_kinds(column: Column) -> Column:
    """All kinds whose words begin the column name, in the order of the table above."""
    hits = [
        F.when(F.lower(column).rlike("^(?:" + "|".join(words) + ")"), F.lit(kind))
        for kind, words in SENSITIVE_NAMES.items()
    ]
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


def matches_field(pattern: str, column: str) -> bool:
    """A rule field names a column when equal to it or a regex prefix of it, ignoring case."""
    if pattern.lower() == column.lower():
        return True
    try:
        return re.match(pattern, column, re.IGNORECASE) is not None
    except re.error:
        return False


def matching_columns(patterns: list[str], columns: list[str]) -> list[str]:
    """Columns named by any of the patterns, each once and in table order."""
    return [c for c in columns if any(matches_field(p, c) for p in patterns)]


# Name parts that tie a column to a job.
JOB_WORDS = [
    ("ETL_RevenueAggregation", ["amount", "price", "total", "revenue"]),
    ("ETL_TimeDimensionJoin", ["date", "time", "created", "updated"]),
    ("ETL_JoinMasterData", ["id", "_key"]),
    ("ETL_StatusFilter", ["status", "type"]),
]


def jobs_of_node(node: Column) -> Column:
    """Jobs a ``table.column`` node feeds, by the words in the column name."""
    column = F.lower(F.split_part(node, F.lit("."), F.lit(2)))
    hits = [F.when(column.rlike("|".join(words)), F.lit(job)) for job, words in JOB_WORDS]
    found = F.filter(F.array(*hits), lambda j: j.isNotNull())
    general = F.concat(F.lit("ETL_GeneralTransform_"), F.upper(F.split_part(node, F.lit("."), F.lit(1))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(general))
