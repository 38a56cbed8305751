"""Registered queries, each with the SQL that must give the same rows.

The given tables hold hardly any dirt, so most queries work on views that derive some
by expressions valid in both engines. Every view keeps all rows of its table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]

#: Derived views: base table and select list.
VIEWS: dict[str, tuple[str, list[str]]] = {
    "dirty_orders": (
        "orders",
        [
            "o_orderkey",
            "CASE WHEN o_orderkey % 19 = 0 THEN -1 - o_custkey ELSE o_custkey END AS o_custkey",
            "CASE WHEN o_orderkey % 13 = 0 THEN concat('  ', o_orderstatus, chr(9)) ELSE o_orderstatus END AS o_orderstatus",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS o_totalprice",
            "o_orderdate",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
        ],
    ),
    "dirty_events": (
        "events",
        [
            "event_id",
            "ts",
            "user_id",
            "event_type",
            "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value",
            "props",
        ],
    ),
    "dirty_customer": (
        "customer",
        [
            "c_custkey",
            "c_name",
            "c_nationkey",
            "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal",
            "CASE WHEN c_custkey % 3 <> 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment",
        ],
    ),
    "text_orders": (
        "orders",
        [
            "o_orderkey",
            "cast(o_custkey AS string) AS cust_text",
            "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE cast(o_custkey AS string) END AS mixed_text",
            "concat(substr(cast(o_orderdate AS string), 1, 10), ' 10:00:00') AS date_text",
            "o_orderstatus",
        ],
    ),
    "linked": (
        "orders",
        [
            "o_orderkey",
            "o_custkey",
            "CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS o_batch",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
            "CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 20 = 1 THEN NULL ELSE o_totalprice * 0.9 + 5 END AS net",
            "o_orderstatus AS status",
            "lower(o_orderstatus) AS status_code",
        ],
    ),
    "buyers": ("customer", ["c_custkey AS buyer_id", "c_acctbal AS acctbal"]),
    "contacts": (
        "customer",
        [
            "c_custkey AS id",
            "c_name AS customer_name",
            "CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN concat('bad', c_custkey) "
            "WHEN c_custkey % 10 = 1 THEN 'a@ex.com' WHEN c_custkey % 10 = 2 THEN 'abc@ex.com' "
            "ELSE concat('user', c_custkey, '@ex', c_nationkey, '.com') END AS email",
            "CASE WHEN c_custkey % 12 = 0 THEN '12' ELSE concat('13', lpad(cast(c_custkey AS string), 9, '0')) END AS phone",
            "concat('110101', lpad(cast(c_custkey AS string), 12, '0')) AS id_card",
            "CASE WHEN c_custkey % 14 = 0 THEN concat(' 99', chr(9)) ELSE concat('6222', lpad(cast(c_custkey AS string), 15, '0')) END AS bank_account",
            "concat('No. ', c_custkey, ' ', c_mktsegment, ' Road') AS home_address",
            "concat('4111-', lpad(cast(c_custkey AS string), 4, '0'), '-2222 3333') AS card_no",
            "CASE WHEN c_custkey % 4 = 0 THEN '1990/01/02' ELSE '1990-01-02' END AS birth_date",
            "CASE WHEN c_custkey % 3 = 0 THEN '2024-01-01 00:00:00' ELSE '2030-01-01 00:00:00' END AS updated_at",
            "CASE WHEN c_custkey % 6 = 0 THEN 'x1' ELSE cast(c_custkey AS string) END AS quantity",
        ],
    ),
}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, select = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*select)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) if n in VIEWS else table(spark, sf_dir, n) for n in names}


def with_views(names: str, body: str) -> str:
    """SQL with the named views in front; the body may start with further views."""
    parts = []
    for n in names.split():
        base, select = VIEWS[n]
        parts.append(f"{n} AS (SELECT {', '.join(select)} FROM {base})")
    body = body.strip()
    if not parts:
        return body if body.upper().startswith("SELECT") else f"WITH {body}"
    joint = " " if body.upper().startswith("SELECT") else ", "
    return "WITH " + ", ".join(parts) + joint + body


def joined(column: str, sep: str = "|"):
    """A list as text, so that results compare alike in any client."""
    return F.array_join(column, sep).alias(column)


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """All doubles rounded: sums in another order differ in the last digits."""
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )


# ---- SQL parts used by several queries

COLUMNS = {
    "dirty_orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "dirty_events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "dirty_customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
}
NUMERIC = {
    "o_orderkey", "o_custkey", "o_totalprice", "event_id", "user_id", "value", "c_custkey", "c_nationkey",
    "c_acctbal", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "p_partkey", "p_size", "p_retailprice", "s_suppkey", "s_nationkey", "s_acctbal",
    "n_nationkey", "n_regionkey", "r_regionkey",
}


def spread_sql(name: str, c: str, k: float = 1.5) -> str:
    """Quartiles ``a``, ``b`` of a column with its fences ``lo``, ``hi``, as one row."""
    return (
        f"(SELECT a, m, b, a - {k} * (b - a) AS lo, b + {k} * (b - a) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS a, "
        f"quantile_cont({c}::DOUBLE, 0.5) AS m, quantile_cont({c}::DOUBLE, 0.75) AS b FROM {name}))"
    )


def profile_sql(*names: str, min_values: int = 0, columns: dict[str, list[str]] | None = None) -> str:
    """A view ``prof`` with the profile of every column of the named views."""
    parts = []
    for n in names:
        for c in (columns or COLUMNS)[n]:
            head = (
                f"SELECT '{n}' AS \"table\", '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, "
                f"CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) - count({c})) / count(*)::DOUBLE END AS null_pct, "
                f"count(DISTINCT {c}) AS distinct_count, count(DISTINCT {c}) / count(*)::DOUBLE AS distinct_pct, "
            )
            if c in NUMERIC:
                beyond = f"count(*) FILTER (WHERE NOT ({c}::DOUBLE BETWEEN lo AND hi))"
                beyond = f"(CASE WHEN count({c}) > {min_values} THEN {beyond} ELSE 0 END)"
                parts.append(
                    head
                    + f"avg({c}::DOUBLE) AS mean, stddev_samp({c}::DOUBLE) AS std, any_value(a) AS q25, any_value(b) AS q75, "
                    f"{beyond} AS outlier_count, {beyond} / count(*)::DOUBLE AS outlier_pct FROM {n}, {spread_sql(n, c)}"
                )
            else:
                parts.append(
                    head
                    + "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS q25, NULL::DOUBLE AS q75, "
                    f"0::BIGINT AS outlier_count, 0.0::DOUBLE AS outlier_pct FROM {n}"
                )
    return "prof AS (" + " UNION ALL ".join(parts) + ")"
