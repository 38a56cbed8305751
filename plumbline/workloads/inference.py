"""Edges between columns: shared values, correlation, chi-square."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import association as A
from plumbline.operators import infer as I
from plumbline.operators import overlap as O
from plumbline.session import small_frame
from plumbline.sources.tables import catalogue
from plumbline.workloads.functions import number_sql
from plumbline.workloads.registry import query, rounded, table, tables, with_views

# ---- shared values of key columns

KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey", "n_regionkey"],
    "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
}


def _keys(spark, sf):
    return {t: table(spark, sf, t).select(*cs) for t, cs in KEYS.items()}


def overlap_sql(columns: dict[str, list[str]], text: set[str] = frozenset()) -> str:
    """View ``ov`` of pairs with shared values, as ``source, target, shared, na, nb, overlap, jaccard``."""
    parts, i = [], 0
    for t, cs in columns.items():
        for c in cs:
            kind = "t" if c in text else "n"
            value = f"cast({c} AS string)" if c in text else f"cast({c}::DOUBLE AS string)"
            parts.append(f"SELECT DISTINCT {i} AS i, '{t}' AS t, '{t}.{c}' AS node, '{kind}' || {value} AS v FROM {t} WHERE {c} IS NOT NULL")
            i += 1
    return (
        "vals AS MATERIALIZED (" + " UNION ALL ".join(parts) + "), sizes AS (SELECT i, count(*) AS n FROM vals GROUP BY i), "
        "ov AS (SELECT a.node AS source, b.node AS target, count(*) AS shared, any_value(x.n) AS na, any_value(y.n) AS nb, "
        "count(*) / least(any_value(x.n), any_value(y.n))::DOUBLE AS overlap, count(*) / (any_value(x.n) + any_value(y.n) - count(*))::DOUBLE AS jaccard "
        "FROM vals a JOIN vals b ON a.v = b.v AND a.i < b.i AND a.t <> b.t JOIN sizes x ON x.i = a.i JOIN sizes y ON y.i = b.i GROUP BY 1, 2)"
    )


@query(
    "jo04_overlap",
    with_views("", overlap_sql(KEYS) + " SELECT source, target, shared, na AS source_distinct, nb AS target_distinct FROM ov"),
)
def jo04(spark, sf):
    return O.overlaps(spark, _keys(spark, sf)).drop("overlap", "jaccard")


@query("se04_jaccard", with_views("", overlap_sql(KEYS) + " SELECT source, target, round(jaccard, 6) AS jaccard FROM ov"))
def se04(spark, sf):
    return rounded(O.overlaps(spark, _keys(spark, sf)).select("source", "target", "jaccard"), 6)


@query("se05_overlap_ratio", with_views("", overlap_sql(KEYS) + " SELECT source, target, round(overlap, 6) AS overlap FROM ov"))
def se05(spark, sf):
    return rounded(O.overlaps(spark, _keys(spark, sf)).select("source", "target", "overlap"), 6)


def ratio_sql(columns: dict[str, list[str]]) -> str:
    return (
        "ratios AS ("
        + " UNION ALL ".join(
            f"SELECT '{t}.{c}' AS node, count(DISTINCT {c}) / count({c})::DOUBLE AS r FROM {t}" for t, cs in columns.items() for c in cs
        )
        + ")"
    )


FK = """
fk AS (SELECT CASE WHEN x.r < y.r THEN source ELSE target END AS source, CASE WHEN x.r < y.r THEN target ELSE source END AS target,
  'foreign_key' AS mechanism, least(1.0, overlap) AS strength, least(0.99, 0.75 + 0.2 * overlap + 0.1 * abs(x.r - y.r)) AS confidence
  FROM ov JOIN ratios x ON x.node = source JOIN ratios y ON y.node = target WHERE overlap >= 0.6 AND x.r <> y.r)
"""
EDGE = "source, target, mechanism, round(strength, 4) AS strength, round(confidence, 4) AS confidence"


def _edges(df):
    return rounded(df.select("source", "target", "mechanism", "strength", "confidence"))


@query("in03_fk", with_views("", overlap_sql(KEYS) + "," + ratio_sql(KEYS) + "," + FK + f"SELECT {EDGE} FROM fk"))
def in03(spark, sf):
    return _edges(I.foreign_keys(spark, _keys(spark, sf)))


@query(
    "in09_relationships",
    " UNION ALL ".join(
        f"SELECT '{a}.{x}' AS source, '{b}.{y}' AS target, count(*) AS shared_values, sum(na * nb)::BIGINT AS join_rows, "
        "CASE WHEN max(na) > 1 AND max(nb) > 1 THEN 'many-to-many' WHEN max(na) > 1 THEN 'many-to-one' WHEN max(nb) > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS relationship "
        f"FROM (SELECT {x} AS v, count(*) AS na FROM {a} GROUP BY 1) JOIN (SELECT {y} AS v, count(*) AS nb FROM {b} GROUP BY 1) USING (v)"
        for a, x, b, y in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "supplier", "s_nationkey")]
    ),
)
def in09(spark, sf):
    parts = None
    for a, x, b, y in [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "supplier", "s_nationkey")]:
        found = O.relationships(table(spark, sf, a), x, table(spark, sf, b), y)
        row = found.select(F.lit(f"{a}.{x}").alias("source"), F.lit(f"{b}.{y}").alias("target"), "*")
        parts = row if parts is None else parts.unionByName(row)
    return parts


def name_pairs_sql(columns: dict[str, list[str]]) -> str:
    rows = ", ".join(f"('{t}', '{c}')" for t, cs in columns.items() for c in cs)
    return f"cols AS (SELECT * FROM (VALUES {rows}) v(t, c))"


NAMED = {
    "sales": ["order_id", "customer_id", "product_key", "amount"],
    "customers": ["customer_id", "customer_name"],
    "products": ["product_key", "product_name", "price"],
}
NAMED_SELECT = {
    "sales": ("orders", ["o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderkey % 100 AS product_key", "o_totalprice AS amount"]),
    "customers": ("customer", ["c_custkey AS customer_id", "c_name AS customer_name"]),
    "products": ("part", ["p_partkey AS product_key", "p_name AS product_name", "p_retailprice AS price"]),
}


@query(
    "jo07_name_keys",
    with_views(
        "",
        name_pairs_sql(NAMED)
        + ", e AS (SELECT a.t || '.' || a.c AS source, b.t || '.' || b.c AS target, a.t AS st, 1.0::DOUBLE AS strength, 0.8::DOUBLE AS confidence FROM cols a JOIN cols b "
        "ON a.t <> b.t AND regexp_replace(a.c, '_id|_key', '') || '_name' = b.c WHERE regexp_matches(a.c, '(_id|_key)$') "
        "UNION ALL SELECT a.t || '.' || a.c, b.t || '.' || b.c, a.t, 0.9::DOUBLE, 0.7::DOUBLE FROM cols a JOIN cols b ON a.t <> b.t AND a.c = b.c WHERE regexp_matches(a.c, '(_id|_key)$')), "
        "n AS (SELECT 'sales' AS st, count(*) AS row_count FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'products', count(*) FROM part) "
        "SELECT source, target, strength, confidence, row_count FROM e JOIN n USING (st)",
    ),
)
def jo07(spark, sf):
    found = {t: table(spark, sf, base).selectExpr(*select) for t, (base, select) in NAMED_SELECT.items()}
    edges = I.name_keys(catalogue(spark, found)).withColumn("st", F.split_part("source", F.lit("."), F.lit(1)))
    counts = None
    for t, df in found.items():
        n = df.agg(F.count("*").alias("row_count")).withColumn("st", F.lit(t))
        counts = n if counts is None else counts.unionByName(n)
    return edges.join(counts, "st").select("source", "target", "strength", "confidence", "row_count")


# ---- correlation and chi-square

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "one"]


def corr_sql(a: str, b: str, source: str) -> str:
    return (
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, CASE WHEN coalesce(stddev_pop(a) * stddev_pop(b), 0) = 0 THEN 0.0 ELSE covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS r "
        f"FROM (SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM {source}) WHERE a IS NOT NULL AND b IS NOT NULL"
    )


@query(
    "in01_pearson",
    "SELECT x, y, n, round(r, 6) AS r FROM ("
    + " UNION ALL ".join(corr_sql(a, b, "(SELECT *, 1 AS one FROM lineitem)") for a, b in combinations(MEASURES, 2))
    + ")",
)
def in01(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("one", F.lit(1))
    found = A.correlations(df, {c: F.col(c).cast("double") for c in MEASURES}, A.all_pairs(MEASURES))
    rows = [(x, y, n, r) for (x, y), (r, n) in found.items()]
    return rounded(small_frame(spark, rows, "x string, y string, n long, r double"), 6)


def chi_sql(a: str, b: str, va: str, vb: str, source: str) -> str:
    """One row of the pair: n, chi2 over n, p."""
    return (
        f"(WITH v AS (SELECT {va} AS a, {vb} AS b FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), "
        "m AS (SELECT min(least(a, b)) AS lo, max(greatest(a, b)) AS hi, count(*) AS n FROM v), "
        "c AS (SELECT floor((a - lo) / (hi - lo) * 9) AS p, floor((b - lo) / (hi - lo) * 9) AS q, count(*) AS o FROM v, m GROUP BY 1, 2), "
        "e AS (SELECT o, sum(o) OVER (PARTITION BY p) * sum(o) OVER (PARTITION BY q) / (sum(o) OVER ())::DOUBLE AS x FROM c), "
        "s AS (SELECT sum((o - x) * (o - x) / x) AS stat FROM e) "
        f"SELECT '{a}' AS x, '{b}' AS y, n, stat / n AS chi2, CASE WHEN stat > 0 THEN exp(-stat / 2) ELSE 1.0 END AS p FROM s, m)"
    )


CHI_COLUMNS = {"l_quantity": "num", "l_linenumber": "num", "l_returnflag": "text", "l_linestatus": "text"}


def _value(c: str, kind: str) -> str:
    return f"{c}::DOUBLE" if kind == "num" else number_sql(c)


@query(
    "in02_chi2",
    "SELECT x, y, n, round(chi2, 6) AS chi2, round(p, 6) AS p_value FROM ("
    + " UNION ALL ".join(
        "SELECT * FROM " + chi_sql(a, b, _value(a, CHI_COLUMNS[a]), _value(b, CHI_COLUMNS[b]), "lineitem") for a, b in combinations(CHI_COLUMNS, 2)
    )
    + ")",
)
def in02(spark, sf):
    return rounded(A.chi_squares(table(spark, sf, "lineitem"), list(CHI_COLUMNS)), 6)


# ---- all mechanisms over two linked tables

LINKED = {
    "linked": {"o_orderkey": "num", "o_custkey": "num", "o_batch": "num", "price": "num", "net": "num", "status": "text", "status_code": "text"},
    "buyers": {"buyer_id": "num", "acctbal": "num"},
}
LINKED_COLUMNS = {t: list(cs) for t, cs in LINKED.items()}
LINKED_TEXT = {c for cs in LINKED.values() for c, k in cs.items() if k == "text"}


def transform_sql() -> str:
    parts = []
    for t, cs in LINKED.items():
        for a, b in combinations([c for c, k in cs.items() if k == "num"], 2):
            parts.append(
                f"SELECT '{t}' AS t, c.*, (SELECT stddev_pop({a}) FROM {t}) AS sa, (SELECT stddev_pop({b}) FROM {t}) AS sb FROM ({corr_sql(a, b, t)}) c"
            )
    return (
        "pairs AS (" + " UNION ALL ".join(parts) + "), "
        "tr AS (SELECT t || '.' || CASE WHEN sa < sb THEN x ELSE y END AS source, t || '.' || CASE WHEN sa < sb THEN y ELSE x END AS target, "
        "'etl_transform' AS mechanism, abs(r) AS strength, least(0.95, 0.75 + 0.15 * abs(r)) AS confidence FROM pairs WHERE n >= 5 AND abs(r) >= 0.7)"
    )


def dependency_sql() -> str:
    parts = [
        f"SELECT '{t}' AS t, d.* FROM {chi_sql(a, b, _value(a, cs[a]), _value(b, cs[b]), t)} d"
        for t, cs in LINKED.items()
        for a, b in combinations(cs, 2)
    ]
    return (
        "chis AS (" + " UNION ALL ".join(parts) + "), "
        "dep AS (SELECT t || '.' || x AS source, t || '.' || y AS target, 'schema_dependency' AS mechanism, least(1.0, chi2) AS strength, "
        "least(0.90, 0.75 + (1 - p) * 0.15) AS confidence FROM chis WHERE n >= 10 AND chi2 >= 0.4)"
    )


def quality_sql() -> str:
    parts = []
    for t, cs in LINKED.items():
        for a, b in combinations(cs, 2):
            flags = f"(SELECT CASE WHEN {a} IS NULL THEN 1 ELSE 0 END AS f_{a}, CASE WHEN {b} IS NULL THEN 1 ELSE 0 END AS f_{b} FROM {t})"
            parts.append(
                f"SELECT '{t}' AS t, '{a}' AS x, '{b}' AS y, r, (SELECT avg(f_{a}) FROM {flags}) AS ma, (SELECT avg(f_{b}) FROM {flags}) AS mb FROM ({corr_sql(f'f_{a}', f'f_{b}', flags)})"
            )
    return (
        "marks AS (" + " UNION ALL ".join(parts) + "), "
        "qp AS (SELECT t || '.' || x AS source, t || '.' || y AS target, 'quality_propagation' AS mechanism, r AS strength, least(0.85, 0.75 + 0.1 * r) AS confidence "
        "FROM marks WHERE r >= 0.5 AND (ma > 0.1 OR mb > 0.1))"
    )


def cascade_sql() -> str:
    """The first unique column of each table against its nearly unique numbers."""
    parts = []
    for t, key, cs in (("linked", "o_orderkey", ["o_custkey", "o_batch", "price", "net"]), ("buyers", "buyer_id", ["acctbal"])):
        for c in cs:
            parts.append(
                f"SELECT '{t}' AS t, r.*, (SELECT count(DISTINCT {c}) / count({c})::DOUBLE FROM {t}) AS u FROM ({corr_sql(key, c, t)}) r"
            )
    return (
        "keyed AS (" + " UNION ALL ".join(parts) + "), "
        "ca AS (SELECT t || '.' || x AS source, t || '.' || y AS target, 'cascading_failure' AS mechanism, abs(r) * 0.7 AS strength, least(0.80, 0.75 + abs(r) * 0.05) AS confidence "
        "FROM keyed WHERE n >= 10 AND abs(r) > 0.5 AND u > 0.5 AND u <= 0.99)"
    )


LINKED_VIEWS = "linked buyers"
LINKED_FK = overlap_sql(LINKED_COLUMNS, LINKED_TEXT) + "," + ratio_sql(LINKED_COLUMNS) + "," + FK
ALL_EDGES = ", ".join([LINKED_FK, transform_sql(), dependency_sql(), quality_sql(), cascade_sql()]) + (
    ", edges AS (SELECT * FROM fk UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM dep UNION ALL SELECT * FROM qp UNION ALL SELECT * FROM ca) "
)


def linked(spark, sf):
    return tables(spark, sf, "linked", "buyers")


def edge_query(key, operator, views_sql, name):
    @query(key, with_views(LINKED_VIEWS, views_sql + f" SELECT {EDGE} FROM {name}"))
    def run(spark, sf):
        return _edges(operator(spark, linked(spark, sf)))


edge_query("in04_transform", I.transforms, transform_sql(), "tr")
edge_query("in05_dependency", I.dependencies, dependency_sql(), "dep")
edge_query("in06_quality", I.quality_propagation, quality_sql(), "qp")
edge_query("in07_cascade", I.cascades, cascade_sql(), "ca")
edge_query("in08_all_edges", I.infer_edges, ALL_EDGES, "edges")

