"""Masks, grades, names, parsing and other scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import grading as G
from plumbline.functions import masking as M
from plumbline.functions import names as N
from plumbline.functions import parsing as X
from plumbline.operators.drift import snapshot
from plumbline.operators.overlap import candidate_pairs
from plumbline.operators.profile import column_statistics
from plumbline.sources.tables import catalogue, ddl_rows
from plumbline.workloads.registry import COLUMNS, query, table, tables, view, with_views

CONTACTS = "contacts"
SPACE = "' ' || chr(9) || chr(10) || chr(13)"


def mask_query(key: str, column: str, mask, sql: str) -> None:
    @query(key, with_views(CONTACTS, f"SELECT id, CASE WHEN {column} IS NOT NULL THEN {sql.format(c=column)} END AS masked FROM {CONTACTS}"))
    def run(spark, sf):
        return view(spark, sf, CONTACTS).select("id", mask(F.col(column)).alias("masked"))


LAST4 = "CASE WHEN length(trim({{c}}, {s})) >= 4 THEN '****' || right(trim({{c}}, {s}), 4) ELSE '****' END".format(s=SPACE)
mask_query(
    "sf01_mask_email",
    "email",
    M.mask_email,
    "CASE WHEN contains({c}, '@') THEN CASE WHEN length(split_part({c}, '@', 1)) <= 1 THEN '****' "
    "WHEN length(split_part({c}, '@', 1)) <= 4 THEN {c}[1] || '***' ELSE {c}[1] || '****' END || '@' || split_part({c}, '@', 2) ELSE '****' END",
)
mask_query(
    "sf02_mask_email_preset",
    "email",
    M.mask_email_preset,
    "CASE WHEN contains({c}, '@') THEN left(split_part({c}, '@', 1), 1) || '****' || '@' || split_part({c}, '@', 2) ELSE '****' END",
)
mask_query("sf03_mask_phone", "phone", M.mask_phone, LAST4)
mask_query(
    "sf04_mask_id_card",
    "id_card",
    M.mask_id_card,
    "CASE WHEN length(trim({c})) >= 10 THEN left(trim({c}), 3) || '********' || right(trim({c}), 4) ELSE '****' END",
)
mask_query("sf05_mask_bank_account", "bank_account", M.mask_bank_account, LAST4)
mask_query("sf06_mask_address", "home_address", M.mask_address, LAST4)
mask_query("sf07_mask_name", "customer_name", M.mask_name, "CASE WHEN length({c}) >= 2 THEN left({c}, 1) || '**' WHEN length({c}) = 1 THEN {c} || '*' ELSE '****' END")
mask_query(
    "sf08_mask_card",
    "card_no",
    M.mask_credit_card,
    "CASE WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) >= 10 THEN left(regexp_replace({c}, '[^0-9]', '', 'g'), 6) || '****' || right(regexp_replace({c}, '[^0-9]', '', 'g'), 4) ELSE '****' END",
)


@query(
    "sf09_grades",
    "SELECT event_id, CASE WHEN value >= 90 THEN 'A' WHEN value >= 80 THEN 'B' WHEN value >= 70 THEN 'C' WHEN value >= 60 THEN 'D' ELSE 'F' END AS letter, "
    "CASE WHEN value >= 90 THEN 'excellent' WHEN value >= 75 THEN 'good' WHEN value >= 60 THEN 'fair' ELSE 'poor' END AS word FROM events",
)
def sf09(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select("event_id", G.letter_grade(v).alias("letter"), G.word_grade(v).alias("word"))


@query(
    "sf10_clean_name",
    "SELECT p_partkey, substr(regexp_replace(lower(p_brand || ' ' || p_name || '-' || p_type), '[^a-z0-9_]', '_', 'g'), 1, 50) AS name FROM part",
)
def sf10(spark, sf):
    raw = F.concat("p_brand", F.lit(" "), "p_name", F.lit("-"), "p_type")
    return table(spark, sf, "part").select("p_partkey", N.clean_name(raw).alias("name"))


SPARK_TYPES = {
    "orders": ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"],
    "customer": ["bigint", "string", "int", "double", "string"],
    "region": ["int", "string"],
}


def _ddl(t: str) -> str:
    return f"CREATE TABLE {t} (" + ", ".join(f"{c} {d}" for c, d in zip(COLUMNS[t], SPARK_TYPES[t])) + ")"


@query(
    "sf11_ddl_hash",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", md5('{_ddl(t)}') AS ddl_hash, count(*) AS row_count FROM {t}" for t in SPARK_TYPES
    ),
)
def sf11(spark, sf):
    return snapshot(spark, tables(spark, sf, *SPARK_TYPES), "now").select("table", "ddl_hash", "row_count").distinct()


@query(
    "io17_ddl_text",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", {len(SPARK_TYPES[t])}::INTEGER AS columns, '{_ddl(t)}' AS ddl, count(*) AS row_count FROM {t}" for t in SPARK_TYPES
    ),
)
def io17(spark, sf):
    found = tables(spark, sf, *SPARK_TYPES)
    counts = snapshot(spark, found, "now").select("table", "row_count").distinct()
    return ddl_rows(catalogue(spark, found)).drop("ddl_hash").join(counts, "table")


@query(
    "sf12_iso_date",
    with_views(CONTACTS, f"SELECT id, regexp_matches(birth_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AS valid FROM {CONTACTS}"),
)
def sf12(spark, sf):
    return view(spark, sf, CONTACTS).select("id", X.is_iso_date(F.col("birth_date")).alias("valid"))


@query("sf13_parse_integer", with_views(CONTACTS, f"SELECT id, TRY_CAST(trim(quantity) AS BIGINT) AS parsed FROM {CONTACTS}"))
def sf13(spark, sf):
    return view(spark, sf, CONTACTS).select("id", X.parse_integer(F.col("quantity")).alias("parsed"))


@query(
    "sf14_equal_width_bin",
    "SELECT event_id, CAST(floor((value - lo) / (hi - lo) * 9) AS INTEGER) AS bin FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events)",
)
def sf14(spark, sf):
    df = table(spark, sf, "events")
    lo, hi = df.agg(F.min("value"), F.max("value")).first()
    return df.select("event_id", X.equal_width_bin(F.col("value"), F.lit(lo), F.lit(hi), 10).alias("bin"))


def number_sql(c: str) -> str:
    return f"coalesce(TRY_CAST({c} AS DOUBLE), (('0x' || substr(md5({c}), 1, 8))::BIGINT % 10000)::DOUBLE)"


@query(
    "sf15_as_number",
    with_views("text_orders", f"SELECT o_orderkey, {number_sql('mixed_text')} AS mixed, {number_sql('o_orderstatus')} AS status FROM text_orders"),
)
def sf15(spark, sf):
    df = view(spark, sf, "text_orders")
    text = df.schema["mixed_text"].dataType
    return df.select(
        "o_orderkey", X.as_number(F.col("mixed_text"), text).alias("mixed"), X.as_number(F.col("o_orderstatus"), text).alias("status")
    )


@query(
    "sf16_breaking_types",
    "WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'double' WHEN 1 THEN 'float' WHEN 2 THEN 'bigint' ELSE 'varchar(10)' END AS a, "
    "CASE o_custkey % 4 WHEN 0 THEN 'double' WHEN 1 THEN 'float' WHEN 2 THEN 'int' ELSE 'string' END AS b FROM orders) "
    "SELECT a AS old_type, b AS new_type, (a = 'double' AND b <> 'double') OR (a = 'float' AND b IN ('int', 'string')) OR (a = 'bigint' AND b = 'string') AS breaking, "
    "count(*) AS changes FROM t GROUP BY 1, 2, 3",
)
def sf16(spark, sf):
    def pick(c, names):
        steps = F
        for i, n in enumerate(names[:-1]):
            steps = steps.when(F.col(c) % 4 == i, n)
        return steps.otherwise(names[-1])

    df = table(spark, sf, "orders").select(
        pick("o_orderkey", ["double", "float", "bigint", "varchar(10)"]).alias("old_type"),
        pick("o_custkey", ["double", "float", "int", "string"]).alias("new_type"),
    )
    flag = G.is_breaking_type_change(F.col("old_type"), F.col("new_type")).alias("breaking")
    return df.select("old_type", "new_type", flag).groupBy("old_type", "new_type", "breaking").agg(F.count("*").alias("changes"))


NODE_NAMES = (
    "concat(lower(event_type), '.', CASE event_id % 7 WHEN 0 THEN 'total_amount' WHEN 1 THEN 'null_rate' WHEN 2 THEN 'job_key' "
    "WHEN 3 THEN 'created_date' WHEN 4 THEN 'status' WHEN 5 THEN 'email' ELSE 'note' END)"
)


@query(
    "sf17_effect_type",
    f"SELECT node, CASE WHEN regexp_matches(node, 'ETL|job|transform|aggregate') THEN 'etl_failure' WHEN regexp_matches(node, 'quality|score|null|anomaly') THEN 'quality_degradation' "
    f"WHEN regexp_matches(node, 'total|sum|revenue') THEN 'metric_error' ELSE 'cascading' END AS effect_type, count(*) AS n FROM (SELECT {NODE_NAMES} AS node FROM events) GROUP BY 1, 2",
)
def sf17(spark, sf):
    df = table(spark, sf, "events").select(F.expr(NODE_NAMES).alias("node"))
    return df.select("node", G.effect_type(F.col("node")).alias("effect_type")).groupBy("node", "effect_type").agg(F.count("*").alias("n"))


OP_NAMES = "CASE event_id % 6 WHEN 0 THEN 'drop_column' WHEN 1 THEN 'truncate_table' WHEN 2 THEN 'rename_column' WHEN 3 THEN 'dtype_change' WHEN 4 THEN 'add_column' ELSE 'other' END"


@query(
    "sf18_op_multiplier",
    f"SELECT op, CASE op WHEN 'drop_column' THEN 0.95::DOUBLE WHEN 'truncate_table' THEN 0.99::DOUBLE WHEN 'rename_column' THEN 0.6::DOUBLE WHEN 'dtype_change' THEN 0.8::DOUBLE WHEN 'add_column' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS multiplier, "
    f"op IN ('drop_column', 'truncate_table', 'dtype_change') AS destructive, count(*) AS n FROM (SELECT {OP_NAMES} AS op FROM events) GROUP BY 1, 2, 3",
)
def sf18(spark, sf):
    op = F.col("op")
    df = table(spark, sf, "events").select(F.expr(OP_NAMES).alias("op"))
    return df.groupBy("op", G.op_multiplier(op).alias("multiplier"), G.is_destructive(op).alias("destructive")).agg(F.count("*").alias("n"))


COLUMN_NAMES = (
    "CASE event_id % 8 WHEN 0 THEN 'email' WHEN 1 THEN 'Mobile_No' WHEN 2 THEN 'customer_name' WHEN 3 THEN 'home_address' "
    "WHEN 4 THEN 'bank_no' WHEN 5 THEN 'id_card' WHEN 6 THEN 'card_no' ELSE 'amount' END"
)


@query(
    "sf19_sensitive_kinds",
    f"SELECT c AS \"column\", CASE WHEN lower(c) LIKE 'email%' THEN 'email' WHEN lower(c) LIKE 'mobile%' THEN 'phone' WHEN c LIKE 'customer_name%' THEN 'name' WHEN c LIKE 'home_address%' THEN 'address' "
    f"WHEN c LIKE 'bank_no%' THEN 'bank_account' WHEN c LIKE 'id_card%' THEN 'id_card' WHEN c LIKE 'card_no%' THEN 'credit_card' ELSE '' END AS kinds, count(*) AS n FROM (SELECT {COLUMN_NAMES} AS c FROM events) GROUP BY 1, 2",
)
def sf19(spark, sf):
    df = table(spark, sf, "events").select(F.expr(COLUMN_NAMES).alias("column"))
    kinds = F.array_join(N.sensitive_kinds(F.col("column")), "|")
    return df.groupBy("column", kinds.alias("kinds")).agg(F.count("*").alias("n"))


@query(
    "sf20_op_label",
    f"SELECT event_id, concat('do(', CASE op WHEN 'drop_column' THEN concat('drop_column(', event_type, '.c', user_id, ')') WHEN 'truncate_table' THEN concat('truncate_table(', event_type, ')') "
    f"WHEN 'rename_column' THEN concat('rename_column(', event_type, '.c', user_id, ' → new)') WHEN 'dtype_change' THEN concat('dtype_change(', event_type, '.c', user_id, ' → int)') "
    f"WHEN 'add_column' THEN concat('add_column(', event_type, '.c', user_id, ':int)') ELSE op END, ')') AS label, concat(event_type, '.c', user_id) AS node FROM (SELECT *, {OP_NAMES} AS op FROM events)",
)
def sf20(spark, sf):
    column = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    df = table(spark, sf, "events").select("event_id", "event_type", column.alias("column"), F.expr(OP_NAMES).alias("op"))
    label = G.op_label(F.col("op"), F.col("event_type"), F.col("column"), F.lit("new"), F.lit("int"))
    return df.select("event_id", label.alias("label"), N.node_id(F.col("event_type"), F.col("column")).alias("node"))


@query(
    "jo08_column_jobs",
    f"SELECT node, CASE split_part(node, '.', 2) WHEN 'total_amount' THEN 'ETL_RevenueAggregation' WHEN 'job_key' THEN 'ETL_JoinMasterData' WHEN 'created_date' THEN 'ETL_TimeDimensionJoin' "
    f"WHEN 'status' THEN 'ETL_StatusFilter' ELSE 'ETL_GeneralTransform_' || upper(split_part(node, '.', 1)) END AS jobs, count(*) AS n FROM (SELECT {NODE_NAMES} AS node FROM events) GROUP BY 1, 2",
)
def jo08(spark, sf):
    df = table(spark, sf, "events").select(F.expr(NODE_NAMES).alias("node"))
    return df.groupBy("node", F.array_join(N.jobs_of_node(F.col("node")), "|").alias("jobs")).agg(F.count("*").alias("n"))


PAIRED = ["region", "nation", "supplier"]


@query(
    "jo05_candidate_pairs",
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count({c}) AS n FROM {t}" for t in PAIRED for c in COLUMNS[t])
    + ") SELECT a.t || '.' || a.c AS source, b.t || '.' || b.c AS target, a.n + b.n AS present FROM c a JOIN c b ON (a.t, a.c) < (b.t, b.c)",
)
def jo05(spark, sf):
    found = tables(spark, sf, *PAIRED)
    columns = catalogue(spark, found)
    pairs = candidate_pairs(columns)
    stats = column_statistics(spark, found).select(F.concat_ws(".", "table", "column").alias("node"), "count")
    counted = pairs.join(stats.toDF("source", "a"), "source").join(stats.toDF("target", "b"), "target")
    return counted.select("source", "target", (F.col("a") + F.col("b")).alias("present"))
