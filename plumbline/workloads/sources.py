"""Files, tables and payloads."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.plans import cleaning_jobs as J
from plumbline.session import scratch_path
from plumbline.sources import files, payloads
from plumbline.sources import tables as S
from plumbline.workloads.registry import query, table, tables, view, with_views

ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
ORDER_COLUMNS = ORDERS.split(", ")
#: Rows of a JSON array, about.
ARRAY_ROWS = 10_000


def _plain_orders(spark, sf):
    return table(spark, sf, "orders").select(*ORDER_COLUMNS)


GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query("io01_scan_files", "SELECT unnest(['" + "', '".join(GIVEN) + "']) || '.parquet' AS name, '.parquet' AS suffix")
def io01(spark, sf):
    return files.scan_files(spark, sf).where("size_kb > 0").select("name", "suffix")


@query("io02_csv", "SELECT o_orderkey::INTEGER AS o_orderkey, o_custkey::INTEGER AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def io02(spark, sf):
    path = scratch_path(spark, "orders.csv")
    _plain_orders(spark, sf).write.csv(path, header=True, timestampFormat="yyyy-MM-dd HH:mm:ss")
    return files.read_csv(spark, path)


@query("io02_csv_schema", with_views("", f"SELECT {ORDERS}, NULL::VARCHAR AS _corrupt_record FROM orders"))
def io02_schema(spark, sf):
    path = scratch_path(spark, "orders.csv")
    orders = _plain_orders(spark, sf)
    orders.write.csv(path, header=True)
    return files.read_csv(spark, path, orders.schema)


# A line break and doubled quotes within a field of every third order.
BROKEN = "CASE WHEN o_orderkey % 3 = 0 THEN concat('say \"', o_orderpriority, '\",', chr(10), 'twice') ELSE o_orderpriority END AS note"


@query("io02_csv_quoted", f"SELECT o_orderkey::INTEGER AS o_orderkey, {BROKEN} FROM orders")
def io02_quoted(spark, sf):
    path = scratch_path(spark, "quoted.csv")
    table(spark, sf, "orders").selectExpr("o_orderkey", BROKEN).write.csv(path, header=True, quote='"', escape='"')
    return files.read_csv(spark, path)


@query("io03_json", f"SELECT {ORDERS} FROM orders")
def io03(spark, sf):
    path = scratch_path(spark, "orders.json")
    orders = _plain_orders(spark, sf)
    orders.write.json(path)
    return files.read_json(spark, path, orders.schema).select(*ORDER_COLUMNS)


@query("io03_json_array", f"SELECT {ORDERS} FROM orders")
def io03_array(spark, sf):
    """Arrays of some ``ARRAY_ROWS`` rows, one a file: each file is a single record to the reader, so their number follows the rows."""
    path = scratch_path(spark, "arrays.json")
    orders = _plain_orders(spark, sf)
    parts = max(1, math.ceil(orders.count() / ARRAY_ROWS))
    grouped = orders.groupBy(F.pmod(F.xxhash64("o_orderkey"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct(*ORDER_COLUMNS)).alias("rows"))
    grouped.select(F.to_json("rows").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_json(spark, path, orders.schema).select(*ORDER_COLUMNS)


@query("io04_parquet", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def io04(spark, sf):
    return files.read_parquet(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")


def _stored(spark, sf, names, prefix):
    root = scratch_path(spark, "tables")
    for n, df in tables(spark, sf, *names).items():
        S.write_table(df, f"{prefix}{n}", f"{root}/{n}")


@query("io05_load_table", "SELECT * FROM customer")
def io05(spark, sf):
    _stored(spark, sf, ["customer"], "io05_")
    return S.load_table(spark, "io05_customer")


@query("io06_load_all", "SELECT 'io06_nation' AS \"table\", count(*) AS rows FROM nation UNION ALL SELECT 'io06_region', count(*) FROM region UNION ALL SELECT 'io06_supplier', count(*) FROM supplier")
def io06(spark, sf):
    _stored(spark, sf, ["nation", "region", "supplier"], "io06_")
    found = {n: df for n, df in S.load_all(spark).items() if n.startswith("io06_")}
    parts = None
    for n, df in found.items():
        row = df.agg(F.lit(n).alias("table"), F.count("*").alias("rows"))
        parts = row if parts is None else parts.unionByName(row)
    return parts


@query("io07_list_tables", "SELECT 'io07_nation' AS \"table\", count(*) AS rows FROM nation UNION ALL SELECT 'io07_part', count(*) FROM part")
def io07(spark, sf):
    _stored(spark, sf, ["nation", "part"], "io07_")
    parts = None
    for n in S.list_tables(spark):
        if n.startswith("io07_"):
            row = spark.table(n).agg(F.lit(n).alias("table"), F.count("*").alias("rows"))
            parts = row if parts is None else parts.unionByName(row)
    return parts


@query(
    "io09_ingest",
    "SELECT 'ods_orders' AS \"table\", 'success' AS status, count(*) AS row_count, 6::INTEGER AS column_count FROM orders "
    "UNION ALL SELECT 'ods_customer', 'success', count(*), 5 FROM customer UNION ALL SELECT 'ods_no_such_file', 'error', 0, 0",
)
def io09(spark, sf):
    paths = [f"{sf}/orders.parquet", f"{sf}/customer.parquet", f"{sf}/no such file.parquet"]
    status, _ = files.ingest(spark, paths, "ods", scratch_path(spark, "ods"))
    return status.drop("file", "error")


@query(
    "io09_ingest_lines",
    "SELECT 'success' AS status, count(*) AS row_count, 6::INTEGER AS column_count FROM orders",
)
def io09_lines(spark, sf):
    """JSON lines keep all their records."""
    path = scratch_path(spark, "lines") + "/orders.json"
    _plain_orders(spark, sf).write.json(path)
    status, _ = files.ingest(spark, [path], "ods_lines", scratch_path(spark, "ods_lines"))
    return status.select("status", "row_count", "column_count")


@query(
    "io09_same_name",
    "SELECT 'success' AS status, count(*) AS row_count FROM nation UNION ALL SELECT 'success', count(*) FROM supplier",
)
def io09_same(spark, sf):
    """Two files of one name both stay."""
    root = scratch_path(spark, "twice")
    paths = []
    for folder, name in (("a", "nation"), ("b", "supplier")):
        paths.append(f"{root}/{folder}/y.csv")
        table(spark, sf, name).write.csv(paths[-1], header=True)
    status, _ = files.ingest(spark, paths, "ods_twice", scratch_path(spark, "ods_twice"))
    stored = [r["table"] for r in status.collect()]
    parts = [spark.table(t).agg(F.lit("success").alias("status"), F.count("*").alias("row_count")) for t in stored]
    return parts[0].unionByName(parts[1])


@query("io10_write_table", with_views("dirty_orders", "SELECT * FROM dirty_orders"))
def io10(spark, sf):
    path = scratch_path(spark, "dwd_orders")
    for _ in range(2):  # a second write replaces the first
        S.write_table(view(spark, sf, "dirty_orders"), "io10_dwd_orders", path)
    return spark.table("io10_dwd_orders")


@query(
    "io11_cleaned_table",
    with_views("dirty_orders", "SELECT * FROM dirty_orders WHERE o_totalprice IS NOT NULL AND (o_totalprice BETWEEN 1000 AND 500000)"),
)
def io11(spark, sf):
    rules = [
        {"id": "n", "type": "null_check", "field": "o_totalprice"},
        {"id": "r", "type": "range_check", "field": "o_totalprice", "min": 1000, "max": 500000},
    ]
    root = scratch_path(spark, "tables")
    S.write_table(view(spark, sf, "dirty_orders"), "io11_orders", f"{root}/source")
    J.clean_table(spark, "io11_orders", rules, apply_fixes=True, path=f"{root}/cleaned")
    return spark.table("io11_orders_cleaned")


# Payloads of every third kind: JSON array, CSV with a header, and text that is neither.
PAYLOAD = (
    "CASE event_id % 3 WHEN 0 THEN concat('[{\"id\": ', event_id, ', \"name\": \"', event_type, '\"}, {\"id\": ', user_id, ', \"name\": \"u\"}]') "
    "WHEN 1 THEN concat('id,name', chr(10), event_id, ',', event_type) ELSE concat('event ', event_id) END"
)


def _payloads(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{PAYLOAD} AS payload")


@query(
    "io12_parse_payloads",
    "SELECT event_id, cast(event_id AS string) AS id, event_type AS name FROM events WHERE event_id % 3 <> 2 "
    "UNION ALL SELECT event_id, cast(user_id AS string), 'u' FROM events WHERE event_id % 3 = 0",
)
def io12(spark, sf):
    good, _ = payloads.parse_payloads(_payloads(spark, sf), "payload", ["id", "name"], ["event_id"])
    return good


@query("io12_bad_payloads", "SELECT event_id, concat('event ', event_id) AS payload FROM events WHERE event_id % 3 = 2")
def io12_bad(spark, sf):
    _, bad = payloads.parse_payloads(_payloads(spark, sf), "payload", ["id", "name"], ["event_id"])
    return bad


@query(
    "io13_json_lines",
    "SELECT concat('{\"c_custkey\":', c_custkey, ',\"c_name\":\"', c_name, '\",\"c_nationkey\":', c_nationkey, ',\"c_acctbal\":', c_acctbal, "
    "',\"c_mktsegment\":\"', c_mktsegment, '\"}') AS line FROM customer",
)
def io13(spark, sf):
    return payloads.serialize(table(spark, sf, "customer"), "json")


@query("io13_csv_lines", "SELECT concat_ws(',', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) AS line FROM customer")
def io13_csv(spark, sf):
    return payloads.serialize(table(spark, sf, "customer"), "csv")
