"""Drift, history, compliance, sources, admission and streams."""

import datetime as dt
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plumbline.operators import admission as A
from plumbline.operators import compliance as C
from plumbline.operators import drift as D
from plumbline.operators import history as H
from plumbline.operators import integrity as I
from plumbline.sources import files, payloads
from plumbline.streaming import jobs as S


def test_equal_snapshots_have_no_change(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, name string, email string")
    old = D.snapshot(spark, {"users": df}, "old")
    assert D.changes(old, D.snapshot(spark, {"users": df}, "new")).count() == 0
    wider = D.snapshot(spark, {"users": df.withColumn("age", F.lit(1))}, "new")
    assert [(r["change_type"], r["field"], r["severity"]) for r in D.changes(old, wider).collect()] == [("column_added", "age", "info")]
    assert D.name_changes(old, wider).first()["added"] == ["age"]


def history(spark, scores, table="t"):
    rows = [(table, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), float(s)) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "`table` string, run_ts timestamp, score double")


def test_trend_and_forecast(spark):
    row = H.trend(history(spark, [1, 1, 90, 91, 92, 93, 94])).first()
    assert (row["direction"], row["runs"]) == ("improving", 5) and row["predicted"] == pytest.approx(95)
    assert H.trend(history(spark, [90, 91])).first()["direction"] == "insufficient_data"
    high = H.trend(history(spark, [80, 90, 100])).first()
    assert high["predicted"] == 100
    rows = H.forecast(H.trend(history(spark, [90, 90, 90]))).orderBy("run_offset").collect()
    assert [r["confidence"] for r in rows] == [85, 75, 65]
    assert H.forecast(H.trend(history(spark, [90]))).count() == 0


def test_run_anomalies(spark):
    row = H.run_anomalies(history(spark, [90, 91, 90, 92, 91, 20])).first()
    assert (row["score"], row["type"], row["severity"]) == (20, "low", "critical")
    assert H.run_anomalies(history(spark, [90, 20, 90])).count() == 0


def test_presets(spark):
    df = spark.createDataFrame([(8, "post@north.example"), (9, None), (10, "x@y.example")], "id int, email string")
    done = C.apply_presets(df)
    assert [r["email"] for r in done.masked.orderBy("id").collect()] == ["p****@north.example", None, "x****@y.example"]
    assert [v[0] for v in done.violations] == ["gdpr_email_mask"]
    assert C.apply_presets(df, dry_run=True).masked is None
    assert not C.apply_presets(df.limit(0)).success
    assert C.apply_presets(df, ["dt_email_format"]).violations == []
    assert len(C.list_presets()) == 11 and len(C.list_presets("GDPR")) == 6


def test_examples_hold_no_set_of_values(spark, monkeypatch):
    df = spark.range(3000, numPartitions=3).selectExpr("id", "if(id % 7 = 0, null, concat('v', id % 1000)) AS a", "cast(id % 2 AS string) AS b")
    none = F.col("id") < 0

    def held(*_):
        raise AssertionError("memory grows with the values")

    monkeypatch.setattr(type(df), "distinct", held)
    wanted = {4: (F.col("b"), F.col("b").isNotNull()), 1: (F.col("a"), F.col("a") >= "v5"), 2: (F.col("a"), none), 3: (F.col("id"), F.col("id") > 20)}
    assert C.smallest(df, wanted) == {4: ["0", "1"], 1: ["v5", "v50", "v500"], 3: ["100", "1000", "1001"]}
    assert C.smallest(df, {}) == {} and C.smallest(df.limit(0), wanted) == {}


def test_orphans(spark):
    a = spark.createDataFrame([(1,), (7,), (7,), (None,), (9,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    row = I.orphan_summary(a, "k", b, "k").first()
    assert (row["orphans"], row["examples"]) == (2, ["7", "9"])


def test_text_findings_read_whole_texts(spark):
    text = "x " * 50_000 + "late@example.com 13812345678"
    df = spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string")
    row = C.text_findings(df, "text", ["id"]).collect()
    assert len(row) == 1 and (row[0]["email_hits"], row[0]["phone_hits"]) == (1, 1)


def test_payload_texts_come_back_as_they_were(spark):
    odd = "\ue000x \ue000c, \ue001\r\n\ue002 \ue000"
    rows = [(1, f'id,name\n7,"{odd}"\n8,plain\ue000')]
    good, bad = payloads.parse_payloads(spark.createDataFrame(rows, "n int, body string"), "body", ["id", "name"], ["n"])
    assert {(r["id"], r["name"]) for r in good.collect()} == {("7", odd), ("8", "plain\ue000")} and bad.count() == 0


def test_payloads(spark):
    rows = [(1, '[{"id": 1, "name": "a"}, {"id": 2}]'), (2, '{"id": 3, "name": "c"}'), (3, 'name,id\r\n"x, y",4\n,5'), (4, "no records"), (5, "[broken"), (6, None),
        (7, 'id,name\n6,"two\nlines, ""quoted"""\n'), (8, '[x],id,name\n1,7,b')]
    df = spark.createDataFrame(rows, "n int, body string")
    good, bad = payloads.parse_payloads(df, "body", ["id", "name"], ["n"])
    assert sorted(tuple(r) for r in good.fillna("").collect()) == [(1, "1", "a"), (1, "2", ""), (2, "3", "c"), (3, "4", "x, y"), (3, "5", ""), (7, "6", 'two\nlines, "quoted"'), (8, "7", "b")]
    assert sorted(r["n"] for r in bad.collect()) == [4, 5, 6]


def test_ingest_and_scan(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "Sales 2024.csv").write_text("id,amount\n1,2.5\n2,\n")
    (tmp_path / "in" / "deep" / "items.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "in" / "notes.txt").write_text("x")
    found = {r["name"]: r["suffix"] for r in files.scan_files(spark, str(tmp_path / "in")).collect()}
    assert found == {"Sales 2024.csv": ".csv", "items.json": ".json"}
    paths = [str(tmp_path / "in" / "Sales 2024.csv"), str(tmp_path / "in" / "deep" / "items.json"), str(tmp_path / "gone.csv")]
    for _ in range(2):  # loading again replaces, it does not add
        status, lineage = files.ingest(spark, paths, "ods", str(tmp_path / "out"))
    rows = {r["table"]: (r["status"], r["row_count"]) for r in status.collect()}
    assert rows == {"ods_sales_2024": ("success", 2), "ods_items": ("success", 2), "ods_gone": ("error", 0)}
    assert {r["column"]: r["null_pct"] for r in lineage.where("table = 'ods_sales_2024'").collect()} == {"id": 0.0, "amount": 0.5}


def test_ingest_keeps_all_records(spark, tmp_path):
    for folder, text in (("a", "k,v\n1,x\n2,y\n"), ("b", "k,v\n3,z\n")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "Y.CSV").write_text(text)
    (tmp_path / "lines.json").write_text("".join(f'{{"a": {i}}}\n' for i in range(100)))
    (tmp_path / "pretty.json").write_text('{\n "a": 1\n}\n')
    (tmp_path / "quoted.csv").write_text('k,v\n1,"two\nlines"\n2,"say ""hi"""\n')
    long = "n" * 60
    (tmp_path / f"{long}1.csv").write_text("k\n1\n")
    (tmp_path / f"{long}2.csv").write_text("k\n1\n2\n")
    assert files.scan_files(spark, str(tmp_path)).where("name = 'Y.CSV'").count() == 2
    names = ["a/Y.CSV", "b/Y.CSV", "lines.json", "pretty.json", "quoted.csv", f"{long}1.csv", f"{long}2.csv"]
    status, _ = files.ingest(spark, [str(tmp_path / n) for n in names], "keep", str(tmp_path / "out"))
    rows = status.collect()
    assert [r["row_count"] for r in rows] == [2, 1, 100, 1, 2, 1, 2] and {r["status"] for r in rows} == {"success"}
    assert len({r["table"] for r in rows}) == 7 and all(len(r["table"]) <= 50 for r in rows)
    assert sorted(r["v"] for r in spark.table(rows[4]["table"]).collect()) == ['say "hi"', "two\nlines"]


# ---- admission


def brute(rows, limit, window):
    state, out = {}, {}
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        held = state.setdefault(k, deque())
        while held and held[0] <= t - window:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(t)
        out[i] = (ok, limit - len(held))
    return out


def event_rows(n=1500):
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(n):
        t += rnd.choice([0, 1, 1, 5, 40])
        rows.append(("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}", t, i))
    return rows


def events(spark, rows):
    df = spark.createDataFrame(rows, "k string, s long, i long")
    return df.select("k", F.timestamp_seconds("s").alias("ts"), "i")


def test_scan_takes_a_table_in_parts_as_one_file(spark, tmp_path):
    root = tmp_path / "all.parquet"  # above what is scanned, so its name says nothing
    spark.range(10).repartition(3).write.parquet(str(root / "orders.parquet"))
    spark.range(5).write.parquet(str(root / "plain"))
    (root / "odd.parquet").mkdir()
    (root / "odd.parquet" / "a.csv").write_text("a\n1\n")
    found = {r["name"]: r for r in files.scan_files(spark, str(root)).collect()}
    parts = [p for p in found if p.startswith("part-")]
    assert set(found) - set(parts) == {"orders.parquet", "a.csv"} and parts
    size = sum(p.stat().st_size for p in (root / "orders.parquet").glob("*.parquet"))
    assert found["orders.parquet"]["size_kb"] == round(size / 1024, 2) and found["orders.parquet"]["suffix"] == ".parquet"
    assert files.read_file(spark, found["orders.parquet"]["path"]).count() == 10


@pytest.mark.parametrize("chunks", [1, 25])
def test_admission_against_brute_force(spark, chunks):
    rows = event_rows()
    got = A.admit(events(spark, rows).repartition(5), "k", "ts", "i", 3, 30, chunks).collect()
    assert {r["i"]: (r["accepted"], r["remaining"]) for r in got} == brute(rows, 3, 30)


def test_admission_golden(spark):
    got = A.admit(events(spark, [("k", 0, i) for i in range(4)]), "k", "ts", "i", 3, 60).orderBy("i").collect()
    assert [r["accepted"] for r in got] == [True, True, True, False] and got[-1]["remaining"] == 0


def test_quarantine_equals_batch(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 10).alias("v"))
    df.write.parquet(str(tmp_path / "in"))
    rules = [{"id": "r", "type": "range_check", "field": "v", "max": 7}]
    S.to_folder(S.quarantine(S.read_folder(spark, str(tmp_path / "in"), df.schema), rules), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_incremental_load_reads_each_file_once(spark, tmp_path):
    schema = "k int, version int, v string"
    load = lambda: S.load_changes(S.read_folder(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "log"), str(tmp_path / "cp"))
    df = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema)
    df.write.mode("append").parquet(str(tmp_path / "in"))
    load()
    spark.createDataFrame([(1, 2, "c"), (3, 1, "d")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    load()
    load()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    now = S.current_rows(spark, str(tmp_path / "log"), ["k"], [-F.col("version")])
    assert sorted((r["k"], r["v"]) for r in now.collect()) == [(1, "c"), (2, "b"), (3, "d")]
    S.compact_log(spark, str(tmp_path / "log"), ["k"], [-F.col("version")], str(tmp_path / "new"))
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "new")).collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_governance_run(spark, tmp_path):
    from plumbline.plans.governance import run

    source = tmp_path / "sales.csv"
    lines = ["order_id,amount,region"] + [f"{i},{'' if i % 4 == 0 else 100 + i},N" for i in range(40)]
    source.write_text("\n".join(lines))
    for day in (1, 2, 3):
        done = run(spark, [str(source)], "ods", str(tmp_path / "warehouse"), f"2024-01-0{day} 00:00:00")
    row = done.trends.first()
    assert (row["table"], row["runs"], row["direction"]) == ("ods_sales", 3, "stable")
    assert done.health.first()["health"] == "healthy"
    assert {r["type"] for r in done.alerts.collect()} >= {"null_rate"}
    assert done.snapshot.first()["row_count"] == 40
    assert done.changes.count() == 0 and done.forecast.count() == 3
    source.write_text("\n".join(["order_id,amount,region,note"] + [f"{i},x{i},N,n" for i in range(10)]))
    rules = [{"id": "n", "type": "null_check", "field": "note"}]
    done = run(spark, [str(source)], "ods", str(tmp_path / "warehouse"), "2024-01-03 00:00:00", rules)
    found = {(r["change_type"], r["field"]) for r in done.changes.collect()}
    assert found == {("column_added", "note"), ("dtype_changed", "amount")}
    # The run of the third day was repeated: its latest load counts.
    assert done.trends.first()["current"] == pytest.approx(done.scores.first()["score"]) and done.violations.first()["status"] == "passed"


def test_warehouse_graph(spark):
    from plumbline.plans.lineage import impact_of, warehouse_graph

    people = spark.range(40).select(F.col("id").alias("person_id"), (F.col("id") * 2).alias("age"), (F.col("id") * 4 + 1).alias("points"))
    visits = spark.range(200).select(F.col("id").alias("visit_id"), (F.col("id") % 40).alias("person_id"))
    log = spark.createDataFrame([("people.points", "report.total"), ("bad", "report.total")], "source string, target string")
    found = warehouse_graph(spark, {"people": people, "visits": visits}, {"people": ["person_id"]}, log)
    pairs = {(r["source"], r["target"], r["mechanism"]) for r in found.edges.collect()}
    assert ("people.points", "report.total", "etl_transform") in pairs
    assert ("visits.person_id", "people.person_id", "foreign_key") in pairs
    ops = spark.createDataFrame([(1, "drop_column", "people", "points", None, None)], "op_id int, op_type string, `table` string, `column` string, new_name string, new_dtype string")
    effects = {r["node"]: r for r in impact_of(found, ops).collect()}
    assert "report.total" in effects and all(0 <= r["probability"] <= 1 for r in effects.values())


def test_json_lines_that_are_not_strict(spark, tmp_path):
    rows = [f'{{"a": {i}}}' for i in range(100)]
    texts = {
        "single": "\n".join(x.replace('"', "'") for x in rows),
        "commas": ",\n".join(rows) + ",\n",
        "broken": "\n".join(['{"a": 0', *rows[1:]]),
        "scalar": "\n".join(["7", *rows[1:]]),
        "pretty": '{\n "a": 1\n}\n',
        "nested": '{"a": 1, "b": [\n{"c": 1}\n]}\n',
        "array": "\n[" + ",\n".join(rows) + "]",
    }
    schema = spark.range(0).selectExpr("id AS a").schema
    counts = {}
    for name, text in texts.items():
        path = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text(text)
        found = files.read_json(spark, path, schema).cache()
        counts[name] = (found.count(), found.where("a IS NOT NULL").count(), found.where("_corrupt_record IS NOT NULL").count())
    whole, kept = (100, 100, 0), (100, 99, 1)
    assert counts == {"single": whole, "commas": whole, "broken": kept, "scalar": kept, "pretty": (1, 1, 0), "nested": (1, 1, 0), "array": whole}


def test_json_arrays_do_not_grow_with_a_frequent_customer(spark, tmp_path):
    from plumbline.workloads.sources import io03_array

    spark.range(60_000).selectExpr(
        "id AS o_orderkey", "16L AS o_custkey", "'O' AS o_orderstatus", "1.5D AS o_totalprice", "DATE '1995-01-01' AS o_orderdate", "'1' AS o_orderpriority"
    ).write.parquet(str(tmp_path / "orders.parquet"))
    found = io03_array(spark, str(tmp_path))
    sizes = [r["count"] for r in found.groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 60_000 and found.select("o_orderkey").distinct().count() == 60_000 and max(sizes) < 15_000
