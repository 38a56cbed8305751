import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators import infer as I
from plumbline.operators import overlap as O
from plumbline.operators.association import chi_squares, correlations

OPS = "op_id int, op_type string, `table` string, `column` string, new_name string, new_dtype string"


def edges(spark, rows):
    return G.log_edges(spark.createDataFrame(rows, "source string, target string, strength double, confidence double"))


def nodes(spark, names, keys=()):
    rows = [(f"{t}.{c}", t, c, f"{t}.{c}" in keys, "column") for t, c in names]
    return spark.createDataFrame(rows, "node string, `table` string, `column` string, is_key boolean, node_type string")


def reach(spark, rows, start, **kw):
    found = G.closure(spark.createDataFrame([(start,)], "start string"), edges(spark, rows), **kw)
    return {r["node"]: (r["hops"], round(r["weight"], 6), list(r["path"])) for r in found.collect()}


def test_one_edge_both_ways(spark):
    rows = [("orders.customer_id", "customers.id", 1.0, 1.0)]
    assert list(reach(spark, rows, "orders.customer_id")) == ["customers.id"]
    up = G.closure(spark.createDataFrame([("customers.id",)], "start string"), G.upstream_edges(edges(spark, rows)))
    assert [r["node"] for r in up.collect()] == ["orders.customer_id"]


def test_best_path_and_cycle(spark):
    rows = [("a.x", "b.x", 0.5, 1.0), ("a.x", "c.x", 0.9, 1.0), ("b.x", "d.x", 1.0, 1.0), ("c.x", "d.x", 0.9, 1.0), ("d.x", "a.x", 1.0, 1.0), ("a.x", "b.x", 0.6, 1.0)]
    found = reach(spark, rows, "a.x")
    assert found == {"b.x": (1, 0.6, ["a.x", "b.x"]), "c.x": (1, 0.9, ["a.x", "c.x"]), "d.x": (2, 0.81, ["a.x", "c.x", "d.x"])}


def test_hop_limit(spark):
    rows = [(f"n{i}.x", f"n{i + 1}.x", 1.0, 1.0) for i in range(9)]
    assert len(reach(spark, rows, "n0.x")) == 9  # to the end, unless a limit is given
    assert len(reach(spark, rows, "n0.x", max_hops=6)) == 6
    assert len(reach(spark, rows, "n0.x", max_hops=3, paths=False)) == 3
    assert reach(spark, rows, "none.x") == {}


def test_ties_take_the_first_path_in_text_order(spark):
    rows = [("a.x", "c.x", 1.0, 1.0), ("a.x", "b.x", 1.0, 1.0), ("b.x", "d.x", 1.0, 1.0), ("c.x", "d.x", 1.0, 1.0)]
    assert reach(spark, rows, "a.x")["d.x"][2] == ["a.x", "b.x", "d.x"]


def test_impact_of_each_kind(spark):
    e = edges(spark, [("orders.customer_id", "customers.id", 0.9, 0.8)])
    n = nodes(spark, [("orders", "customer_id"), ("orders", "total"), ("customers", "id")], {"customers.id"})
    ops = spark.createDataFrame(
        [(1, "drop_column", "orders", "customer_id", None, None), (2, "add_column", "orders", "customer_id", None, "int"), (3, "truncate_table", "orders", None, None, None)], OPS
    )
    found = {(r["op_id"], r["node"]): r for r in G.impact(ops, n, e).collect()}
    assert found[1, "orders.customer_id"]["probability"] == 0.95
    assert found[1, "customers.id"]["probability"] == pytest.approx(0.9 * 0.8 * 0.95)
    assert found[1, "customers.id"]["severity"] == "critical"
    assert found[1, "orders.total"]["probability"] == pytest.approx(0.8 * 0.95)
    assert found[2, "customers.id"]["severity"] == "info"
    assert found[3, "customers.id"]["hops"] == 1 and found[3, "orders"]["probability"] == 0.95
    assert all(0 <= r["probability"] <= 1 for r in found.values())
    risk = {r["op_id"]: r for r in G.change_risk(G.impact(ops, n, e)).collect()}
    assert risk[1]["risk_level"] == "CRITICAL" and risk[2]["risk_level"] == "LOW"
    assert risk[1]["jobs"] == ["ETL_JoinMasterData", "ETL_RevenueAggregation"]


def test_outcome_falls_back_to_three(spark):
    e = edges(spark, [(f"a.c{i}", f"a.c{i + 1}", 1.0, 1.0) for i in range(5)])
    n = nodes(spark, [("a", f"c{i}") for i in range(6)])
    ops = spark.createDataFrame([(1, "drop_column", "a", "c0", None, None)], OPS)
    effects = G.impact(ops, n, e)
    assert G.effects_for_outcome(effects, ["zzz"]).count() == 3
    assert G.effects_for_outcome(effects, ["c3_x"]).select("node").collect()[0][0] == "a.c3"


def test_log_entries_without_two_parts_are_skipped(spark):
    log = spark.createDataFrame([("a.x", "b.y"), ("a", "b.y"), ("a.b.c", "b.y"), (None, "b.y")], "source string, target string")
    assert [(r["strength"], r["confidence"]) for r in G.log_edges(log).collect()] == [(0.95, 0.9)]


def test_overlap_over_many_columns(spark):
    # More columns than one mask word holds.
    wide = spark.range(10).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(70)])
    other = spark.createDataFrame([(69.0, "5"), (70.0, "x"), (1000.5, None)], "d double, s string")
    found = {(r["source"], r["target"]): r for r in O.overlaps(spark, {"w": wide, "o": other}).collect()}
    assert found["w.c69", "o.d"]["shared"] == 2 and found["w.c61", "o.d"]["shared"] == 2
    assert found["w.c60", "o.d"]["shared"] == 1 and ("w.c59", "o.d") not in found
    assert found["w.c69", "o.d"]["overlap"] == pytest.approx(2 / 3)
    assert ("w.c0", "o.s") not in found  # text 5 and number 5 differ


def test_hot_value_does_not_change_overlap(spark):
    a = spark.range(900).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("x"))
    b = spark.range(300).select(F.lit(1).alias("y"))
    row = O.overlaps(spark, {"a": a, "b": b}).first()
    assert (row["shared"], row["source_distinct"], row["target_distinct"]) == (1, 301, 1)


def test_constant_columns(spark):
    df = spark.range(20).select(F.lit(1.0).alias("a"), F.col("id").cast("double").alias("b"), (F.col("id") * 2.0).alias("c"))
    found = correlations(df, {c: F.col(c) for c in df.columns}, [("a", "b"), ("b", "c")])
    assert found["a", "b"] == (0.0, 20) and found["b", "c"][0] == pytest.approx(1.0)
    flat = spark.range(20).select(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    row = chi_squares(flat, ["a", "b"]).first()
    assert (row["chi2"], row["p_value"]) == (0.0, 1.0)


def test_foreign_key_points_to_the_key(spark):
    orders = spark.range(50).select((F.col("id") % 20).alias("customer_id"))
    customers = spark.range(20).select("id")
    row = I.foreign_keys(spark, {"orders": orders, "customers": customers}).first()
    assert (row["source"], row["target"], row["strength"]) == ("orders.customer_id", "customers.id", 1.0)


def test_rank_flows_to_nodes_with_dependents(spark):
    e = edges(spark, [("a.x", "b.x", 1.0, 1.0), ("a.x", "c.x", 1.0, 1.0), ("b.x", "c.x", 1.0, 1.0)])
    ranks = {r["node"]: r["rank"] for r in G.page_rank(nodes(spark, [("a", "x"), ("b", "x"), ("c", "x")]), e).collect()}
    assert ranks["a.x"] > ranks["b.x"] > ranks["c.x"]


def test_nodes_that_starts_share_are_walked_from_once(spark, monkeypatch):
    # Starts s0..s19 lead to three nodes of a small graph with a cycle and a way back to a start.
    rows = [(f"s{i}.x", f"m{j}.x", 0.5 + (i * 7 + j) % 5 / 10, 1.0) for i in range(20) for j in range(3) if (i + j) % 3]
    rows += [("m0.x", "p.x", 0.9, 1.0), ("m1.x", "p.x", 0.9, 1.0), ("m2.x", "q.x", 0.8, 1.0), ("p.x", "q.x", 1.0, 1.0)]
    rows += [("q.x", "m0.x", 0.7, 1.0), ("q.x", "s3.x", 0.6, 1.0), ("s1.x", "s1.x", 1.0, 1.0), ("s2.x", "m0.x", 0.1, 1.0)]
    e, starts = edges(spark, rows), spark.createDataFrame([(f"s{i}.x",) for i in range(20)], "start string")
    n = nodes(spark, [(f"s{i}", "x") for i in range(20)] + [("s0", "y"), ("p", "x")], {"p.x", "s4.x"})
    kinds = [("drop_column", "x"), ("truncate_table", None), ("rename_column", "x")]
    ops = spark.createDataFrame([(i, kinds[i % 3][0], f"s{i % 20}", kinds[i % 3][1], "n", None) for i in range(25)], OPS)
    found = {}
    for times in (2, 1 << 30):
        monkeypatch.setattr(G, "SHARED", times)
        monkeypatch.setattr(G, "TAIL", 2)
        found[times] = []
        for hops in (None, 0, 2):
            for paths in (True, False):
                reached = G.closure(starts, e, hops, paths).collect()
                found[times].append(sorted((r["start"], r["node"], r["hops"], round(r["weight"], 9), tuple(r["path"])) for r in reached))
        effects = G.impact(ops, n, e, 3).collect()
        found[times].append(sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in effects))
    shared, single = found.values()
    assert shared == single and len(shared[0]) > 60 and not shared[2]


def test_few_starts_walk_the_links_as_they_are(spark, monkeypatch):
    rows = [(f"s{i % 4}.x", f"m{i % 7}.x", 0.5 + i * 7 % 5 / 10, 1.0) for i in range(60)]
    rows += [(f"m{i % 7}.x", f"n{i}.x", 0.9, 1.0) for i in range(40)] + [("n3.x", "p.x", 0.9, 1.0), ("p.x", "s1.x", 0.7, 1.0), ("s2.x", "s2.x", 1.0, 1.0)]
    starts = spark.createDataFrame([(f"s{i % 4}.x",) for i in range(6)] + [("none.x",)], "start string")
    for more in ([], [("n3.x", "p.x", -0.4, 1.0), ("p.x", "s1.x", -0.7, 1.0), ("m2.x", "n2.x", -1.0, 1.0)]):
        e, found = edges(spark, rows + more), []
        for few in (0, 1000):
            monkeypatch.setattr(G, "FEW", few)
            for hops in (None, 0, 1, 3):
                for paths in (True, False):
                    reached = G.closure(starts, e, hops, paths).collect()
                    found.append(sorted((r["start"], r["node"], r["hops"], round(r["weight"], 9), tuple(r["path"])) for r in reached))
        assert found[:8] == found[8:] and len(found[0]) > 150 and not found[2]

    def reduced(*_):
        raise AssertionError("links are shuffled to be marked")

    monkeypatch.setattr(G, "_reach", reduced)
    assert G.closure(starts, edges(spark, rows), paths=False).count() == len(found[0])


def test_effects_are_dealt_by_operation_once(spark):
    e = edges(spark, [(f"a.c{i}", f"a.c{i + 1}", 1.0, 1.0) for i in range(5)])
    n = nodes(spark, [("a", f"c{i}") for i in range(6)])
    ops = spark.createDataFrame([(1, "drop_column", "a", "c0", None, None)], OPS)
    effects = G.impact(ops, n, e)
    before = effects._jdf.queryExecution().executedPlan().toString().count("Exchange")
    for df in (G.change_risk(effects), G.what_if(effects, ["c3_x", "zzz"]), G.top_effects(effects, 3)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= before


def test_rank_is_exact_where_only_some_nodes_give(spark):
    rows = [(f"s{i}.x", f"m{i % 3}.x") for i in range(7)] + [("m0.x", "p.x"), ("m1.x", "p.x"), ("p.x", "m2.x"), ("m2.x", "p.x")]
    names = sorted({x for r in rows for x in r} | {"alone.x"})
    e = edges(spark, [(a, b, 1.0, 1.0) for a, b in rows])
    n = nodes(spark, [x.split(".") for x in names])
    for rounds, tolerance in ((0, 0), (1, 0), (2, 0), (7, 0), (100, 1e-6)):
        want, i = {x: 1 / len(names) for x in names}, 0
        while i < rounds:
            degree = {b: sum(t == b for _, t in rows) for _, b in rows}
            old, want = want, {x: 0.15 / len(names) + 0.85 * sum(want[b] / degree[b] for a, b in rows if a == x) for x in names}
            i += 1
            if tolerance and i % 5 == 0 and max(abs(want[x] - old[x]) for x in names) <= tolerance / len(names):
                break
        got = {r["node"]: r["rank"] for r in G.page_rank(n, e, rounds, tolerance=tolerance).collect()}
        assert got == pytest.approx(want, abs=1e-12)
