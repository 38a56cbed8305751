"""Lineage graph and impact over row-level lineage: every order, customer, supplier, nation and
region is a small table of the graph, so the graph grows with the data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators import infer as I
from plumbline.operators.asof import factual_scores
from plumbline.workloads.inference import ALL_EDGES, LINKED_VIEWS, linked
from plumbline.workloads.registry import COLUMNS, joined, query, rounded, table, tables, with_views

# source, target, strength, confidence; expressions valid in both engines
LOG = [
    ("orders", "concat('orders_', o_orderkey, '.id')", "concat('customer_', o_custkey, '.id')", "0.9", "0.8"),
    ("lineitem", "concat('orders_', l_orderkey, '.total')", "concat('supplier_', l_suppkey, '.quality_score')", "0.5 + l_discount * 4", "0.9"),
    ("customer", "concat('customer_', c_custkey, '.id')", "concat('nation_', c_nationkey, '.id')", "0.95", "0.9"),
    ("supplier", "concat('supplier_', s_suppkey, '.quality_score')", "concat('nation_', s_nationkey, '.id')", "0.85", "0.9"),
    ("nation", "concat('nation_', n_nationkey, '.id')", "concat('region_', n_regionkey, '.revenue_total')", "0.99", "0.95"),
]
# node table, columns, key column
NODES = [
    ("orders", "concat('orders_', o_orderkey)", ["id", "total"], "id"),
    ("customer", "concat('customer_', c_custkey)", ["id", "name"], "id"),
    ("supplier", "concat('supplier_', s_suppkey)", ["quality_score"], ""),
    ("nation", "concat('nation_', n_nationkey)", ["id"], "id"),
    ("region", "concat('region_', r_regionkey)", ["revenue_total"], ""),
]
OP_TYPE = (
    "CASE o_orderkey % 5 WHEN 0 THEN 'drop_column' WHEN 1 THEN 'truncate_table' WHEN 2 THEN 'rename_column' "
    "WHEN 3 THEN 'dtype_change' ELSE 'add_column' END"
)
OP_COLUMN = "CASE WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'id' ELSE 'total' END"


def _log(spark, sf) -> DataFrame:
    parts = [
        table(spark, sf, t).selectExpr(f"{a} AS source", f"{b} AS target", f"cast({s} AS double) AS strength", f"cast({c} AS double) AS confidence")
        for t, a, b, s, c in LOG
    ]
    return reduce(DataFrame.unionByName, parts)


def _edges(spark, sf) -> DataFrame:
    return G.log_edges(_log(spark, sf))


def _nodes(spark, sf) -> DataFrame:
    parts = []
    for t, name, columns, key in NODES:
        rows = ", ".join(f"('{c}', {'true' if c == key else 'false'})" for c in columns)
        listed = f"inline(array({rows})) AS (column, is_key)"
        named = table(spark, sf, t).selectExpr(f"{name} AS table", listed)
        parts.append(named.selectExpr("concat(table, '.', column) AS node", "table", "column", "is_key", "'column' AS node_type"))
    return reduce(DataFrame.unionByName, parts)


def _ops(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS op_id",
        f"{OP_TYPE} AS op_type",
        "concat('orders_', o_orderkey) AS table",
        f"{OP_COLUMN} AS column",
        "'fresh' AS new_name",
        "'int' AS new_dtype",
    )


LOG_SQL = "log AS (" + " UNION ALL ".join(
    f"SELECT {a} AS source, {b} AS target, ({s})::DOUBLE AS strength, ({c})::DOUBLE AS confidence FROM {t}" for t, a, b, s, c in LOG
) + "), links AS MATERIALIZED (SELECT source, target, max(strength * confidence) AS w FROM log GROUP BY 1, 2)"
NODES_SQL = "nodes AS (" + " UNION ALL ".join(
    f"SELECT concat({name}, '.{c}') AS node, {name} AS t, '{c}' AS c, {'true' if c == key else 'false'} AS is_key FROM {t}"
    for t, name, columns, key in NODES
    for c in columns
) + ")"
OPS_SQL = (
    f"ops AS (SELECT o_orderkey AS op_id, {OP_TYPE} AS op_type, concat('orders_', o_orderkey) AS t, {OP_COLUMN} AS c FROM orders), "
    "opx AS (SELECT *, CASE WHEN c IS NULL THEN t ELSE t || '.' || c END AS prim, op_type IN ('drop_column', 'truncate_table', 'dtype_change') AS destructive, "
    "CASE op_type WHEN 'drop_column' THEN 0.95 WHEN 'truncate_table' THEN 0.99 WHEN 'rename_column' THEN 0.6 WHEN 'dtype_change' THEN 0.8 ELSE 0.1 END::DOUBLE AS mult FROM ops)"
)


def walk_sql(starts: str, up: bool = False) -> str:
    a, b = ("target", "source") if up else ("source", "target")
    return (
        f"walk AS (SELECT start, start AS node, 0 AS hops, 1.0::DOUBLE AS weight, [start] AS path FROM ({starts}) "
        f"UNION ALL SELECT k.start, l.{b}, k.hops + 1, k.weight * l.w, list_append(k.path, l.{b}) FROM walk k JOIN links l ON k.node = l.{a} "
        f"WHERE k.hops < 6 AND NOT list_contains(k.path, l.{b})), "
        "reach AS (SELECT start, node, hops, weight, path FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY hops, weight DESC, path) AS rn FROM walk) WHERE rn = 1 AND hops > 0)"
    )


#: Hops that the walks in SQL go.
HOPS = 6
ORDER_STARTS = "SELECT concat('orders_', o_orderkey, '.id') AS start FROM orders UNION ALL SELECT concat('orders_', o_orderkey, '.total') FROM orders"
CLOSURE = "start, node, hops::INTEGER AS hops, round(weight, 6) AS weight"


def _order_starts(spark, sf):
    both = "explode(array(concat('orders_', o_orderkey, '.id'), concat('orders_', o_orderkey, '.total'))) AS start"
    return table(spark, sf, "orders").selectExpr(both)


def _shown(reach):
    return rounded(reach.select("start", "node", "hops", "weight"), 6)


CHAIN = 25


@query(
    "gr05_long_chain",
    f"SELECT s_suppkey - s_suppkey % {CHAIN} AS start, s_suppkey AS node, (s_suppkey % {CHAIN})::INTEGER AS hops, round(0.9 ** (s_suppkey % {CHAIN}), 6) AS weight "
    f"FROM (SELECT DISTINCT s_suppkey FROM supplier) WHERE s_suppkey % {CHAIN} > 0 AND s_suppkey - s_suppkey % {CHAIN} IN (SELECT s_suppkey FROM supplier)",
)
def gr05_long(spark, sf):
    """Chains of suppliers, walked to their ends."""
    suppliers = table(spark, sf, "supplier").select("s_suppkey").distinct()
    edges = suppliers.where(f"s_suppkey % {CHAIN} > 0").selectExpr(
        "cast(s_suppkey - 1 AS string) AS source", "cast(s_suppkey AS string) AS target", "0.9D AS strength", "1.0D AS confidence"
    )
    starts = suppliers.where(f"s_suppkey % {CHAIN} = 0").selectExpr("cast(s_suppkey AS string) AS start")
    reach = rounded(G.closure(starts, edges, paths=False), 6)
    return reach.select(F.col("start").cast("long").alias("start"), F.col("node").cast("long").alias("node"), "hops", "weight")


@query("gr05_closure", f"WITH RECURSIVE {LOG_SQL}, {walk_sql(ORDER_STARTS)} SELECT {CLOSURE} FROM reach")
def gr05(spark, sf):
    return _shown(G.closure(_order_starts(spark, sf), _edges(spark, sf), HOPS, paths=False))


@query(
    "gr05_upstream",
    f"WITH RECURSIVE {LOG_SQL}, {walk_sql('''SELECT concat('region_', r_regionkey, '.revenue_total') AS start FROM region''', up=True)} SELECT {CLOSURE} FROM reach",
)
def gr05_up(spark, sf):
    starts = table(spark, sf, "region").selectExpr("concat('region_', r_regionkey, '.revenue_total') AS start")
    return _shown(G.closure(starts, G.upstream_edges(_edges(spark, sf)), HOPS, paths=False))


@query(
    "gr06_shortest_path",
    f"WITH RECURSIVE {LOG_SQL}, {walk_sql(ORDER_STARTS)} SELECT start, node, array_to_string(path, '>') AS path FROM reach",
)
def gr06(spark, sf):
    reach = G.closure(_order_starts(spark, sf), _edges(spark, sf), HOPS)
    return reach.select("start", "node", joined("path", ">"))


@query("gr03_log_edges", f"WITH {LOG_SQL} SELECT source, target, 'etl_transform' AS mechanism, round(strength, 4) AS strength, confidence, 1::INTEGER AS delay_steps FROM log")
def gr03(spark, sf):
    odd = table(spark, sf, "nation").selectExpr("n_name AS source", "concat(n_name, '.x') AS target", "cast(1 AS double) AS strength", "cast(1 AS double) AS confidence")
    return rounded(G.log_edges(_log(spark, sf).unionByName(odd)).drop("metrics"))


@query(
    "gr04_quality_edges",
    "SELECT concat('supplier_', s_suppkey, '.quality_score') AS source, concat('nation_', s_nationkey, '.id') AS target, 'quality_propagation' AS mechanism, 0.8::DOUBLE AS strength, 0.85::DOUBLE AS confidence FROM supplier",
)
def gr04(spark, sf):
    _, a, b, _, _ = LOG[3]
    links = table(spark, sf, "supplier").selectExpr(f"{a} AS source", f"{b} AS target")
    return G.quality_edges(links).drop("metrics", "delay_steps")


@query(
    "gr01_nodes",
    " UNION ALL ".join(
        f"SELECT '{t}.{c}' AS node, '{t}' AS \"table\", '{c}' AS \"column\", {'true' if c == k else 'false'} AS is_key, 'column' AS node_type, count(*) AS row_count FROM {t}"
        for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("region", "r_regionkey"))
        for c in COLUMNS[t]
    )
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT '{t}', '{t}', NULL, false, 'table', count(*) FROM {t}" for t in ("orders", "customer", "region")),
)
def gr01(spark, sf):
    found = tables(spark, sf, "orders", "customer", "region")
    keys = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "region": ["r_regionkey"]}
    return G.nodes_of(spark, found, keys).drop("dtype")


@query(
    "gr02_inferred_edges",
    with_views(LINKED_VIEWS, ALL_EDGES + "SELECT source, target, round(max(strength * confidence), 4) AS weight FROM edges GROUP BY 1, 2"),
)
def gr02(spark, sf):
    return rounded(G.links(I.infer_edges(spark, linked(spark, sf))))


@query("ag18_edge_counts", with_views(LINKED_VIEWS, ALL_EDGES + "SELECT mechanism, count(*) AS edges FROM edges GROUP BY 1"))
def ag18(spark, sf):
    return G.mechanism_counts(I.infer_edges(spark, linked(spark, sf)))


@query("ag18_graph_totals", f"WITH {LOG_SQL}, {NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM log) AS total_edges")
def ag18_totals(spark, sf):
    return G.graph_totals(_nodes(spark, sf), _edges(spark, sf))


@query(
    "jo06_traversal_join",
    f"WITH {LOG_SQL}, front AS ({ORDER_STARTS}) SELECT f.start, l.target AS node, round(l.w, 6) AS weight FROM front f JOIN links l ON l.source = f.start",
)
def jo06(spark, sf):
    step = G.links(_edges(spark, sf))
    reached = _order_starts(spark, sf).join(step, F.col("start") == F.col("source"))
    return rounded(reached.select("start", F.col("target").alias("node"), "weight"), 6)


# ---- impact of one operation per order

OP_STARTS = "SELECT prim AS start FROM opx WHERE c IS NOT NULL UNION SELECT n.node FROM opx JOIN nodes n USING (t) WHERE opx.c IS NULL"
EFFECTS = f"""
{LOG_SQL}, {NODES_SQL}, {OPS_SQL}, {walk_sql(OP_STARTS)},
start_of AS (SELECT op_id, prim AS start FROM opx WHERE c IS NOT NULL UNION ALL SELECT op_id, n.node FROM opx JOIN nodes n USING (t) WHERE opx.c IS NULL),
every AS (
  SELECT op_id, prim AS node, 0 AS hops, 1.0::DOUBLE AS weight, [prim] AS path FROM opx
  UNION ALL SELECT op_id, r.node, r.hops, r.weight, r.path FROM start_of JOIN reach r USING (start)
  UNION ALL SELECT op_id, n.node, 7, 0.8::DOUBLE, [prim, n.node] FROM opx JOIN nodes n USING (t)),
hit AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY op_id, node ORDER BY hops, weight DESC, path) AS rn FROM every) WHERE rn = 1),
scored AS (SELECT h.op_id, h.node, h.path, CASE WHEN h.hops > 6 THEN 1 ELSE h.hops END AS hops, o.op_type, o.destructive,
  CASE WHEN len(h.path) = 1 THEN CASE WHEN o.destructive THEN 0.95 ELSE 0.7 END ELSE least(0.999, h.weight * o.mult) END::DOUBLE AS p,
  coalesce(n.is_key, false) AS is_key FROM hit h JOIN opx o USING (op_id) LEFT JOIN nodes n ON n.node = h.node),
effects AS (SELECT *, CASE WHEN NOT destructive THEN 'info' WHEN is_key THEN 'critical' WHEN p > 0.8 THEN 'critical' WHEN p > 0.5 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN regexp_matches(node, 'ETL|job|transform|aggregate') THEN 'etl_failure' WHEN regexp_matches(node, 'quality|score|null|anomaly') THEN 'quality_degradation'
       WHEN regexp_matches(node, 'total|sum|revenue') THEN 'metric_error' ELSE 'cascading' END AS effect_type,
  CASE WHEN split_part(node, '.', 2) IN ('total', 'revenue_total') THEN ['ETL_RevenueAggregation'] WHEN split_part(node, '.', 2) = 'id' THEN ['ETL_JoinMasterData']
       ELSE ['ETL_GeneralTransform_' || upper(split_part(node, '.', 1))] END AS jobs FROM scored)
"""


def _impact(spark, sf):
    return G.impact(_ops(spark, sf), _nodes(spark, sf), _edges(spark, sf), HOPS)


@query("gr07_probability", f"WITH RECURSIVE {EFFECTS} SELECT op_id, node, round(p, 6) AS probability FROM effects")
def gr07(spark, sf):
    return rounded(_impact(spark, sf).select("op_id", "node", "probability"), 6)


@query("gr08_affected", f"WITH RECURSIVE {EFFECTS} SELECT op_id, node FROM hit")
def gr08(spark, sf):
    known = G.describe_ops(_ops(spark, sf))
    return G.affected_nodes(known, _nodes(spark, sf), _edges(spark, sf), HOPS).select("op_id", "node")


@query("gr09_severity", f"WITH RECURSIVE {EFFECTS} SELECT op_type, severity, count(*) AS effects FROM effects GROUP BY 1, 2")
def gr09(spark, sf):
    found = _impact(spark, sf).withColumn("op_type", F.regexp_extract("operation", r"do\((\w+)\(", 1))
    return found.groupBy("op_type", "severity").agg(F.count("*").alias("effects"))


@query(
    "gr10_impact",
    f"WITH RECURSIVE {EFFECTS} SELECT op_id, node, effect_type, round(p, 6) AS probability, severity, hops::INTEGER AS hops, array_to_string(path, '>') AS path, array_to_string(jobs, '|') AS jobs FROM effects",
)
def gr10(spark, sf):
    found = rounded(_impact(spark, sf).drop("operation"), 6)
    return found.withColumn("path", F.array_join("path", ">")).withColumn("jobs", F.array_join("jobs", "|"))


@query(
    "tk04_top_effects",
    f"WITH RECURSIVE {EFFECTS} SELECT op_id, node, round(p, 6) AS probability, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY p DESC, node) AS rank FROM effects) WHERE rank <= 3",
)
def tk04(spark, sf):
    return rounded(G.top_effects(_impact(spark, sf), 3).select("op_id", "node", "probability", "rank"), 6)


@query(
    "gr11_risk",
    f"""WITH RECURSIVE {EFFECTS},
job_first AS (SELECT op_id, job, min(struct_pack(p := -p, node := node)) AS f FROM (SELECT op_id, p, node, unnest(jobs) AS job FROM effects) GROUP BY 1, 2),
job_top AS (SELECT op_id, string_agg(job, '|' ORDER BY rk) AS jobs FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY f, job) AS rk FROM job_first) WHERE rk <= 5 GROUP BY 1)
SELECT op_id, CASE WHEN count(*) FILTER (WHERE severity = 'critical') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (WHERE severity = 'warning') > 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level,
  count(*) AS affected_nodes, count(*) FILTER (WHERE severity = 'critical') AS critical_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count,
  round(max(p) FILTER (WHERE effect_type = 'quality_degradation') * 30, 4) AS quality_loss, any_value(j.jobs) AS jobs FROM effects JOIN job_top j USING (op_id) GROUP BY op_id""",
)
def gr11(spark, sf):
    return rounded(G.change_risk(_impact(spark, sf)).drop("operation")).withColumn("jobs", F.array_join("jobs", "|"))


OUTCOMES = ["revenue_total", "quality_score", "etl_job"]
OUTCOME_SQL = """
asked AS (SELECT e.*, o.outcome, list_bool_or(list_transform(string_split(o.outcome, '_'), lambda w: contains(lower(node), w) OR contains(lower(array_to_string(jobs, ' ')), w))) AS hit
  FROM effects e, (SELECT unnest(['revenue_total', 'quality_score', 'etl_job']) AS outcome) o),
any_hit AS (SELECT op_id, outcome, bool_or(hit) AS found FROM asked GROUP BY 1, 2),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY op_id, outcome ORDER BY p DESC, node) AS rk FROM asked) JOIN any_hit USING (op_id, outcome) WHERE hit OR (NOT found AND rk <= 3))
"""


@query("fi12_outcome_filter", f"WITH RECURSIVE {EFFECTS}, {OUTCOME_SQL} SELECT op_id, outcome, node FROM chosen")
def fi12(spark, sf):
    return G.effects_for_outcome(_impact(spark, sf), OUTCOMES).select("op_id", "outcome", "node")


@query(
    "gr12_whatif",
    f"WITH RECURSIVE {EFFECTS}, {OUTCOME_SQL} SELECT op_id, outcome, round(max(p) * 30, 4) AS quality_loss, count(*) FILTER (WHERE p > 0.5) AS affected, round(max(p) * 0.15, 4) AS metric_error, "
    "round(least(0.95, avg(p) * (0.5 + 0.3 * least(1.0, avg(len(path))))), 3) AS confidence FROM chosen GROUP BY 1, 2",
)
def gr12(spark, sf):
    return rounded(G.what_if(_impact(spark, sf), OUTCOMES))


FACTUAL = (
    "factual AS (SELECT o_orderkey AS op_id, l_quantity * 2.0::DOUBLE AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate < o_orderdate + INTERVAL 45 DAY "
    "QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate DESC, l_quantity DESC) = 1)"
)


@query(
    "gr12_factual",
    f"WITH RECURSIVE {EFFECTS}, {OUTCOME_SQL}, {FACTUAL} SELECT op_id, outcome, round(any_value(score), 4) AS factual, "
    "round(CASE WHEN any_value(score) IS NOT NULL THEN greatest(0.0, any_value(score) - max(p) * 30) END, 4) AS what_if FROM chosen LEFT JOIN factual USING (op_id) GROUP BY 1, 2",
)
def gr12_factual(spark, sf):
    """The score of each order's table when its operation was made, beside the one to expect after it."""
    made = F.col("o_orderdate").cast("timestamp") + F.expr("interval 45 days")
    ops = table(spark, sf, "orders").select(F.col("o_orderkey").alias("op_id"), F.concat(F.lit("orders_"), "o_orderkey").alias("table"), made.alias("run_ts"))
    history = table(spark, sf, "lineitem").select(
        F.concat(F.lit("orders_"), "l_orderkey").alias("table"),
        F.col("l_shipdate").cast("timestamp").alias("run_ts"),
        (F.col("l_quantity") * 2).cast("double").alias("score"),
    )
    expected = G.what_if(_impact(spark, sf), OUTCOMES).join(factual_scores(ops, history), "op_id", "left")
    after = F.when(F.col("factual").isNotNull(), F.greatest(F.lit(0.0), F.col("factual") - F.col("quality_loss")))
    return rounded(expected.select("op_id", "outcome", "factual", after.alias("what_if")))


# ---- measures of the whole graph

SCORES = "scores AS (SELECT concat('supplier_', s_suppkey, '.quality_score') AS node, s_acctbal / 100 AS score FROM supplier UNION ALL SELECT concat('customer_', c_custkey, '.id'), c_acctbal / 100 FROM customer UNION ALL SELECT concat('nation_', n_nationkey, '.id'), 80.0 FROM nation)"


def _scores(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("concat('supplier_', s_suppkey, '.quality_score') AS node", "s_acctbal / 100 AS score")
    c = table(spark, sf, "customer").selectExpr("concat('customer_', c_custkey, '.id') AS node", "c_acctbal / 100 AS score")
    n = table(spark, sf, "nation").selectExpr("concat('nation_', n_nationkey, '.id') AS node", "cast(80 AS double) AS score")
    return s.unionByName(c).unionByName(n)


@query(
    "gr13_graph_metrics",
    f"WITH {LOG_SQL}, {NODES_SQL} SELECT (SELECT count(*) FROM nodes) AS nodes, count(*) AS edges, round(count(*) / ((SELECT count(*) FROM nodes)::DOUBLE * (SELECT count(*) FROM nodes)), 10) AS density, 1.0::DOUBLE AS propagation_efficiency FROM log",
)
def gr13(spark, sf):
    return rounded(G.graph_metrics(_nodes(spark, sf), _edges(spark, sf)), 10)


@query(
    "gr13_fragility",
    f"WITH RECURSIVE {LOG_SQL.replace('strength * confidence', 'strength')}, {NODES_SQL}, {SCORES}, {walk_sql('SELECT node AS start FROM nodes')}, "
    "deps AS (SELECT source AS node, count(*) AS d FROM links GROUP BY 1), crit AS (SELECT s.node, s.score / 100 * coalesce(d, 0) AS k FROM scores s LEFT JOIN deps USING (node)) "
    "SELECT start AS node, round(sum(weight * k), 4) AS fragility FROM reach JOIN crit USING (node) GROUP BY 1",
)
def gr13_fragility(spark, sf):
    return rounded(G.fragility(_nodes(spark, sf), _edges(spark, sf), _scores(spark, sf), HOPS))


ROUNDS = 10
RANK_SQL = (
    f"{LOG_SQL}, {NODES_SQL}, ids AS MATERIALIZED (SELECT DISTINCT node FROM nodes), total AS (SELECT count(*)::DOUBLE AS n FROM ids), "
    "flow AS MATERIALIZED (SELECT target AS f, source AS t, count(*) OVER (PARTITION BY target) AS degree FROM links), "
    "r0 AS (SELECT node, 1.0 / n AS rank FROM ids, total)"
    + "".join(
        f", r{i + 1} AS MATERIALIZED (SELECT ids.node, 0.15 / n + 0.85 * coalesce(g.got, 0) AS rank FROM ids CROSS JOIN total LEFT JOIN "
        f"(SELECT t AS node, sum(rank / degree) AS got FROM flow JOIN r{i} ON f = node GROUP BY 1) g ON g.node = ids.node)"
        for i in range(ROUNDS)
    )
)


@query("gr14_page_rank", f"WITH {RANK_SQL} SELECT node, round(rank * n, 4) AS rank FROM r{ROUNDS}, total")
def gr14(spark, sf):
    nodes = _nodes(spark, sf)
    ranks = G.page_rank(nodes, _edges(spark, sf), ROUNDS, tolerance=0)
    return ranks.select("node", F.round(F.col("rank") * F.lit(nodes.select("node").distinct().count()), 4).alias("rank"))


@query(
    "gr14_weighted_health",
    f"WITH {RANK_SQL}, {SCORES} SELECT count(*) AS columns, round(100 * (1 - sum(rank * (1 - score / 100)) / sum(rank)), 4) AS health FROM r{ROUNDS} JOIN scores USING (node)",
)
def gr14_health(spark, sf):
    ranks = G.page_rank(_nodes(spark, sf), _edges(spark, sf), ROUNDS, tolerance=0)
    issues = _scores(spark, sf).select("node", (1 - F.col("score") / 100).alias("issue_rate"))
    return rounded(G.weighted_health(ranks, issues))


@query(
    "gr15_causal_anomaly",
    f"WITH {LOG_SQL}, {SCORES}, s AS (SELECT source, target, max(strength) AS strength FROM log GROUP BY 1, 2), "
    "par AS (SELECT target AS node, sum(s.strength * p.score) / count(*) AS e FROM s JOIN scores p ON p.node = s.source GROUP BY 1) "
    "SELECT node, round(score, 4) AS actual, round(greatest(0, least(100, coalesce(e, 100))), 4) AS expected, round(abs(score - greatest(0, least(100, coalesce(e, 100)))), 4) AS discrepancy, "
    "abs(score - greatest(0, least(100, coalesce(e, 100)))) > 10 AS is_anomaly FROM scores LEFT JOIN par USING (node)",
)
def gr15(spark, sf):
    return rounded(G.causal_anomalies(_scores(spark, sf), _edges(spark, sf)))


@query(
    "gr16_change_severity",
    f"WITH {OPS_SQL}, reads AS (SELECT concat('job_', l_suppkey) AS job, concat('orders_', l_orderkey, '.', CASE WHEN l_linenumber % 2 = 0 THEN 'id' ELSE 'total' END) AS node FROM lineitem), "
    "js AS (SELECT concat('job_', s_suppkey) AS job, abs(s_acctbal) / 100 AS score, s_nationkey AS dependents FROM supplier), "
    "hit AS (SELECT op_id, job FROM opx JOIN (SELECT DISTINCT job, node FROM reads) r ON r.node = opx.prim) "
    "SELECT o.op_id, round(coalesce(sum(score / 100 * dependents), 0), 6) AS severity, count(js.job) AS jobs FROM opx o LEFT JOIN hit USING (op_id) LEFT JOIN js ON js.job = hit.job GROUP BY 1",
)
def gr16(spark, sf):
    reads = table(spark, sf, "lineitem").selectExpr(
        "concat('job_', l_suppkey) AS job", "concat('orders_', l_orderkey, '.', CASE WHEN l_linenumber % 2 = 0 THEN 'id' ELSE 'total' END) AS node"
    )
    scores = table(spark, sf, "supplier").selectExpr("concat('job_', s_suppkey) AS job", "abs(s_acctbal) / 100 AS score", "s_nationkey AS dependents")
    return rounded(G.change_severity(_ops(spark, sf), reads, scores), 6)


