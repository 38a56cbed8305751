"""Streaming jobs over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.admission import admit
from plumbline.operators.logs import LATENCY_BOUNDS
from plumbline.session import scratch_path
from plumbline.streaming import jobs as S
from plumbline.streaming.admission import admit_all
from plumbline.streaming.uniqueness import outcome, store_changes
from plumbline.workloads.registry import query, rounded, table

RULES = [
    {"id": "value_range", "type": "range_check", "field": "value", "min": 1, "max": 40, "severity": "critical"},
    {"id": "type_enum", "type": "enum_check", "field": "event_type", "allowed_values": ["view", "click", "purchase"], "severity": "warning"},
]
LIMIT, WINDOW = 2, 6 * 3600
#: Batches of events, dealt by hash, that the admission stream reads one after the other.
BATCHES = 5


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = S.read_folder(spark, sf, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _in_batches(spark, sf, path):
    """The events dealt over files by hash, as a stream of ``BATCHES`` batches."""
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    files = max(BATCHES, events.rdd.getNumPartitions())
    events.repartition(files, "event_id").write.parquet(path)
    return S.read_folder(spark, path, events.schema, maxFilesPerTrigger=-(-files // BATCHES))


def _paths(spark, name):
    root = scratch_path(spark, name)
    return f"{root}/out", f"{root}/checkpoint"


ADMISSION_SQL = f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (
  SELECT event_id, user_id, rn, [t] AS held, true AS accepted FROM e WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, rn, CASE WHEN len(kept) < {LIMIT} THEN list_append(kept, t) ELSE kept END, len(kept) < {LIMIT}
  FROM (SELECT e.event_id, e.user_id, e.rn, e.t, list_filter(f.held, lambda x: x > e.t - {WINDOW}000000) AS kept FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT event_id, user_id, accepted, ({LIMIT} - len(held))::INTEGER AS remaining FROM f
"""


@query("st01_admission_batch", ADMISSION_SQL)
def st01(spark, sf):
    found = admit(table(spark, sf, "events"), "user_id", "ts", "event_id", LIMIT, WINDOW)
    return found.select("event_id", "user_id", "accepted", "remaining")


@query("st01_admission_stream", ADMISSION_SQL)
def st01_stream(spark, sf):
    """Files of shuffled events, one a batch, decided in the order of time."""
    out, checkpoint = _paths(spark, "st01")
    root = scratch_path(spark, "st01_in")
    stream = _in_batches(spark, sf, f"{root}/events")
    admit_all(
        spark, stream, out, checkpoint, f"{root}/beats", key="user_id", ts="ts", tie="event_id", limit=LIMIT, window_sec=WINDOW,
        delay="3650 days", bucket_sec=WINDOW,
    )
    return spark.read.parquet(out).select("event_id", "user_id", "accepted", "remaining")


BUCKETS_SQL = ", ".join(f"count(*) FILTER (WHERE seconds <= {b}) AS le_{i + 1}" for i, b in enumerate(LATENCY_BOUNDS))


@query(
    "st02_histogram",
    "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS requests, "
    f"{BUCKETS_SQL}, round(sum(seconds), 4) AS total FROM (SELECT *, value / 10 AS seconds FROM events) GROUP BY 1, 2, 3 "
    "HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
)
def st02(spark, sf):
    out, checkpoint = _paths(spark, "st02")
    log = _events(spark, sf).withColumn("seconds", F.col("value") / 10)
    S.to_folder(S.latency_windows(log, "ts", ["event_type"], "seconds", "1 hour", "10 minutes"), out, checkpoint)
    return rounded(spark.read.parquet(out))


@query(
    "st03_rule_outcomes",
    "SELECT 'value_range' AS rule_id, count(*) FILTER (WHERE value < 1 OR value > 40) AS failed_count, count(value) AS total_count FROM events "
    "UNION ALL SELECT 'type_enum', count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase')), count(event_type) FROM events",
)
def st03(spark, sf):
    out, checkpoint = _paths(spark, "st03")
    S.by_batch(_events(spark, sf), S.rule_outcomes(RULES, "events"), out, checkpoint)
    found = spark.read.parquet(out)
    return found.groupBy("rule_id").agg(F.sum("failed_count").alias("failed_count"), F.sum("total_count").alias("total_count"))


@query(
    "st03_quarantine",
    "SELECT event_id, concat_ws('|', CASE WHEN value < 1 OR value > 40 THEN 'value_range' END, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'type_enum' END) AS broken_rules "
    "FROM events WHERE value < 1 OR value > 40 OR event_type NOT IN ('view', 'click', 'purchase')",
)
def st03_quarantine(spark, sf):
    out, checkpoint = _paths(spark, "st03q")
    S.to_folder(S.quarantine(_events(spark, sf), RULES), out, checkpoint)
    return spark.read.parquet(out).select("event_id", F.array_join("broken_rules", "|").alias("broken_rules"))


@query(
    "st03_uniqueness",
    "SELECT count(*) FILTER (WHERE n > 1) AS duplicated_values, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS duplicated_rows, sum(n)::BIGINT AS total_count "
    "FROM (SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)",
)
def st03_unique(spark, sf):
    out, checkpoint = _paths(spark, "st03u")
    stream = _in_batches(spark, sf, scratch_path(spark, "st03_in"))
    store_changes(spark, stream, "user_id", out, checkpoint)
    return outcome(spark, out)


@query(
    "st04_freshness_lag",
    "SELECT event_type, round((epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(max(ts))) / 60000000.0, 4) AS lag_minutes FROM events GROUP BY 1",
)
def st04(spark, sf):
    out, checkpoint = _paths(spark, "st04")
    S.by_batch(S.newest_per_source(_events(spark, sf), "event_type", "ts"), lambda b: b, out, checkpoint, mode="update")
    newest = spark.read.parquet(out).groupBy("event_type").agg(F.max("newest").cast("timestamp").alias("newest"))
    as_of = F.lit("2024-06-01 00:00:00").cast("timestamp")
    lag = (F.unix_micros(as_of) - F.unix_micros("newest")) / 60_000_000
    return newest.select("event_type", F.round(lag, 4).alias("lag_minutes"))


@query("st05_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def st05(spark, sf):
    out, checkpoint = _paths(spark, "st05")
    S.to_folder(S.first_per_key(_events(spark, sf), ["user_id", "event_type"], "ts", "60 days"), out, checkpoint)
    return spark.read.parquet(out).select("user_id", "event_type")


HISTORY = "(SELECT event_type AS \"table\", CAST(ts AS DATE) AS run_ts, round(avg(value) * 1.3, 6) AS score FROM events GROUP BY 1, 2)"


@query(
    "st06_alerts",
    f"SELECT run_ts AS ts, \"table\", 'quality_score' AS type, score AS value, 70.0::DOUBLE AS threshold, CASE WHEN score < 50 THEN 'high' ELSE 'medium' END AS severity FROM {HISTORY} WHERE score < 70",
)
def st06(spark, sf):
    root = scratch_path(spark, "st06")
    history = (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("table"), F.to_date("ts").alias("run_ts"))
        .agg(F.round(F.avg("value") * 1.3, 6).alias("score"))
    )
    history.write.parquet(f"{root}/history")
    runs = S.read_folder(spark, f"{root}/history", history.schema)
    S.by_batch(runs, S.score_alerts(), f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").drop("batch")


@query(
    "st07_incremental_load",
    "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
)
def st07(spark, sf):
    root = scratch_path(spark, "st07")
    events = table(spark, sf, "events")
    middle = events.agg((F.min("event_id") + F.max("event_id")) / 2).first()[0]
    halves = [events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle)]
    for half in halves:  # the second load sees only what came after the first
        half.write.mode("append").parquet(f"{root}/in")
        S.load_changes(S.read_folder(spark, f"{root}/in", events.schema), f"{root}/log", f"{root}/checkpoint")
    newest = [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]
    return S.current_rows(spark, f"{root}/log", ["user_id"], newest).select("user_id", "event_id", "value")
