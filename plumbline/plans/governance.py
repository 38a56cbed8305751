"""The full run: ingest, profile, score, rules, drift, history, trend, forecast, alerts."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import drift, history, scoring
from plumbline.operators import rules as R
from plumbline.operators.profile import profile
from plumbline.sources import files
from plumbline.sources.tables import append_rows


@dataclass
class Run:
    status: DataFrame
    lineage: DataFrame
    profile: DataFrame
    scores: DataFrame
    alerts: DataFrame
    trends: DataFrame
    health: DataFrame
    snapshot: DataFrame
    changes: DataFrame
    forecast: DataFrame
    violations: DataFrame | None


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def store_drift(spark: SparkSession, snapshot: DataFrame, root: str, load: int, at) -> DataFrame:
    """Compare a snapshot with the last one of each of its tables, store both it and the changes, return the changes.

    Tables that this run has not loaded are left out of the comparison; a table seen for the first time is added.
    """
    before = _stored(spark, f"{root}/snapshots")
    append_rows(snapshot.withColumn("load", F.lit(load)), f"{root}/snapshots")
    new = snapshot if before is None else _stored(spark, f"{root}/snapshots").where(F.col("load") == load)
    if before is None:
        before = snapshot.withColumn("load", F.lit(load)).limit(0)
    earlier = before.where(F.col("load") < load)
    last = earlier.groupBy("table").agg(F.max("load").alias("load"))
    old = earlier.join(last, ["table", "load"]).join(new.select("table").distinct(), "table", "left_semi")
    append_rows(drift.changes(old, new, at).withColumn("load", F.lit(load)), f"{root}/changes")
    return spark.read.parquet(f"{root}/changes").where(F.col("load") == load).drop("load")


def run(
    spark: SparkSession, paths: list[str], layer: str, root: str, run_ts: str, rules: list[dict] | None = None, **profile_options
) -> Run:
    """Ingest files into a layer and record their state below ``root``.

    Logs are append-only folders: ``lineage``, ``profile``, ``history``, ``snapshots`` and ``changes``. A run that is
    repeated appends again under the same ``run_ts`` with a later ``load``; its readers take the latest load.
    """
    status, lineage = files.ingest(spark, paths, layer, f"{root}/{layer}")
    loaded = [r["table"] for r in status.where("status = 'success'").collect()]
    tables = {t: spark.table(t) for t in loaded}
    at = F.lit(run_ts).cast("timestamp")
    found = profile(spark, tables, **profile_options)
    scores = scoring.table_scores(found)
    append_rows(lineage.withColumn("run_ts", at), f"{root}/lineage")
    append_rows(found.withColumn("run_ts", at), f"{root}/profile")
    load = time.time_ns()
    append_rows(scores.select("table", at.alias("run_ts"), "score", "row_count", F.lit(load).alias("load")), f"{root}/history")
    snapshot = drift.snapshot(spark, tables, run_ts)
    log = spark.read.option("mergeSchema", "true").parquet(f"{root}/history")
    past = log.groupBy("table", "run_ts").agg(F.max_by("score", F.coalesce("load", F.lit(0))).alias("score"))
    trends = history.trend(past)
    return Run(
        status,
        lineage,
        found,
        scores,
        scoring.alerts(scores, at),
        trends,
        history.pipeline_health(trends, history.run_anomalies(past)),
        snapshot,
        store_drift(spark, snapshot, root, load, at),
        history.forecast(trends),
        R.violations(spark, tables, rules) if rules else None,
    )
