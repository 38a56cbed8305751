"""Score history: trend, anomalies, forecast, and pipeline health.

``history(table, run_ts, score, ...)`` may hold any number of runs. Every window here
keeps only the latest few runs of a series; that limit acts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TREND_RUNS, MIN_TREND_RUNS = 5, 3
ANOMALY_RUNS, MIN_ANOMALY_RUNS = 6, 4
STEADY = 0.1


def _latest(history: DataFrame, n: int, key: str = "table") -> DataFrame:
    """The latest n runs of each series, ``back`` = 1 for the newest; of one time, the higher score is the newer."""
    order = Window.partitionBy(key).orderBy(F.desc("run_ts"), F.desc("score"))
    return history.withColumn("back", F.row_number().over(order)).where(F.col("back") <= n)


def _clip(score: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), score))


def trend(history: DataFrame) -> DataFrame:
    """Least-squares line over the last five runs, its next value, and the direction."""
    recent = _latest(history, TREND_RUNS)
    size = F.count("*").over(Window.partitionBy("table"))
    placed = recent.withColumn("n", size).withColumn("x", (F.col("n") - F.col("back")).cast("double"))
    fit = placed.groupBy("table").agg(
        F.count("*").alias("runs"),
        F.max_by("score", F.struct("run_ts", "score")).alias("current"),
        F.regr_slope("score", "x").alias("slope"),
        F.regr_intercept("score", "x").alias("intercept"),
    )
    enough = F.col("runs") >= MIN_TREND_RUNS
    direction = (
        F.when(~enough, "insufficient_data")
        .when(F.col("slope") > STEADY, "improving")
        .when(F.col("slope") < -STEADY, "declining")
        .otherwise("stable")
    )
    next_value = F.when(enough, _clip(F.col("slope") * F.col("runs") + F.col("intercept"))).otherwise(F.col("current"))
    return fit.select(
        "table",
        "runs",
        "current",
        F.when(enough, F.col("slope")).otherwise(0.0).alias("slope"),
        next_value.alias("predicted"),
        direction.alias("direction"),
    )


def run_anomalies(history: DataFrame) -> DataFrame:
    """Among the last six runs, those outside the quartile bounds of these runs."""
    recent = _latest(history, ANOMALY_RUNS).groupBy("table").agg(
        F.sort_array(F.collect_list("score")).alias("scores"), F.collect_list(F.struct("run_ts", "score")).alias("runs")
    )
    n = F.size("scores")
    bounds = (
        recent.where(n >= MIN_ANOMALY_RUNS)
        .withColumn("q1", F.get("scores", F.floor(n / 4).cast("int")))
        .withColumn("q3", F.get("scores", F.floor(3 * n / 4).cast("int")))
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    )
    low, high = F.col("q1") - 1.5 * F.col("iqr"), F.col("q3") + 1.5 * F.col("iqr")
    rows = bounds.select("table", "q1", "q3", "iqr", low.alias("lower"), high.alias("upper"), F.inline("runs"))
    far = F.abs(F.col("score") - (F.col("q1") + F.col("q3")) / 2) > 2 * F.col("iqr")
    return rows.where((F.col("score") < F.col("lower")) | (F.col("score") > F.col("upper"))).select(
        "table",
        "run_ts",
        "score",
        "lower",
        "upper",
        F.when(F.col("score") < F.col("lower"), "low").otherwise("high").alias("type"),
        F.when(far, "critical").otherwise("warning").alias("severity"),
    )


def forecast(trends: DataFrame, runs: int = 3) -> DataFrame:
    """Expected score and confidence for each of the next runs, where a trend is known."""
    ahead = F.explode(F.sequence(F.lit(1), F.lit(runs)))
    return (
        trends.where(F.col("direction") != "insufficient_data")
        .select("table", "predicted", "slope", ahead.alias("run_offset"))
        .select(
            "table",
            "run_offset",
            F.round("predicted", 1).alias("predicted_score"),
            F.round(
                F.greatest(F.lit(50.0), 95 - 10 * F.col("run_offset") - 5 * F.abs("slope")), 1
            ).alias("confidence"),
        )
    )


def run_deltas(history: DataFrame) -> DataFrame:
    """Latest run of each series against the one before, with the mean of the last seven."""
    recent = _latest(history, 7)
    parts = recent.groupBy("table").agg(
        F.max(F.when(F.col("back") == 1, F.col("score"))).alias("latest"),
        F.max(F.when(F.col("back") == 2, F.col("score"))).alias("before"),
        F.avg("score").alias("mean_last_7"),
    )
    delta = F.col("latest") - F.coalesce("before", "latest")
    arrow = F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same")
    return parts.select("table", "latest", delta.alias("delta"), arrow.alias("arrow"), "mean_last_7")


def display_runs(history: DataFrame, n: int = 10) -> DataFrame:
    return _latest(history, n)


def pipeline_health(trends: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Health of each series with recommendation codes."""
    count = anomalies.groupBy("table").agg(F.count("*").alias("anomalies"))
    joined = trends.join(count, "table", "left").fillna({"anomalies": 0})
    steady = F.col("direction").isin("improving", "stable") & (F.col("anomalies") == 0)
    codes = F.filter(
        F.array(
            F.when(F.col("direction") == "declining", "check_sources"),
            F.when(F.col("anomalies") > 0, "check_anomalies"),
            F.when(F.col("current") < 90, "add_validation_rules"),
            F.when(F.col("predicted") < F.col("current") - 5, "expect_decline"),
        ),
        lambda x: x.isNotNull(),
    )
    return joined.select(
        "table",
        "direction",
        "anomalies",
        F.when(steady, "healthy").otherwise("degraded").alias("health"),
        F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("keep_monitoring"))).alias("recommendations"),
    )
