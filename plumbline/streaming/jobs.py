"""Streaming forms of the batch operators.

Each job reads a stream, and either returns a stream for the caller to write, or
writes per-batch results into a folder named by the batch number, so that a batch that
is retried replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.cleaning import first_rows
from plumbline.operators.logs import LATENCY_BOUNDS, bucket_columns
from plumbline.operators.rules import VIOLATION_SCHEMA, evaluate, failing_rows
from plumbline.operators.scoring import SCORE_MIN
from plumbline.session import small_frame


def read_folder(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.parquet", **options) -> DataFrame:
    """A stream over the Parquet files of a folder, new files as they come."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).options(**options).parquet(folder)


def run_now(writer, wait: bool = True) -> StreamingQuery:
    """Process all that is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


def to_folder(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream to a Parquet folder, each batch once."""
    return run_now(stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint))


def by_batch(
    stream: DataFrame, job: Callable[[DataFrame], DataFrame | None], path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Run a batch job on each micro-batch and store its result under the batch number."""

    def store(batch: DataFrame, number: int) -> None:
        done = job(batch)
        if done is not None:
            done.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run_now(stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", checkpoint))


# ---- windows, rules, freshness, duplicates, alerts


def latency_windows(
    log: DataFrame, ts: str, keys: list[str], value: str, width: str, delay: str, bounds: list[float] = LATENCY_BOUNDS
) -> DataFrame:
    """Request counts and cumulative latency buckets per window and key; a window is given once, when closed."""
    v = F.col(value)
    counted = (
        log.withWatermark(ts, delay)
        .groupBy(F.window(ts, width).alias("w"), *keys)
        .agg(F.count("*").alias("requests"), *bucket_columns(v, bounds), F.sum(v).alias("total"))
    )
    rest = [c for c in counted.columns if c != "w"]
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)


def rule_outcomes(rules: list[dict], table: str) -> Callable[[DataFrame], DataFrame]:
    """Job for ``by_batch``: the fused rule check on one micro-batch."""

    def job(batch: DataFrame) -> DataFrame:
        return small_frame(batch.sparkSession, evaluate(batch, rules, table), VIOLATION_SCHEMA)

    return job


def quarantine(stream: DataFrame, rules: list[dict]) -> DataFrame:
    """The rows that break a row rule, with the rule ids; needs no state."""
    return failing_rows(stream, rules).where(F.size("broken_rules") > 0)


def newest_per_source(stream: DataFrame, key: str, ts: str) -> DataFrame:
    """Running newest time per source; write in complete or update mode."""
    return stream.groupBy(key).agg(F.max(ts).alias("newest"))


def first_per_key(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def score_alerts(limit: float = SCORE_MIN) -> Callable[[DataFrame], DataFrame]:
    """Job for ``by_batch``: alert rows for the scores of one micro-batch below the limit."""

    def job(batch: DataFrame) -> DataFrame:
        low = F.col("score") < limit
        return batch.where(low).select(
            F.col("run_ts").alias("ts"),
            "table",
            F.lit("quality_score").alias("type"),
            F.col("score").alias("value"),
            F.lit(float(limit)).alias("threshold"),
            F.when(F.col("score") < 50, "high").otherwise("medium").alias("severity"),
        )

    return job


# ---- incremental load


def load_changes(stream: DataFrame, log_path: str, checkpoint: str) -> StreamingQuery:
    """Append what is new since the last run to a change log; the checkpoint is the high-water mark."""
    return by_batch(stream, lambda batch: batch, log_path, checkpoint)


def current_rows(spark: SparkSession, log_path: str, keys: list[str], newest: list[Column]) -> DataFrame:
    """The latest version of every key of a change log."""
    log = spark.read.parquet(log_path).drop("batch")
    names = [f"_by{i}" for i in range(len(newest))]
    ranked = log.withColumns(dict(zip(names, newest)))
    return first_rows(ranked, keys, names).drop(*names)


def compact_log(spark: SparkSession, log_path: str, keys: list[str], newest: list[Column], into: str) -> None:
    """Write the latest version of every key as the first batch of a new log; later loads go on there.

    The old log stays as it is until its readers have moved on.
    """
    current_rows(spark, log_path, keys, newest).write.mode("overwrite").parquet(f"{into}/batch=-1")
