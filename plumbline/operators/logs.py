"""Request logs: counts, latency histograms, and how fresh each source is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the latency buckets, in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def endpoint_template(path: Column) -> Column:
    """A path segment that is not alphabetic (dots aside) becomes ``{id}``, so that one endpoint is one key."""
    parts = F.split(path, "/")
    word = F.lit(r"^[\p{L}.]*\p{L}[\p{L}.]*$")
    shown = F.transform(parts, lambda p: F.when((p == "") | F.rlike(p, word), p).otherwise("{id}"))
    return F.array_join(shown, "/")


def bucket_columns(value: Column, bounds: list[float] = LATENCY_BOUNDS) -> list[Column]:
    """Cumulative bucket counts with their names ``le_1`` .. ``le_n`` in the order of the bounds."""
    return [F.count_if(value <= b).alias(f"le_{i + 1}") for i, b in enumerate(bounds)]


def latency_histogram(log: DataFrame, keys: list[str | Column], value: str, bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    v = F.col(value)
    return log.groupBy(*keys).agg(F.count("*").alias("requests"), *bucket_columns(v, bounds), F.sum(v).alias("total"))


def freshness_minutes(df: DataFrame, key: str, ts: str, as_of: Column) -> DataFrame:
    """Minutes between ``as_of`` and the newest row of each source."""
    newest = F.max(F.col(ts).cast("timestamp"))
    lag = (F.unix_micros(as_of) - F.unix_micros(newest)) / 60_000_000
    return df.groupBy(key).agg(lag.alias("lag_minutes"))
