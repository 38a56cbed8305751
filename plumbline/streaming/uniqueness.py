"""Uniqueness on a stream: how often each value has come is kept as state across batches.

A batch gives what it changes: values that have become duplicates, rows that hold one, and rows
with a value. So the changes of any batches add up to what one batch of all rows gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.admission import rocksdb_state
from plumbline.streaming.jobs import by_batch

CHANGES = "duplicated_values long, duplicated_rows long, total_count long"


class _Count(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.seen.get()[0] if self.seen.exists() else 0
        more = sum(map(len, rows))
        new = old + more
        self.seen.update((new,))
        values = int(new > 1) - int(old > 1)
        held = (new if new > 1 else 0) - (old if old > 1 else 0)
        yield pd.DataFrame({"duplicated_values": [values], "duplicated_rows": [held], "total_count": [more]})

    def close(self) -> None:
        pass


def duplicate_changes(stream: DataFrame, field: str) -> DataFrame:
    """A row of changes for each value of a batch; rows without a value take no part."""
    present = stream.where(F.col(f"`{field}`").isNotNull()).select(F.col(f"`{field}`").alias("value"))
    return present.groupBy("value").transformWithStateInPandas(_Count(), CHANGES, "Update", "None")


def store_changes(spark: SparkSession, stream: DataFrame, field: str, path: str, checkpoint: str) -> None:
    """One row of changes per batch below ``path``; a batch that is retried replaces its own."""
    total = [F.sum(c.split()[0]).alias(c.split()[0]) for c in CHANGES.split(", ")]
    with rocksdb_state(spark):
        by_batch(duplicate_changes(stream, field), lambda batch: batch.agg(*total).coalesce(1), path, checkpoint, "update")


def outcome(spark: SparkSession, path: str) -> DataFrame:
    """Duplicated values, rows that hold one, and rows with a value, over all batches so far."""
    names = [c.split()[0] for c in CHANGES.split(", ")]
    return spark.read.parquet(path).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
