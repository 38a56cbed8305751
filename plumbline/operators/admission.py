"""Sliding-window admission per key, over stored events.

An event is accepted when fewer than ``limit`` accepted events of its key lie in
(t - window, t]. Acceptance depends on earlier acceptance, so it is a fold in time
order. A pause of a whole window empties the state: keys are cut there into runs that
fold independently and spread over tasks. Rows stream through a task in sorted order
with at most ``limit`` times of state; no group is ever held in memory.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.operators.ordered import CHUNK, join_carry, with_chunks

MICROS = 1_000_000


def fold(times: np.ndarray, accepted: deque, limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Decisions and remaining places for sorted times in microseconds; ``accepted`` is the state."""
    ok = np.zeros(len(times), dtype=bool)
    left = np.zeros(len(times), dtype="int32")
    for i, t in enumerate(times):
        while accepted and accepted[0] <= t - window:
            accepted.popleft()
        if len(accepted) < limit:
            accepted.append(t)
            ok[i] = True
        left[i] = limit - len(accepted)
    return ok, left


def run_starts(df: DataFrame, key: str, ts: str, tie: str, window: int, chunks: int | None) -> DataFrame:
    """Add ``_t``, the time in microseconds, and ``_run``, when the current uninterrupted run of the key began."""
    timed = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    cut = with_chunks(timed, [key], ["_t", tie], chunks)
    inside = Window.partitionBy(key, CHUNK).orderBy("_t", tie)
    by_key = Window.partitionBy(key).orderBy(CHUNK)
    ends = cut.groupBy(key, CHUNK).agg(F.max("_t").alias("_end"))
    placed = join_carry(cut.withColumn("_prev", F.lag("_t").over(inside)), ends, [key], {"_before": F.lag("_end").over(by_key)})
    placed = placed.withColumn("_prev", F.coalesce("_prev", "_before")).drop("_before")
    opens = F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= window)
    opened = placed.withColumn("_open", F.when(opens, F.col("_t"))).drop("_prev")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ends = opened.groupBy(key, CHUNK).agg(F.max("_open").alias("_end"))
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    runs = join_carry(opened.withColumn("_run", F.max("_open").over(upto)), ends, [key], {"_earlier": F.max("_end").over(earlier)})
    return runs.withColumn("_run", F.coalesce("_run", "_earlier")).drop("_earlier", "_open", CHUNK)


def admit(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    limit: int,
    window_sec: int,
    chunks: int | None = None,
) -> DataFrame:
    """Add ``accepted`` and ``remaining`` to every event; both are null for events without a key or a time."""
    window = window_sec * MICROS
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    runs = run_starts(df.where(known), key, ts, tie, window, chunks)
    placed = runs.repartition(key, "_run").sortWithinPartitions(key, "_run", "_t", tie)
    schema = T.StructType(
        [*placed.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("remaining", T.IntegerType())]
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, deque()
        for batch in batches:
            if batch.empty:
                continue
            ok = np.zeros(len(batch), dtype=bool)
            left = np.zeros(len(batch), dtype="int32")
            change = (batch[key].ne(batch[key].shift()) | batch["_run"].ne(batch["_run"].shift())).to_numpy()
            edges = [*np.flatnonzero(change), len(batch)]
            times = batch["_t"].to_numpy()
            for a, b in zip(edges, edges[1:]):
                group = (batch[key].iat[a], batch["_run"].iat[a])
                if group != current:
                    current, state = group, deque()
                ok[a:b], left[a:b] = fold(times[a:b], state, limit, window)
            yield batch.assign(accepted=ok, remaining=left)

    decided = placed.mapInPandas(decide, schema).drop("_t", "_run")
    undecided = df.where(~known).withColumns({"accepted": F.lit(None).cast("boolean"), "remaining": F.lit(None).cast("int")})
    return decided.unionByName(undecided)
