"""Sliding-window admission on a stream, in the order of event times.

A decision depends on all earlier ones, so an event waits until the watermark has passed the time
bucket it lies in. The few events that wait in most keys are one state value with one timer, and
when it fires all of them that the watermark has passed are sorted and folded into the times
accepted so far. Where more than a page of events waits, they go to a map state by bucket, in pages
of bounded size, and each bucket has a timer at its end: when it fires, that bucket alone is read.
So decisions are those of the batch form, however events were cut into batches and in whatever
order they came within the delay.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.operators.admission import MICROS, fold

#: Events of a key that wait in one state value; those of a key with more lie in pages of at most as many and one more.
PAGE = 1000
BUCKET_SEC = 60
#: A heartbeat of this time lets all waiting events be decided.
END_OF_TIME = datetime(9999, 1, 1, tzinfo=timezone.utc)
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Admit(StatefulProcessor):
    """Decisions of one key; events come and go as rows that end in ``_t``, the time in microseconds.

    ``held`` is all the state of a key with at most ``page`` events waiting: its next timer, the times
    accepted so far and the events, read and written once a batch. A key with more has them in pages,
    ``buckets`` of which wait, until all are decided.
    """

    def __init__(self, schema: T.StructType, tie: str, limit: int, window: int, bucket: int, page: int):
        self.schema, self.tie, self.limit, self.window, self.bucket, self.page = schema, tie, limit, window, bucket, page

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows = T.StructField("rows", T.ArrayType(self.schema))
        count, times = T.LongType(), T.ArrayType(T.LongType())
        before = [T.StructField("due", count), T.StructField("buckets", count), T.StructField("times", times)]
        self.held = handle.getValueState("held", T.StructType([*before, rows]))
        self.waiting = handle.getMapState("waiting", "bucket long, page int", T.StructType([rows]))
        self.pages = handle.getMapState("pages", "bucket long", "n int")

    def _load(self) -> tuple[int | None, int, list[int], list[tuple]]:
        due, buckets, times, rows = self.held.get() or (None, 0, [], [])
        return due, buckets, list(times), [tuple(r) for r in rows]

    def _end(self, time: int) -> int:
        """When the bucket of a time ends, in milliseconds."""
        return (time // self.bucket + 1) * self.bucket // 1000

    def _spread(self, rows: list[tuple]) -> int:
        """Write events to the pages of their buckets; how many of these are new."""
        by_bucket: dict[int, list[tuple]] = defaultdict(list)
        for row in rows:
            by_bucket[row[-1] // self.bucket].append(row)
        new = 0
        for bucket, some in by_bucket.items():
            n = (self.pages.getValue((bucket,)) or (0,))[0]
            self.waiting.updateValue((bucket, n), (some,))
            self.pages.updateValue((bucket,), (n + 1,))
            if n == 0:
                self.handle.registerTimer((bucket + 1) * self.bucket // 1000)
                new += 1
        return new

    def _save(self, due: int | None, buckets: int, times: list[int], rows: list[tuple]) -> None:
        """Write the state with a timer for what waits, or, if nothing does, for the last time that counts."""
        if buckets:  # they have timers of their own
            due = None
        elif rows or times:
            wanted = self._end(min(r[-1] for r in rows)) if rows else -(-(times[-1] + self.window) // 1000)
            if wanted != due:
                if due is not None:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(wanted)
            due = wanted
        else:
            if due is not None:
                self.handle.deleteTimer(due)
            self.held.clear()
            return
        self.held.update((due, buckets, times, rows))

    def _decide(self, rows: list[tuple], times: list[int], upto: int) -> Iterator[Row]:
        """Decisions on rows, the next of the key; of ``times`` those stay that count after ``upto``."""
        names = self.schema.names
        tie = names.index(self.tie)
        rows.sort(key=lambda r: (r[-1], r[tie] is not None, r[tie]))
        accepted = deque(times)
        ok, left = fold(np.array([r[-1] for r in rows], np.int64), accepted, self.limit, self.window)
        times[:] = [int(t) for t in accepted if t > upto - self.window]
        out = Row(*names, "accepted", "remaining")
        return (out(*row, a, b) for row, a, b in zip(rows, ok.tolist(), left.tolist()))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # a heartbeat only moves the watermark
            return iter(())
        due, buckets, times, some = self._load()
        for row in rows:
            some.append(tuple(row))
            if len(some) > self.page:
                buckets += self._spread(some)
                some = []
        if buckets and some:
            buckets += self._spread(some)
            some = []
        self._save(due, buckets, times, some)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due, buckets, times, rows = self._load()
        if buckets:
            bucket = at * 1000 // self.bucket - 1
            pages = self.pages.getValue((bucket,))
            if pages is None:  # a timer from before there were pages
                return iter(())
            for n in range(pages[0]):
                rows += [tuple(r) for r in self.waiting.getValue((bucket, n))[0]]
                self.waiting.removeKey((bucket, n))
            self.pages.removeKey((bucket,))
            upto, buckets, found, rows = at, buckets - 1, rows, []
        else:
            # All that the watermark has passed, so that the timers in between need not be set.
            upto = max(at, timerValues.getCurrentWatermarkInMs())
            found = [r for r in rows if self._end(r[-1]) <= upto]
            rows = [r for r in rows if self._end(r[-1]) > upto]
        decided = self._decide(found, times, upto * 1000)
        self._save(None if due is None or due <= at else due, buckets, times, rows)
        return decided

    def close(self) -> None:
        pass


def admit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    tie: str,
    limit: int,
    window_sec: int,
    delay: str,
    heartbeats: DataFrame | None = None,
    bucket_sec: int = BUCKET_SEC,
) -> DataFrame:
    """Add ``accepted`` and ``remaining`` to the events of a stream, once the watermark has passed them.

    Equal to ``operators.admission.admit`` for all events that are at most ``delay`` late; later
    ones are left out, as their decision is past. Events without a key or a time come out undecided.
    ``heartbeats(ts)`` is a stream whose times move the watermark on where events do not, at the
    end of the data, say. The state store must be RocksDB: start the query within ``rocksdb_state``.
    """
    known = F.col(key).isNotNull() & F.col(ts).isNotNull()
    timed = events.where(known)
    if heartbeats is not None:
        beats = heartbeats.where(F.col(ts).isNotNull())
        timed = timed.unionByName(beats.select(ts), allowMissingColumns=True)
    # The time goes along as a number, so that no time zone comes between it and the watermark.
    timed = timed.withWatermark(ts, delay).withColumn("_t", F.unix_micros(ts))
    state = T.StructType([T.StructField(f.name, f.dataType) for f in timed.schema])
    out = T.StructType([*state, T.StructField("accepted", T.BooleanType()), T.StructField("remaining", T.IntegerType())])
    processor = _Admit(state, tie, limit, window_sec * MICROS, bucket_sec * MICROS, PAGE)
    decided = timed.groupBy(key).transformWithState(processor, out, "Append", "EventTime").drop("_t")
    undecided = events.where(~known).withColumns({"accepted": F.lit(None).cast("boolean"), "remaining": F.lit(None).cast("int")})
    return decided.unionByName(undecided)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own store comes back after it."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def heartbeat_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The heartbeats in a folder, which ``beat`` creates."""
    return spark.readStream.schema("ts timestamp").parquet(folder)


def beat(spark: SparkSession, folder: str, at: datetime | None = None) -> None:
    """Write a heartbeat; none to create the folder for them."""
    spark.createDataFrame([] if at is None else [(at,)], "ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def admit_all(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, beats: str, **options) -> None:
    """Decide all that a stream holds now and has held back, into a Parquet folder, and close its time.

    The first run reads the events; a heartbeat after it lets the second, which goes on from the
    same checkpoint, decide those that are still waiting.
    """
    beat(spark, beats)
    for last in (False, True):
        if last:
            beat(spark, beats, END_OF_TIME)
        heartbeats = heartbeat_stream(spark, beats).withColumnRenamed("ts", options["ts"])
        decided = admit_stream(events, heartbeats=heartbeats, **options)
        with rocksdb_state(spark):
            writer = decided.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            writer.trigger(availableNow=True).start().awaitTermination()
