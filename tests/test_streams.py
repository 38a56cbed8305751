"""Streams against their batch forms, with events out of order and over several batches."""

import random
from collections import Counter, deque

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from plumbline.operators import admission as A
from plumbline.operators import rules as R
from plumbline.streaming import admission as SA
from plumbline.streaming import jobs as S
from plumbline.streaming import uniqueness as SU


def shuffled(spark, rows, path, files):
    """The rows dealt at random over files, which a stream reads one by one."""
    random.Random(3).shuffle(rows)
    size = -(-len(rows) // files)
    for n in range(files):
        some = spark.createDataFrame(rows[n * size : (n + 1) * size], "k string, s long, i long, note string")
        some.select("k", F.timestamp_seconds("s").alias("at"), "i", "note").coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path):
    return S.read_folder(spark, path, spark.read.parquet(path).schema, maxFilesPerTrigger=1)


def test_admission_of_shuffled_events_equals_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SA, "PAGE", 7)
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}", rnd.randrange(3000), i, None) for i in range(500)]
    rows += [(None, 5, 900, "no key"), ("hot", None, 901, "no time"), ("hot", 100, 902, "x"), ("hot", 100, 902, "x")]
    data, out, cp, beats = (str(tmp_path / p) for p in ("in", "out", "cp", "beats"))
    shuffled(spark, rows, data, 5)
    options = {"key": "k", "ts": "at", "tie": "i", "limit": 3, "window_sec": 30}
    SA.admit_all(spark, stream_of(spark, data), out, cp, beats, delay="2 hours", bucket_sec=10, **options)
    want = A.admit(spark.read.parquet(data), **options)
    columns = ["k", "at", "i", "note", "accepted", "remaining"]
    got = spark.read.parquet(out)
    assert got.columns == columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(columns).collect()))


def test_admission_decides_as_the_watermark_goes(spark, tmp_path):
    data, out, cp, beats = (str(tmp_path / p) for p in ("in", "out", "cp", "beats"))
    options = {"key": "k", "ts": "at", "tie": "i", "limit": 1, "window_sec": 60}

    def run():
        decided = SA.admit_stream(stream_of(spark, data), delay="100 seconds", heartbeats=None, bucket_sec=10, **options)
        with SA.rocksdb_state(spark):
            S.to_folder(decided, out, cp)
        return {r["i"]: r["accepted"] for r in spark.read.parquet(out).collect()}

    shuffled(spark, [("a", 1000, 1, ""), ("a", 1030, 2, "")], data, 1)
    assert run() == {}  # the watermark stands at 930
    # An earlier event comes later, and still counts first.
    shuffled(spark, [("a", 990, 3, ""), ("b", 1145, 4, "")], data, 1)
    assert run() == {3: True, 1: False, 2: False}
    # What lies before the watermark is left out.
    shuffled(spark, [("a", 900, 5, ""), ("a", 1200, 6, "")], data, 1)
    assert 5 not in run()


class Store:
    """A handle with its states in memory, which counts the calls."""

    def __init__(self):
        self.timers, self.calls = set(), 0

    def getValueState(self, name, schema):
        store, held = self, {}

        class Value:
            def get(self):
                store.calls += 1
                return held.get(0)

            def update(self, value):
                store.calls += 1
                held[0] = value

            def exists(self):
                store.calls += 1
                return 0 in held

            def clear(self):
                store.calls += 1
                held.clear()

        return Value()

    def getMapState(self, name, key, value):
        store, held = self, {}

        class Map:
            def getValue(self, key):
                store.calls += 1
                return held.get(key)

            def containsKey(self, key):
                store.calls += 1
                return key in held

            def updateValue(self, key, value):
                store.calls += 1
                held[key] = value

            def removeKey(self, key):
                store.calls += 1
                del held[key]

            def exists(self):
                store.calls += 1
                return bool(held)

        return Map()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


def admitted(times, batches, watermarks, page=1000):
    """Decisions of one key on times in seconds by limit 2 in 30 seconds, the state calls made, and what timers stay."""
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("_t", T.LongType())])
    args = [schema, "i", 2, 30 * A.MICROS, 10 * A.MICROS, page]
    processor, store = SA._Admit(*args[: SA._Admit.__init__.__code__.co_argcount - 1]), Store()
    processor.init(store)
    rows, found = list(enumerate(times)), {}
    for n, mark in enumerate([*[None] * (batches - len(watermarks)), *watermarks]):
        some = [Row(i=i, _t=t * A.MICROS) for i, t in rows[n::batches]]
        list(processor.handleInputRows(("k",), iter(some), None))
        while mark is not None and (due := sorted(t for t in store.timers if t <= mark * 1000)):
            store.timers.discard(due[0])
            timers = TimerValues(0, mark * 1000)
            found |= {r["i"]: (r["accepted"], r["remaining"]) for r in processor.handleExpiredTimer(("k",), timers, ExpiredTimerInfo(due[0]))}
    return found, store.calls, store.timers


def test_admission_takes_few_calls_for_a_key_with_few_events():
    times = random.Random(4).sample(range(100_000), 60)
    order = sorted(range(60), key=lambda i: times[i])
    ok, left = A.fold(np.array([times[i] * A.MICROS for i in order]), deque(), 2, 30 * A.MICROS)
    found, calls, timers = admitted(times, 5, [10**9])
    assert found == {i: (bool(a), int(b)) for i, a, b in zip(order, ok, left)}
    assert not timers
    assert calls < 60  # there were some fifteen for each event


def test_admission_in_pages_equals_admission_in_one_value():
    rnd = random.Random(8)
    for _ in range(40):
        times = sorted(rnd.randrange(400) for _ in range(rnd.randrange(1, 60)))
        near = [t + rnd.randrange(40) for t in times]
        few, _, none = admitted(near, 1, [10**9])
        assert len(few) == len(near) and not none
        for page in (1, 7, 1000):
            found, _, none = admitted(near, 1, [10**9], page)
            assert found == few and not none
            whole, _, none = admitted(near, 3, [10**9], page)
            assert whole == few and not none


def test_uniqueness_over_batches_equals_one_batch(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(None if i % 11 == 0 else f"k{rnd.randrange(150)}" if i % 3 else "hot", i, i, None) for i in range(300)] + [("once", 1, 1, None)]
    data, out, cp = (str(tmp_path / p) for p in ("in", "out", "cp"))
    shuffled(spark, rows, data, 5)
    SU.store_changes(spark, stream_of(spark, data), "k", out, cp)
    want = R._duplicates(spark.read.parquet(data), "k")
    assert tuple(SU.outcome(spark, out).first()) == (want["v"], want["r"], want["n"])
    assert spark.read.parquet(out).select("batch").distinct().count() >= 5
    # More data later goes on from the state kept.
    shuffled(spark, [("once", 5, 5, None), ("new", 6, 6, None)], data, 1)
    SU.store_changes(spark, stream_of(spark, data), "k", out, cp)
    want = R._duplicates(spark.read.parquet(data), "k")
    assert tuple(SU.outcome(spark, out).first()) == (want["v"], want["r"], want["n"])
