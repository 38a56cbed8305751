"""How far the sources of a language lie apart in their terms, by a tree of term rows.

Every kept term has a row: its counts in the sources that have it, in the order of the sources.
A smoothed share ``p`` stands for each count, and ``p0`` for no occurrence. The distance of two
sources is the sum of ``|p - q|`` over all kept terms, put together from

* a base, as if no term occurred in either of them: ``V * |p0 - q0|``,
* for the terms of one source, what replacing its ``p0`` by ``p`` changes; equal counts count once,
* for terms of both, a correction, since both replacements were made as if the other had none.

Only the last needs the rows. They go into a prefix tree with their multiplicities: a node is a
source with a count below those of earlier sources, and terms whose rows begin alike share it,
so that each node corrects each of its ancestors once for all its terms. Sorted rows are dealt
to tasks by ranges, so that shared beginnings meet, and a task holds the open path of its tree
alone: a branch is summed up when the next row has left it.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, record_batches, rows_of

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS, TOP, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Different terms, and bytes of the texts they are from, for which a task holds counts before it passes them on.
HELD, HELD_BYTES = 400_000, 64 << 20
#: Sums of pairs that a task of the tree holds before it passes them on.
HELD_PAIRS = 4_000_000


def _term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, occurrences ``n`` and documents ``d``: several rows a term, one per task and flush."""
    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "term")] + [("n", pa.int64()), ("d", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
            terms = size = 0

            def flush():
                for (lang, source), (n, d) in held.items():
                    for term, count in n.items():
                        yield lang, source, term.decode(), count, d[term]
                held.clear()

            for lang, source, text in rows_of(batches, "lang", "source", "text"):
                raw = text.encode().lower()
                words = TERM.findall(raw)
                n, d = held[lang, source]
                before = len(n)
                n.update(words)
                d.update(set(words))
                terms, size = terms + len(n) - before, size + len(raw)
                if terms > HELD or size > HELD_BYTES:
                    yield from flush()
                    terms = size = 0
            yield from flush()

        yield from record_batches(found(), schema, 8192)

    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*blank).mapInArrow(run, "lang string, source string, term string, n bigint, d bigint")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms))``, exactly."""
    over = (count.cast("decimal(19,0)") + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    under = (total.cast("decimal(19,0)") + terms.cast("decimal(18,0)") * F.lit(SMOOTH).cast("decimal(1,0)")).cast("decimal(20,0)")
    return F.call_function("div", over, under) + F.lit(1)


def tree_corrections(rows: Iterator[tuple]) -> Iterator[tuple[str, str, str, int]]:
    """``lang``, two sources and the sum of their terms' corrections, from sorted ``(lang, row, multiplicity)``.

    A row is a sequence of ``(source, n, p, p0)``. Sums may come in several parts.
    """
    numbers: dict[str, int] = {}
    names: list[str] = []
    sums: dict[int, np.ndarray] = {}
    room = 64
    #: The open path: its items, multiplicities, and the numbers, p and p0 of its sources.
    path: list[tuple] = []
    terms: list[int] = []
    who, ps, zeros = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
    current = None

    def close(depth: int) -> None:
        """Leave all nodes below ``depth``: each corrects its ancestors and hands its terms to its parent."""
        while len(path) > depth:
            times, last = terms.pop(), len(path) - 1
            path.pop()
            if last:
                terms[-1] += times
                a, a0, b, b0 = ps[:last], zeros[:last], ps[last], zeros[last]
                change = np.abs(a - b) - np.abs(a - b0) - np.abs(a0 - b) + np.abs(a0 - b0)
                mine = sums.get(who[last])
                if mine is None or len(mine) < len(names):
                    grown = np.zeros(2 * len(names), np.int64)
                    if mine is not None:
                        grown[: len(mine)] = mine
                    mine = sums[who[last]] = grown
                mine[who[:last]] += times * change

    def flush() -> Iterator[tuple[str, str, str, int]]:
        for t, with_ in sums.items():
            for s in np.flatnonzero(with_):
                yield current, names[s], names[t], int(with_[s])
        sums.clear()

    for lang, row, times in rows:
        if lang != current:
            close(0)
            yield from flush()
            numbers, names, current = {}, [], lang
        same = 0
        while same < min(len(path), len(row)) and path[same] == row[same][:2]:
            same += 1
        close(same)
        if len(row) > len(who):
            who, ps, zeros = (np.concatenate([x, np.zeros(len(row), np.int64)]) for x in (who, ps, zeros))
        for source, n, p, p0 in row[same:]:
            at = len(path)
            if source not in numbers:
                numbers[source] = len(names)
                names.append(source)
            who[at], ps[at], zeros[at] = numbers[source], p, p0
            path.append((source, n))
            terms.append(0)
        terms[-1] += times
        if len(sums) * len(names) > HELD_PAIRS:
            yield from flush()
    close(0)
    yield from flush()


def _corrections(entries: DataFrame) -> DataFrame:
    """The tree's corrections as ``lang``, ``source``, ``item``, ``value``, in both directions."""
    items = F.sort_array(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("items")
    rows = entries.groupBy("lang", "term").agg(items).groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    spread = rows.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")
    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "item")] + [("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = rows_of(batches, "lang", "items", "times")
        found = tree_corrections((lang, [(i["source"], i["n"], i["p"], i["p0"]) for i in row], times) for lang, row, times in told)
        yield from record_batches(found, schema)

    one = spread.mapInArrow(run, "lang string, source string, item string, value bigint")
    other = [F.col("item").alias("source"), F.col("source").alias("item")]
    return one.select("lang", "source", "item", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("way")).select(
        "lang",
        F.when(F.col("way") == 0, F.col("source")).otherwise(F.col("item")).alias("source"),
        F.when(F.col("way") == 0, other[0]).otherwise(other[1]).alias("item"),
        "value",
    )


def side_changes(ps: np.ndarray, times: np.ndarray, p0: int, others: np.ndarray) -> np.ndarray:
    """For each other source's ``q0``: the sum of ``times * (|p - q0| - |p0 - q0|)`` over sorted shares ``p``."""
    count = np.concatenate([[0], np.cumsum(times)])
    total = np.concatenate([[0], np.cumsum(times * ps)])
    low = np.searchsorted(ps, others)
    below, sum_below = count[low], total[low]
    far = others * below - sum_below + (total[-1] - sum_below) - others * (count[-1] - below)
    return far - count[-1] * np.abs(p0 - others)


def _bases(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """Base and one-sided changes as ``lang``, ``source``, ``item``, ``value``: two rows a pair."""
    equal = entries.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    sides = equal.groupBy("lang", "source").agg(F.sort_array(F.collect_list(F.struct("p", "times"))).alias("side"))
    # As many sources as the result has rows for each of them.
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    schema = pa.schema([(c, pa.string()) for c in ("lang", "source", "item")] + [("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for lang, source, p0, v, side, others in rows_of(batches, "lang", "source", "p0", "v", "side", "others"):
                if not v:
                    changes = base = np.zeros(len(others), np.int64)
                else:
                    ps = np.array([x["p"] for x in side or ()], np.int64)
                    times = np.array([x["times"] for x in side or ()], np.int64)
                    q0 = np.array([x["p0"] for x in others], np.int64)
                    changes, base = side_changes(ps, times, p0, q0), v * np.abs(p0 - q0)
                for other, change, at in zip(others, changes.tolist(), base.tolist()):
                    if other["source"] != source:
                        yield lang, source, other["source"], change + at
                        yield lang, other["source"], source, change

        yield from record_batches(found(), schema)

    joined = groups.join(sides, ["lang", "source"], "left").join(others, "lang")
    return joined.mapInArrow(run, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair``: the distance of a source to each other one of its language, largest first.
    Part ``term``: the ``top`` terms that a source has more of than its language. Terms are those
    in at least ``least`` rows of a language. A null text, language or source is an empty one;
    a source whose texts are all empty takes part. Rows that repeat count again. Ties go by the
    item's bytes. A language without a kept term has pairs at distance 0, and one with a single
    source has none. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    # One shuffle by term serves all three groupings.
    counts = _term_counts(docs).repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    of_term = counts.groupBy("lang", "term").agg(
        F.sum("d").alias("d"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("row")
    )
    kept = scratch.keep(of_term.filter(F.col("d") >= least).drop("d"))
    by_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_total"))
    totals = kept.select("lang", F.explode("row").alias("at")).groupBy("lang", F.col("at.source").alias("source")).agg(F.sum("at.n").alias("total"))
    names = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = names.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    p0 = F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))
    groups = scratch.keep(groups.withColumn("p0", p0))
    entries = kept.select("lang", "term", "all", F.explode("row").alias("at")).select("lang", "term", "all", "at.source", "at.n")
    entries = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "p0",
        _share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        _share(F.col("all"), F.col("lang_total"), F.col("v")).alias("q"),
    )
    entries = scratch.keep(entries)
    pairs = _bases(groups, entries).union(_corrections(entries)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    terms = entries.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ordered = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", ordered).select(*columns)
    best = terms.withColumn("part", F.lit("term")).withColumn("rank", ordered).filter(F.col("rank") <= top).select(*columns)
    return ranked.union(best)
