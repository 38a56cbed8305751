"""Phrases that hold together, from a weighted de Bruijn graph of words.

Nodes are runs of three words, and an edge of four words leads from its first three to its last
three. A task builds the graph of a block of texts and writes its unary paths, which are left by
no other edge, as one run of words each with its weight. Where a piece of text ends, its last
three words and their shorter ends are written as well, since no edge begins with them.

Edges and ends of all blocks are then sorted. What a node sends out stands together: its edges
and the ends at it add up to how often its three words occur, these to the counts of two words,
and so on down to the words and their number, all in one reading of the sorted rows. A task
passes on frequent phrases, and those at its bounds, which its neighbours may have parts of.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, record_batches, rows_of
from plumbline.llm.shingles import mix

LONGEST, LEAST, TOP = 4, 30, 2000
SCALE, HELD_PERCENT = 2_000_000, 80
#: Bytes of texts whose graph a task holds at a time.
BLOCK = 12 << 20
#: Cells of the table of counts of each length, and of the part of one that is a row.
CELLS, PART = 1 << 24, 1 << 18
#: Between the words of a key: smaller than any other byte in it, so that what begins alike stands together.
GAP = b"\x00"
#: A-Z in lower case, ends of pieces as line breaks, tabs as spaces.
_TABLE = bytearray(range(256))
_TABLE[65:91] = bytes(range(97, 123))
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE[9] = 32
_TABLE = bytes(_TABLE)


def escaped(raw: bytes) -> bytes:
    """Without zero bytes, reversibly."""
    return raw.replace(b"\x01", b"\x01\x01").replace(b"\x00", b"\x01\x02") if b"\x00" in raw or b"\x01" in raw else raw


def unescaped(raw: bytes) -> bytes:
    return re.sub(rb"\x01([\x01\x02])", lambda m: b"\x01" if m[1] == b"\x01" else b"\x00", raw) if b"\x01" in raw else raw


def _told(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, dict[bytes, int]]:
    """The words of some texts with a line break around every piece, a number for each, and the words by number."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    numbers[b"\n"]
    told = b"\n".join([b"", *texts, b""]).translate(_TABLE)
    words = list(filter(None, escaped(told).replace(b"\n", b" \n ").split(b" ")))
    return words, np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), numbers


def _room(ids: np.ndarray) -> np.ndarray:
    """How many words from each place on are in its piece, ``LONGEST`` at most."""
    inner = ids != 0
    room, run = inner.astype(np.int8), inner
    for k in range(1, LONGEST):
        run = run[:-1] & inner[k:]
        room[: len(run)] += run
    return room


def _cells(lang: bytes, ids: np.ndarray, numbers: dict[bytes, int], room: np.ndarray, table: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from two words on, the places that have as many, and the cells of the runs there in a ``table`` of so many."""
    hashes = mix(np.fromiter(map(zlib.crc32, numbers), np.uint64, len(numbers)) + np.uint64(1))[ids]
    out = hashes + np.uint64(zlib.crc32(lang))
    for size in range(2, LONGEST + 1):
        out = out[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[size - 1 :]
        at = np.flatnonzero(room >= size)
        yield size, at, (mix(out[at]) % np.uint64(table)).astype(np.int64)


def graph(texts: list[bytes], lang: bytes = b"", frequent: np.ndarray | None = None) -> Iterator[tuple[bytes, int]]:
    """Unary paths and ends of some texts, as words with ``GAP`` between them, and how often they occur.

    An end has three words at most, a path at least four. ``frequent`` has a row of bits for each
    length from two words on: the cells of runs that may be frequent. Others are cut to ends.
    """
    words, ids, numbers = _told(texts)
    reach = _room(ids)
    if not reach.any():
        return
    if frequent is not None:
        kept = np.minimum(reach, 1)
        for size, at, cells in _cells(lang, ids, numbers, reach, 8 * frequent.shape[1]):
            may = (frequent[size - 2][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1 == 1
            at = at[may]
            kept[at[kept[at] == size - 1]] = size
        reach = kept
    word = lambda i, j: GAP.join(words[i:j])

    for size in range(1, LONGEST):
        ends = np.flatnonzero(reach == size)
        if len(ends):
            _, first, times = np.unique(_ranks(ids, ends, size), return_index=True, return_counts=True)
            for i, n in zip(ends[first].tolist(), times.tolist()):
                yield word(i, i + size), n

    edge = reach == LONGEST
    edges_at = np.flatnonzero(edge)
    if not len(edges_at):
        return
    # Nodes that edges lead from and to, by rank.
    nodes = _ranks(ids, np.concatenate([edges_at, edges_at + 1]), LONGEST - 1)
    node_count = int(nodes.max()) + 1
    source, target = nodes[: len(edges_at)], nodes[len(edges_at) :]
    _, first, weight = np.unique(source * node_count + target, return_index=True, return_counts=True)
    into = np.bincount(target[first], minlength=node_count)
    out = np.bincount(source[first], minlength=node_count)
    begins = source[~edge[edges_at - 1]]  # a bound stands before every piece
    stops = target[~edge[edges_at + 1]]
    unary = (into == 1) & (out == 1)
    unary[begins] = False
    unary[stops] = False
    # The first edge after a unary node is the next one in the text, for every occurrence: a path is read off there.
    order = np.argsort(first)
    first, weight = first[order], weight[order]
    here = edges_at[first]
    joined = np.zeros(len(here), bool)
    joined[1:] = (here[1:] == here[:-1] + 1) & unary[source[first[1:]]]
    heads = np.flatnonzero(~joined)
    tails = np.append(heads[1:], len(here)) - 1
    for i, j, n in zip(here[heads].tolist(), here[tails].tolist(), weight[heads].tolist()):
        yield word(i, j + LONGEST), n


def _ranks(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` ids that begins at one of the places, equal for equal runs."""
    out = ids[at]
    for k in range(1, size):
        out = np.unique(out * (int(ids.max()) + 1) + ids[at + k], return_inverse=True)[1]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """Languages and some of their texts, ``block`` bytes at a time."""
    held, size = defaultdict(list), 0
    for lang, text in rows_of(batches, "lang", "text"):
        raw = text.encode()
        held[lang].append(raw)
        size += len(raw)
        if size >= block:
            yield from ((k.encode(), v) for k, v in held.items())
            held.clear()
            size = 0
    yield from ((k.encode(), v) for k, v in held.items())


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def _frequent(docs: DataFrame, least: int) -> np.ndarray:
    """For each length from two words on, the bits of the cells whose runs occur ``least`` times together."""
    top, parts = min(least, 255), CELLS // PART
    levels = LONGEST - 1
    schema = pa.schema([("part", pa.int32()), ("cells", pa.binary())])

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            counts = None
            for lang, texts in _blocks(batches, BLOCK):
                _, ids, numbers = _told(texts)
                if counts is None:
                    counts = np.zeros((levels, CELLS), np.uint32)
                for size, _, cells in _cells(lang, ids, numbers, _room(ids), CELLS):
                    np.add.at(counts[size - 2], cells, np.uint32(1))
                    np.minimum(counts[size - 2], top, out=counts[size - 2])
            if counts is not None:
                for i, part in enumerate(counts.reshape(-1, PART)):
                    if part.any():
                        yield i, pa.compress(part.astype(np.uint8).tobytes(), codec="zstd", asbytes=True)

        yield from record_batches(found(), schema, 16)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            part, total = None, None
            for i, raw in rows_of(batches, "part", "cells"):
                cells = np.frombuffer(pa.decompress(raw, PART, codec="zstd", asbytes=True), np.uint8)
                if part is not None and i != part:
                    yield part, np.packbits(total >= top, bitorder="little").tobytes()
                    total = None
                part, total = i, cells.astype(np.uint64) if total is None else total + cells
            if part is not None:
                yield part, np.packbits(total >= top, bitorder="little").tobytes()

        yield from record_batches(found(), schema, 16)

    ddl = "part int, cells binary"
    added = _named(docs).mapInArrow(tables, ddl).repartition("part").sortWithinPartitions("part").mapInArrow(sums, ddl)
    bits = np.zeros((levels * parts, PART // 8), np.uint8)
    for r in added.collect():  # a bit for each cell, whatever the input
        bits[r["part"]] = np.frombuffer(r["cells"], np.uint8)
    return bits.reshape(levels, -1)


def _paths(docs: DataFrame, least: int) -> DataFrame:
    """``run``, the language and the words of a path or an end with ``GAP`` between them, and ``times``."""
    schema = pa.schema([("run", pa.binary()), ("times", pa.int64())])
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for lang, texts in _blocks(batches, BLOCK):
                head = escaped(lang) + GAP
                for words, times in graph(texts, lang, frequent.value):
                    yield head + words, times

        yield from record_batches(found(), schema, 8192)

    return _named(docs).mapInArrow(run, "run binary, times bigint")


def _edges(paths: DataFrame) -> DataFrame:
    """``key``, the language with the words of one edge or end, and ``times``."""
    words = F.split(F.col("run").cast("string"), "\x00")
    split = paths.select(words.alias("w"), "run", "times")
    edge = lambda i: F.concat_ws("\x00", F.get("w", F.lit(0)), *[F.get("w", i + k) for k in range(LONGEST)])
    edges = F.when(F.size("w") > LONGEST, F.transform(F.sequence(F.lit(1), F.size("w") - LONGEST), edge)).otherwise(
        F.array(F.col("run").cast("string"))
    )
    return split.select(F.explode(edges).alias("key"), "times")


def flows(rows: Iterator[tuple[str, int]], least: int) -> Iterator[tuple[str, str, int, int]]:
    """``lang``, ``phrase``, words in it and occurrences, from sorted edges and ends with their weights.

    Phrases of at least ``least`` occurrences, and whatever may go on in the rows before or after:
    what the first and the last row begin with. A language itself is a phrase of no words.
    """
    path: list[bytes] = []
    sums: list[int] = []
    #: How many words of the path the first row begins with too.
    first = 0

    def named(n: int) -> tuple[str, str, int, int]:
        head, *rest = (unescaped(w).decode() for w in path)
        return head, " ".join(rest), len(rest), n

    before = None
    for key, times in rows:
        if key == before:
            sums[-1] += times
            continue
        words = key.encode().split(GAP)
        same, upto = 0, min(len(path), len(words))
        while same < upto and path[same] == words[same]:
            same += 1
        while len(path) > same:
            n = sums.pop()
            if len(path) <= first or n >= least or not sums:
                yield named(n)
            if sums:
                sums[-1] += n
            path.pop()
        first = len(words) if before is None else min(first, same)
        path += words[same:]
        sums += [0] * (len(words) - same)
        sums[-1] += times
        before = key
    while path:
        n = sums.pop()
        yield named(n)
        if sums:
            sums[-1] += n
        path.pop()


def phrase_counts(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """``lang``, ``phrase``, ``words`` in it and ``f``, for phrases of at most ``LONGEST`` words and each language as a whole."""
    paths = scratch.keep(_paths(docs, least))
    spread = _edges(paths).repartitionByRange("key").sortWithinPartitions("key")
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(flows(rows_of(batches, "key", "times"), least), schema)

    parts = spread.mapInArrow(run, "lang string, phrase string, words int, f bigint")
    whole = parts.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    found = scratch.keep(whole.filter((F.col("f") >= least) | (F.col("words") == 0)))
    scratch.drop(paths)
    return found


def _exact(n: Column) -> Column:
    return n.cast("decimal(19,0)")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of each language's ``top`` phrases.

    A phrase of two to four words is a candidate if it occurs ``least`` times. ``l`` and ``r`` are
    how often its two parts occur, cut where the score ``floor(SCALE * a / (l + r))`` is lowest, at
    the first of equal places. It goes if a longer candidate that holds it occurs at least
    ``HELD_PERCENT`` percent as often. A null language is ``und``, a null text an empty one. Rows
    that repeat count again. Ties go by ``a``, then by the phrase's bytes. A language without a
    candidate and an empty table give no rows.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    counts = phrase_counts(docs, scratch, least)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    parts = counts.filter("words > 0").select("lang", "phrase", "f")
    phrases = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    upto = lambda i: F.call_function("substring_index", F.col("phrase"), F.lit(" "), i)
    # A phrase that a longer one holds is held by one of just one word more, which occurs at least as often.
    ends = [upto(F.col("words") - 1), upto(1 - F.col("words"))]
    longer = phrases.filter("words > 2").select("lang", F.explode(F.array(*ends)).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    free = phrases.join(longer, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull()
        | (_exact(F.col("longest")) * F.lit(100) < _exact(F.col("a")) * F.lit(HELD_PERCENT))
    )
    free = scratch.keep(free.select("lang", "phrase", "words", "a"))
    cuts = free.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", upto(F.col("cut"))).withColumn("right", upto(F.col("cut") - F.col("words")))
    cuts = scratch.keep(cuts)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.call_function("div", _exact(F.col("a")) * F.lit(SCALE), _exact(F.col("l")) + _exact(F.col("r")))
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    ordered = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = best.withColumn("rank", ordered.cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
