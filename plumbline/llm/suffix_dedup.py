"""Repeated passages by sparse suffix arrays over words.

A full suffix array has an entry per word. Here only suffixes at minimiser positions are kept:
in every window of word runs the one with the smallest hash. Equal passages of ``LEAST`` words
have a whole window in common and so keep the same position. Suffixes whose run several
documents have are sorted twice, by the words from the position on and by the words before it
(read backwards, after the run). In either order the nearest suffix of another document on each
side is the longest match that way; the match is extended the other way on the words themselves.

Let ``l`` and ``r`` be the most words that a suffix shares with others before and after its
position. With fewer than ``LEAST`` together no passage is there; if neighbours reach as many,
words are covered. What is left, where ``l`` and ``r`` come from different neighbours, are
passages whose copies lie apart in both orders. There, and only for the windows of ``LEAST`` words
that ``l`` and ``r`` leave possible and no passage found covers, other documents are asked for the
same words, by a digest of 192 bits: a bitmap of the digests asked for drops their other windows
where they are laid out. So no passage is lost, whatever its copies share with others, and no
group of copies is spelled out as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, among, record_batches, rows_of, texts
from plumbline.llm.shingles import runs, words

#: Words that a passage must have in common at least.
LEAST = 50
#: Words of a run, and runs of a window: together they span a shortest passage.
RUN = 10
WINDOW = LEAST - RUN + 1
#: Longer words are compared by a digest of 192 bits, so that a suffix has a bounded size.
WORD_BYTES = 64
#: Different windows whose documents a task sums up at a time.
HELD = 1 << 17
ORDER = ["own", "cross", "doc_id", "pos"]


def minimisers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept word positions of a text, and the hash of the run of words at each."""
    if len(hashes) < LEAST:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    found = runs(hashes, RUN)
    seen = []
    for i in range(0, len(found) - WINDOW + 1, 65536):
        part = np.lib.stride_tricks.sliding_window_view(found[i : i + 65536 + WINDOW - 1], WINDOW)
        seen.append(np.unique(part.argmin(axis=1) + np.arange(i, i + len(part))))
    at = np.unique(np.concatenate(seen))
    return at, found[at]


def _kept(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("run", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            at, found = minimisers(words(text)[0])
            if len(at):
                ids = pa.array([doc_id] * len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(at.astype(np.int32)), pa.array(found.view(np.int64))], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id bigint, pos int, run bigint")


def spelled(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case, long ones as digests."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    return [w if len(w) <= WORD_BYTES else hashlib.blake2b(w, digest_size=24).hexdigest().encode() for w in found]


def _ended(found: list[bytes]) -> bytes:
    """Words with a space after each: words that two such texts begin with alike are the spaces both begin with."""
    return b"".join([w + b" " for w in found])


def _suffixes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``after``: the 50 words from a kept position on; ``before``: the run at it, then the 40 words before it, backwards."""
    schema = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("after", pa.binary()), ("before", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc_id, at, text in rows_of(batches, "doc_id", "at", "text"):
                w = spelled(text)
                for p in at:
                    if p + RUN <= len(w):  # rows that repeat a doc_id may be shorter
                        yield doc_id, p, _ended(w[p : p + LEAST]), _ended(w[p : p + RUN] + w[max(0, p - WINDOW + 1) : p][::-1])

        yield from record_batches(found(), schema)

    places = kept.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    return texts(docs).join(places, "doc_id").mapInArrow(run, "doc_id bigint, pos int, after binary, before binary")


def common_words(a: bytes, b: bytes) -> int:
    """How many words two texts of ended words begin with alike."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return a.count(b" ", 0, high)
    while high - low > 1:  # a[:low] agrees, a[:high] does not
        half = (low + high) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half
    return a.count(b" ", 0, low)


_MET = pa.schema([
    ("doc_id", pa.int64()), ("pos", pa.int32()), ("n_own", pa.int32()), ("n_cross", pa.int32()), ("other", pa.int64()),
    ("edge", pa.bool_()), ("own", pa.binary()), ("cross", pa.binary()),
])
_MET_DDL = "doc_id bigint, pos int, n_own int, n_cross int, other bigint, edge boolean, own binary, cross binary"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each suffix of a sorted range, the better of the nearest ones of other documents on both sides.

    A stretch is a sequence of suffixes of one document. The first and the last stretch, and the
    suffix next to each, are marked as edges: all that other ranges can meet, or be met by.
    """

    def against(row: tuple, other: tuple | None) -> tuple[int, int, int] | None:
        return None if other is None else (common_words(row[2], other[2]), common_words(row[3], other[3]), other[0])

    def done(stretch: list, after: tuple | None, first: bool, last: bool, edge: tuple[bool, bool]) -> Iterator[tuple]:
        for i, (row, before) in enumerate(stretch):
            n_own, n_cross, other = max(x for x in (before, against(row, after), (0, 0, row[0])) if x is not None)
            kept = first or last or (edge[0] and i == 0) or (edge[1] and i == len(stretch) - 1)
            yield row[0], row[1], n_own, n_cross, other, kept, row[2] if kept else None, row[3] if kept else None

    def found():
        # One finished stretch is held back, as only the end of the range tells whether it is the last but one.
        held: tuple | None = None
        stretch: list = []
        number, before = 0, None  # the last suffix of the stretch before this one
        for row in rows_of(batches, "doc_id", "pos", "own", "cross"):
            if stretch and stretch[-1][0] == row:
                continue
            if stretch and stretch[-1][0][0] != row[0]:
                if held is not None:
                    yield from done(*held, (held[2] is False and number == 2, False))
                held = (stretch, row, number == 0, False)
                before, stretch, number = stretch[-1][0], [], number + 1
            stretch.append((row, against(row, before)))
        if held is not None:
            yield from done(*held, (number == 2, True))
        yield from done(stretch, None, number == 0, True, (False, False))

    yield from record_batches(found(), _MET)


def _matches(suffixes: DataFrame, own: str, cross: str, scratch: Scratch) -> DataFrame:
    """``doc_id``, ``pos`` and the best neighbour ``m`` (``own``, ``cross``, ``other``) in the order of ``own``, per range and over the edges."""
    rows = suffixes.select("doc_id", "pos", F.col(own).alias("own"), F.col(cross).alias("cross"))
    met = scratch.keep(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_neighbours, _MET_DDL))
    # A few rows of each range, in one order again: neighbours across the bounds of ranges.
    edges = met.filter("edge").select(*ORDER).repartition(1).sortWithinPartitions(*ORDER).mapInArrow(_neighbours, _MET_DDL)
    best = F.struct(F.col("n_own").alias("own"), F.col("n_cross").alias("cross"), "other").alias("m")
    return met.union(edges).filter(F.col("n_own") >= RUN).select("doc_id", "pos", best)


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for doc_id, pos, low, high, after, before in rows_of(batches, "doc_id", "pos", "low", "high", "after", "before"):
        w = before.split(b" ")[RUN:-1][::-1]
        w, at = w + after.split(b" ")[:-1], len(w)
        for k in range(low, high + 1):
            if len(w[at - k : at - k + LEAST]) == LEAST:
                yield doc_id, pos - k, hashlib.blake2b(_ended(w[at - k : at - k + LEAST]), digest_size=24).digest()


def _met(suffixes: DataFrame, wanted: DataFrame) -> DataFrame:
    return suffixes.join(wanted, ["doc_id", "pos"]).select("doc_id", "pos", "low", "high", "after", "before")


def _open_windows(suffixes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows that begin ``low`` to ``high`` words before a kept position: ``doc_id``, ``start``, ``words``, a digest of theirs."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from record_batches(_laid_out(batches), schema)

    return _met(suffixes, wanted).mapInArrow(run, "doc_id bigint, start int, words binary")


def _window_ends(suffixes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``words`` of the same windows with ``a`` and ``b``, the smallest and the largest document of a part that has them."""
    schema = pa.schema([("words", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            held: dict[bytes, tuple[int, int]] = {}
            for doc_id, _, words_ in _laid_out(batches):
                a, b = held.get(words_, (doc_id, doc_id))
                held[words_] = min(a, doc_id), max(b, doc_id)
                if len(held) == HELD:
                    yield from ((w, *ends) for w, ends in held.items())
                    held.clear()
            yield from ((w, *ends) for w, ends in held.items())

        yield from record_batches(found(), schema)

    return _met(suffixes, wanted).mapInArrow(run, "words binary, a bigint, b bigint")


def _span(left: Column, right: Column, other: Column) -> Column:
    start, stop = (F.col("pos") - left).alias("start"), (F.col("pos") + right).alias("stop")
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), other.alias("other"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with the number of their ``passage`` in the document: the ``span`` rows that overlap. Others, in the order of their starts, belong to the last one begun."""
    so_far = Window.partitionBy("doc_id").orderBy("start", F.desc("span"), "stop", "other")
    stop = F.when(F.col("span"), F.col("stop"))
    reach = F.max(stop).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("new", F.when(~F.col("span") | (F.col("start") < reach), 0).otherwise(1))
    return opened.withColumn("passage", F.sum("new").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))


def _not_covered(spans: DataFrame, asking: DataFrame) -> DataFrame:
    """The rows of ``asking`` whose windows do not all lie within one passage of the ``spans``, less windows that do at its end."""
    no_other = F.lit(None).cast("bigint").alias("other")
    windows = asking.select(
        "doc_id", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + LEAST).alias("stop"), no_other,
        F.lit(False).alias("span"), "pos", "low", "high",
    )
    none = [F.lit(None).cast("int").alias(n) for n in ("pos", "low", "high")]
    numbered = _numbered(spans.select("doc_id", "start", "stop", "other", F.lit(True).alias("span"), *none).union(windows))
    end = F.max(F.when(F.col("span"), F.col("stop"))).over(Window.partitionBy("doc_id", "passage"))
    left = numbered.withColumn("end", end).filter("NOT span AND (end IS NULL OR end < stop)")
    return left.select("doc_id", "pos", "low", F.least("high", F.col("pos") - F.col("end") + (LEAST - 1)).alias("high"))


def repeats(docs: DataFrame) -> DataFrame:
    """Passages of at least 50 words that other documents have too, in words from 0.

    One row per passage: ``doc_id``, ``start_word``, ``end_word`` (exclusive), ``n_words``, and
    ``other_id``, the smallest of the documents that a part of it was matched with. Matches that
    overlap are one passage, those that only touch are two. Words are parted by white space and
    compared without regard to the case of A-Z. Documents with fewer words, null texts and rows
    with a null ``doc_id`` have no rows; rows that repeat a ``doc_id`` are one document, which is not
    compared with itself. An empty table gives no rows; other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "suffix_dedup")
    docs = docs.filter("doc_id IS NOT NULL")
    ends = [F.min("doc_id").alias("a"), F.max("doc_id").alias("b")]
    kept = scratch.keep(_kept(docs))
    several = scratch.keep(kept.groupBy("run").agg(*ends).filter("a <> b").select("run"))
    # Written before the sorts, so that the ranges are sampled from a table and a frequent run can be split.
    suffixes = scratch.keep(_suffixes(docs, kept.join(several, "run").select("doc_id", "pos")))
    scratch.drop(kept, several)
    right, left = _matches(suffixes, "after", "before", scratch), _matches(suffixes, "before", "after", scratch)
    both = right.select("doc_id", "pos", F.col("m").alias("x"), F.lit(None).cast(right.schema["m"].dataType).alias("y"))
    both = both.union(left.select("doc_id", "pos", F.lit(None).cast(left.schema["m"].dataType), F.col("m")))
    best = scratch.keep(both.groupBy("doc_id", "pos").agg(F.max("x").alias("x"), F.max("y").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL"))
    c = F.col
    r, x_left, l, y_right = c("x.own"), c("x.cross") - RUN, c("y.own") - RUN, c("y.cross")  # noqa: E741
    by_right, by_left = x_left + r >= LEAST, l + y_right >= LEAST
    possible = best.filter(l + r >= LEAST)
    found = F.filter(
        F.array(F.when(by_right, _span(x_left, r, c("x.other"))), F.when(by_left, _span(l, y_right, c("y.other")))), lambda s: s.isNotNull()
    )
    spans = scratch.keep(possible.select("doc_id", F.explode(found).alias("s")).select("doc_id", "s.*"))
    range_ = possible.select("doc_id", "pos", (LEAST - r).alias("low"), l.alias("high"))
    # Of a suffix that neighbours do not cover as a whole, the windows that neither of its two matches covers.
    low, high = F.when(by_right, x_left + 1).otherwise(LEAST - r), F.when(by_left, LEAST - 1 - y_right).otherwise(l)
    open_ = possible.filter(~by_right | ~by_left).select("doc_id", "pos", low.alias("low"), high.alias("high"))
    asking = scratch.keep(_not_covered(spans, open_.filter("low <= high")))
    if asking.limit(1).count():
        # All suffixes of a run that asks lay out the windows asked for that they may share with others.
        head = F.xxhash64(F.substring_index(F.decode("before", "ISO-8859-1"), " ", RUN)).alias("head")
        named = scratch.keep(suffixes.select("doc_id", "pos", head))
        asked = scratch.keep(named.join(asking, ["doc_id", "pos"]).groupBy("head").agg(F.min("low").alias("least"), F.max("high").alias("most")))
        wanted = range_.join(among(named, "head", asked.select("head")), ["doc_id", "pos"]).join(asked, "head")
        wanted = wanted.select("doc_id", "pos", F.greatest("low", "least").alias("low"), F.least("high", "most").alias("high"))
        of_these = scratch.keep(among(suffixes.select("*", head), "head", asked.select("head")).drop("head"))
        windows = scratch.keep(_open_windows(of_these, asking))
        others = among(_window_ends(of_these, wanted.filter("low <= high")), "words", windows.select("words"))
        shared = scratch.keep(others.groupBy("words").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter("a <> b"))
        other = F.when(c("doc_id") == c("a"), c("b")).otherwise(c("a")).alias("other")
        scratch.drop(suffixes, named, asking, of_these)
        spans = spans.union(windows.join(shared, "words").select("doc_id", "start", (c("start") + LEAST).alias("stop"), other))
    numbered = _numbered(spans.withColumn("span", F.lit(True)))
    return (
        numbered.groupBy("doc_id", "passage")
        .agg(F.min("start").alias("start_word"), F.max("stop").alias("end_word"), F.min("other").alias("other_id"))
        .select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_id")
    )
