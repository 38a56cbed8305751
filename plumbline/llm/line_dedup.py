"""Near-equal lines by deletion neighbourhoods.

Two lines are near-equal if one edit of a character (replaced, inserted or deleted) at most
turns one into the other. The earliest line stays: a line goes if an equal or near-equal line
comes before it, by ``doc_id``, then line number.

Only lines that can have a partner emit their variants. A line is cut into segments. One edit
touches one segment, so near-equal lines agree in all others: the hash of all segments but one
is a key, and a line without a shared key has no partner. For each shared key, the segment
left out emits its deletion variants as hashed keys:

* without character ``i``: lines of one length that agree are one replacement apart,
* whole, for the shorter, and without a character, for the longer of two lines one insertion apart.

Any two lines that meet on such a key are within the bound, so the earliest of each group is
all that a line is compared with, and no group is spelled out as pairs. Lengths and hashes are
then confirmed by the edit distance of the lines themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, bring_back, set_aside

#: Characters of a segment at most, but a line always has two segments.
SEGMENT = 256
#: Shorter lines must be equal to go: one edit would make different words of them.
MIN_CHARS = 16
SAME, SHORTER, LONGER = 0, 1, 2


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``line`` and its 64-bit hash ``h`` for every line with a character that is no space."""
    split = docs.select("doc_id", F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line_no", "line"))
    return split.filter(F.trim(F.col("line"), F.lit(" \t\r\v\f")) != "").withColumn("h", F.xxhash64("line"))


def _segments(length: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(length / F.lit(SEGMENT)).cast("int"))


def _bound(length: Column, count: Column, j: Column) -> Column:
    """Where segment ``j`` of ``count`` begins in a line of that length, from 0."""
    return F.floor(length.cast("bigint") * j / count).cast("int")


def _hashes(line: Column, length: Column, count: Column, shift: int) -> Column:
    """Hashes of the segments of a line cut as one of ``length`` characters, read ``shift`` characters later."""

    def one(j: Column) -> Column:
        start = _bound(length, count, j)
        return F.xxhash64(F.substring(line, start + 1 + shift, _bound(length, count, j + 1) - start))

    return F.transform(F.sequence(F.lit(0), count - 1), one)


def _keys(role: int, length: Column, left: Column, right: Column) -> Column:
    """A key per segment: all segments before it and all after it, with the length that they are cut for."""

    def one(_: Column, j: Column) -> Column:
        key = F.xxhash64(length, j, F.slice(left, F.lit(1), j), F.slice(right, j + 2, F.greatest(F.size(right) - j - 1, F.lit(0))))
        return F.struct(key.alias("key"), F.lit(role).alias("role"), j.alias("j"))

    return F.transform(left, one)


def keyed(found: DataFrame) -> DataFrame:
    """Rows of ``found`` (with ``line``) once per key: ``key``, ``role`` and the segment ``j`` left out.

    As it is, a line is cut for its own length; as the longer of two it is cut for one
    character less, with the segments after the edit read one character later.
    """
    length = F.length("line")
    long = found.withColumn("n", length).filter(F.col("n") >= MIN_CHARS)
    n, m = F.col("n"), F.col("n") - 1
    # Most lines have two segments, whose keys need no arrays of hashes.
    many, fewer = _segments(n) > 2, _segments(m) > 2
    cut = long.withColumn("own", F.when(many, _hashes(F.col("line"), n, _segments(n), 0)))
    cut = cut.withColumn("left", F.when(fewer, _hashes(F.col("line"), m, _segments(m), 0)))
    cut = cut.withColumn("right", F.when(fewer, _hashes(F.col("line"), m, _segments(m), 1)))
    own = F.when(many, _keys(SAME, n, F.col("own"), F.col("own"))).otherwise(_two_keys(SAME, n, 0))
    longer = F.when(fewer, _keys(LONGER, m, F.col("left"), F.col("right"))).otherwise(_two_keys(LONGER, m, 1))
    return cut.withColumn("k", F.explode(F.concat(own, longer))).select(*found.columns, "n", "k.key", "k.role", "k.j")


def _two_keys(role: int, length: Column, shift: int) -> Column:
    """The keys of a line cut in two: the second half without the first, the first without the second."""
    half = _bound(length, F.lit(2), F.lit(1))
    halves = [F.substring(F.col("line"), half + 1 + shift, length - half), F.substring(F.col("line"), F.lit(1), half)]
    keys = [F.xxhash64(length, F.lit(j), F.xxhash64(part)) for j, part in enumerate(halves)]
    return F.array(*[F.struct(k.alias("key"), F.lit(role).alias("role"), F.lit(j).alias("j")) for j, k in enumerate(keys)])


def variants(found: DataFrame) -> DataFrame:
    """Deletion variants of the segment left out: ``variant`` and ``role`` per row of ``keyed`` lines."""
    n, j = F.col("n"), F.col("j")
    cut_for = F.when(F.col("role") == SAME, n).otherwise(n - 1)
    count = _segments(cut_for)
    start = _bound(cut_for, count, j)
    size = _bound(cut_for, count, j + 1) - start + F.when(F.col("role") == SAME, 0).otherwise(1)
    part = found.withColumn("part", F.substring(F.col("line"), start + 1, size))
    without = lambda i: F.concat(F.substring(F.col("part"), F.lit(1), i), F.substring(F.col("part"), i + 2, F.length("part")))
    places = F.when(F.length("part") > 0, F.sequence(F.lit(0), F.length("part") - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(
        places, lambda i: F.struct(F.xxhash64("key", F.lit(SAME), i, without(i)).alias("variant"), F.lit(SAME).alias("role"))
    )
    whole = F.array(F.struct(F.xxhash64("key", F.lit(SHORTER), F.lit(-1), F.col("part")).alias("variant"), F.lit(SHORTER).alias("role")))
    longer = F.transform(
        places, lambda i: F.struct(F.xxhash64("key", F.lit(SHORTER), F.lit(-1), without(i)).alias("variant"), F.lit(LONGER).alias("role"))
    )
    every = F.when(F.col("role") == SAME, F.concat(same, whole)).otherwise(longer)
    return part.withColumn("v", F.explode(every)).select("h", "at", "v.variant", "v.role").distinct()


def near_copies(first: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Hashes ``h`` of the different lines that have an earlier near-equal line.

    ``first`` has ``h`` and the earliest place ``at`` (``doc_id``, ``line_no``) of each line.
    """
    every = lines(docs)
    # Written once: to cut all lines again would cost more than to read their keys back.
    keys = scratch.keep(keyed(every.select("h", "line")).select("key", "h"), "snappy")
    shared = scratch.keep(
        keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    )
    hashes = scratch.keep(keys.join(shared, "key").select("h").distinct())
    scratch.drop(keys)
    places = first.join(hashes, "h").select("h", "at", F.col("at.doc_id").alias("doc_id"), F.col("at.line_no").alias("line_no"))
    wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h", "at")).alias("wanted"))
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    texts = docs.select("doc_id", "text").withColumnRenamed("doc_id", "id")
    held = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select(F.explode("wanted").alias("w"), split.alias("parts"))
    held = held.select("w.h", "w.at", F.get("parts", F.col("w.line_no")).alias("line")).filter(F.xxhash64("line") == F.col("h"))
    held = scratch.keep(held.groupBy("h", "at").agg(F.first("line").alias("line")))
    emitted = scratch.keep(variants(keyed(held).join(shared, "key")))
    earliest = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "h"))).alias(f"e{role}")
    groups = emitted.groupBy("variant").agg(earliest(SAME), earliest(SHORTER), earliest(LONGER), F.count(F.lit(1)).alias("n"))
    # The earliest line of a group that the row's own role goes with.
    other = F.when(F.col("role") == SAME, F.col(f"e{SAME}")).when(F.col("role") == SHORTER, F.col(f"e{LONGER}")).otherwise(F.col(f"e{SHORTER}"))
    met = emitted.join(groups.filter("n > 1"), "variant").select("h", "at", other.alias("o")).filter("o.at < at")
    pairs = met.select("h", F.col("o.h").alias("other")).distinct()
    one = held.select("h", "line")
    two = held.select(F.col("h").alias("other"), F.col("line").alias("other_line"))
    near = pairs.join(one, "h").join(two, "other").filter(F.levenshtein("line", "other_line", 1) >= 0)
    found = scratch.keep(near.select("h").distinct())
    scratch.drop(shared, hashes, held, emitted)
    return found


def kept_lines(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the lines that stay (``kept``: of ``line_no`` and ``h``), for documents that keep any.

    Blank lines are not looked at and always stay; they are not listed here. Lines are
    compared as they are. Rows that repeat a ``doc_id`` have the same places, so neither is
    earlier than the other, and equal ones keep the same lines. A null ``doc_id`` comes first.
    """
    scratch = Scratch(docs.sparkSession, "line_dedup")
    place = F.struct("doc_id", "line_no")
    first = scratch.keep(lines(docs).groupBy("h").agg(F.min(place).alias("at")))
    near = near_copies(first, docs, scratch)
    stay = first.join(near, "h", "left_anti")
    return stay.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("at.line_no", "h")).alias("kept"))


def _blank(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\v\f")) == ""


def report(docs: DataFrame) -> DataFrame:
    """Per document: ``n_lines``, ``n_dropped`` and the numbers of the lines that go, as text."""
    stay = kept_lines(docs).withColumnRenamed("doc_id", "id")
    all_lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    looked_at = F.filter(
        F.transform(all_lines, lambda x, i: F.struct(i.alias("line_no"), F.xxhash64(x).alias("h"), _blank(x).alias("blank"))),
        lambda s: ~s["blank"],
    )
    mine = docs.select(
        "doc_id", F.size(all_lines).cast("bigint").alias("n_lines"),
        F.transform(looked_at, lambda s: F.struct(s["line_no"].alias("line_no"), s["h"].alias("h"))).alias("looked_at"),
    )
    kept = F.coalesce("kept", F.array().cast("array<struct<line_no: int, h: bigint>>"))
    gone = F.array_sort(F.transform(F.array_except("looked_at", kept), lambda s: s["line_no"]))
    return mine.join(stay, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", "n_lines", F.size(gone).cast("bigint").alias("n_dropped"), F.array_join(gone.cast("array<string>"), ",").alias("dropped")
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """The documents without the lines that go; a document that loses all its lines goes too.

    All columns of ``docs`` stay, ``n_chars`` follows the text, and documents without any
    line to look at stay as they are.
    """
    names = docs.columns
    docs = set_aside(docs, "doc_id", "text", "n_chars")
    stay = kept_lines(docs).withColumnRenamed("doc_id", "_id").withColumnRenamed("kept", "_kept")
    kept = F.coalesce("_kept", F.array().cast("array<struct<line_no: int, h: bigint>>"))
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    left = F.filter(
        parts, lambda x, i: _blank(x) | F.array_contains(kept, F.struct(i.alias("line_no"), F.xxhash64(x).alias("h")))
    )
    joined = docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    empty = F.forall(parts, _blank)
    text = F.when(empty, F.col("text")).otherwise(F.array_join(left, "\n"))
    done = joined.withColumn("_text", text).filter(empty | ~F.forall(left, _blank))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("_text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(empty, F.col(c)).otherwise(F.length("_text").cast(docs.schema[c].dataType)).alias(c))
        else:
            columns.append(F.col(f"`{c}`"))
    return bring_back(done.select(*columns), names)
