"""Near duplicates: banded MinHash candidates, judged by odd sketches, confirmed on full sets.

A document's set is its distinct 5-word shingles. ``SAMPLES`` MinHash values of the set are
grouped into bands, and documents that agree in a band share a bucket. The samples are also
folded into a bitmap in which each flips one bit: the bits that differ between two bitmaps tell
how many samples differ, which estimates high similarities well. Pairs with a fair estimate are
confirmed by the size of the intersection of the full sets.

Documents with equal sets are one node from the start, so copies cost one row each. In a
bucket every node is first compared with a few hubs, the first of which is the node that most
others share bands with: in a large group of near copies that is what they are copies of, and
the group is linked without spelling out its pairs. What hubs have not linked is then met by the
rarest shingles of the full sets: two sets that are similar enough share one of their first few, in an order
that puts rare ones first, at places that leave room for the rest of what they must share. Only
nodes that are not connected yet meet, so no pair that could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, record_batches, rows_of, texts
from plumbline.llm.shingles import mix, shingle_set

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
#: The first samples make the bands, all of them the sketch.
SAMPLES = 256
BITS = 512
#: Pairs whose sketches estimate less than this are not confirmed: more than four deviations below the bound.
LEAST_ESTIMATE = 0.6
#: Rounds in which each bucket's nodes meet one hub.
HUBS = 2
#: Bits of the bitmap that keeps other texts out of the shuffle: 16 a node, and never more than these (32 MB).
MOST_MARKS = 1 << 28
#: Bits of one row of the bitmap, as Spark's own bitmap functions cut it.
_ROW_BITS = 32768
#: Rows of one shingle on the smaller side of a meeting that go to one task; more are dealt to several.
DEAL = 4096

_ODD = np.random.default_rng(90210).integers(0, 2**63, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def samples(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    step = max(1, 65536 // SAMPLES)
    low = None
    for i in range(0, len(found), step):
        part = np.multiply.outer(_ODD, found[i : i + step]).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for row in low[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + row)
    return h.astype(np.int64)


def sketch(low: np.ndarray) -> bytes:
    """Parities of the bits that the samples fall on."""
    at = mix(low + np.arange(len(low), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits; 0 where more than half of them differ."""
    rest = 1 - 2 * np.asarray(differing, dtype=float) / BITS
    return np.where(rest > 0, 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(rest, 1e-9)), 0.0)


#: Bits that may differ for the estimate to be fair.
MOST_BITS = int(np.flatnonzero(estimate(np.arange(BITS // 2)) >= LEAST_ESTIMATE).max())


def _signatures(docs: DataFrame) -> DataFrame:
    """Per document: size and digest of its set, bands and sketch; no bands for an empty set."""
    ddl = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "n_shingles", "d1", "d2")] + [("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                s = shingle_set(text, SHINGLE)
                if not len(s):
                    yield doc_id, 0, 0, 0, None, None
                    continue
                low = samples(s)
                d1, d2 = (int(mix(s + np.uint64(k)).sum().astype(np.int64)) for k in (1, 2))
                yield doc_id, len(s), d1, d2, bands(low), sketch(low)

        yield from record_batches(found(), schema, 1024)

    return texts(docs).mapInArrow(run, ddl)


def _marked(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The documents whose number may be a node's: by a bitmap of bounded size, no node is left out."""
    bits = _ROW_BITS
    while bits < min(16 * nodes.count(), MOST_MARKS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    row, at = F.floor(F.col("p") / _ROW_BITS).alias("row"), F.pmod("p", F.lit(_ROW_BITS))
    marks = nodes.select(place("node").alias("p")).select(row, F.bitmap_bit_position(at + 1).alias("bit"))
    marks = marks.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("marks"))
    byte = F.conv(F.hex(F.substring("marks", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = docs.withColumn("p", place("doc_id")).withColumn("row", row).join(F.broadcast(marks), "row")
    return met.filter(F.getbit(byte, F.pmod("p", F.lit(8)).cast("int")) == 1).select("doc_id", "text")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The full sets of the given documents, as sorted 64-bit hashes."""
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, shingle_set(t, SHINGLE).tobytes()) for i, t in rows_of(batches, "doc_id", "text"))
        yield from record_batches(rows, schema, 256)

    # An inner join, as nodes are distinct: a semi join would be moved below the bitmap and shuffle every text.
    wanted = _marked(texts(docs), nodes).join(nodes.withColumnRenamed("node", "doc_id"), "doc_id")
    return wanted.mapInArrow(run, "node bigint, items binary")


def _fair(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sketches differ in few enough bits."""
    one = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    two = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    differing = sum((F.bit_count(F.get("x", i).bitwiseXOR(F.get("y", i))) for i in range(BITS // 64)), F.lit(0))
    return pairs.join(one, "a").join(two, "b").filter(differing <= MOST_BITS).select("a", "b")


def _words(sketch_: Column) -> Column:
    """A sketch as 64-bit words."""
    part = lambda i, n: F.conv(F.hex(F.substring(sketch_, i, n)), 16, 10).cast("bigint")
    return F.array(*[F.shiftleft(part(8 * i + 1, 4), 32).bitwiseOR(part(8 * i + 5, 4)) for i in range(BITS // 64)])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose full sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for a, b, x, y in rows_of(batches, "a", "b", "x", "y"):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    yield a, b

        yield from record_batches(found(), schema)

    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and the smallest node that it is connected with, for nodes with edges.

    Every node takes the smallest label around it, then the label of its label, until
    nothing changes; the number of rounds follows the logarithm of a chain's length.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct().filter("a <> b"))
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        around = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        new = scratch.keep(nearer.join(up, "label", "left").select("node", "old", F.least("label", "upper").alias("label")))
        moved = new.filter("label <> old").limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "label")
        if not moved:
            scratch.drop(both)
            return labels


def _relabel(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (``node``, ``label``) after joining the labels that edges connect."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    joined = edges.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    upper = components(joined, scratch).select(F.col("node").alias("label"), F.col("label").alias("upper"))
    return scratch.keep(labels.join(upper, "label", "left").select("node", F.coalesce("upper", "label").alias("label")))


def _pair(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def _hub_pairs(members: DataFrame, number: int) -> DataFrame:
    """Each node of a bucket with the bucket's hub of this round, where they are not connected."""
    order = -F.col("shared") if number == 0 else F.xxhash64("node", F.lit(number))
    hubs = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "label")).alias("h"))
    met = members.join(hubs, "key").filter("label <> h.label")
    return met.select(*_pair("node", "h.node")).distinct()


def _items(sets: DataFrame) -> DataFrame:
    """``item`` and ``node`` for every shingle of every set."""
    schema = pa.schema([("item", pa.int64()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, items in rows_of(batches, "node", "items"):
            found = np.frombuffer(items, np.int64)
            for i in range(0, len(found), 65536):
                part = found[i : i + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), node))], schema=schema)

    return sets.mapInArrow(run, "item bigint, node bigint")


def _places(sets: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The shingles by which a node can meet others: ``item``, ``node``, ``label``, ``size``, ``at`` and ``held``.

    Two sets of sizes x >= y with a similarity of 3/4 share 3/7 of x + y, so 3/4 of x and 6/7 of
    y: what they share begins within the first x - 3x/4 + 1 shingles of the one and the first
    y - 6y/7 + 1 of the other, in any order common to all. Rare ones come first here, and those that
    no other node has stand before all others without being listed. ``held`` marks the shorter beginning.
    """
    items = scratch.keep(_items(sets))
    seen = items.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = items.join(seen, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("found"))
    found = found.join(nodes, "node").withColumn("own", F.col("size") - F.size("found"))
    long, short = (F.expr(f"size - (({t} * size + {of - 1}) div {of}) + 1") for t, of in ((3, 4), (6, 7)))
    first = F.slice("found", 1, F.greatest(long - F.col("own"), F.lit(0)).cast("int"))
    placed = found.select("node", "label", "size", "own", short.alias("short"), F.posexplode(first).alias("i", "f"))
    at = (F.col("own") + F.col("i")).alias("at")
    return placed.select(F.col("f.item").alias("item"), "node", "label", "size", at, (F.col("own") + F.col("i") < F.col("short")).alias("held"))


def _rare_pairs(places: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs of nodes that are not connected and may be similar enough by the places of a shingle they share.

    Most nodes of a frequent shingle are connected with each other: they meet only those that are not, which
    are dealt to several tasks where they are many.
    """
    per_label = places.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    most = F.max(F.struct("c", "label")).alias("most")
    per_item = per_label.groupBy("item").agg(most, F.count(F.lit(1)).alias("labels"), F.sum("c").alias("n")).filter("labels > 1")
    tasks = F.ceil((F.col("n") - F.col("most.c")) / F.lit(DEAL)).cast("int").alias("tasks")
    met = scratch.keep(places.join(per_item.select("item", F.col("most.label").alias("main"), tasks), "item"))
    others = met.filter("label <> main").withColumn("task", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int"))
    every = met.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    x, y = others.alias("x"), every.alias("y")
    c = lambda name: F.col(name)
    # The smaller set, by size and number, meets by its shorter beginning.
    smaller = F.struct("x.size", "x.node") < F.struct("y.size", "y.node")
    sizes = 4 * F.least("x.size", "y.size") >= 3 * F.greatest("x.size", "y.size")
    room = 7 * F.least(c("x.size") - c("x.at"), c("y.size") - c("y.at")) >= 3 * (c("x.size") + c("y.size"))
    # Two others meet twice; once is enough.
    once = (c("y.label") == c("y.main")) | (c("x.node") < c("y.node"))
    alike = (c("x.label") != c("y.label")) & sizes & room & once & F.when(smaller, c("x.held")).otherwise(c("y.held"))
    same = (c("x.item") == c("y.item")) & (c("x.task") == c("y.task"))
    return x.join(y, same & alike).select(*_pair("x.node", "y.node")).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document.

    ``component_id`` is the smallest ``doc_id`` that links lead to. Null and empty texts and
    texts without words link with nothing. Rows with a null ``doc_id`` are their own component,
    without a number, and stay. Rows that repeat a ``doc_id`` have the component of
    their own text each. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "near_dedup")
    found = scratch.keep(_signatures(docs))
    linkable = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["n_shingles", "d1", "d2"]
    # Equal sets are one node, named by their smallest document.
    nodes = scratch.keep(
        linkable.groupBy(*digest).agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    filed = nodes.select(F.explode("bands").alias("key"), "node")
    # Keys are written before the join, so that both of its sides are plain shuffles and a large bucket can be split.
    sizes = F.count(F.lit(1)).alias("n")
    shared = filed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), sizes).filter("x <> y").select("key", "n")
    filed = scratch.keep(filed.join(scratch.keep(shared), "key"))
    # ``shared``: with how many nodes a node shares bands, counted by band.
    members_of = filed.groupBy("node").agg(F.sum("n").alias("shared"))
    filed = filed.select("key", "node")
    sketches = nodes.select("node", F.col("n_shingles").alias("size"), _words(F.col("sketch")).alias("sketch")).dropDuplicates(["node"])
    sketches = scratch.keep(sketches.join(members_of, "node"))
    sets = scratch.keep(_sets(docs, sketches.select("node")))
    labels = scratch.keep(sketches.select("node", F.col("node").alias("label")))

    def link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        edges = scratch.keep(_confirmed(_fair(pairs, sketches), sets))
        return _relabel(labels, edges, scratch) if edges.limit(1).count() else labels

    for number in range(HUBS):
        members = scratch.keep(filed.join(labels, "node").join(sketches.select("node", "shared"), "node"))
        labels = link(_hub_pairs(members, number), sets)
        # Buckets whose nodes are all connected have nothing more to give.
        spread = filed.join(labels, "node").groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
        before, filed = filed, scratch.keep(filed.join(spread.filter("x <> y").select("key"), "key"))
        scratch.drop(before, members)
        if number == 0:  # most nodes are done: later rounds carry the sets of the others alone
            every, sets = sets, scratch.keep(sets.join(filed.select("node").distinct(), "node", "left_semi"))
            scratch.drop(every)
    left = filed.select("node").distinct()
    open_nodes = labels.join(sketches.select("node", "size"), "node").join(left, "node", "left_semi")
    places = scratch.keep(_places(sets.join(left, "node", "left_semi"), open_nodes, scratch))
    labels = link(_rare_pairs(places, scratch), sets)
    scratch.drop(filed, sets, places)
    named = nodes.select(*digest, "node").join(labels, "node", "left")
    named = named.select(*digest, F.coalesce("label", "node").alias("component"))
    rows = found.select("doc_id", *digest).join(named, digest, "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNull(), None).otherwise(F.col("component")))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all columns.

    Rows that repeat a ``doc_id`` stay or go together: they go if each of them has a smaller
    document in its group, so no text is lost. Null ids, null and empty texts stay.
    """
    gone = groups(docs).groupBy("doc_id").agg(F.max("kept").alias("stays")).filter("NOT stays").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
