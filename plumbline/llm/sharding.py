"""Sharding by balanced label propagation.

Documents that share a key are linked. Every document starts in a shard by its hash. In each
round the shards of a key's members are counted, the key votes for the shard that most of
them are in, and its members move there as far as the shards' quotas allow. A key with more
members than fit votes for as many shards as it needs. At the end, shards that are too full
give documents without links, and only then linked ones, to those with room, until the
counts differ by one at most. Counts are grouped before they are shuffled, so a key that a
third of all rows have costs one row per shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch

SHARDS = 40
ROUNDS = 8
#: Rows that are numbered together in one window.
RUN = 4096


def _lookup(values: list, at: Column) -> Column:
    """``values[at]`` as a column; the list has one entry per shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), at + 1)


def _dice(*columns: Column | str) -> Column:
    """A number from 0 to 1 that depends on the columns alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / F.lit(1_000_003.0)


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def _sizes(df: DataFrame, shards: int) -> list[int]:
    found = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def _votes(links: DataFrame, placed: DataFrame, room: int, full: list[bool], scratch: Scratch) -> DataFrame:
    """The shard that each linked node is drawn to, its present one first among equals.

    A key that is not yet in one shard prefers those that are not full.
    """
    here = links.join(placed, "node")
    counts = here.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
    # Ties go by a hash of key and shard, so that all members of a key agree.
    found = F.collect_list(F.struct("n", F.xxhash64("key", "shard").alias("tie"), "shard"))
    targets = counts.groupBy("key").agg(found.alias("all"), F.sum("n").alias("members"))

    def rank(s: Column) -> Column:
        fits = (s["n"] == F.col("members")) | ~_lookup(full, s["shard"])
        return F.struct(fits.alias("fits"), s["n"].alias("n"), s["tie"].alias("tie"), s["shard"].alias("shard"))

    targets = targets.withColumn("all", F.reverse(F.array_sort(F.transform("all", rank))))
    need = F.least(F.ceil(F.col("members") / F.lit(room)).cast("int"), F.size("all"))
    # Written before the join, so that both of its sides are plain shuffles and a large key can be split.
    targets = scratch.keep(targets.select("key", F.slice("all", 1, need).alias("targets")))
    choice = F.pmod(F.xxhash64("node", "key"), F.size("targets")).cast("int")
    own = F.filter("targets", lambda t: t["shard"] == F.col("shard"))
    voted = here.join(targets, "key").select(
        "node", "shard", "key", F.when(F.size(own) > 0, F.element_at(own, 1)).otherwise(F.get("targets", choice)).alias("t"),
        (F.size("targets") > 1).alias("large"),
    )
    by_shard = voted.groupBy("node", "shard", F.col("t.shard").alias("to")).agg(
        F.sum("t.n").alias("weight"), F.min("key").alias("key"), F.max("large").alias("large")
    )
    best = F.max_by(F.struct("to", "key", "large"), F.struct("weight", F.col("to") == F.col("shard"), -F.col("to")))
    return by_shard.groupBy("node", "shard").agg(best.alias("b")).select("node", "shard", "b.to", "b.key", "b.large")


def propagate(links: DataFrame, rows: int, shards: int, rounds: int, scratch: Scratch) -> DataFrame:
    """Shards of the linked nodes after the moves. ``rows``: of all nodes, linked or not.

    Linked nodes may fill a shard's whole share, since nodes without links give way to them later.
    """
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    placed = scratch.keep(links.select("node").distinct().withColumn("shard", start))
    held = _sizes(placed, shards)
    share = rows // shards
    room = max(1, share // 2)
    for number in range(rounds):
        votes = scratch.keep(_votes(links, placed, room, [h >= share for h in held], scratch))
        flow = votes.filter("to <> shard").groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()
        if not flow:
            scratch.drop(votes)
            break
        into, out = [0] * shards, [0] * shards
        for r in flow:
            into[r["to"]] += r["n"]
            out[r["shard"]] += r["n"]
        # Quota of a shard: its free room and what leaves it, shared among all who want to come.
        accept = [min(1.0, max(0.0, (share - h + o) / i)) if i else 0.0 for h, o, i in zip(held, out, into)]
        dice = F.when(F.col("large"), _dice("node", F.lit(number))).otherwise(_dice("key", "shard", F.lit(number)))
        moves = (F.col("to") != F.col("shard")) & (dice < _lookup(accept, F.col("to")))
        before = placed
        placed = scratch.keep(votes.select("node", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")))
        scratch.drop(votes, before)
        held = _sizes(placed, shards)
    return placed


def _numbered(df: DataFrame, runs: int, order: list[str], name: str) -> DataFrame:
    """Number the rows of each shard from 0, by ``order``, then so that the rows of a ``group`` follow each other.

    A shard is cut into runs by hashes of groups; rows are numbered within a run, and runs by sums of their sizes.
    """
    cut = df.withColumn("run", F.pmod(F.xxhash64("group"), F.lit(runs)))
    keys = ["shard", *order, "run"]
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy(*order, "run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("group", "node")) - 1
    return cut.withColumn("at", within).join(starts, keys).withColumn(name, F.col("before") + F.col("at")).drop("run", "at", "before")


def level(nodes: DataFrame, shards: int, runs: int) -> DataFrame:
    """Move as few nodes as needed from full shards, those without links first, until counts are even.

    Rows of ``nodes``: node, shard, linked, group. Nodes of a group are moved one after the other.
    """
    sizes = _sizes(nodes, shards)
    wanted = quotas(sum(sizes), shards)
    # The shards with most rows get the larger quotas, which saves moves.
    largest = sorted(range(shards), key=lambda i: -sizes[i])
    quota = [0] * shards
    for i, q in zip(largest, sorted(wanted, reverse=True)):
        quota[i] = q
    excess = [max(0, s - q) for s, q in zip(sizes, quota)]
    if not any(excess):
        return nodes.select("node", "shard", "group")
    before = [sum(excess[:i]) for i in range(shards)]
    ends, total = [], 0
    for s, q in zip(sizes, quota):
        total += max(0, q - s)
        ends.append(total)
    full = nodes.filter(_lookup(excess, F.col("shard")) > 0)
    ranked = _numbered(full, runs, ["linked"], "rank").filter(F.col("rank") < _lookup(excess, F.col("shard")))
    number = _lookup(before, F.col("shard")) + F.col("rank")
    ends_column = F.array(*[F.lit(e) for e in ends])
    to = F.size(F.filter(ends_column, lambda e: e <= number)).cast("int")
    moved = ranked.select("node", to.alias("to"))
    return nodes.join(moved, "node", "left").select("node", F.coalesce("to", "shard").alias("shard"), "group")


def _grouped(links: DataFrame, scratch: Scratch) -> DataFrame:
    """A ``group`` per linked node: one of its keys, or itself where its keys have too many members for one run."""
    small = scratch.keep(links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RUN).select("key"))
    named = links.join(small, "key").groupBy("node").agg(F.min(F.xxhash64("key")).alias("group"))
    every = links.select("node").distinct().join(named, "node", "left")
    return every.select("node", F.coalesce("group", F.xxhash64("node")).alias("group"))


def shard(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard and slot of every node; counts of shards differ by one at most.

    ``nodes`` has a unique ``node`` (long), ``links`` has (``node``, ``key``): nodes of a key
    are linked. Slots number the rows of a shard from 0. An empty table gives no rows.
    """
    scratch = Scratch(nodes.sparkSession, "sharding")
    links = scratch.keep(links.select("node", "key").distinct())
    alone = nodes.select("node").join(links.select("node").distinct(), "node", "left_anti")
    alone = scratch.keep(alone.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")))
    rows = nodes.count()
    placed = propagate(links, rows, shards, rounds, scratch)
    every = alone.withColumns({"linked": F.lit(0), "group": F.xxhash64("node")})
    every = every.unionByName(placed.withColumn("linked", F.lit(1)).join(_grouped(links, scratch), "node"))
    runs = max(1, math.ceil(rows / shards / RUN))
    even = scratch.keep(level(every, shards, runs))
    return _numbered(even, runs, [], "slot").select("node", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Documents in shards of even counts, equal texts together as far as counts allow.

    Null texts have no bytes and are equal to empty ones. Rows that repeat a ``doc_id`` are
    documents of their own. ``size`` is the text's bytes and 16 more.
    """
    scratch = Scratch(docs.sparkSession, "sharding_documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = scratch.keep(
        docs.select(
            F.monotonically_increasing_id().alias("node"),
            "doc_id",
            (F.octet_length(text) + 16).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"),
        )
    )
    several = scratch.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    placed = shard(rows.select("node"), rows.select("node", "key").join(several, "key"), shards, rounds)
    return rows.join(placed, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
